"""End-to-end runs on files: the command-line entry points as functions, with the published defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import sequences as S
from kinfold.functions.ids import member_accession
from kinfold.operators import batching, curate, density, embed, expand, fragment, purity, sizes
from kinfold.operators.head import Head, project
from kinfold.operators.ordering import with_position
from kinfold.session import checkpoint, ship_package
from kinfold.sources import fasta, files, store

# Batch limits of the two embedder families.
LIMITS = {
    "esm": {"max_residues": 12000, "max_seq_len": 1022, "max_batch": 256, "bucket_size": 10000},
    "t5": {"max_residues": 4000, "max_seq_len": 1000, "max_batch": 100},
}


def split_file(spark: SparkSession, path: str, out_dir: str, val_size: float = 0.05, seed: int = 42) -> DataFrame:
    """Write ``train`` and ``val`` sequence folders of exact sizes; returns (split, n)."""
    ship_package(spark)
    tagged = checkpoint(curate.exact_split(fasta.read_fasta(spark, path), "pos", val_size, seed=seed))
    for part in ("train", "val"):
        fasta.write_fasta(tagged.where(F.col("split") == part), f"{out_dir}/{part}.fasta")
    return tagged.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def embed_file(
    spark: SparkSession,
    path: str,
    store_path: str,
    family: str = "esm",
    factory=embed.CodePointEmbedder,
    split_char: str = "!",
    id_field: int = 0,
    is_3di: bool = False,
    overwrite: bool = False,
    **limits: int,
) -> DataFrame:
    """Embed the sequences of a file that the store lacks and append them; returns one row of run counters.

    ``esm`` drops empty and overlong sequences, batches by falling length inside buckets and halves failing batches;
    ``t5`` keeps all of them, batches in file order and gives failing batches up. Of records with one key the first counts, and
    nothing stored is embedded again; with ``overwrite`` the last counts and takes the place of what is stored.
    """
    ship_package(spark)
    wins = curate.last_wins if overwrite else curate.first_wins
    cfg = {**LIMITS[family], **limits}
    raw = fasta.read_embedder_input(spark, path, split_char, id_field, is_3di)
    masked = raw.withColumn("sequence", S.mask_rare(F.col("sequence"), family)).withColumn("length", S.n_residues(F.col("sequence")))
    # counted while they are written
    seen, made = Observation(), Observation()
    of_family = F.lit(family == "esm")
    rows = checkpoint(masked.observe(
        seen,
        F.count(F.lit(1)).alias("n_seen"),
        F.count_if((F.col("length") == 0) & of_family).alias("n_empty"),
        F.count_if((F.col("length") > cfg["max_seq_len"]) & of_family).alias("n_long"),
    ))
    known = store.read_store(spark, store_path).select("key")
    if family == "esm":
        # buckets count surviving rows before the resume filter, as resumed runs must see the same buckets
        placed = batching.length_buckets(rows, cfg["bucket_size"], "pos", max_len=cfg["max_seq_len"])
        left = curate.pending(wins(placed.join(rows.select("pos", "key"), "pos"), "key", "pos"), known, overwrite=overwrite)
        batches = batching.bucket_batches(left, cfg["max_batch"], cfg["max_residues"], id_col="pos")
    else:
        left = curate.pending(wins(rows, "key", "pos"), known, overwrite=overwrite)
        batches = _file_order(left, cfg)
    embedded = embed.embed(batches.join(rows.select("pos", "key", "sequence"), "pos"), factory, "bisect" if family == "esm" else "drop")
    done = checkpoint(embedded.join(left.select("key", "pos"), "key").observe(made, *embed.stats()))
    good = done.where(F.col("status") == "embedded")
    if overwrite:
        store.put_over(good, store_path)
    else:
        store.put_missing(good, store_path)
    store.write_meta(spark, store_path, {"family": family, "per_protein": "true", "dtype": "float16"}, replace=family == "t5")
    return spark.createDataFrame([Row(**seen.get, **made.get)])


def _file_order(left: DataFrame, cfg: dict) -> DataFrame:
    slim = left.select(F.col("pos").alias("id"), "pos", "length")
    placed = batching.stream_batches(slim, ["pos"], cfg["max_batch"], cfg["max_residues"], cfg["max_seq_len"])
    return placed.select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("bucket"), "batch")


def export_file(spark: SparkSession, store_path: str, path: str | None = None, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exported vectors and ids without a vector.

    Without ``path`` the whole store is exported under the ids its keys stand for; with it the ids of a sequence file in
    file order (column ``pos``).
    """
    vectors = store.read_store(spark, store_path)
    if path is None:
        return store.export_store(vectors), vectors.where("false").select(F.col("key").alias("label"))
    wanted = fasta.read_ids(spark, path).select("pos", F.col("fasta_id").alias("label"), F.col("export_key").alias("key"))
    found, missing = store.lookup_stored(wanted, store_path)
    return store.export_vectors(found, unit=unit, keep=("pos",)), missing.select("pos", "label")


def project_file(spark: SparkSession, head: Head, store_path: str, path: str) -> DataFrame:
    """(pos, label, mean_representations): vectors of a sequence file's ids through a trained head."""
    ship_package(spark)
    exported, _ = export_file(spark, store_path, path)
    raw = store.import_vectors(exported).select(F.struct("pos", "label").alias("id"), "embedding")
    return store.export_vectors(project(raw, head).select("id.pos", "id.label", "embedding"), keep=("pos",))


def cluster_and_score(
    exported: DataFrame,
    cluster_tsv: DataFrame,
    annotations: DataFrame,
    min_samples: int = 2,
    metric: str = "euclidean",
    output_dir: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, size report, purity report) of the density families of exported vectors.

    ``exported`` is (label, mean_representations[, pos]); without ``pos`` the ids are taken in their own order.
    """
    ship_package(exported.sparkSession)
    reps = exported if "pos" in exported.columns else with_position(exported, ["label"])
    reps = checkpoint(store.import_vectors(reps))
    found = density.hdbscan(reps, "pos", "embedding", min_samples, metric)
    fam = expand.families(found.join(reps.select("pos", F.col("label").alias("rep")), "pos"))
    members = checkpoint(expand.expand_members(fam, cluster_tsv).select("cluster_id", "pos", "rep", "member"))
    if output_dir:
        files.write_families(members, output_dir)
    scored = members.select(F.col("cluster_id").alias("cluster"), member_accession(F.col("member")).alias("accession"))
    report = purity.purity_summary(scored, annotations)
    return members, sizes.size_summary(sizes.cluster_sizes(scored)), report


def purity_report(spark: SparkSession, ec_file: str, folder: str) -> DataFrame:
    return purity.purity_summary(files.read_cluster_folder(spark, folder), files.read_annotations(spark, ec_file))


def fragmentation_report(spark: SparkSession, ec_file: str, folder: str, output_csv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The purity report and the fragmentation summary; optionally writes the split counts."""
    members, ann = checkpoint(files.read_cluster_folder(spark, folder)), files.read_annotations(spark, ec_file)
    splits = checkpoint(fragment.split_counts(purity.term_counts(members, ann)))
    if output_csv:
        files.write_splits(splits, output_csv)
    return purity.purity_summary(members, ann), fragment.split_summary(splits, members)


def size_report(spark: SparkSession, folder: str, output: str | None = None) -> DataFrame:
    table = files.folder_sizes(spark, folder)
    if output:
        files.write_sizes(table, output)
    return table.orderBy("cluster")
