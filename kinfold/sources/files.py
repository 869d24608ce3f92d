"""Annotation, cluster, label, size and split-count files, and cluster folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import ids
from kinfold.operators.ordering import with_position
from kinfold.session import TASK_ROWS, checkpoint, parts_for

# The suffixes of cluster files and of sequence files, and the heading lines of the report files.
CLUSTER_SUFFIXES = ("faa", "aln")
FASTA_SUFFIXES = ("fasta", "fa")
SPLIT_HEADER = ("ec4_term", "split_count")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> list[tuple[str, str]]:
    """(name, path) of the files directly in ``folder`` with one of the suffixes: suffix by suffix, sorted."""
    path, fs = _hadoop_path(spark, folder)
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(path) if s.isFile()]
    return [f for suffix in suffixes for f in sorted(f for f in found if f[0].endswith("." + suffix))]


def resolve_fasta(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """Dataset name (file stem) to path for a file, a list of files or a folder; a later stem wins."""
    out: dict[str, str] = {}
    for one in [path] if isinstance(path, str) else path:
        p, fs = _hadoop_path(spark, one)
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).isDirectory():
            found = list_files(spark, one, FASTA_SUFFIXES)
        else:
            found = [(p.getName(), p.toString())]
        out.update({name.rsplit(".", 1)[0]: full for name, full in found})
    return out


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(accession, term), a set. Exactly two comma-separated fields per line, else the read fails; no header."""
    line = ids.strip(F.col("value"))
    parts = spark.read.text(path).select(F.split(line, ",", -1).alias("p"))
    checked = parts.withColumn("ok", F.assert_true(F.size("p") == 2, F.concat(F.lit("expected 2 fields: "), F.array_join("p", ","))))
    return checked.where(F.col("ok").isNull()).select(F.col("p")[0].alias("accession"), F.col("p")[1].alias("term")).dropDuplicates()


def read_cluster_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(rep, member), a multimap: lines with fewer than two fields are skipped, further fields ignored."""
    parts = spark.read.text(path).select(F.split(ids.strip(F.col("value")), "\t", -1).alias("p"))
    return parts.where(F.size("p") >= 2).select(F.col("p")[0].alias("rep"), F.col("p")[1].alias("member"))


def read_label_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(pos, seq_id, family) in line order; blank and one-field lines are skipped."""
    lines = spark.read.text(path).select(
        F.split(ids.strip(F.col("value")), "\t", -1).alias("p"),
        F.col("_metadata.file_path").alias("_src"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = lines.where(F.size("p") >= 2).select("_src", "_block", "_row", F.col("p")[0].alias("seq_id"), F.col("p")[1].alias("family"))
    return with_position(rows, ["_src", "_block", "_row"]).select("pos", "seq_id", "family")


def read_cluster_folder(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(cluster, accession) of the header lines of all cluster files in a folder.

    Every file is a cluster, also an empty one, which yields one row without accession: text readers skip files of
    length zero, so the names come from the folder listing. Folders of ``write_families`` are read in both of its
    layouts. A folder without any cluster fails.
    """
    path, fs = _hadoop_path(spark, folder)
    inside = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    if any(n.endswith(".parquet") for n in inside):
        members = spark.read.parquet(folder).select(F.col("cluster_file").alias("cluster"), F.concat(F.lit(">"), "member").alias("value"))
        return members.select("cluster", ids.accession(F.col("value"), strict).alias("accession"), F.lit(True).alias("is_member"))
    if any(n.startswith("cluster_file=") for n in inside):
        members = spark.read.text(folder).where(F.startswith("value", F.lit(">")))
        return members.select(F.col("cluster_file").cast("string").alias("cluster"), ids.accession(F.col("value"), strict).alias("accession"), F.lit(True).alias("is_member"))
    glob = "*.{" + ",".join(CLUSTER_SUFFIXES) + "}"
    if not any(n.endswith(tuple("." + x for x in CLUSTER_SUFFIXES)) for n in inside):
        raise ValueError(f"{folder} holds no cluster")
    # one name per file, as many as Spark's own file index holds on the driver; large results belong in the one-table layout
    names = spark.createDataFrame([(n,) for n in inside if n.endswith(tuple("." + x for x in CLUSTER_SUFFIXES))], "cluster string")
    lines = spark.read.option("pathGlobFilter", glob).text(folder).select(F.col("_metadata.file_name").alias("cluster"), "value")
    headers = lines.where(F.startswith("value", F.lit(">")))
    members = headers.select(F.expr("url_decode(replace(cluster, '+', '%2B'))").alias("cluster"), ids.accession(F.col("value"), strict).alias("accession"), F.lit(True).alias("is_member"))
    return names.join(members, "cluster", "left")


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster, size) per cluster file of a folder, 0 for empty ones."""
    return read_cluster_folder(spark, folder).groupBy("cluster").agg(F.count("is_member").alias("size"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, size) from a size report: its first two lines, the count and the heading, are dropped by their place.
    A row of other than two fields, or with a size that is no whole number, fails the read."""
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("at")
    )
    second = lines.select("at").orderBy("at").limit(2).agg(F.max("at").alias("at"))  # one row
    rows = lines.where(F.col("at") > second.select("at").scalar())
    parts = rows.select("value", F.split("value", "\t", -1).alias("p"))
    good = F.assert_true((F.size("p") == 2) & F.col("p")[1].rlike("^\\d+$"), F.concat(F.lit("not a size row: "), "value"))
    return parts.withColumn("ok", good).where(F.col("ok").isNull()).select(F.col("p")[0].alias("cluster"), F.col("p")[1].cast("bigint").alias("size"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(term, split_count) from a split-count file with a heading line."""
    return spark.read.csv(path, header=True, schema="term string, split_count long", enforceSchema=True)


def write_splits(splits: DataFrame, path: str) -> None:
    # one row per term, the size of the term domain
    named = splits.select(F.col("term").alias(SPLIT_HEADER[0]), F.col("split_count").alias(SPLIT_HEADER[1]))
    named.write.csv(path, header=True)


def write_sizes(sizes: DataFrame, path: str, heading: str = "family\tnum_sequences") -> None:
    """Size report: ``num_files`` line, heading line, then the rows by name, in as many part files as there are ranges."""
    n = sizes.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("num_files\t"), "n").alias("value"), F.lit(0).alias("o"), F.lit("").alias("k"))
    head = sizes.sparkSession.range(1).select(F.lit(heading).alias("value"), F.lit(1).alias("o"), F.lit("").alias("k"))
    rows = sizes.select(F.concat_ws("\t", "cluster", F.col("size").cast("string")).alias("value"), F.lit(2).alias("o"), F.col("cluster").alias("k"))
    n.unionByName(head).unionByName(rows).sort("o", "k").select("value").write.text(path)


def write_families(members: DataFrame, folder: str, text: bool = False, task_rows: int = TASK_ROWS) -> None:
    """Families as one Parquet table (cluster_file, pos, member), in few files and sorted by family; with ``text`` as text instead, one
    directory per family, a header and a placeholder residue per member.

    ``members`` is (cluster_id, pos, member). The folder is replaced as a whole. Rows are spread by (family, slice of
    positions) so that a hot family is written by several tasks, of about ``task_rows`` rows.
    """
    if not text:
        # written first: it is counted, sampled for its ranges, and sorted
        rows = checkpoint(members.select(ids.cluster_file(F.col("cluster_id")).alias("cluster_file"), "pos", "member"))
        rows.repartitionByRange(parts_for(rows.count(), task_rows), "cluster_file", "pos").sortWithinPartitions("cluster_file", "pos").write.mode("overwrite").parquet(folder)
        return
    out = members.select(
        ids.cluster_file(F.col("cluster_id")).alias("cluster_file"), "pos", F.concat(F.lit(">"), "member", F.lit("\nX")).alias("value")
    )
    slices = out.repartition("cluster_file", F.floor(F.col("pos") / (1 << 20)))
    slices.sortWithinPartitions("cluster_file", "pos").select("cluster_file", "value").write.mode("overwrite").partitionBy("cluster_file").text(folder)
