"""Queries of the readers and writers: tables are written as the files the pipeline exchanges, read back and compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import sequences as S
from kinfold.functions import vectors as V
from kinfold.operators import expand, fragment, labels, purity, sizes
from kinfold.plans import runs
from kinfold.plans.bindings import annotations, members, sequences, table, vectors
from kinfold.plans.catalog import CLEANED, EC, MAPPING, METRICS, _mapping, _purity, _sc, _summary, _tc, query, r6
from kinfold.session import checkpoint, scratch_dir
from kinfold.sources import fasta, files, store


def _place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sources_folder(spark, sf: str) -> str:
    """Documents as one sequence file per source."""
    path = _place(spark, "many")
    rows = sequences(spark, sf).withColumn("source", F.substring_index(F.substring("header", 2, 1 << 30), "/", 1))
    text = rows.repartition("source").sortWithinPartitions("source", "pos").select("source", F.concat_ws("\n", "header", "sequence").alias("value"))
    text.write.partitionBy("source").text(path)
    return path


@query("fasta_many_files", "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents")
def fasta_many_files(spark, sf):
    """Records of several files are numbered throughout, in the order of the paths."""
    records = fasta.read_fasta(spark, f"{_sources_folder(spark, sf)}/*")
    doc = F.regexp_extract("header", "/(\\d+)-", 1).cast("long").alias("doc_id")
    return records.select(doc, F.regexp_extract("src", "source=([^/]*)", 1).alias("source"), "pos")


@query(
    "datasets_by_file",
    f"""SELECT source AS dataset, count(*)::BIGINT AS n_records, sum(length({CLEANED}))::BIGINT AS n_residues FROM documents GROUP BY 1""",
)
def datasets_by_file(spark, sf):
    """A folder of sequence files, one per dataset: each record carries the name of its file."""
    folder, named = _sources_folder(spark, sf), _place(spark, "datasets")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(named))
    for source in (s.getPath() for s in fs.listStatus(at(folder)) if s.isDirectory()):  # one folder per dataset
        part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
        fs.rename(part, at(f"{named}/{source.getName().split('=', 1)[1]}.fasta"))
    records = fasta.read_datasets(spark, files.resolve_fasta(spark, named))
    length = F.length(S.clean(F.col("sequence"))).cast("long")
    return records.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_records"), F.sum(length).alias("n_residues"))


@query(
    "fasta_numbering",
    "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_positions, 0::BIGINT AS first_pos, count(*)::BIGINT - 1 AS last_pos FROM documents",
)
def fasta_numbering(spark, sf):
    path = _place(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf), path)
    return fasta.read_fasta(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("n_positions"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query(
    "fasta_headers",
    "SELECT source, count(*)::BIGINT AS n_headers FROM documents GROUP BY 1",
)
def fasta_headers(spark, sf):
    """Header lines per file, without reading sequences into records."""
    heads = fasta.read_headers(spark, f"{_sources_folder(spark, sf)}/*")
    return heads.groupBy(F.regexp_extract("src", "source=([^/]*)", 1).alias("source")).agg(F.count(F.lit(1)).alias("n_headers"))


@query(
    "fasta_ids",
    "SELECT concat(source, '/', doc_id, '-', n_chars) AS fasta_id, concat(source, '_', doc_id, '-', n_chars) AS export_key FROM documents",
)
def fasta_ids(spark, sf):
    path = _place(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf), path)
    return fasta.read_ids(spark, path).select("fasta_id", "export_key")


@query("annotation_file", f"WITH {EC} SELECT DISTINCT accession::VARCHAR AS accession, term FROM ec")
def annotation_file(spark, sf):
    path = _place(spark, "annotations")
    twice = annotations(spark, sf).select(F.concat_ws(",", "accession", "term").alias("value"))
    twice.union(twice).write.text(path)
    return files.read_annotations(spark, path)


@query("cluster_file_pairs", "SELECT l_orderkey::VARCHAR AS rep, l_partkey::VARCHAR AS member FROM lineitem WHERE l_linenumber % 3 > 0")
def cluster_file_pairs(spark, sf):
    """Members as tab-separated lines, some short (skipped) and some with further fields (ignored)."""
    path = _place(spark, "pairs")
    kind = F.col("l_linenumber") % 3
    line = F.when(kind == 0, F.col("l_orderkey").cast("string")).when(kind == 1, F.concat_ws("\t", "l_orderkey", "l_partkey"))
    table(spark, sf, "lineitem").select(line.otherwise(F.concat_ws("\t", "l_orderkey", "l_partkey", "l_shipdate")).alias("value")).write.text(path)
    return files.read_cluster_tsv(spark, path)


@query(
    "label_file",
    f"""WITH m AS ({MAPPING}), c AS (SELECT family, row_number() OVER (ORDER BY min(pos)) - 1 AS class_idx FROM m GROUP BY family),
    l AS (SELECT seq_id, arg_max(family, pos) AS family FROM m GROUP BY seq_id) SELECT seq_id::VARCHAR AS seq_id, family, class_idx FROM l JOIN c USING (family)""",
)
def label_file(spark, sf):
    """The label map read from lines in order, blank and one-field lines among them."""
    path = _place(spark, "labels")
    m = _mapping(spark, sf)
    line = F.concat_ws("\t", "seq_id", "family")
    lines = m.select("pos", F.explode(F.when(F.col("pos") % 10 == 0, F.array(F.lit(""), F.lit("alone"), line)).otherwise(F.array(line))).alias("value"))
    lines.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.text(path)
    return labels.label_map(files.read_label_tsv(spark, path))


@query("size_report_file", "SELECT l_suppkey::VARCHAR AS cluster, count(*)::BIGINT AS size FROM lineitem GROUP BY 1")
def size_report_file(spark, sf):
    path = _place(spark, "sizes")
    files.write_sizes(sizes.cluster_sizes(members(spark, sf, "l_suppkey").withColumn("cluster", F.col("cluster").cast("string"))), path)
    return files.read_sizes(spark, path)


@query("split_report_file", f"WITH {EC}, {_sc('sc', 'l_suppkey')} SELECT term, split_count FROM sc")
def split_report_file(spark, sf):
    path = _place(spark, "splits")
    files.write_splits(fragment.split_counts(purity.term_counts(members(spark, sf, "l_suppkey"), annotations(spark, sf))), path)
    return files.read_splits(spark, path)


@query(
    "store_put_twice",
    """SELECT p_partkey::VARCHAR AS key, round(p_retailprice::FLOAT::DOUBLE, 6) AS first_item FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey::VARCHAR, (p_size + 0.5)::DOUBLE FROM part WHERE p_partkey % 2 = 1""",
)
def store_put_twice(spark, sf):
    """What is stored stays: the second call adds only keys that the first had not."""
    path = _place(spark, "store")
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("pos"), "p_retailprice", "p_size")
    store.put_missing(part.where("pos % 2 = 0").withColumn("embedding", F.array(F.col("p_retailprice"))), path)
    store.put_missing(part.withColumn("embedding", F.array((F.col("p_size") + 0.5).cast("double"))), path)
    return store.read_store(spark, path).select("key", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_item"))


@query(
    "store_overwrite",
    """SELECT p_partkey::VARCHAR AS key, round((CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_size + 0.5 END)::FLOAT::DOUBLE, 6) AS first_item FROM part""",
)
def store_overwrite(spark, sf):
    """New rows take the place of stored ones, twice with the same result."""
    path = _place(spark, "store")
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("pos"), "p_retailprice", "p_size")
    store.put_missing(part.withColumn("embedding", F.array((F.col("p_size") + 0.5).cast("double"))), path)
    new = part.where("pos % 2 = 0").select("key", F.array(F.col("p_retailprice")).alias("embedding"))
    for _ in range(2):
        store.put_over(new, path)
    return store.read_store(spark, path).select("key", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_item"))


@query("store_replaced", "SELECT p_partkey::VARCHAR AS key, round(p_retailprice::FLOAT::DOUBLE, 6) AS first_item FROM part WHERE p_partkey % 2 = 0")
def store_replaced(spark, sf):
    """The whole store exchanged for rows derived from it; the version before stays readable until it is cleared away."""
    path = _place(spark, "store")
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("pos"), F.array("p_retailprice").alias("embedding"))
    store.put_missing(part, path)
    store.replace_store(store.read_store(spark, path).where(F.col("key").cast("long") % 2 == 0), path)
    store.vacuum(spark, path)
    return store.read_store(spark, path).select("key", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_item"))


def _stored_vectors(spark, sf: str) -> str:
    path = _place(spark, "store")
    store.put_missing(vectors(spark, sf).select(F.concat(F.lit("V_"), F.col("id").cast("string")).alias("key"), F.col("id").alias("pos"), "embedding"), path)
    return path


def _items(df: DataFrame, vec: str, *cols: str) -> DataFrame:
    """All items of the vectors, one to a row."""
    return df.select(*cols, F.posexplode(vec).alias("item", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(
    "vector_lookup_few",
    """SELECT o_custkey AS pos, e.vec_id IS NOT NULL AS found, i::INT AS item, round(e.embedding[i + 1]::DOUBLE, 6) AS value
    FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') o LEFT JOIN embeddings e ON e.vec_id = o.o_custkey
    JOIN range(64) t(i) ON e.vec_id IS NOT NULL OR i = 0""",
)
def vector_lookup_few(spark, sf):
    """Few keys looked up in a stored table: only the buckets that may hold them are read."""
    path = _stored_vectors(spark, sf)
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("pos")).distinct()
    hit, miss = store.lookup_stored(wanted.withColumn("key", F.concat(F.lit("V_"), F.col("pos").cast("string"))), path)
    whole = _items(hit, "embedding", "pos").select("pos", F.lit(True).alias("found"), "item", "value")
    return whole.unionByName(miss.select("pos", F.lit(False).alias("found"), F.lit(0).alias("item"), F.lit(None).cast("double").alias("value")))


@query(
    "export_whole_store",
    "SELECT 'V/' || vec_id AS label, i::INT AS item, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings CROSS JOIN range(64) t(i)",
)
def export_whole_store(spark, sf):
    """All of a store in the export layout, under the ids its keys stand for, and read back from it."""
    exported, _ = runs.export_file(spark, _stored_vectors(spark, sf))
    return _items(store.import_vectors(exported), "embedding", "label")


@query("store_meta", "SELECT source AS name, count(*)::VARCHAR AS value FROM documents GROUP BY 1")
def store_meta(spark, sf):
    """Run metadata is written once, unless it is to be replaced."""
    path = _place(spark, "store")
    counts = table(spark, sf, "documents").groupBy("source").count().orderBy("source")
    meta = {r.source: r["count"] for r in counts.collect()}  # one row per source
    store.write_meta(spark, path, dict.fromkeys(meta, "0"))
    store.write_meta(spark, path, meta, replace=True)
    store.write_meta(spark, path, {"ignored": "1"})
    return spark.read.parquet(f"{path}.meta")


# eleven significant bits, fewer below 2^-14, ties to even
@query(
    "half_precision",
    """WITH x AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    s AS (SELECT id, i, v, CASE WHEN v = 0 THEN 1 ELSE pow(2, greatest(floor(log2(abs(v))), -14) - 10) END AS step FROM x)
    SELECT id, i::INT AS item, round(round_even(v / step, 0) * step, 9) AS value FROM s""",
)
def half_precision(spark, sf):
    """Vectors packed as half-precision numbers and unpacked."""
    packed = vectors(spark, sf).select("id", V.encode_half(F.col("embedding")).alias("raw"))
    back = packed.select("id", F.posexplode(V.decode_half(F.col("raw"), 64)).alias("item", "value"))
    return back.withColumn("value", F.round(F.col("value").cast("double"), 9))


@query("store_keys", "SELECT p_partkey::VARCHAR AS key FROM part")
def store_keys(spark, sf):
    """Key-only scan; internal keys stay out."""
    path = _place(spark, "store")
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("pos"), F.array(F.lit(1.0)).alias("embedding"))
    store.put_missing(rows.union(rows.select(F.concat(F.lit("__"), "key"), "pos", "embedding")), path)
    return store.keys(spark, path)


@query(
    "export_in_file_order",
    """SELECT pos, label, i::INT AS item, round(embedding[i + 1]::DOUBLE, 6) AS value FROM (
      SELECT row_number() OVER (ORDER BY c_custkey, k) - 1 AS pos, 'V/' || (c_custkey % 700) AS label, e.vec_id, e.embedding
      FROM (SELECT c_custkey, unnest(range(2)) AS k FROM customer) c LEFT JOIN embeddings e ON e.vec_id = c.c_custkey % 700)
    CROSS JOIN range(64) t(i) WHERE vec_id IS NOT NULL""",
)
def export_in_file_order(spark, sf):
    """A list of ids, many repeated and some unknown, exported in its order."""
    path, lists = _stored_vectors(spark, sf), _place(spark, "list")
    lines = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(">V/"), (F.col("c_custkey") % 700).cast("string"), F.lit("\nX")).alias("value"))
    lines = lines.select("c_custkey", F.explode(F.array("value", "value")).alias("value"))
    lines.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(lists)
    exported, _ = runs.export_file(spark, path, lists)
    return _items(exported.withColumn("vec", F.element_at("mean_representations", store.EXPORT_LAYER)), "vec", "pos", "label")


FAMILIES = "(SELECT l_suppkey, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS k, l_partkey FROM lineitem)"


def _families_folder(spark, sf: str) -> str:
    """Families of suppliers, members named as the pipeline names them."""
    path = _place(spark, "families")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("rep"), F.col("l_suppkey").alias("label"), F.col("l_partkey"), F.col("l_suppkey").alias("pos"))
    fam = expand.families(rows.select("rep", "pos", "label").distinct())
    named = rows.select("rep", F.concat(F.col("l_partkey").cast("string"), F.lit("/1-9")).alias("member"))
    files.write_families(expand.expand_members(fam, named).select("cluster_id", "pos", "member"), path)
    return path


@query(
    "folder_sizes",
    f"SELECT printf('cluster_%05d.faa', k) AS cluster, count(*)::BIGINT AS size FROM {FAMILIES} GROUP BY 1",
)
def folder_sizes(spark, sf):
    return files.folder_sizes(spark, _families_folder(spark, sf))


@query("folder_purity", f"WITH {EC}, {_tc('l_suppkey')}, {_purity()} {_summary('SELECT count(DISTINCT l_suppkey) FROM lineitem')}")
def folder_purity(spark, sf):
    """Families written and scored from what was written."""
    ec = _place(spark, "annotations")
    annotations(spark, sf).select(F.concat_ws(",", "accession", "term").alias("value")).write.text(ec)
    return runs.purity_report(spark, ec, _families_folder(spark, sf)).select(*r6(*METRICS))


@query(
    "fragmentation_report",
    f"""WITH {EC}, {_tc('l_suppkey')}, {_purity()}, {_sc('sc', 'l_suppkey')}, s AS ({_summary('SELECT count(DISTINCT l_suppkey) FROM lineitem')}),
    f AS (SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem)::BIGINT AS total_clusters, count(*)::BIGINT AS total_ec4_terms,
    median(split_count)::DOUBLE AS median_split_count, round(100.0 * count(*) FILTER (split_count = 1) / count(*), 6) AS pct_terms_in_one_cluster FROM sc)
    SELECT * FROM s CROSS JOIN f""",
)
def fragmentation_report(spark, sf):
    """All fourteen metrics of one folder of families, as one row."""
    ec = _place(spark, "annotations")
    annotations(spark, sf).select(F.concat_ws(",", "accession", "term").alias("value")).write.text(ec)
    pure, split = runs.fragmentation_report(spark, ec, _families_folder(spark, sf))
    split = checkpoint(split.withColumn("pct_terms_in_one_cluster", F.round("pct_terms_in_one_cluster", 6)))
    # two one-row tables
    return pure.select(*r6(*METRICS), *[split.select(c).scalar().alias(c) for c in split.columns])


LABELLED = f"""m AS ({MAPPING}), c AS (SELECT family, row_number() OVER (ORDER BY min(pos)) - 1 AS class_idx FROM m GROUP BY family),
    l AS (SELECT seq_id, arg_max(family, pos) AS family FROM m GROUP BY seq_id),
    j AS (SELECT o_orderkey AS pos, o_custkey AS seq_id, class_idx, e.vec_id, e.embedding FROM orders LEFT JOIN l ON l.seq_id = o_custkey LEFT JOIN c USING (family)
      LEFT JOIN embeddings e ON e.vec_id = o_custkey)"""


def _labelled(spark, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("seq_id"))
    known = wanted.join(labels.label_map(_mapping(spark, sf)).select("seq_id", "class_idx"), "seq_id", "left")
    return known.join(vectors(spark, sf).select(F.col("id").alias("seq_id"), "embedding"), "seq_id", "left")


@query(
    "labelled_vectors",
    f"""WITH {LABELLED} SELECT pos, class_idx, i::INT AS item, round(embedding[i + 1]::DOUBLE, 6) AS value FROM j CROSS JOIN range(64) t(i)
    WHERE class_idx IS NOT NULL AND vec_id IS NOT NULL""",
)
def labelled_vectors(spark, sf):
    """Sequence list x label map x store: rows with a label and a vector, written in one pass that also counts what is missing."""
    rows, _ = labels.write_complete(_labelled(spark, sf), {"label": F.col("class_idx"), "vector": F.col("embedding")}, _place(spark, "labelled"), most_missing=None)
    return _items(rows, "embedding", "pos", "class_idx")


@query(
    "labelled_missing",
    f"""WITH {LABELLED}, w AS (SELECT 'label' AS what, pos, seq_id, class_idx IS NULL AS missing FROM j UNION ALL SELECT 'vector', pos, seq_id, vec_id IS NULL FROM j)
    SELECT what, count(*)::BIGINT AS n_total, count(*) FILTER (missing)::BIGINT AS n_missing, count(*) FILTER (missing) > 0.1 * count(*) FILTER (NOT missing) AS warn,
      coalesce(array_to_string((list(seq_id ORDER BY pos) FILTER (missing))[1:5], ','), '') AS first_missing FROM w GROUP BY what""",
)
def labelled_missing(spark, sf):
    """The report of that pass: what has no label and what no vector, and the first five of each."""
    _, report = labels.write_complete(_labelled(spark, sf), {"label": F.col("class_idx"), "vector": F.col("embedding")}, _place(spark, "labelled"), most_missing=None, id_col="seq_id")
    return report
