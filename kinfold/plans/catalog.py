"""One entry per operator: the Spark query and, where SQL can express it, an equivalent for an independent engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import ids
from kinfold.functions import sequences as S
from kinfold.functions import vectors as V
from kinfold.operators import batching, curate, density, embed, expand, fragment, head, labels, losses, mst, neighbors, purity, sizes, train
from kinfold.plans import density_sql
from kinfold.plans.bindings import EC_VIEW, annotations, lehmer, members, sequences, table, vectors
from kinfold.session import checkpoint, scratch_dir, ship_package
from kinfold.sources import fasta, store
from kinfold.streaming import batches as stream_batches
from kinfold.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


# ---------------------------------------------------------------- annotation purity

EC = f"ec AS ({EC_VIEW})"


def _tc(cluster: str) -> str:
    return f"""tc AS (SELECT l.{cluster} AS cluster, e.term, count(*)::BIGINT AS n
    FROM lineitem l JOIN ec e ON e.accession = l.l_partkey GROUP BY 1, 2)"""


def _purity(dotted: bool = False) -> str:
    match = "starts_with(t.term, p.parent)"
    if dotted:
        match = "(t.term = p.parent OR starts_with(t.term, p.parent || '.'))"
    return f"""par AS (SELECT DISTINCT cluster, regexp_replace(term, '\\.[^.]*$', '') AS parent FROM tc),
    cov AS (SELECT p.cluster, p.parent, sum(t.n) AS covered FROM par p JOIN tc t
            ON t.cluster = p.cluster AND {match} GROUP BY 1, 2),
    top3 AS (SELECT cluster, max(covered) AS c3 FROM cov GROUP BY 1),
    top4 AS (SELECT cluster, sum(n)::BIGINT AS n_occurrences, count(*)::BIGINT AS n_terms, max(n) AS c4 FROM tc GROUP BY 1),
    pur AS (SELECT a.cluster, n_occurrences, n_terms, c4::DOUBLE / n_occurrences AS ec4_purity,
            c3::DOUBLE / n_occurrences AS ec3_purity FROM top4 a JOIN top3 b ON a.cluster = b.cluster)"""


def _summary(total: str) -> str:
    return f"""SELECT round(100.0 * count(*) / ({total}), 6) AS pct_with_ec,
    round(100.0 * count(*) FILTER (ec4_purity > 0.8) / count(*), 6) AS pct_ec4_over_80,
    round(100.0 * count(*) FILTER (ec4_purity > 0.9) / count(*), 6) AS pct_ec4_over_90,
    round(100.0 * count(*) FILTER (ec4_purity = 1.0) / count(*), 6) AS pct_ec4_100,
    round(avg(ec4_purity), 6) AS avg_ec4_purity, round(avg(ec3_purity), 6) AS avg_ec3_purity,
    round(100.0 * count(*) FILTER (n_terms = 1) / count(*), 6) AS pct_1_ec,
    round(100.0 * count(*) FILTER (n_terms = 2) / count(*), 6) AS pct_2_ec,
    round(100.0 * count(*) FILTER (n_terms = 3) / count(*), 6) AS pct_3_ec,
    round(100.0 * count(*) FILTER (n_terms >= 4) / count(*), 6) AS pct_4_or_more_ec FROM pur"""


ORDERS_TOTAL = "SELECT count(DISTINCT l_orderkey) FROM lineitem"
PURITY_COLS = "SELECT cluster, n_occurrences, n_terms, round(ec4_purity, 6) AS ec4_purity, round(ec3_purity, 6) AS ec3_purity FROM pur"


@query("ec_term_counts", f"WITH {EC}, {_tc('l_orderkey')} SELECT cluster, term, n FROM tc")
def ec_term_counts(spark, sf):
    return purity.term_counts(members(spark, sf), annotations(spark, sf))


def _purity_rows(spark, sf, cluster, mode="raw"):
    p = purity.cluster_purity(members(spark, sf, cluster), annotations(spark, sf), mode)
    return p.select("cluster", "n_occurrences", "n_terms", *r6("ec4_purity", "ec3_purity"))


@query("cluster_purity", f"WITH {EC}, {_tc('l_orderkey')}, {_purity()} {PURITY_COLS}")
def cluster_purity(spark, sf):
    return _purity_rows(spark, sf, "l_orderkey")


@query("cluster_purity_large", f"WITH {EC}, {_tc('l_suppkey')}, {_purity()} {PURITY_COLS}")
def cluster_purity_large(spark, sf):
    return _purity_rows(spark, sf, "l_suppkey")


@query("cluster_purity_dotted", f"WITH {EC}, {_tc('l_orderkey')}, {_purity(dotted=True)} {PURITY_COLS}")
def cluster_purity_dotted(spark, sf):
    return _purity_rows(spark, sf, "l_orderkey", "dotted")


METRICS = [
    "pct_with_ec", "pct_ec4_over_80", "pct_ec4_over_90", "pct_ec4_100", "avg_ec4_purity", "avg_ec3_purity",
    "pct_1_ec", "pct_2_ec", "pct_3_ec", "pct_4_or_more_ec",
]


@query("cluster_purity_summary", f"WITH {EC}, {_tc('l_orderkey')}, {_purity()} {_summary(ORDERS_TOTAL)}")
def cluster_purity_summary(spark, sf):
    return purity.purity_summary(members(spark, sf), annotations(spark, sf)).select(*r6(*METRICS))


# families over all orders, also those without members and so without annotation
@query(
    "expanded_purity_summary",
    f"WITH {EC}, {_tc('l_orderkey')}, {_purity()} {_summary('SELECT count(*) FROM orders')}",
)
def expanded_purity_summary(spark, sf):
    def named(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    reps = table(spark, sf, "orders").select(named("o", "o_orderkey").alias("rep"))
    tsv = table(spark, sf, "lineitem").select(named("o", "l_orderkey").alias("rep"), named("p", "l_partkey").alias("member"))
    fam = expand.expand_members(reps, tsv).select(F.col("rep").alias("cluster"), F.col("member").alias("accession"))
    known = annotations(spark, sf).withColumn("accession", named("p", "accession"))
    return purity.purity_summary(checkpoint(fam), known).select(*r6(*METRICS))


FLAG_TC = """tc AS (SELECT l_orderkey AS cluster, concat_ws('.', l_returnflag, l_linestatus) AS term, count(*)::BIGINT AS n
    FROM lineitem GROUP BY 1, 2)"""


@query("flag_purity_summary", f"WITH {FLAG_TC}, {_purity()} {_summary(ORDERS_TOTAL)}")
def flag_purity_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("term"))
    counts = rows.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    return purity.summary(purity.purity_of_counts(counts)).select(*r6(*METRICS))


@query(
    "purity_report",
    f"WITH {EC}, {_tc('l_suppkey')}, {_purity()}, s AS ({_summary('SELECT count(DISTINCT l_suppkey) FROM lineitem')}) UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value",
)
def purity_report(spark, sf):
    s = purity.purity_summary(members(spark, sf, "l_suppkey"), annotations(spark, sf)).select(*r6(*METRICS))
    return purity.long_form(s)


@query(
    "top_terms",
    f"WITH {EC}, {_tc('l_orderkey')} SELECT cluster, term, n FROM tc QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) = 1",
)
def top_terms(spark, sf):
    return purity.top_terms(ec_term_counts(spark, sf))


# ---------------------------------------------------------------- fragmentation and comparison


def _splits(spark, sf, cluster):
    return fragment.split_counts(purity.term_counts(members(spark, sf, cluster), annotations(spark, sf)))


def _sc(name: str, cluster: str) -> str:
    return f"""{name} AS (SELECT e.term, count(DISTINCT l.{cluster})::BIGINT AS split_count
    FROM lineitem l JOIN ec e ON e.accession = l.l_partkey GROUP BY 1)"""


@query("ec_split_counts", f"WITH {EC}, {_sc('sc', 'l_orderkey')} SELECT term, split_count FROM sc")
def ec_split_counts(spark, sf):
    return _splits(spark, sf, "l_orderkey")


@query(
    "ec_split_summary",
    f"""WITH {EC}, {_sc('sc', 'l_suppkey')} SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem)::BIGINT AS total_clusters,
    count(*)::BIGINT AS total_ec4_terms, median(split_count)::DOUBLE AS median_split_count,
    round(100.0 * count(*) FILTER (split_count = 1) / count(*), 6) AS pct_terms_in_one_cluster FROM sc""",
)
def ec_split_summary(spark, sf):
    out = fragment.split_summary(_splits(spark, sf, "l_suppkey"), members(spark, sf, "l_suppkey"))
    return out.withColumn("pct_terms_in_one_cluster", F.round("pct_terms_in_one_cluster", 6))


# terms here are brands and clusters are part types, so that all three bins occur
BRANDS = """WITH sc AS (SELECT concat_ws('.', p_brand, p_size) AS term, count(DISTINCT p_type)::BIGINT AS split_count FROM part GROUP BY 1)"""


@query(
    "split_bins",
    f"""{BRANDS} SELECT count(*) FILTER (split_count = 1)::BIGINT AS split_1,
    count(*) FILTER (split_count BETWEEN 2 AND 5)::BIGINT AS split_2_5, count(*) FILTER (split_count > 5)::BIGINT AS split_over_5 FROM sc""",
)
def split_bins(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_type").alias("cluster"), F.concat_ws(".", "p_brand", "p_size").alias("term"))
    return fragment.split_bins(fragment.split_counts(part.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))))


COMPARE = f"WITH {EC}, {_sc('a', 'l_orderkey')}, {_sc('b', 'l_suppkey')}, m AS (SELECT a.term, a.split_count AS split_count_base, b.split_count AS split_count_other FROM a JOIN b ON a.term = b.term)"


@query("split_compare", f"{COMPARE} SELECT * FROM m")
def split_compare(spark, sf):
    return fragment.compare_splits(_splits(spark, sf, "l_orderkey"), _splits(spark, sf, "l_suppkey"))


@query(
    "split_compare_counts",
    f"""{COMPARE} SELECT count(*) FILTER (split_count_other > split_count_base)::BIGINT AS n_above,
    count(*) FILTER (split_count_other < split_count_base)::BIGINT AS n_below,
    count(*) FILTER (split_count_other = split_count_base)::BIGINT AS n_equal FROM m""",
)
def split_compare_counts(spark, sf):
    return fragment.compare_counts(split_compare(spark, sf))


def _side(cluster: str) -> str:
    return f"""(WITH {EC}, {_tc(cluster)}, {_purity()}, sz AS (SELECT count(*) AS s FROM lineitem GROUP BY {cluster})
    SELECT (SELECT avg(ec4_purity) FROM pur) AS p, count(*) AS c, 100.0 * count(*) FILTER (s = 1) / count(*) AS g FROM sz)"""


@query(
    "method_delta",
    f"""SELECT round(b.p - a.p, 6) AS delta_avg_ec4_purity, round(100.0 * (b.c - a.c) / a.c, 6) AS delta_clusters_pct,
    round(b.g - a.g, 6) AS delta_singleton_points FROM {_side('l_orderkey')} a, {_side('l_suppkey')} b""",
)
def method_delta(spark, sf):
    def side(cluster):
        m = members(spark, sf, cluster)
        mean = purity.purity_summary(m, annotations(spark, sf)).select("avg_ec4_purity").scalar()
        return sizes.size_summary(sizes.cluster_sizes(m)).withColumn("avg_ec4_purity", mean)

    out = fragment.method_delta(side("l_orderkey"), side("l_suppkey"))
    return out.select(*r6(*out.columns))


# ---------------------------------------------------------------- sizes


@query("cluster_sizes", "SELECT l_orderkey AS cluster, count(*)::BIGINT AS size FROM lineitem GROUP BY 1")
def cluster_sizes(spark, sf):
    return sizes.cluster_sizes(members(spark, sf))


@query(
    "cluster_size_ccdf",
    """WITH s AS (SELECT l_orderkey AS cluster, count(*)::BIGINT AS size FROM lineitem GROUP BY 1)
    SELECT cluster, size, round(1 - row_number() OVER (ORDER BY size, cluster) / (count(*) OVER ())::DOUBLE, 6) AS ccdf FROM s""",
)
def cluster_size_ccdf(spark, sf):
    return sizes.ccdf(cluster_sizes(spark, sf)).withColumn("ccdf", F.round("ccdf", 6))


@query(
    "cluster_size_log_histogram",
    """WITH s AS (SELECT 'order' AS method, count(*) AS size FROM lineitem GROUP BY l_orderkey
      UNION ALL SELECT 'supplier', count(*) FROM lineitem GROUP BY l_suppkey),
    e AS (SELECT i, pow(10.0, i * (SELECT log10(max(size) + 1) / 34 FROM s)) AS edge FROM range(35) t(i)),
    b AS (SELECT method, least(count(*) - 1, 33)::INT AS bin, any_value(size) AS size, rid FROM (SELECT *, row_number() OVER () AS rid FROM s) x
      JOIN e ON e.edge <= x.size GROUP BY method, rid),
    c AS (SELECT method, bin, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT m.method, g.bin::INT AS bin, coalesce(c.n, 0)::BIGINT AS n_clusters FROM (SELECT DISTINCT method FROM s) m CROSS JOIN range(34) g(bin)
    LEFT JOIN c ON c.method = m.method AND c.bin = g.bin""",
)
def cluster_size_log_histogram(spark, sf):
    both = [sizes.cluster_sizes(members(spark, sf, c)).select(F.lit(m).alias("method"), "size") for m, c in (("order", "l_orderkey"), ("supplier", "l_suppkey"))]
    return sizes.log_histogram(both[0].unionByName(both[1]))


@query(
    "singleton_share",
    """WITH s AS (SELECT o_orderkey, greatest(count(l_orderkey), 1) AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT count(*)::BIGINT AS n_clusters, round(100.0 * count(*) FILTER (size = 1) / count(*), 6) AS pct_singletons FROM s""",
)
def singleton_share(spark, sf):
    fam = expand_members(spark, sf).select(F.col("rep").alias("cluster"))
    return sizes.size_summary(sizes.cluster_sizes(fam)).withColumn("pct_singletons", F.round("pct_singletons", 6))


# ---------------------------------------------------------------- expansion


@query(
    "expand_members",
    "SELECT o_orderkey AS rep, coalesce(l_partkey, o_orderkey) AS member FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
)
def expand_members(spark, sf):
    reps = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rep"))
    return expand.expand_members(reps, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rep"), F.col("l_partkey").alias("member")))


# label = customer, orders with status P count as noise
@query(
    "cluster_ordinals",
    """WITH a AS (SELECT o_orderkey AS rep, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS label FROM orders),
    k AS (SELECT *, CASE WHEN label = -1 THEN 'n' || rep ELSE 'c' || label END AS key FROM a),
    f AS (SELECT key, row_number() OVER (ORDER BY min(rep)) - 1 AS cluster_id FROM k GROUP BY key)
    SELECT rep, label::BIGINT AS label, cluster_id::BIGINT AS cluster_id, printf('cluster_%05d.faa', cluster_id) AS cluster_file FROM k JOIN f USING (key)""",
)
def cluster_ordinals(spark, sf):
    a = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rep"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.col("o_custkey")).cast("long").alias("label"),
    )
    return expand.with_file_name(expand.families(a)).drop("pos")


# ---------------------------------------------------------------- ids and sequences

PY_SPACE = ids.WHITESPACE
RAW_ID = "concat(source, '.', lang, '_', doc_id % 7, '/', doc_id, '-', n_chars, '/x')"


@query(
    "id_normalise",
    f"""WITH h AS (SELECT doc_id, {RAW_ID} AS raw, concat('>> ', {RAW_ID}, ' !tail') AS header FROM documents)
    SELECT doc_id, replace(regexp_replace(trim(header), '^>+', ''), '/', '_') AS fasta_key, translate(raw, '/.', '__') AS embedder_key,
    regexp_replace(raw, '/', '_') AS export_key, regexp_replace(regexp_replace(raw, '/', '_'), '_', '/') AS back,
    split_part(trim(header[2:]), '!', 2) AS field_1, coalesce(nullif(split_part(trim(header[2:]), '!', 6), ''), trim(header[2:])) AS field_5,
    split_part(raw, '/', 1) AS accession, regexp_replace(raw, '\\.[^.]*$', '') AS parent FROM h""",
)
def id_normalise(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.expr(RAW_ID).alias("raw")).withColumn("header", F.concat(F.lit(">> "), "raw", F.lit(" !tail")))
    body = ids.strip(F.expr("substr(header, 2)"))
    exported = ids.export_key(F.col("raw"))
    return h.select(
        "doc_id", ids.fasta_key(F.col("header")).alias("fasta_key"), ids.embedder_key(F.col("raw")).alias("embedder_key"),
        exported.alias("export_key"), ids.key_to_id(exported).alias("back"), ids.header_field(body, "!", 1).alias("field_1"),
        ids.header_field(body, "!", 5).alias("field_5"), ids.member_accession(F.col("raw")).alias("accession"), ids.parent_term(F.col("raw")).alias("parent"),
    )


CLEANED = f"regexp_replace(text, '[{PY_SPACE}-]', '', 'g')"


@query(
    "clean_sequences",
    f"""SELECT doc_id, md5(translate({CLEANED}, 'UZO', 'XXX')) AS t5_md5, md5(translate({CLEANED}, 'UZOB', 'XXXX')) AS esm_md5,
    md5(lower({CLEANED})) AS fold_md5, length({CLEANED})::BIGINT AS n_residues,
    md5(concat('<AA2fold> ', regexp_replace({CLEANED}, '(.)', '\\1 ', 'g'))) AS tokens_md5 FROM documents""",
)
def clean_sequences(spark, sf):
    c = S.clean(F.col("text"))
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.md5(S.clean_and_mask(F.col("text"), "t5")).alias("t5_md5"), F.md5(S.clean_and_mask(F.col("text"), "esm")).alias("esm_md5"),
        F.md5(S.clean(F.col("text"), is_3di=True)).alias("fold_md5"), S.n_residues(c).cast("long").alias("n_residues"),
        F.md5(F.concat(S.tokens(c), F.lit(" "))).alias("tokens_md5"),
    )


# the store already holds every third document
@query(
    "length_filter_stats",
    f"""WITH d AS (SELECT doc_id, length({CLEANED}) AS len FROM documents), s AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
    SELECT count(*)::BIGINT AS n_seen, count(*) FILTER (len = 0)::BIGINT AS n_empty, count(*) FILTER (len > 1022)::BIGINT AS n_long,
    count(*) FILTER (len BETWEEN 1 AND 1022 AND s.doc_id IS NOT NULL)::BIGINT AS n_existing,
    count(*) FILTER (len BETWEEN 1 AND 1022 AND s.doc_id IS NULL)::BIGINT AS n_written,
    round(coalesce(avg(len) FILTER (len BETWEEN 1 AND 1022 AND s.doc_id IS NULL), 0), 6) AS avg_length FROM d LEFT JOIN s ON s.doc_id = d.doc_id""",
)
def length_filter_stats(spark, sf):
    d = curate.clean_records(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("sequence")))
    stored = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"))
    return curate.run_stats(d, 1022, stored).withColumn("avg_length", F.round("avg_length", 6))


@query("dedup_first_wins", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedup_first_wins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return curate.first_text_wins(d, "text", "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("dedup_keys", "SELECT user_id AS key, min(event_id) AS pos, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def dedup_keys(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), "event_type")
    return curate.first_wins(e, "key", "pos")


@query(
    "train_val_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY (doc_id * 48271) % 2147483647, doc_id) <= floor(count(*) OVER () * 0.05)
    THEN 'val' ELSE 'train' END AS split FROM documents""",
)
def train_val_split(spark, sf):
    return curate.exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.05, lehmer("doc_id"), shift=11)


@query("resume_pending", "SELECT doc_id AS key, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    return curate.pending(d, table(spark, sf, "labels").select(F.col("doc_id").alias("key")))


@query(
    "store_upsert",
    """SELECT d.doc_id AS key, coalesce(l.quality, -1)::BIGINT AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def store_upsert(spark, sf):
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.lit(-1).cast("long").alias("v"))
    new = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("long").alias("v"))
    return store.upsert(old, new)


@query(
    "vector_lookup",
    """SELECT l.doc_id AS pos, e.vec_id IS NOT NULL AS found, i::INT AS item, round(e.embedding[i + 1]::DOUBLE, 6) AS value
    FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id JOIN range(64) t(i) ON e.vec_id IS NOT NULL OR i = 0""",
)
def vector_lookup(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("pos"))
    hit, miss = store.lookup(wanted, vectors(spark, sf).select(F.col("id").alias("key"), "embedding"))
    whole = hit.select("pos", F.lit(True).alias("found"), F.posexplode("embedding").alias("item", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))
    return whole.unionByName(miss.select("pos", F.lit(False).alias("found"), F.lit(0).alias("item"), F.lit(None).cast("double").alias("value")))


# ---------------------------------------------------------------- labels

MAPPING = "SELECT event_id AS pos, user_id AS seq_id, event_type || '-' || (event_id % 3) AS family FROM events"


def _mapping(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("seq_id"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("family")
    )


@query("label_index", f"SELECT family, row_number() OVER (ORDER BY min(pos)) - 1 AS class_idx FROM ({MAPPING}) GROUP BY family")
def label_index(spark, sf):
    return labels.class_index(_mapping(spark, sf))


@query(
    "label_map",
    f"""WITH m AS ({MAPPING}), c AS (SELECT family, row_number() OVER (ORDER BY min(pos)) - 1 AS class_idx FROM m GROUP BY family),
    l AS (SELECT seq_id, arg_max(family, pos) AS family FROM m GROUP BY seq_id) SELECT seq_id, family, class_idx FROM l JOIN c USING (family)""",
)
def label_map(spark, sf):
    return labels.label_map(_mapping(spark, sf))


@query("num_classes", f"SELECT count(DISTINCT family)::BIGINT AS num_classes FROM ({MAPPING})")
def num_classes(spark, sf):
    return labels.num_classes(_mapping(spark, sf))


@query(
    "label_join_quality",
    """SELECT source, count(*)::BIGINT AS n_total, count(l.doc_id)::BIGINT AS n_matched, (count(*) - count(l.doc_id))::BIGINT AS n_missing,
    (count(*) - count(l.doc_id)) > count(l.doc_id) * 0.1 AS warn FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""",
)
def label_join_quality(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), "source")
    return labels.label_quality(d, table(spark, sf, "labels").select(F.col("doc_id").alias("seq_id")), ["source"])


@query("first_missing_labels", "SELECT doc_id AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 5")
def first_missing_labels(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), F.col("doc_id").alias("pos"))
    _, missing = labels.join_labels(d, table(spark, sf, "labels").select(F.col("doc_id").alias("seq_id")))
    return labels.first_missing(missing).select("pos")


# ---------------------------------------------------------------- batching

BUCKET, MAX_LEN = 64, 1022
BUCKETED = f"""p AS (SELECT doc_id, length({CLEANED}) AS len FROM documents),
    q AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {BUCKET} AS bucket FROM p WHERE len BETWEEN 1 AND {MAX_LEN}),
    s AS (SELECT doc_id, len, bucket, row_number() OVER (PARTITION BY bucket ORDER BY len DESC, doc_id) - 1 AS rn FROM q)"""


def _bucketed(spark, sf):
    d = curate.clean_records(table(spark, sf, "documents").select("doc_id", F.col("text").alias("sequence")))
    return batching.length_buckets(d, BUCKET, "doc_id", max_len=MAX_LEN)


@query("length_buckets", f"WITH {BUCKETED} SELECT doc_id, len::BIGINT AS length, bucket::BIGINT AS bucket, rn::BIGINT AS rank_in_bucket FROM s")
def length_buckets(spark, sf):
    return _bucketed(spark, sf).select("doc_id", F.col("length").cast("long").alias("length"), "bucket", "rank_in_bucket")


@query(
    "greedy_bucket_batches",
    f"""WITH RECURSIVE {BUCKETED}, g AS (SELECT doc_id, bucket, rn, len AS res, 1 AS n, 0 AS batch FROM s WHERE rn = 0
    UNION ALL SELECT s.doc_id, s.bucket, s.rn, CASE WHEN g.n >= 16 OR g.res >= 6000 THEN s.len ELSE g.res + s.len END,
    CASE WHEN g.n >= 16 OR g.res >= 6000 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 16 OR g.res >= 6000 THEN g.batch + 1 ELSE g.batch END
    FROM g JOIN s ON s.bucket = g.bucket AND s.rn = g.rn + 1) SELECT doc_id, bucket::BIGINT AS bucket, batch::BIGINT AS batch FROM g""",
)
def greedy_bucket_batches(spark, sf):
    return batching.bucket_batches(_bucketed(spark, sf), 16, 6000, id_col="doc_id")


@query(
    "greedy_stream_batches",
    f"""WITH RECURSIVE s AS (SELECT doc_id, length({CLEANED}) AS len, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents),
    g AS (SELECT doc_id, rn, len, len AS res, 1 AS n, 0 AS batch FROM s WHERE rn = 0
    UNION ALL SELECT s.doc_id, s.rn, s.len, CASE WHEN g.n >= 8 OR g.res >= 12000 OR g.len > 6000 THEN s.len ELSE g.res + s.len END,
    CASE WHEN g.n >= 8 OR g.res >= 12000 OR g.len > 6000 THEN 1 ELSE g.n + 1 END,
    CASE WHEN g.n >= 8 OR g.res >= 12000 OR g.len > 6000 THEN g.batch + 1 ELSE g.batch END
    FROM g JOIN s ON s.rn = g.rn + 1) SELECT doc_id, rn::BIGINT AS pos, batch::BIGINT AS batch FROM g""",
)
def greedy_stream_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.n_residues(S.clean(F.col("text"))).alias("length"))
    return batching.stream_batches(d, ["doc_id"], 8, 12000, 6000, id_col="doc_id")


EPOCHS, BATCH = 12, 128
EPOCH_RANK = "((doc_id + 1) * 48271 * (epoch + 1) + epoch * 7919) % 2147483647"


@query(
    "epoch_batches",
    f"""WITH r AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY {EPOCH_RANK}, doc_id) - 1 AS k FROM documents CROSS JOIN range({EPOCHS}) t(epoch))
    SELECT epoch::INT AS epoch, (k // {BATCH})::BIGINT AS batch, count(*)::BIGINT AS n_rows, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS id_sum,
    round(CASE WHEN epoch < 5 THEN 0.001 * (0.5 + 0.5 * epoch / 5.0) ELSE 0.000001 + 0.000999 * (1 + cos(pi() * (epoch - 5) / {EPOCHS - 5}.0)) / 2 END, 9) AS lr
    FROM r GROUP BY epoch, k // {BATCH}""",
)
def epoch_batches(spark, sf):
    b = batching.epoch_batches(table(spark, sf, "documents"), "doc_id", EPOCHS, BATCH, F.expr(EPOCH_RANK))
    g = b.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("id_sum"))
    return g.withColumn("lr", F.round(train.lr_at(F.col("epoch"), 1e-3, 5, EPOCHS, 1e-6), 9))


# ---------------------------------------------------------------- vectors


@query("vector_norms", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.norm(V.as_double(F.col("embedding"))), 6).alias("norm"))


@query(
    "l2_normalize",
    """WITH v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings),
    n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
    SELECT id, i::INT AS dim, round(e[i + 1] / n, 6) AS value FROM n CROSS JOIN range(64) t(i)""",
)
def l2_normalize(spark, sf):
    v = vectors(spark, sf).select("id", F.transform(V.as_double(F.col("embedding")), lambda x: x * 3).alias("embedding"))
    return V.with_unit(v).select("id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "mean_pool",
    "SELECT label::BIGINT AS label, i::INT AS dim, round(avg(embedding[i + 1]::DOUBLE), 6) AS value FROM embeddings CROSS JOIN range(64) t(i) GROUP BY 1, 2",
)
def mean_pool(spark, sf):
    pooled = V.mean_pool(vectors(spark, sf), "label")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


UNIT = density_sql.UNIT
PAIRS = f"{UNIT}, d AS (SELECT a.id AS id, b.id AS neighbor, list_distance(a.e, b.e) AS d FROM u a JOIN u b ON a.id <> b.id)"


def _cells(spark, sf):
    return neighbors.build_cells(neighbors.distinct_points(V.with_unit(vectors(spark, sf))))


@query(
    "knn_core_distance",
    f"WITH {PAIRS}, k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS r FROM d) SELECT id, round(d, 6) AS core FROM k WHERE r = 4",
)
def knn_core_distance(spark, sf):
    # the fifth sample counting the point itself
    return neighbors.core_distances(_cells(spark, sf), 5).withColumn("core", F.round("core", 6))


@query(
    "mutual_reachability_topk",
    f"""WITH {PAIRS}, c AS (SELECT id, min(d) AS core FROM d GROUP BY id),
    m AS (SELECT d.id, d.neighbor, greatest(d.d, a.core, b.core) AS reach FROM d JOIN c a ON a.id = d.id JOIN c b ON b.id = d.neighbor)
    SELECT id, neighbor, (row_number() OVER (PARTITION BY id ORDER BY reach, neighbor))::INT AS rank, round(reach, 6) AS reach FROM m QUALIFY rank <= 3""",
)
def mutual_reachability_topk(spark, sf):
    # with two samples the core distance is the nearest distance, so reachability ranks like distance
    near = checkpoint(neighbors.nearest(_cells(spark, sf), 3))
    cores = near.where(F.col("rank") == 1).select("id", F.col("distance").alias("core"))
    both = near.join(cores, "id").join(cores.select(F.col("id").alias("neighbor"), F.col("core").alias("other")), "neighbor")
    return both.select("id", "neighbor", "rank", F.round(F.greatest("distance", "core", "other"), 6).alias("reach"))


# with five samples the order of reachability is no longer that of distance
@query(
    "mutual_reachability_core5",
    f"""WITH RECURSIVE {density_sql.tree(5)} SELECT id, neighbor, (row_number() OVER (PARTITION BY id ORDER BY d, neighbor))::INT AS rank, round(d, 6) AS reach
    FROM d QUALIFY rank <= 3""",
)
def mutual_reachability_core5(spark, sf):
    cells = _cells(spark, sf)
    near = neighbors.nearest(cells, 3, neighbors.core_distances(cells, 5))
    return near.select("id", "neighbor", "rank", F.round("reach", 6).alias("reach"))


@query("mst_edges_core5", f"WITH RECURSIVE {density_sql.tree(5)} SELECT lo, hi, round(w, 6) AS w FROM edges")
def mst_edges_core5(spark, sf):
    return mst.tree_edges(density.spanning_rounds(vectors(spark, sf), min_samples=5)).select("lo", "hi", F.round("w", 6).alias("w"))


# Prim's algorithm, one vertex per recursion step
@query(
    "mst_edges",
    f"""WITH RECURSIVE {UNIT}, d AS MATERIALIZED (SELECT a.id AS id, b.id AS neighbor, list_distance(a.e, b.e) AS d FROM u a JOIN u b ON a.id <> b.id),
    s AS (SELECT 0 AS step, neighbor AS v, d AS best, id AS via FROM d WHERE id = 0
    UNION ALL SELECT x.step + 1, x.v, least(d.d, x.best), CASE WHEN d.d < x.best THEN x.pick ELSE x.via END
    FROM (SELECT *, first_value(v) OVER (ORDER BY best, v) AS pick FROM s) x JOIN d ON d.id = x.pick AND d.neighbor = x.v WHERE x.v <> x.pick)
    SELECT least(v, via) AS lo, greatest(v, via) AS hi, round(best, 6) AS w FROM s QUALIFY row_number() OVER (PARTITION BY step ORDER BY best, v) = 1""",
)
def mst_edges(spark, sf):
    return mst.tree_edges(density.spanning_rounds(vectors(spark, sf))).select("lo", "hi", F.round("w", 6).alias("w"))


# with five samples many edges have the same reachability and trees differ, but not the weights of their edges
@query(
    "mst_weights_core5",
    f"""WITH RECURSIVE {UNIT}, p AS MATERIALIZED (SELECT a.id AS id, b.id AS neighbor, list_distance(a.e, b.e) AS d FROM u a JOIN u b ON a.id <> b.id),
    c AS MATERIALIZED (SELECT id, d AS core FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor) = 4),
    d AS MATERIALIZED (SELECT p.id, p.neighbor, greatest(p.d, a.core, b.core) AS d FROM p JOIN c a ON a.id = p.id JOIN c b ON b.id = p.neighbor),
    s AS (SELECT 0 AS step, neighbor AS v, d AS best FROM d WHERE id = 0
    UNION ALL SELECT x.step + 1, x.v, least(d.d, x.best)
    FROM (SELECT *, first_value(v) OVER (ORDER BY best, v) AS pick FROM s) x JOIN d ON d.id = x.pick AND d.neighbor = x.v WHERE x.v <> x.pick)
    SELECT w, count(*)::BIGINT AS n FROM (SELECT round(min(best), 6) AS w FROM s GROUP BY step) GROUP BY w""",
)
def mst_weights_core5(spark, sf):
    edges = mst.tree_edges(density.spanning_rounds(vectors(spark, sf), min_samples=5))
    return edges.groupBy(F.round("w", 6).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("condensed_tree", density_sql.condensed_sql())
def condensed_tree(spark, sf):
    return density.condensed_tree(vectors(spark, sf)).withColumn("lambda", F.round("lambda", 6))


@query("condensed_tree_core5", density_sql.condensed_sql(5))
def condensed_tree_core5(spark, sf):
    return density.condensed_tree(vectors(spark, sf), min_samples=5).withColumn("lambda", F.round("lambda", 6))


@query("hdbscan_clusters", density_sql.labels_sql())
def hdbscan_clusters(spark, sf):
    return density.hdbscan(vectors(spark, sf))


@query("hdbscan_cosine", density_sql.labels_sql(metric="cosine"))
def hdbscan_cosine(spark, sf):
    return density.hdbscan(vectors(spark, sf), metric="cosine")


@query("hdbscan_core5", density_sql.labels_sql(5))
def hdbscan_core5(spark, sf):
    return density.hdbscan(vectors(spark, sf), min_samples=5)


def _family_ctes(labels: str = "labels") -> str:
    """Families of ``labels`` with their members, down to the purity of each."""
    return f"""fam AS (SELECT id AS rep, CASE WHEN label = -1 THEN concat('n', id) ELSE concat('c', label) END AS cluster FROM {labels}),
    grown AS (SELECT f.cluster, l.l_partkey AS member FROM fam f JOIN lineitem l ON l.l_orderkey = f.rep
      UNION ALL SELECT cluster, rep FROM fam WHERE rep NOT IN (SELECT l_orderkey FROM lineitem)),
    tc AS (SELECT g.cluster, e.term, count(*)::BIGINT AS n FROM grown g JOIN ec e ON e.accession = g.member GROUP BY 1, 2),
    {_purity()}"""


FAMILY_TOTAL = "SELECT count(DISTINCT cluster) FROM grown"


def _grown(spark, sf, found: DataFrame) -> DataFrame:
    fam = expand.families(found.select(F.col("id").alias("rep"), F.col("id").alias("pos"), "label"))
    tsv = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rep"), F.col("l_partkey").alias("member"))
    grown = expand.expand_members(fam, tsv)
    return grown.select(F.col("cluster_id").alias("cluster"), F.col("member").alias("accession"))


@query("hdbscan_family_purity", f"WITH RECURSIVE {EC}, {density_sql.labels()}, {_family_ctes()} {_summary(FAMILY_TOTAL)}")
def hdbscan_family_purity(spark, sf):
    """The whole chain: cluster, number the families, expand to members, annotate, score."""
    grown = checkpoint(_grown(spark, sf, density.hdbscan(vectors(spark, sf))))
    return purity.purity_summary(grown, annotations(spark, sf)).select(*r6(*METRICS))


def _run_sql(unit: str) -> str:
    """What ``method_delta`` compares, of the families of one clustering."""
    return f"""(WITH RECURSIVE {EC}, {density_sql.labels(unit=unit)}, {_family_ctes()}, sizes AS (SELECT cluster, count(*) AS n FROM grown GROUP BY 1)
    SELECT (SELECT avg(ec4_purity) FROM pur) AS p, count(*) AS c, 100.0 * count(*) FILTER (n = 1) / count(*) AS g FROM sizes)"""


@query(
    "raw_versus_projected",
    f"""SELECT round(b.p - a.p, 6) AS delta_avg_ec4_purity, round(100.0 * (b.c - a.c) / a.c, 6) AS delta_clusters_pct,
    round(b.g - a.g, 6) AS delta_singleton_points FROM {_run_sql(UNIT)} a, {_run_sql(density_sql.PROJECTED)} b""",
)
def raw_versus_projected(spark, sf):
    """Raw and projected vectors, both clustered, expanded to families and scored: what the projection changes."""

    def side(v: DataFrame) -> DataFrame:
        grown = checkpoint(_grown(spark, sf, density.hdbscan(v)))
        mean = purity.purity_summary(grown, annotations(spark, sf)).select("avg_ec4_purity").scalar()
        return sizes.size_summary(sizes.cluster_sizes(grown)).withColumn("avg_ec4_purity", mean)

    out = fragment.method_delta(side(vectors(spark, sf)), side(head.project(vectors(spark, sf), _formula_head())))
    return out.select(*r6(*out.columns))


# ---------------------------------------------------------------- losses and learning

LOSS_BATCH = 128


def _loss_rows(spark, sf):
    v = V.with_unit(vectors(spark, sf))
    return v.select(F.floor(F.col("id") / LOSS_BATCH).cast("long").alias("batch"), "label", F.col("embedding").alias("vec"))


@query(
    "supcon_loss",
    f"""WITH {UNIT}, b AS (SELECT *, id // {LOSS_BATCH} AS batch FROM u),
    s AS (SELECT a.batch, a.id AS i, b.id AS j, a.label = b.label AS same, list_inner_product(a.e, b.e) / 0.07 AS s FROM b a JOIN b ON a.batch = b.batch),
    l AS (SELECT batch, i, j, same, s - max(s) OVER (PARTITION BY i) AS l FROM s),
    n AS (SELECT i, ln(greatest(sum(exp(l)) FILTER (i <> j), 1e-12)) AS n FROM l GROUP BY i),
    p AS (SELECT l.batch, l.i, coalesce(sum(l.l - n.n) FILTER (same AND l.i <> j), 0) / greatest(count(*) FILTER (same AND l.i <> j), 1e-12) AS v
      FROM l JOIN n ON n.i = l.i GROUP BY 1, 2)
    SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n_rows, round(-avg(v), 6) AS loss FROM p GROUP BY 1""",
)
def supcon_loss(spark, sf):
    return losses.supcon_loss(_loss_rows(spark, sf)).withColumn("loss", F.round("loss", 6))


@query(
    "proxy_anchor_loss",
    f"""WITH {UNIT}, b AS (SELECT *, id // {LOSS_BATCH} AS batch FROM u),
    c AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(e[i + 1]) AS m FROM u CROSS JOIN range(64) t(i) GROUP BY 1, 2) GROUP BY label),
    s AS (SELECT b.batch, c.label AS k, b.label = c.label AS own, list_cosine_similarity(b.e, c.p) AS c FROM b CROSS JOIN c),
    t AS (SELECT batch, k, bool_or(own) AS present, coalesce(sum(exp(-32 * (c - 0.2))) FILTER (own), 0) AS p, coalesce(sum(exp(32 * (c + 0.2))) FILTER (NOT own), 0) AS n FROM s GROUP BY 1, 2)
    SELECT batch::BIGINT AS batch, round(avg(ln(1 + p)) FILTER (present) + avg(ln(1 + n)), 6) AS loss FROM t GROUP BY 1""",
)
def proxy_anchor_loss(spark, sf):
    # proxies: the class centroids
    v = V.with_unit(vectors(spark, sf))
    proxies = V.mean_pool(v, "label").select(F.col("label").alias("class_idx"), F.col("embedding").alias("proxy"))
    return losses.proxy_anchor_loss(_loss_rows(spark, sf), proxies).withColumn("loss", F.round("loss", 6))


HISTORY = "SELECT datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch, round(avg(value), 6) AS val_loss FROM events GROUP BY 1"
PATIENCE, MIN_DELTA = 3, 0.01


def _history(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf, "events").groupBy(day.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("val_loss"))


@query(
    "early_stop",
    f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (ORDER BY epoch) AS k FROM ({HISTORY})),
    g AS (SELECT k, epoch, val_loss, val_loss AS best, 0 AS waited, false AS stopped FROM h WHERE k = 1
    UNION ALL SELECT h.k, h.epoch, h.val_loss, CASE WHEN NOT g.stopped AND h.val_loss < g.best - {MIN_DELTA} THEN h.val_loss ELSE g.best END,
    CASE WHEN g.stopped THEN g.waited WHEN h.val_loss < g.best - {MIN_DELTA} THEN 0 ELSE g.waited + 1 END,
    g.stopped OR (NOT h.val_loss < g.best - {MIN_DELTA} AND g.waited + 1 >= {PATIENCE}) FROM g JOIN h ON h.k = g.k + 1)
    SELECT epoch, val_loss, best, waited::BIGINT AS waited, stopped FROM g""",
)
def early_stop(spark, sf):
    return train.early_stop(_history(spark, sf), PATIENCE, MIN_DELTA)


@query("best_epoch", f"SELECT epoch, val_loss FROM ({HISTORY}) ORDER BY val_loss, epoch LIMIT 1")
def best_epoch(spark, sf):
    return train.best_epoch(_history(spark, sf))


def _formula_head() -> head.Head:
    """One linear layer whose weights follow a formula that SQL can state."""
    made = head.Head.create(64, [], 8, seed=0)
    rows, cols = np.meshgrid(np.arange(8), np.arange(64), indexing="ij")
    made.params["w0"], made.params["b0"] = ((rows * 31 + cols * 17) % 13 - 6) / 8.0, (np.arange(8) - 3.0) / 16.0
    return made


@query(
    "project_head",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
    y AS (SELECT vec_id, j, sum(v * ((j * 31 + i * 17) % 13 - 6) / 8.0) + (j - 3.0) / 16.0 AS y FROM x CROSS JOIN range(8) t(j) GROUP BY 1, 2)
    SELECT vec_id AS id, j::INT AS item, round((y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)))::DOUBLE, 6) AS value FROM y""",
)
def project_head(spark, sf):
    """Vectors through a projection head and normalised, as the exporter does with a trained one."""
    out = head.project(vectors(spark, sf), _formula_head())
    return out.select("id", F.posexplode("embedding").alias("item", "value")).withColumn("value", F.round("value", 6))


# ---------------------------------------------------------------- embedding and ingestion


@query(
    "embed_sequences",
    f"""WITH d AS (SELECT doc_id, translate({CLEANED}, 'UZOB', 'XXXX') AS s FROM documents), k AS (SELECT * FROM d WHERE length(s) BETWEEN 1 AND {MAX_LEN}),
    r AS (SELECT doc_id, unicode(substr(s, i, 1)) AS c FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM k)), 
    v AS (SELECT doc_id, j, round(avg((c * (j + 1)) % 97 / 97.0), 6) AS m, count(*) AS n FROM r CROSS JOIN range(8) t(j) GROUP BY 1, 2)
    SELECT doc_id, 'embedded' AS status, j::INT AS dim, m AS value, n::BIGINT AS length FROM v
    UNION ALL SELECT doc_id, CASE WHEN length(s) = 0 THEN 'empty' ELSE 'long' END, NULL, NULL, length(s)::BIGINT FROM d WHERE length(s) NOT BETWEEN 1 AND {MAX_LEN}""",
)
def embed_sequences(spark, sf):
    d = curate.clean_records(table(spark, sf, "documents").select("doc_id", F.col("text").alias("sequence")))
    bucketed = batching.length_buckets(d, 10000, "doc_id", max_len=MAX_LEN)
    batches = batching.bucket_batches(bucketed, id_col="doc_id").join(d.select("doc_id", "sequence"), "doc_id")
    out = embed.embed(batches.withColumnRenamed("doc_id", "key"), half_precision=False)
    done = out.select(F.col("key").alias("doc_id"), "status", F.posexplode("embedding").alias("dim", "value"), "length").withColumn("value", F.round("value", 6))
    # what the length rule leaves out is listed, not lost
    out_of_range = d.withColumn("status", curate.status(F.col("length"), MAX_LEN)).where("status != 'ok'")
    return done.unionByName(out_of_range.select("doc_id", "status", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("double").alias("value"), F.col("length").cast("long").alias("length")))


@query(
    "fasta_records",
    f"""SELECT doc_id AS pos, concat('>', source, '/', doc_id, '-', n_chars) AS header, concat(source, '_', doc_id, '-', n_chars) AS key,
    md5({CLEANED}) AS sequence_md5, length({CLEANED})::BIGINT AS n_residues FROM documents""",
)
def fasta_records(spark, sf):
    """Documents written as multi-line sequence files and read back in parallel splits."""
    path = f"{scratch_dir(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_fasta(sequences(spark, sf), path)
    records = fasta.read_fasta(spark, path)
    cleaned = fasta.embedder_columns(records)
    # the number of a record within its file depends on how the writer split the table; its id holds the document
    doc = F.regexp_extract("seq_id", "/(\\d+)-", 1).cast("long")
    return cleaned.select(
        doc.alias("pos"), F.concat(F.lit(">"), "seq_id").alias("header"), "key", F.md5("sequence").alias("sequence_md5"), F.length("sequence").cast("long").alias("n_residues")
    )


PARTS, FILES = 4, 3


def _arriving(spark, rows: DataFrame, order: str, base: str, run: Callable[[DataFrame], None]) -> None:
    """Rows arrive in PARTS parts of FILES files each, one part to a micro-batch; the stream stops after half of them and is started again."""
    bounds = rows.agg(F.min(order).alias("lo"), (F.max(order) + 1).alias("hi")).first()
    part = F.floor((F.col(order) - bounds.lo) * PARTS / (bounds.hi - bounds.lo))
    for k in range(PARTS):
        rows.where(part == k).repartition(FILES).write.mode("append").parquet(f"{base}/source")
        if k % 2:
            run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{base}/source"))


@query("stream_ingest", "SELECT user_id AS key, min(event_id) AS pos, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_ingest(spark, sf):
    """Events as an arriving stream, ingested once per user."""
    base = f"{scratch_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), "event_type")
    _arriving(spark, source, "pos", base, lambda rows: streaming.ingest(rows, f"{base}/table", f"{base}/state").awaitTermination())
    return streaming.read_stored(spark, f"{base}/table", "key long, pos long, event_type string")


@query("greedy_batches_streamed", ORACLES["greedy_stream_batches"])
def greedy_batches_streamed(spark, sf):
    """The batches of the whole file, made while it arrives."""
    base = f"{scratch_dir(spark)}/batches-{uuid.uuid4().hex}"
    source = table(spark, sf, "documents").select("doc_id", S.n_residues(S.clean(F.col("text"))).cast("long").alias("length"))

    def run(rows: DataFrame) -> None:
        out = stream_batches.stream_batches(rows, 8, 12000, 6000, order="doc_id", id_col="doc_id")
        streaming.store_batches(out, f"{base}/table", f"{base}/state").awaitTermination()

    _arriving(spark, source, "doc_id", base, run)
    return streaming.read_stored(spark, f"{base}/table", "doc_id long, pos long, batch long")
