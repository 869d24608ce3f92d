import pytest
from pyspark.sql import functions as F

from kinfold.operators import expand, fragment, purity, sizes


def occurrences(spark, clusters):
    """{cluster: [terms]} as members and annotations with one accession per term."""
    rows = [(c, t) for c, terms in clusters.items() for t in terms]
    members = spark.createDataFrame([(c, t or "none") for c, t in rows], "cluster string, accession string")
    ann = spark.createDataFrame(sorted({(t, t) for _, t in rows if t}), "accession string, term string")
    return members, ann


def one(spark, terms, mode="raw"):
    m, a = occurrences(spark, {"c": terms})
    return purity.cluster_purity(m, a, mode).first()


def test_raw_and_dotted_prefixes(spark):
    terms = ["1.1.1.1", "1.1.1.1", "1.1.10.2", "2.7.1.1"]
    raw, dotted = one(spark, terms), one(spark, terms, "dotted")
    assert (raw.ec4_purity, raw.ec3_purity, raw.n_terms) == (0.5, 0.75, 3)
    assert (dotted.ec4_purity, dotted.ec3_purity) == (0.5, 0.5)


@pytest.mark.parametrize("terms, over80, over90", [(["A.B.C.1"] * 4 + ["A.B.D.1"], 0, 0), (["A.1"] * 9 + ["A.2"], 100, 0), (["A.1"], 100, 100)])
def test_thresholds_are_strict(spark, terms, over80, over90):
    m, a = occurrences(spark, {"c": terms})
    s = purity.purity_summary(m, a).first()
    assert (s.pct_ec4_over_80, s.pct_ec4_over_90) == (over80, over90)


def test_members_are_a_multiset_and_unannotated_clusters_count(spark):
    members = spark.createDataFrame([("a", x) for x in ("P", "P", "Q", "Z")] + [("b", "Z")], "cluster string, accession string")
    ann = spark.createDataFrame([("P", "x.1"), ("P", "x.2"), ("Q", "x.1"), ("Q", "x.1")], "accession string, term string")
    counts = {r.term: r.n for r in purity.term_counts(members, ann).collect()}
    assert counts == {"x.1": 3, "x.2": 2}
    s = purity.purity_summary(members, ann).first()
    assert (s.pct_with_ec, s.avg_ec4_purity) == (50.0, 0.6)


@pytest.mark.parametrize("term, parent", [("1.1.1.-", "1.1.1"), ("1.1.1", "1.1"), ("5", "5"), (".5", "")])
def test_parent_terms(spark, term, parent):
    from kinfold.functions.ids import parent_term

    assert spark.range(1).select(parent_term(F.lit(term)).alias("p")).first().p == parent


def test_no_cluster_and_no_annotation(spark):
    members = spark.createDataFrame([], "cluster string, accession string")
    ann = spark.createDataFrame([("P", "x.1")], "accession string, term string")
    s = purity.purity_summary(members, ann).first()
    assert s.pct_with_ec is None and s.avg_ec4_purity == 0
    alone = spark.createDataFrame([("a", "Z")], "cluster string, accession string")
    assert purity.purity_summary(alone, ann).first().pct_with_ec == 0


def test_invariants_on_tables(spark):
    from kinfold.plans.bindings import annotations, members

    m, a = members(spark, "/root/testdata/sf0.001"), annotations(spark, "/root/testdata/sf0.001")
    p = purity.cluster_purity(m, a).cache()
    assert p.where("ec3_purity < ec4_purity or ec4_purity <= 0 or ec4_purity > 1").count() == 0
    assert p.where("(ec4_purity = 1) != (n_terms = 1)").count() == 0
    s = purity.summary(p).first()
    assert s.pct_1_ec + s.pct_2_ec + s.pct_3_ec + s.pct_4_or_more_ec == pytest.approx(100)
    counts = purity.term_counts(m, a)
    assert fragment.split_counts(counts).agg(F.sum("split_count")).first()[0] == p.agg(F.sum("n_terms")).first()[0]


def test_hot_accession_and_hot_cluster(spark):
    """A third of all members share an accession and a cluster."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("cluster"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997).alias("accession"),
    )
    ann = spark.range(997).select(F.col("id").alias("accession"), F.format_string("%d.%d.%d", F.col("id") % 3, F.col("id") % 5, F.col("id") % 11).alias("term"))
    got = {r.cluster: (r.ec4_purity, r.n_occurrences) for r in purity.cluster_purity(rows, ann).collect()}
    want = {}
    term = {r.accession: r.term for r in ann.collect()}
    for r in rows.collect():
        want.setdefault(r.cluster, []).append(term[r.accession])
    assert got == {c: (max(map(t.count, set(t))) / len(t), len(t)) for c, t in want.items()}


def test_split_summary_median(spark):
    splits = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 10)], "term string, split_count long")
    clusters = spark.createDataFrame([("x",), ("y",), ("y",)], "cluster string")
    s = fragment.split_summary(splits, clusters).first()
    assert (s.total_clusters, s.total_ec4_terms, s.median_split_count, s.pct_terms_in_one_cluster) == (2, 4, 2.5, 25.0)
    empty = fragment.split_summary(splits.limit(0), clusters).first()
    assert (empty.total_ec4_terms, empty.median_split_count, empty.pct_terms_in_one_cluster) == (0, 0, 0)


def test_split_bins_and_comparison(spark):
    def t(**kw):
        return spark.createDataFrame(list(kw.items()), "term string, split_count long")

    a, b = t(x=1, y=3, z=7, w=2), t(x=2, y=3, z=1)
    assert tuple(fragment.split_bins(a).first()) == (1, 2, 1) and tuple(fragment.split_bins(b).first()) == (1, 2, 0)
    m = fragment.compare_splits(a, b)
    assert m.count() == 3 and tuple(fragment.compare_counts(m).first()) == (1, 1, 1)


def test_ccdf_and_histogram(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 5)], "cluster string, size long")
    assert [r.ccdf for r in sizes.ccdf(s).orderBy(F.desc("ccdf")).collect()] == [0.75, 0.5, 0.25, 0.0]
    h = sizes.log_histogram(spark.createDataFrame([("m", v) for v in (1, 1, 2, 5, 10)], "method string, size long"))
    full = {r.bin: r.n_clusters for r in h.collect()}
    assert len(full) == 34 and {k: v for k, v in full.items() if v} == {0: 2, 9: 1, 22: 1, 32: 1}


def test_expansion(spark):
    assign = spark.createDataFrame([("r1", 0, 0), ("r2", 1, -1), ("r3", 2, 0), ("r4", 3, -1)], "rep string, pos long, label long")
    tsv = spark.createDataFrame([("r1", "r1"), ("r1", "m1"), ("r2", "r2"), ("r2", "m2"), ("r3", "r3")], "rep string, member string")
    out = expand.expand_members(expand.families(assign), tsv)
    got = {}
    for r in out.collect():
        got.setdefault(r.cluster_id, set()).add(r.member)
    assert got == {0: {"r1", "m1", "r3"}, 1: {"r2", "m2"}, 2: {"r4"}}
    s = sizes.size_summary(sizes.cluster_sizes(out.withColumnRenamed("cluster_id", "cluster"))).first()
    assert s.n_clusters == 3 and s.pct_singletons == pytest.approx(100 / 3)


def test_expanding_deals_rows_by_their_number(spark):
    """Tasks follow the rows, not the session's partitions; a frequent representative, a null and a member that is null keep all their rows."""
    reps = spark.range(40).select(F.col("id").alias("rep"), (F.col("id") * 2).alias("more")).unionByName(spark.createDataFrame([(None, 7)], "rep long, more long"))
    rows = [(r, 100 * r + k) for r in range(30) for k in range(r % 4)] + [(5, k) for k in range(60)] + [(31, None), (None, 3), (77, 1)]
    members = spark.createDataFrame(rows, "rep long, member long")
    want = sorted(([(r, 2 * r, m) for r, m in rows if r is not None and r < 40] + [(r, 2 * r, r) for r in range(40) if r not in {x for x, _ in rows}] + [(None, 7, None)]), key=str)
    for task_rows in (10, 1000):
        out = expand.expand_members(reps, members, task_rows)
        assert sorted(map(tuple, out.select("rep", "more", "member").collect()), key=str) == want
    few = expand.expand_members(reps, members.where("rep <> 5"), 10)
    assert few.rdd.getNumPartitions() == -(-(41 + members.where("rep <> 5").count()) // 10)


def test_members_of_others_are_left_out_first(spark):
    """Neither counted nor dealt: tasks follow the members of the given representatives, repeated ones and nulls included."""
    reps = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (900, 30), (None, 40)], "rep long, more long")
    others = spark.range(3, 603).select(F.col("id").alias("rep"), F.col("id").alias("member")).unionByName(spark.range(50).select(F.lit(700).cast("long").alias("rep"), F.col("id").alias("member")))
    members = others.unionByName(spark.createDataFrame([(1, 5), (1, 6), (2, None), (None, 9)], "rep long, member long"))
    out = expand.expand_members(reps, members, 10)
    got = sorted(map(tuple, out.select("rep", "more", "member").collect()), key=str)
    assert got == sorted([(1, 10, 5), (1, 10, 6), (1, 11, 5), (1, 11, 6), (2, 20, None), (900, 30, 900), (None, 40, None)], key=str)
    assert out.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("keep", [False, True])
def test_counting_deals_rows_by_their_number(spark, keep):
    """Tasks follow the rows, not the session's partitions; a large cluster, a null one and members without terms are counted all the same."""
    rows = [(k % 9, k % 13) for k in range(100)] + [(20, k % 5) for k in range(70)] + [(None, 1), (None, 99), (30, 99)]
    terms = [(a, f"1.{a % 3}.{a}") for a in range(13)] + [(a, f"2.{a}") for a in range(0, 13, 4)]
    members, ann = spark.createDataFrame(rows, "cluster long, accession long"), spark.createDataFrame(terms, "accession long, term string")
    want = {}
    for c, a in rows:
        for t in [t for x, t in terms if x == a] or [None] * keep:
            want[c, t] = want.get((c, t), 0) + (t is not None)
    for task_rows in (20, 1000):
        got = purity.term_counts(members, ann, keep, task_rows).collect()
        assert {(r.cluster, r.term): r.n for r in got} == want and len(got) == len(want)
    few = purity.term_counts(members.where("cluster < 9"), ann, keep, 20)
    assert few.rdd.getNumPartitions() == 200 // 20 == purity.purity_of_counts(few, ann).rdd.getNumPartitions()
