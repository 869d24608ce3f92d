import pytest
from pyspark.sql import functions as F

from kinfold.functions import ids, sequences
from kinfold.operators import batching, curate, embed, labels, ordering
from kinfold.sources import fasta, files, store


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_id_rules_diverge(spark):
    raw = F.lit("A_B.1/3-8/x")
    assert value(spark, ids.fasta_key(F.concat(F.lit("  >>"), raw, F.lit("\n")))) == "A_B.1_3-8_x"
    assert value(spark, ids.embedder_key(raw)) == "A_B_1_3-8_x"
    assert value(spark, ids.export_key(raw)) == "A_B.1_3-8/x"
    assert value(spark, ids.key_to_id(ids.export_key(raw))) == "A/B.1_3-8/x"
    assert value(spark, ids.key_to_id(F.lit("A0A3Q8W200_25-112_187-234"))) == "A0A3Q8W200/25-112_187-234"


def test_header_fields_and_accessions(spark):
    h = F.lit("a|b|c")
    assert [value(spark, ids.header_field(h, "|", i)) for i in (0, 2, 3, -1)] == ["a", "c", "a|b|c", "c"]
    assert value(spark, ids.accession(F.lit(">Q8EJT8/3-88"))) == "Q8EJT8"
    assert value(spark, ids.accession(F.lit(">Q8EJT8"), strict=True)) is None
    assert value(spark, ids.accession(F.lit(">Q8EJT8 "))) == "Q8EJT8"
    assert [tuple(s) for s in value(spark, ids.segments(F.lit("A/25-112_187-234")))] == [(25, 112), (187, 234)]
    assert value(spark, ids.cluster_file(F.lit(123456))) == "cluster_123456.faa"


def test_cleaning(spark):
    c = sequences.clean(F.lit("AU-Z O  \x1c\nB"))
    assert value(spark, c) == "AUZOB"
    assert value(spark, sequences.mask_rare(c, "t5")) == "AXXXB"
    assert value(spark, sequences.clean_and_mask(F.lit("AU-Z O\nB"), "esm")) == "AXXXX"
    assert value(spark, sequences.tokens(F.lit("ACD"))) == "<AA2fold> A C D"
    assert value(spark, sequences.tokens(F.lit("acd"), is_3di=True)) == "<fold2AA> a c d"
    with pytest.raises(ValueError):
        sequences.mask_rare(c, "other")


FASTA = "junk\nmore junk\n>A/1-3 x \nAC-D  \n EF\n\n>>B\n>C/2-4\r\nGG\r\nTT\n>D\n"


@pytest.fixture
def fasta_dir(tmp_path):
    (tmp_path / "a.fasta").write_bytes(FASTA.encode())
    (tmp_path / "b.fasta").write_text(">X\nAAA")
    (tmp_path / "a.fa").write_text(">Y\nCCC\n")
    (tmp_path / "note.txt").write_text(">no\nNO\n")
    return tmp_path


def test_fasta_reader(spark, fasta_dir):
    rows = fasta.read_fasta(spark, str(fasta_dir / "a.fasta")).orderBy("pos").collect()
    assert [(r.pos, r.header, r.sequence) for r in rows] == [
        (0, ">A/1-3 x", "AC-D EF"), (1, ">>B", ""), (2, ">C/2-4", "GGTT"), (3, ">D", "")
    ]
    cleaned = fasta.read_embedder_input(spark, str(fasta_dir / "a.fasta"), " ", 0).orderBy("pos").collect()
    assert [(r.seq_id, r.key, r.sequence) for r in cleaned][:1] == [("A/1-3", "A_1-3", "ACDEF")]
    assert fasta.read_headers(spark, str(fasta_dir / "a.fasta")).count() == 4
    assert [r.fasta_id for r in fasta.read_ids(spark, str(fasta_dir / "a.fasta")).orderBy("pos").collect()] == ["A/1-3 x", "B", "C/2-4", "D"]


def test_fasta_reader_is_independent_of_splits(spark, tmp_path):
    text = "".join(f">S{i}/1-{i % 7}\n" + "ACDEFGHIKL\n" * (i % 5) for i in range(2000))
    (tmp_path / "big.fasta").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = fasta.read_fasta(spark, str(tmp_path / "big.fasta"))
        rows = df.orderBy("pos").collect()
        assert spark.read.text(str(tmp_path / "big.fasta")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [(r.pos, r.header, r.sequence) for r in rows] == [(i, f">S{i}/1-{i % 7}", "ACDEFGHIKL" * (i % 5)) for i in range(2000)]


def test_path_resolution(spark, fasta_dir):
    got = files.resolve_fasta(spark, str(fasta_dir))
    assert {k: v.rsplit("/", 1)[1] for k, v in got.items()} == {"a": "a.fa", "b": "b.fasta"}
    assert list(files.resolve_fasta(spark, [str(fasta_dir / "b.fasta"), str(fasta_dir / "missing")])) == ["b"]


def test_annotation_reader_rejects_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("id,term\nP,1.1.1.1\nP,1.1.1.1\n")
    bad.write_text("P,1.1.1.1\n\n")
    assert {tuple(r) for r in files.read_annotations(spark, str(good)).collect()} == {("id", "term"), ("P", "1.1.1.1")}
    with pytest.raises(Exception, match="expected 2 fields"):
        files.read_annotations(spark, str(bad)).collect()


def test_cluster_folder_counts_empty_files(spark, tmp_path):
    (tmp_path / "c 1.faa").write_text(">P/1-2\nX\n>Q\nX\n")
    (tmp_path / "c2.aln").write_text("")
    (tmp_path / "skip.txt").write_text(">Z/1\n")
    assert {r.cluster: r.size for r in files.folder_sizes(spark, str(tmp_path)).collect()} == {"c 1.faa": 2, "c2.aln": 0}
    from kinfold.operators import purity

    ann = spark.createDataFrame([("P", "1.1"), ("Q", "1.2")], "accession string, term string")
    members = files.read_cluster_folder(spark, str(tmp_path))
    assert purity.purity_summary(members, ann).first().pct_with_ec == 50
    strict = purity.cluster_purity(files.read_cluster_folder(spark, str(tmp_path), strict=True), ann).first()
    assert strict.n_occurrences == 1


def test_report_files_round_trip(spark, tmp_path):
    sizes = spark.createDataFrame([("b.faa", 2), ("a.faa", 0)], "cluster string, size long")
    files.write_sizes(sizes, str(tmp_path / "sizes"))
    assert {tuple(r) for r in files.read_sizes(spark, str(tmp_path / "sizes")).collect()} == {("a.faa", 0), ("b.faa", 2)}
    lines = [line for p in sorted((tmp_path / "sizes").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["num_files\t2", "family\tnum_sequences", "a.faa\t0", "b.faa\t2"]
    splits = spark.createDataFrame([("1.1", 3)], "term string, split_count long")
    files.write_splits(splits, str(tmp_path / "splits"))
    assert [tuple(r) for r in files.read_splits(spark, str(tmp_path / "splits")).collect()] == [("1.1", 3)]
    fam = spark.createDataFrame([(0, 0, "P/1-2"), (0, 1, "Q/1-2"), (1, 2, "R/1-2")], "cluster_id long, pos long, member string")
    files.write_families(fam, str(tmp_path / "fam"), text=True)
    back = fasta.read_fasta(spark, str(tmp_path / "fam" / "*"))
    assert {(r.header, r.sequence) for r in back.collect()} == {(">P/1-2", "X"), (">Q/1-2", "X"), (">R/1-2", "X")}


def test_tsv_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("r1\tm1\textra\nr1\tm1\nlonely\n\n")
    assert [tuple(r) for r in files.read_cluster_tsv(spark, str(tmp_path / "c.tsv")).collect()] == [("r1", "m1")] * 2
    (tmp_path / "l.tsv").write_text("s1\tF2\n\ns2\tF1\ns3\tF2\ns1\tF1\n")
    m = files.read_label_tsv(spark, str(tmp_path / "l.tsv"))
    assert {r.family: r.class_idx for r in labels.class_index(m).collect()} == {"F2": 0, "F1": 1}
    assert {r.seq_id: r.class_idx for r in labels.label_map(m).collect()} == {"s1": 1, "s2": 1, "s3": 0}


def test_exact_split(spark):
    ids_ = spark.range(101)
    a = {r.id: r.split for r in curate.exact_split(ids_, "id", 0.05).collect()}
    b = {r.id: r.split for r in curate.exact_split(ids_.repartition(7), "id", 0.05).collect()}
    other = {r.id: r.split for r in curate.exact_split(ids_, "id", 0.05, seed=7).collect()}
    assert list(a.values()).count("val") == 5 and len(a) == 101 and a == b and a != other
    hot = spark.range(50).select("id", F.lit(5).cast("long").alias("r"))  # all ranks tie
    assert [r.id for r in curate.exact_split(hot, "id", 0.1, F.col("r")).where("split = 'val'").collect()] == [0, 1, 2, 3, 4]
    assert curate.exact_split(ids_, "id", 0.0).where("split = 'val'").count() == 0
    assert curate.exact_split(ids_, "id", 1.0).where("split = 'val'").count() == 101


def test_positions_and_scans_cross_chunks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("g"))
    placed = ordering.with_position(df, ["g", "k"], total="n")
    rows = placed.orderBy("g", "k").collect()
    assert [r.pos for r in rows] == list(range(1000)) and {r.n for r in rows} == {1000}
    got = ordering.running(placed, ["g"], "pos", {"s": "k"}, {"m": "k"}, chunk=13)
    got = ordering.following(got, ["g"], "pos", "k", "nx", chunk=13).orderBy("pos").collect()
    total, best, last = 0, None, None
    for i, r in enumerate(got):
        if r.g != last:
            total, best, last = 0, None, r.g
        total += r.k
        nxt = got[i + 1].k if i + 1 < len(got) and got[i + 1].g == r.g else None
        assert (r.s, r.m, r.nx) == (total, best, nxt)
        best = r.k if best is None else max(best, r.k)


def greedy(lengths, max_batch, max_residues, max_len=None):
    out, batch, n, res = [], 0, 0, 0
    for v in lengths:
        out.append(batch)
        n, res = n + 1, res + v
        if n >= max_batch or res >= max_residues or (max_len is not None and v > max_len):
            batch, n, res = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_stream_batches_cross_chunks(spark, seed):
    import random

    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 9, 30, 200]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(5)
    got = batching.stream_batches(df, ["id"], 7, 60, 100 if seed else None, chunk=16).orderBy("pos").collect()
    assert [r.batch for r in got] == greedy(lengths, 7, 60, 100 if seed else None)


def test_batches_golden(spark):
    df = spark.createDataFrame(list(enumerate([2, 5, 1, 1])), "id long, length long")
    assert [r.batch for r in batching.stream_batches(df, ["id"], 100, 4000, 4).orderBy("id").collect()] == [0, 0, 1, 1]
    df = spark.createDataFrame(list(enumerate([1, 2, 3, 4, 5])), "id long, length long")
    b = batching.bucket_batches(batching.length_buckets(df, 10, "id"), 3, 8).orderBy("id").collect()
    assert [r.batch for r in b] == [1, 1, 1, 0, 0]


def test_buckets_golden(spark):
    df = spark.createDataFrame(list(enumerate([3, 0, 9, 4, 2])), "id long, length int")
    kept = batching.length_buckets(df, 2, "id", max_len=8)
    assert {(r.length, r.bucket) for r in kept.collect()} == {(3, 0), (4, 0), (2, 1)}
    stats = curate.run_stats(df.withColumn("key", F.col("id")), 8).first()
    assert (stats.n_seen, stats.n_empty, stats.n_long, stats.n_written, stats.avg_length) == (5, 1, 1, 3, 3.0)


def test_dedup_and_resume(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "key string, pos long")
    first = curate.first_wins(rows, "key", "pos")
    assert {(r.key, r.pos) for r in first.collect()} == {("a", 0), ("b", 1)}
    stored = spark.createDataFrame([("b",)], "key string")
    assert [r.key for r in curate.pending(first, stored).collect()] == ["a"]
    assert curate.pending(first, stored, overwrite=True).count() == 2


def test_label_quality_flag(spark):
    seqs = spark.range(20).select(F.col("id").alias("seq_id"))
    known = spark.range(19).select(F.col("id").alias("seq_id"))
    assert not labels.label_quality(seqs, known).first().warn
    assert labels.label_quality(seqs, known.limit(10)).first().warn


def _numbers(spark, path, version=None):
    return {r.key: r.embedding[0] for r in store.read_store(spark, path, version=version).collect()}


def test_store_versions(spark, tmp_path, monkeypatch):
    """A killed writer leaves the last version readable; a write leaves the files of other buckets alone."""
    path, schema = str(tmp_path / "v"), "key string, pos long, embedding array<double>"
    rows = spark.createDataFrame([(f"k{i}", i, [float(i)]) for i in range(200)], schema)
    store.put_missing(rows, path)
    before = store.manifest(spark, path)["folders"]
    assert len(before) == store.BUCKETS and _numbers(spark, path) == {f"k{i}": i for i in range(200)}
    few = spark.createDataFrame([("k3", 0, [-3.0]), ("new", 1, [7.0])], schema)
    touched = {str(b) for b in store.buckets_of(few, path)}
    store.put_over(few, path)
    after = store.manifest(spark, path)["folders"]
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) == 2
    want = {f"k{i}": i for i in range(200)} | {"k3": -3, "new": 7}
    assert _numbers(spark, path) == want and _numbers(spark, path, 0)["k3"] == 3
    store.put_missing(spark.createDataFrame([("k3", 0, [5.0]), ("late", 2, [9.0]), ("late", 1, [8.0])], schema), path)
    assert _numbers(spark, path) == want | {"late": 8}
    assert all(set(after[b]) <= set(store.manifest(spark, path)["folders"][b]) for b in after)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.put_over(few.withColumn("embedding", F.array(F.lit(0.0))), path)
    assert _numbers(spark, path) == want | {"late": 8}
    store.replace_store(store.read_store(spark, path).where("key in ('k1', 'k2')"), path)
    assert _numbers(spark, path) == {"k1": 1, "k2": 2} and _numbers(spark, path, 2) == want | {"late": 8}
    assert store.vacuum(spark, path) >= 2 + store.BUCKETS - 2 and _numbers(spark, path) == {"k1": 1, "k2": 2}
    assert store.versions(spark, path) == [3]


def test_lookup_reads_matching_buckets_only(spark, tmp_path):
    path = str(tmp_path / "v")
    store.put_missing(spark.range(1000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("pos"), F.array(F.col("id").cast("double")).alias("embedding")), path)
    wanted = spark.createDataFrame([("5",), ("77",), ("absent",), (None,)], "key string")
    n_read = store.read_store(spark, path, store.buckets_of(wanted, path)).count()
    assert 0 < n_read <= 4 * 1000 / store.BUCKETS
    hit, miss = store.lookup_stored(wanted, path)
    assert {(r.key, r.embedding[0]) for r in hit.collect()} == {("5", 5), ("77", 77)} and {r.key for r in miss.collect()} == {"absent", None}


def test_written_and_counted_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i}", i % 4 or None, [1.0] if i % 10 else None) for i in range(40)], "pos long, seq_id string, y int, v array<double>")
    needed, sc = {"label": F.col("y"), "vector": F.col("v")}, spark.sparkContext
    sc.setJobGroup("one pass", "count")
    whole, report = labels.write_complete(rows, needed, str(tmp_path / "t"), None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("one pass"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and whole.count() == 28
    assert {tuple(r) for r in report.collect()} == {("label", 40, 10, True), ("vector", 40, 4, True)}
    _, report = labels.write_complete(rows, needed, str(tmp_path / "u"), 0.5, id_col="seq_id")
    assert {r.what: r.first_missing for r in report.collect()} == {"label": "s0,s4,s8,s12,s16", "vector": "s0,s10,s20,s30"}
    with pytest.raises(ValueError, match="too many"):
        labels.write_complete(rows, needed, str(tmp_path / "w"), 0.1)
    assert not (tmp_path / "w").exists()


def test_store(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([("A_1-3", 0, [1.0, 2.0]), ("A_1-3", 1, [9.0, 9.0]), ("__meta__", 2, [0.0, 0.0])], "key string, pos long, embedding array<double>")
    store.put_missing(rows, path)
    store.put_missing(spark.createDataFrame([("A_1-3", 0, [5.0, 5.0]), ("B_2-4", 1, [0.0, 0.0])], rows.schema), path)
    back = {r.key: list(r.embedding) for r in store.read_store(spark, path).collect()}
    assert back == {"A_1-3": [1, 2], "__meta__": [0, 0], "B_2-4": [0, 0]}
    assert {r.key for r in store.keys(spark, path).collect()} == {"A_1-3", "B_2-4"}
    exported = store.export_store(store.read_store(spark, path))
    assert {r.label: list(r.embedding) for r in store.import_vectors(exported).collect()} == {"A/1-3": [1, 2], "B/2-4": [0, 0]}
    new = spark.createDataFrame([("B_2-4", 2, [7.0, 7.0])], store.STORE_SCHEMA)
    assert {r.key: list(r.embedding) for r in store.upsert(store.read_store(spark, path), new).collect()}["B_2-4"] == [7, 7]
    store.write_meta(spark, path, {"model": "one"})
    store.write_meta(spark, path, {"model": "two"})
    assert spark.read.parquet(path + ".meta").first().value == "one"
    with pytest.raises(Exception, match="expected 3"):
        store.check_dim(store.read_store(spark, path), 3).collect()


def test_half_precision_codec(spark):
    from kinfold.functions import vectors as V

    df = spark.createDataFrame([([0.1, -2.0, 65504.0],)], "v array<double>")
    coded = df.select(V.encode_half(F.col("v")).alias("b"))
    back = coded.select(F.length("b").alias("n"), V.decode_half(F.col("b"), 3).alias("v")).first()
    assert back.n == 6 and back.v[1:] == [-2.0, 65504.0] and abs(back.v[0] - 0.1) < 1e-4
    with pytest.raises(Exception, match="expected 4"):
        coded.select(V.decode_half(F.col("b"), 4)).collect()


class Flaky(embed.CodePointEmbedder):
    def __call__(self, seqs):
        if any("!" in s for s in seqs):
            raise RuntimeError("out of memory")
        return super().__call__(seqs)


def test_embedding_policies(spark):
    rows = [(0, 0, k, s) for k, s in enumerate(["AC", "D!", "EFG", "HI"])]
    df = spark.createDataFrame(rows, "bucket long, batch long, key long, sequence string")
    spark.sparkContext.addPyFile(__file__)
    bisect = {r.key: r.status for r in embed.embed(df, Flaky).collect()}
    assert bisect == {0: "embedded", 1: "failed", 2: "embedded", 3: "embedded"}
    assert {r.status for r in embed.embed(df, Flaky, policy="drop").collect()} == {"failed"}
    s = embed.embed_stats(embed.embed(df, Flaky)).first()
    assert (s.n_embedded, s.n_failed, s.avg_length) == (3, 1, pytest.approx(7 / 3))
    full = embed.embed(df.where("key = 2"), pool=False).first()
    assert len(full.embedding) == 3 and len(full.embedding[0]) == 8


def test_families_are_written_by_as_many_tasks_as_rows_ask_for(spark, tmp_path):
    members = spark.range(400).select((F.col("id") % 40).alias("cluster_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("member"))
    files.write_families(members, str(tmp_path / "fam"), task_rows=20)
    assert 15 <= len(list((tmp_path / "fam").glob("*.parquet"))) <= 20
    back = files.read_cluster_folder(spark, str(tmp_path / "fam"))
    assert back.count() == 400 and back.select("cluster").distinct().count() == 40
