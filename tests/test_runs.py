"""The file-to-file runs, end to end on small files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators.head import Head, load_head, save_head
from kinfold.plans import runs
from kinfold.sources import fasta, files, store


def write(path, text):
    path.write_text(text)
    return str(path)


def test_split_file(spark, tmp_path):
    src = write(tmp_path / "all.fasta", "".join(f">S{i}/1-2\nAC\nDE\n" for i in range(101)))
    n = {r.split: r.n for r in runs.split_file(spark, src, str(tmp_path / "out")).collect()}
    assert n == {"val": 5, "train": 96}
    back = [r.header for p in ("train", "val") for r in fasta.read_fasta(spark, str(tmp_path / "out" / f"{p}.fasta")).collect()]
    assert sorted(back) == sorted(f">S{i}/1-2" for i in range(101))


@pytest.mark.parametrize("family, stored", [("esm", {"A_1-3", "B_1-2"}), ("t5", {"A_1-3", "B_1-2", "LONG_1-9"})])
def test_embed_export_project(spark, tmp_path, family, stored):
    src = write(tmp_path / "s.fasta", ">A/1-3\nAC-D\n>B/1-2\nEU\n>A/1-3\nAAA\n>LONG/1-9\nACDEFGHIK\n")
    path = str(tmp_path / "store")
    first = runs.embed_file(spark, src, path, family, max_seq_len=8).first()
    assert (first.n_seen, first.n_embedded, first.n_long) == (4, len(stored), 1 if family == "esm" else 0)
    assert {r.key for r in store.keys(spark, path).collect()} == stored
    again = runs.embed_file(spark, src, path, family, max_seq_len=8).first()
    assert again.n_embedded == 0 and store.read_store(spark, path).count() == len(stored)

    wanted = write(tmp_path / "w.fasta", ">B/1-2\nX\n>MISSING/1-2\nX\n>A/1-3\nX\n")
    exported, missing = runs.export_file(spark, path, wanted, unit=True)
    assert [r.label for r in exported.orderBy("pos").collect()] == ["B/1-2", "A/1-3"]
    assert [r.label for r in missing.collect()] == ["MISSING/1-2"]
    assert all(math.isclose(np.linalg.norm(r.mean_representations[33]), 1, rel_tol=1e-6) for r in exported.collect())
    assert {r.label for r in runs.export_file(spark, path)[0].collect()} >= {"A/1-3", "B/1-2"}

    head = Head.create(8, [6], 4, seed=1)
    save_head(spark, head, str(tmp_path / "head"))
    loaded = load_head(spark, str(tmp_path / "head"))
    out = runs.project_file(spark, loaded, path, wanted).orderBy("pos").collect()
    raw = {r.key: np.array(r.embedding, float) for r in store.read_store(spark, path).collect()}
    assert [r.label for r in out] == ["B/1-2", "A/1-3"]
    assert np.allclose(out[1].mean_representations[33], head.forward(raw["A_1-3"][None])[0], atol=1e-6)


def test_cluster_and_score(spark, tmp_path):
    angles = {"r1/1-2": 0.0, "r2/1-2": 0.01, "r3/1-2": 1.0, "r4/1-2": 1.02, "r5/1-2": 2.5}
    rows = [(i, k, {33: [math.cos(a), math.sin(a)]}) for i, (k, a) in enumerate(angles.items())]
    exported = spark.createDataFrame(rows, "pos long, label string, mean_representations map<int,array<double>>")
    tsv = files.read_cluster_tsv(spark, write(tmp_path / "c.tsv", "r1/1-2\tr1/1-2\nr1/1-2\tm1/4-9\nr3/1-2\tr3/1-2\n"))
    ann = files.read_annotations(spark, write(tmp_path / "ec.csv", "r1,1.1.1.1\nm1,1.1.1.1\nr2,1.1.1.2\nr3,2.1.1.1\n"))
    members, size, report = runs.cluster_and_score(exported, tsv, ann, output_dir=str(tmp_path / "fam"))
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster_id, set()).add(r.member)
    assert got == {0: {"r1/1-2", "m1/4-9", "r2/1-2"}, 1: {"r3/1-2", "r4/1-2"}, 2: {"r5/1-2"}}
    assert size.first().n_clusters == 3
    r = report.first()
    assert r.pct_with_ec == pytest.approx(200 / 3) and r.avg_ec4_purity == pytest.approx((2 / 3 + 1) / 2) and r.avg_ec3_purity == 1
    again = {}
    for r in files.read_cluster_folder(spark, str(tmp_path / "fam")).collect():
        again.setdefault(r.cluster, []).append(r.accession)
    assert sorted(map(len, again.values())) == [1, 2, 3]


def test_folder_reports(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    write(folder / "a.faa", ">P/1-2\nX\n>Q/1-2\nX\n")
    write(folder / "b.aln", ">P/3-4\nX\n")
    write(folder / "empty.faa", "")
    ec = write(tmp_path / "ec.csv", "P,1.1.1.1\nQ,1.1.2.1\n")
    assert runs.purity_report(spark, ec, str(folder)).first().pct_with_ec == pytest.approx(200 / 3)
    report, frag = runs.fragmentation_report(spark, ec, str(folder), str(tmp_path / "splits"))
    f = frag.first()
    assert (f.total_clusters, f.total_ec4_terms, f.median_split_count, f.pct_terms_in_one_cluster) == (3, 2, 1.5, 50)
    assert {tuple(r) for r in files.read_splits(spark, str(tmp_path / "splits")).collect()} == {("1.1.1.1", 2), ("1.1.2.1", 1)}
    assert [tuple(r) for r in runs.size_report(spark, str(folder)).collect()] == [("a.faa", 2), ("b.aln", 1), ("empty.faa", 0)]
    assert report.agg(F.count(F.lit(1))).first()[0] == 1


def test_several_files_and_repeated_ids(spark, tmp_path):
    """Record numbers hold over all files: nothing is multiplied or chosen by its place in one file."""
    folder = tmp_path / "seqs"
    folder.mkdir()
    for f in range(3):
        write(folder / f"f{f}.fasta", "".join(f">S{f}_{i}/1-2\nACDE\n" for i in range(20)))
    for family in ("esm", "t5"):
        path = str(tmp_path / family)
        assert runs.embed_file(spark, str(folder), path, family).first().n_embedded == 60
        assert store.read_store(spark, path).count() == 60
    n = {r.split: r.n for r in runs.split_file(spark, str(folder), str(tmp_path / "out"), val_size=0.12).collect()}
    assert n == {"val": 7, "train": 53}
    wanted = write(tmp_path / "w.fasta", ">S0_1/1-2\nX\n>S0_1/1-2\nX\n>S2_3/1-2\nX\n")
    exported, missing = runs.export_file(spark, path, wanted)
    assert [r.label for r in exported.orderBy("pos").collect()] == ["S0_1/1-2", "S0_1/1-2", "S2_3/1-2"] and missing.count() == 0
    assert runs.project_file(spark, Head.create(8, [6], 4, seed=1), path, wanted).count() == 3


def test_overwriting_takes_the_last_record_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "store")
    runs.embed_file(spark, write(tmp_path / "a.fasta", ">A/1-2\nAC\n>B/1-2\nDE\n"), path, "t5")
    new = write(tmp_path / "b.fasta", ">A/1-2\nGH\n>A/1-2\nKK\n")
    want = runs.embed.CodePointEmbedder()(["KK"])[0].mean(axis=0).astype(np.float16)
    for _ in range(2):
        runs.embed_file(spark, new, path, "t5", overwrite=True)
        got = {r.key: np.array(r.embedding) for r in store.read_store(spark, path).collect()}
        assert set(got) == {"A_1-2", "B_1-2"} and np.allclose(got["A_1-2"], want)


def test_families_are_scored_as_written(spark, tmp_path):
    fam = spark.createDataFrame([(0, 0, "P/1-2"), (0, 1, "Q/1-2"), (1, 2, "R/1-2")], "cluster_id long, pos long, member string")
    for text in (False, True):
        files.write_families(fam, str(tmp_path / f"fam{text}"), text=text)
        got = sorted((r.cluster, r.accession) for r in files.read_cluster_folder(spark, str(tmp_path / f"fam{text}")).collect())
        assert got == [("cluster_00000.faa", "P"), ("cluster_00000.faa", "Q"), ("cluster_00001.faa", "R")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no cluster"):
        files.read_cluster_folder(spark, str(tmp_path / "none"))


def test_bad_size_rows_fail(spark, tmp_path):
    good = write(tmp_path / "good.tsv", "num_files\t2\nfamily\tnum_sequences\na\t1\nnum_files\t9\n")
    assert {tuple(r) for r in files.read_sizes(spark, good).collect()} == {("a", 1), ("num_files", 9)}
    with pytest.raises(Exception, match="not a size row"):
        files.read_sizes(spark, write(tmp_path / "bad.tsv", "num_files\t2\nfamily\tn\na\t1\nb\tbad\n")).collect()


def test_scratch_must_be_shared_on_a_cluster(spark):
    from kinfold.session import checkpoint, discard, refuse_local_scratch

    for master in ("yarn", "k8s://x", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            refuse_local_scratch(master, None)
        refuse_local_scratch(master, "/shared")
    refuse_local_scratch("local[8]", None)
    table = checkpoint(spark.range(3))
    assert table.count() == 3
    discard(table)
    with pytest.raises(Exception):
        table.count()
