"""The pipeline's stages, each on its own input, against brute force; the registered queries; and what happens without the subpackage."""

import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
from test_operators import SF, brute_lines, components, ordered, semi_global, shingles, texts  # noqa: F401

import corpus_pipeline
from kinfold.llm import decontaminate, toxicity, vocab

ROOT = Path(__file__).resolve().parents[2]
BY_NAME = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_toxicity_stage(spark, docs):
    kept = BY_NAME["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}


def test_line_stage(spark, docs):
    out = BY_NAME["line_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    want = [(i, t, len(t)) for i, n, gone, t in brute_lines(sorted(texts(docs))) if not gone or gone < n]
    assert ordered((r.doc_id, r.text, r.n_chars) for r in out.collect()) == ordered(want)


def test_near_stage(spark, docs):
    out = BY_NAME["near_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    rows = texts(docs)
    sets, _, least = components(rows, 80)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for (i, _), s, c in zip(rows, sets, least) if not s or i == c)


def test_leak_stage(spark, docs):
    out = BY_NAME["decontamination"](spark, docs, SF)
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for i, t in texts(docs):
        words = decontaminate.words_of(t)
        if not any(len(set(words) & set(x)) >= 0.5 * len(set(x)) and semi_global(x, words) <= int(0.2 * len(x) + 1e-9) for x in items):
            clean.append(i)
    assert sorted(r.doc_id for r in out.collect()) == sorted(clean) and out.columns == docs.columns


def test_run(spark):
    import tiktoken

    ranks = {t: i for i, t in enumerate(vocab.read_ranks(vocab.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        text = library.decode_bytes(r.ids)
        assert library.encode_ordinary(text.decode()) == r.ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    rows = [(1, None, "x"), (2, "", "x"), (None, "one two three four five six", "x"), (3, "one two three four five six", "x"), (3, "one two three four five six", "x"), (4, " \n", "x")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    for df in (odd, odd.limit(0)):
        out = BY_NAME[name](spark, df, SF)
        if name != "bpe":
            assert out.columns == df.columns
        want = 0 if not df.count() else {"near_dedup": 4}.get(name, 6)
        assert out.count() == want


def test_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries

    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in queries() and "op5_line_windows" in oracle_sql()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('kinfold.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 60 and not [n for n in e.queries() if n.startswith('op')]\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
