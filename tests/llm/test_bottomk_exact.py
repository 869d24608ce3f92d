"""The sketch and both likenesses against plain Python, value by value."""

import re

import xxhash
from pyspark.sql import functions as F

from kinfold.llm import bottomk

SF = "/root/testdata/sf0.001"


def hashed(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def sketch(text, k=bottomk.K):
    words = [w for w in re.split("[ \t-\r]+", text.lower()) if w]
    if len(words) < 5:
        return [hashed(words)] if words else []
    return sorted({hashed(words[i : i + 5]) for i in range(len(words) - 4)})[:k]


def likeness(a, b, k=bottomk.K):
    if not a or not b:
        return float(not a and not b)
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union)


def test_least_hashes_and_likenesses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    own = {r.doc_id: list(r.s) for r in docs.select("doc_id", bottomk.words(F.col("text")).alias("w")).select("doc_id", bottomk.sketch(F.col("w")).alias("s")).collect()}
    got = {r.doc_id: r for r in bottomk.edit_likeness(docs, ranges=3).collect()}
    for (i, text), (j, following) in zip(texts, texts[1:] + texts[:1]):
        s, n = sketch(text), len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        assert own[i] == s
        assert got[i].near_next == likeness(s, sketch(following))
        assert got[i].near_edited == likeness(s, sketch(edited))
