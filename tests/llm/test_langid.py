"""Language identification against a plain Python version, and on held-out rows."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import langid

SF = "/root/testdata/sf0.01"


def letters(text):
    out = " "
    for c in text:
        low = (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " "
        if low != " " or out[-1] != " ":
            out += low
    return out if out[-1] == " " else out + " "


def bucket(gram, bits):
    """The hash, one character at a time from the last to the first, in 32 bits."""
    mask = 0xFFFFFFFF
    h = ord(gram[-1]) * 0x9E3779B1 & mask
    for c in reversed(gram[:-1]):
        h = ((h ^ (h >> 15)) * 0x85EBCA77 + ord(c)) & mask
    return ((h ^ (h >> 13)) * 0xC2B2AE3D & mask) >> (32 - bits)


def grams(text):
    s = letters(text)
    return [s[k : k + n] for n in langid.LENGTHS for k in range(len(s) - n + 1) if s[k : k + n] != " "]


def brute(train, texts, bits):
    langs = sorted({lang for lang, t in train if grams(t)})
    sums = {lang: Counter() for lang in langs}
    n = Counter()
    for lang, t in train:
        if grams(t):
            n[lang] += 1
            sums[lang].update(bucket(g, bits) for g in grams(t))
    out = []
    for t in texts:
        logits = {}
        for lang in langs:
            total = sum(sums[lang].values()) + langid.SMOOTHING * 2**bits
            weight = lambda b: round(math.log((sums[lang][b] + langid.SMOOTHING) / total) * langid.UNIT)  # noqa: E731, B023
            logits[lang] = math.log(n[lang] / sum(n.values())) + sum(weight(bucket(g, bits)) for g in grams(t or "")) / langid.UNIT
        if not langs or not grams(t or ""):
            out.append(("und", 0.0))
            continue
        best = max(langs, key=lambda x: (logits[x], -langs.index(x)))
        out.append((best, 1 / sum(math.exp(v - logits[best]) for v in logits.values())))
    return out


TRAIN = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "Der Hund, die Katze!", "de"), (4, "the cat and the dog", "en"), (5, "12 34", "xx"), (6, None, "yy"), (7, "nobody's", None)]
ODD = ["", None, " \n", "a", "Ł", "the", "chat--chat  chat", "日本語 text", "İstanbul", "1", "the cat " * 300, "x" * 999 + " ," * 40 + "y" * 80]


@pytest.mark.parametrize("piece", [langid.PIECE, 64, 5])
def test_against_plain_python(spark, monkeypatch, piece):
    model = langid.fit(spark.createDataFrame([r[1:] for r in TRAIN], "text string, lang string"), bits=12)
    assert model.langs == ("de", "en", "fr")
    monkeypatch.setattr(langid, "PIECE", piece)
    texts = [*ODD, *[t for _, t, _ in TRAIN]]
    langs, score = model.predict(texts)
    want = brute([(lang, t) for _, t, lang in TRAIN if t and lang], texts, 12)
    assert langs == [w[0] for w in want]
    assert np.allclose(score, [w[1] for w in want], atol=1e-9)


def test_odd_tables(spark, monkeypatch):
    extra = ["id", "bucket", "n", "texts", "score", "row"]
    rows = [(i, t, lang, *extra) for i, t, lang in [*TRAIN, *[(k + 10, t, "en") for k, t in enumerate(ODD)], (10, "twice", "en"), (10, "twice", "en"), (None, "ohne Nummer", "de")]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in extra)).repartition(3)
    got = langid.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.held_out for r in found} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    plain = Counter((i, not grams(t or "")) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.lang_pred == "und") for r in found) == plain
    assert langid.identify(df.where("doc_id < 0")).collect() == []
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 2 << 10)
    with pytest.raises(ValueError, match="fewer bits"):
        langid.fit(df, bits=10)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    # what is held out is not read
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2, F.col("lang")))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(other).collect())
