"""Lexical search against a plain version, block by block and with many ties."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    seen = [(i, t) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(seen), sum(len(t) for _, t in seen)
    df = Counter(x for _, t in seen for x in set(t))
    out = []
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, []).extend(terms(text))
    for item, want in wanted.items():
        found = []
        for i, t in seen:
            m, tf = 25 + 75 * len(t) * n_docs // n_terms, Counter(t)
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in want if tf[x])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


ITEMS = [(1, "the cat"), (2, "Cat CAT cat the"), (3, None), (4, ""), (5, "nowhere"), (6, "übung 日本 x1"), (7, "the"), (7, "dog's"), (None, "cat"), (8, "a-b_c"), (9, "cat " * 50)]
DOCS = [(1, "The cat, the dog!"), (2, None), (3, ""), (4, "cat"), (5, "cat"), (5, "CAT"), (None, "cat cat"), (6, "Übung übung 日本。x1"), (7, " - "), (8, "scat cats c at"), (9, "a b c _ a"), (10, "dog the " * 5000 + "s"), (11, "日本 日本語"), (11, "日本 日本語")]


@pytest.mark.parametrize("setting", [{}, {"block_bytes": 60}, {"k": 2}])
def test_odd_rows(spark, setting):
    extra = ["id", "item", "term", "n", "tf", "score", "rank", "part"]
    clash = ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*d, *extra) for d in DOCS], f"doc_id bigint, text string, {clash}").repartition(3)
    items = spark.createDataFrame([(*d, *extra) for d in ITEMS], f"item_id int, text string, {clash}")
    got = lexical.search(docs, items, **setting)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute(DOCS, ITEMS, setting.get("k", 10))
    assert lexical.search(docs.where("false"), items).collect() == lexical.search(docs, items.where("false")).collect() == []


def test_scorer_by_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "MATRIX_ENTRIES", 50)
    monkeypatch.setattr(lexical, "TABLE_ENTRIES", 90)
    rng = np.random.default_rng(11)
    table = np.where(rng.random((40, 13)) < 0.3, rng.integers(1, 4, (40, 13)), 0)
    table[0, 5] = 1
    term, item = np.nonzero(table)
    scorer = lexical.Scorer(13, term, item, table[term, item], 6)
    assert len(scorer.groups) > 2
    for _ in range(4):
        held = rng.random((30, 40)) < 0.2
        owner, terms = np.nonzero(held)
        parts = np.ones(len(owner), np.int64)
        want = held.astype(int) @ table
        got = [x for part in scorer.best(owner, terms, parts) for x in zip(*(c.tolist() for c in part))]
        for i in range(13):
            assert [(d, s) for it, d, s in got if it == i] == sorted(((d, s) for d, s in enumerate(want[:, i].tolist()) if s > 0), key=lambda x: (-x[1], x[0]))[:6]


def test_many_ties(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for k in range(300)] + [(k, "w1 w2 w3 w1") for k in range(300, 700)]
    rng.shuffle(docs)
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=9))) for k in range(40)] + [("hot", "w1 w2")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame(items, "item_id string, text string"))
    want = brute(docs, items, 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_blocks_hold_whole_items(spark):
    items = spark.createDataFrame([(k, f"alpha beta w{k}") for k in range(200)], "item_id bigint, text string")
    blocks = list(lexical._blocks(lexical.item_terms(items), 2000))
    assert len(blocks) > 5 and max(sum(len(r.term) + 16 for r in b) for b in blocks) < 4000
    assert sum(len({r["item"] for r in b}) for b in blocks) == 200
