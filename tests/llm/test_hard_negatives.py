"""Hard negatives against a plain version; the look-ups against products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import hard_negatives as hn


def brute(rows, is_anchor, positives=5, k=5):
    def number(v):
        return [math.floor(256 * float(np.float32(x))) for x in v]

    good = [(i, y, number(v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in good:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, y) for i, y, w in good if i != a]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            near = sorted(r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s)[:k]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [0, 1, 8, 13, 64])
@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_look_ups_equal_products(width, kind):
    rng = np.random.default_rng(12)
    a, x = rng.integers(-300, 300, (7, width)), rng.integers(-5000, 5000, (50, width))
    assert (hn.scores(hn.bit_planes(x), hn.subset_sums(a, kind)) == x @ a.T).all()
    assert (hn.scores(hn.bit_planes(x * 0), hn.subset_sums(a, kind)) == 0).all()
    extremes = np.array([[-256] * width, [255] * width, [-1] * width, [0] * width])
    assert (hn.scores(hn.bit_planes(extremes), hn.subset_sums(a, kind)) == extremes @ a.T).all()


def frame(spark, rows):
    extra = ["id", "vec", "which", "rank", "anchor", "score"]
    schema = "vec_id bigint, label int, embedding array<float>, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(4)


@pytest.mark.parametrize("setting", [{}, {"block_bytes": 200}])
def test_odd_rows(spark, setting):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 3), [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(10)]) for k in range(400)]
    rows += [(k, 0, [1.0] * 10) for k in range(400, 460)]  # copies: ties by id
    rows += [(500, None, [1.0]), (None, 1, [1.0]), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")]), (504, 1, [float("inf"), 1.0])]
    rows += [(600, 2, []), (601, 2, [0.5, 0.5]), (602, 3, [0.5] * 30), (350, 3, [0.3] * 10), (350, 3, [0.3] * 10), (700, 9, [1.0] * 10)]
    df = frame(spark, rows)
    got = hn.mine(df, F.col("vec_id") % 50 == 0, **setting)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 50 == 0)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want
    assert hn.mine(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert hn.mine(df, F.lit(None).cast("boolean")).collect() == []


def test_scores_beyond_the_bound(spark):
    df = spark.createDataFrame([(1, 1, [1e9]), (2, 1, [1.0])], "vec_id bigint, label int, embedding array<double>")
    with pytest.raises(OverflowError, match="2\\^23"):
        hn.mine(df, F.col("vec_id") == 1)


def test_batches_and_groups_of_anchors(monkeypatch):
    monkeypatch.setattr(hn, "TABLE_ANCHORS", 3)
    monkeypatch.setattr(hn, "BATCH_ROWS", 16)
    rng = np.random.default_rng(5)
    x, labels, ids = rng.integers(-4, 5, (200, 9)), rng.integers(0, 3, 200), rng.permutation(200)
    order = np.argsort(labels[:10], kind="stable")
    a = hn.Anchors(ids[:10][order], labels[:10][order], x[:10][order], np.full((10, 2), -10), np.tile([5, 40], (10, 1)), False, 4)
    best = hn.Best(a)
    for at in range(0, 200, 60):
        best.add(ids[at : at + 60], labels[at : at + 60], x[at : at + 60])
    for n in range(10):
        s = x @ a.numbers[n]
        for j, most in enumerate((5, 40)):
            want = sorted((-v, i) for v, i, y in zip(s, ids, labels) if y != a.labels[n] and -10 <= v <= most)[:4]
            assert list(zip((-best.score[n, j]).tolist(), best.id[n, j].tolist())) == want
