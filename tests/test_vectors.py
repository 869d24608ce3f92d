import math
import time

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.operators import density, head, losses, mst, neighbors, train


def frame(spark, x, first=0):
    rows = [(first + i, [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


#: Sizes at which small tables go through every part: cells inside cells, rounds on Spark, homes below long chains cut into stretches.
SMALL = {"tile_rows": 16, "block_rows": 4, "last_edges": 20, "home_rows": 6, "chunk": 5}


def labels_of(spark, x, **kw):
    got = {r.id: r.label for r in density.hdbscan(frame(spark, x), **kw).collect()}
    return [got[i] for i in range(len(x))]


def test_normalisation_modes(spark):
    df = frame(spark, [[3, 4], [0, 0]])
    keep = [r.embedding for r in V.with_unit(df).orderBy("id").collect()]
    assert keep == [[0.6, 0.8], [0, 0]]
    assert all(math.isnan(v) for v in V.with_unit(df, zero="nan").orderBy("id").collect()[1].embedding)
    assert V.with_unit(df, zero="clamp").orderBy("id").collect()[1].embedding == [0, 0]


# the root is never selected; a parent wins against its children only when it is at least as stable
@pytest.mark.parametrize("points, want", [
    ([0, 1, 10, 11.5, 40], [0, 0, 1, 1, -1]),
    ([0, 1, 3, 4, 50, 51], [0, 0, 1, 1, 2, 2]),
    ([0, 1, 2.5, 3.5, 50, 51], [0, 0, 0, 0, 1, 1]),
    ([0, 1], [-1, -1]),
    ([5], [-1]),
])
def test_lines(spark, points, want):
    assert labels_of(spark, np.array(points, float)[:, None], normalize=False, min_samples=min(2, len(points))) == want


def test_metric_matters(spark):
    angles = np.array([0, 0.01, 0.026, 0.036, 1.5, 1.51])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    assert labels_of(spark, x) == [0, 0, 0, 0, 1, 1]
    assert labels_of(spark, x, metric="cosine") == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize(
    "seed, dim, min_samples, copies, sizes",
    [(0, 2, 2, False, {}), (1, 1, 2, True, {}), (2, 3, 4, True, {}), (0, 2, 2, False, {"tile_rows": 16, "block_rows": 4, "home_rows": 20}), (2, 3, 4, True, SMALL)],
)
def test_against_brute_force(spark, seed, dim, min_samples, copies, sizes):
    """With copies, a third of the rows are one and the same vector."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (20, dim)) for c in (0, 3, 9)])
    if copies:
        x[rng.permutation(len(x))[:20]] = x[0]
    got = labels_of(spark, x, normalize=False, min_samples=min_samples, **sizes)
    assert got == brute.canonical(brute.hdbscan(x, min_samples))


@pytest.mark.parametrize("copies", [0, 6])
def test_condensed_tree(spark, copies):
    """The same tree whatever a task may hold; sizes and densities of every cluster as in a plain recursion."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(70, 2))
    x[:copies] = x[9]
    got = density.condensed_tree(frame(spark, x), normalize=False)
    assert got.columns == ["parent", "child", "lambda", "size"]
    rows = sorted(map(tuple, got.collect()))
    assert sorted(map(tuple, density.condensed_tree(frame(spark, x), normalize=False, home_rows=12, chunk=7).collect())) == rows
    assert sorted(r[1] for r in rows if "-" not in r[1]) == sorted(map(str, range(70)))
    members, name, want = {i: {i} for i in range(70)}, {}, []
    for d, i, j in brute.kruskal(brute.mutual_reachability(x, 2)):
        a, b = (next(k for k, m in members.items() if p in m) for p in (i, j))
        big = [k for k in (a, b) if k in name]
        new = name[big[0]] if len(big) == 1 else f"{i}-{j}"
        for k in (a, b):
            if k not in name or len(big) == 2:
                want.append((new, name.get(k, str(k)), math.inf if d == 0 else pytest.approx(1 / d), len(members[k])))
        both = members.pop(a) | members.pop(b)
        name = {k: v for k, v in name.items() if k not in big} | {min(both): new}
        members[min(both)] = both
    assert rows == sorted(want, key=lambda r: r[:2])
    assert density.condensed_tree(frame(spark, x[:1]), normalize=False, min_samples=1).collect() == []


@pytest.mark.parametrize("min_samples", [2, 3])
def test_cosine_zero_vectors(spark, min_samples):
    """At distance 1 from everything; the rest are two tight bundles pointing in opposite directions."""
    rng = np.random.default_rng(8)
    half = rng.normal([1, 0, 0], 0.05, (8, 3))
    x = np.concatenate([half, -half[:7] + rng.normal(0, 0.01, (7, 3)), np.zeros((2, 3))])
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    got = labels_of(spark, x, metric="cosine", min_samples=min_samples, tile_rows=8, block_rows=4)
    assert got == brute.canonical(brute.hdbscan(unit, min_samples, "cosine"))


def test_planted_blobs_and_permutation(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(8, 8)))[0][:3]
    x = np.concatenate([c + rng.normal(0, 0.01, (15, 8)) for c in centres])
    perm = rng.permutation(len(x))
    a = np.array(labels_of(spark, x, tile_rows=16, block_rows=4))
    b = np.array(labels_of(spark, x[perm]))
    assert brute.canonical(a[perm]) == list(b)
    for i in range(3):
        own = np.arange(15 * i, 15 * i + 15)
        assert not (set(a[own]) & set(np.delete(a, own))) - {-1}


@pytest.mark.parametrize("min_samples", [2, 5])
def test_spanning_tree_is_the_one_of_its_order(spark, min_samples):
    """Equal reachabilities are ordered by ids, whatever the tiles."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    want = {(i, j) for _, i, j in brute.kruskal(brute.mutual_reachability(x, min_samples))}
    for sizes in ({}, {"tile_rows": 16, "block_rows": 5, "last_edges": 100}):
        tree = mst.tree_edges(density.spanning_rounds(frame(spark, x), min_samples=min_samples, normalize=False, **sizes)).collect()
        assert {(r.lo, r.hi) for r in tree} == want


def cells_of(spark, x, **sizes):
    return neighbors.build_cells(neighbors.distinct_points(frame(spark, x)), **sizes)


def test_nested_cells_and_tiles(spark):
    """Cells are nested and bounded, small ones share tiles, and a point travels to at most an eighth as many tiles as there are blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    cells = cells_of(spark, x, tile_rows=128, block_rows=8, fan=4)
    tree, rows = cells.tree, cells.points.collect()
    assert tree.level.max() >= 3 and max(np.bincount([r.tile for r in rows])) <= 128
    paths = tree.paths()
    for r in rows:
        for c in paths[r.cell]:
            if c > 0:
                assert np.linalg.norm(np.array(r.vec) - tree.pivot[c]) <= tree.radius[c] + 1e-12
    none = neighbors.replace(tree, reach=np.full(len(tree.parent), np.inf))
    copies = neighbors.tile_pairs(neighbors.replace(cells, tree=none)).groupBy("id").count().agg(F.max("count")).first()[0] + 1
    assert copies == tree.n_tiles <= 1500 / 8 / 8
    far = np.concatenate([rng.normal(50 * i, 0.5, (40, 2)) for i in range(6)])
    apart = cells_of(spark, far, tile_rows=40, block_rows=8)
    kept = neighbors.tile_pairs(neighbors.replace(apart, tree=apart.tree.upwards(np.full(apart.tree.n_tiles, 1.0), np.zeros(len(apart.tree.parent))))).select("lo", "hi").distinct().count()
    assert kept < apart.tree.n_tiles * (apart.tree.n_tiles - 1) / 4


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 20, "block_rows": 6, "fan": 3}])
@pytest.mark.parametrize("min_samples, k", [(1, 3), (5, 3), (8, 5)])
def test_nearest_by_reachability(spark, sizes, min_samples, k):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(90, 3)), rng.normal(4, 0.2, (30, 3))])
    cells = cells_of(spark, x, **sizes)
    cores = neighbors.core_distances(cells, min_samples) if min_samples > 1 else None
    got = [(r.id, r.rank, r.neighbor) for r in neighbors.nearest(cells, k, cores).orderBy("id", "rank").collect()]
    reach = brute.mutual_reachability(x, min_samples)
    np.fill_diagonal(reach, np.inf)
    assert got == [(i, r + 1, j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), reach[i]))[:k])]


def tile(x, first=0, **more):
    return pd.DataFrame({"id": np.arange(first, first + len(x)), "vec": list(x), "tile": 0, **more})


def counted(monkeypatch, *modules):
    """How many pairs are measured from here on."""
    seen, measure, whole = [0], neighbors.Rows.measure, neighbors.distances
    monkeypatch.setattr(neighbors.Rows, "measure", lambda x, y, i, j: (seen.__setitem__(0, seen[0] + len(i)), measure(x, y, i, j))[1])
    for m in modules:
        monkeypatch.setattr(m, "distances", lambda x, y: (seen.__setitem__(0, seen[0] + len(x) * len(y)), whole(x, y))[1])
    return seen


#: without structure; a lattice, where most distances are equal; far from the origin, where products round most
POINTS = {
    "normal": np.random.default_rng(8).normal(size=(1200, 32)),
    "lattice": np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3),
    "far": 1e6 + np.random.default_rng(9).normal(size=(300, 8)),
}


@pytest.mark.parametrize("kind", POINTS)
@pytest.mark.parametrize("cored", [False, True])
def test_nearest_measures_few_pairs(monkeypatch, kind, cored):
    """Tiles by themselves and a pair of them, against all pairs; of points without structure no more than a twentieth is measured."""
    x, k = POINTS[kind], 4
    seen, half = counted(monkeypatch, neighbors), len(x) // 2
    core = {"core": np.sort(neighbors.distances(x, x), axis=1)[:, 3]} if cored else {}
    d = neighbors.distances(x, x)
    reach = np.maximum(d, np.maximum.outer(core["core"], core["core"])) if cored else d
    np.fill_diagonal(reach, np.inf)
    seen[0], local = 0, neighbors._top(k, 64, cored)
    parts = [tile(x, **core).iloc[s] for s in (slice(half), slice(half, None))]
    found = [local(p, p, True) for p in parts]
    limits = [f.groupby("id")["reach"].max().to_numpy() for f in found]
    found.append(local(parts[0].assign(limit=limits[0]), parts[1].assign(limit=limits[1]), False))
    got = pd.concat(found).sort_values(["id", "reach", "neighbor"])
    got = got[got.groupby("id").cumcount() < k]
    want = np.array([np.lexsort((np.arange(len(x)), row))[:k] for row in reach])
    assert (got["neighbor"].to_numpy().reshape(-1, k) == want).all() and (got["reach"].to_numpy().reshape(-1, k) == np.take_along_axis(reach, want, 1)).all()
    assert kind != "normal" or seen[0] < len(x) ** 2 / 20


@pytest.mark.parametrize("kind", POINTS)
@pytest.mark.parametrize("cored", [False, True])
def test_trees_measure_few_pairs(monkeypatch, kind, cored):
    """Trees of two tiles and the forest between them hold the tree of all pairs; of points without structure no more than a twentieth is measured."""
    x = POINTS[kind]
    seen, half = counted(monkeypatch, neighbors, mst), len(x) // 2
    d = neighbors.distances(x, x)
    core = {"core": np.sort(d, axis=1)[:, 3]} if cored else {}
    reach = np.maximum(d, np.maximum.outer(core["core"], core["core"])) if cored else d
    i, j = np.triu_indices(len(x), 1)
    want = {(i[e], j[e]) for e in mst._forest(i, j, reach[i, j])}
    seen[0] = 0
    parts = [tile(x, **core).iloc[s] for s in (slice(half), slice(half, None))]
    own = [mst._tile_tree(64, cored)(p, p, True) for p in parts]
    assert all(list(o["id"]) == list(p["id"]) and (o["lo"] != o["hi"]).sum() == len(p) - 1 for o, p in zip(own, parts))
    between = mst._pair_forest(64, cored)(*(p.assign(way=o["way"].to_numpy()) for p, o in zip(parts, own)), False)
    every = pd.concat([o[o["lo"] != o["hi"]] for o in own] + [between])
    lo, hi, w = (every[c].to_numpy() for c in ("lo", "hi", "w"))
    assert {(lo[e], hi[e]) for e in mst._forest(lo, hi, w)} == want and (w == reach[lo, hi]).all()
    assert len(between) < len(x) and (kind != "normal" or seen[0] < len(x) ** 2 / 20)


@pytest.mark.parametrize("kind", POINTS)
@pytest.mark.parametrize("cored", [False, True])
def test_products_are_within_their_slack(kind, cored):
    """Single precision only where its rounding is far below the squares of interest: not far from the origin, nor for tiny or huge vectors."""
    for scale in (1.0, 1e-18, 1e25):
        x = POINTS[kind][:200] * scale
        d = neighbors.distances(x, x)
        rows = neighbors.Rows(tile(x), cored) if not cored else neighbors.Rows(tile(x, core=np.sort(d, axis=1)[:, 3]), True)
        at = np.random.default_rng(3).permutation(len(x))
        left, right, slack = rows.products(rows, at, at[::-1], float(np.median(d) ** 2))
        assert left.dtype == (np.float32 if kind != "far" and scale == 1 else np.float64)
        assert np.abs(left @ right.T - np.square(d)[at][:, at[::-1]]).max() <= slack
    mask = np.zeros(1024, bool)
    mask[[3, 8, 9, 700, 1001]] = True
    assert list(neighbors.few(mask, 1001)) == [3, 8, 9, 700] and list(neighbors.few(mask, 1002)) == [3, 8, 9, 700, 1001]


def test_pairs_of_tiles_do_not_share_a_task(spark, monkeypatch):
    """Their rows are few bytes and much work; Spark would put all of them into one task."""
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 64, raising=False)
    cells = cells_of(spark, np.random.default_rng(4).normal(size=(300, 3)), tile_rows=64, block_rows=8)
    n = cells.tree.n_tiles
    where = lambda left, right, same: pd.DataFrame({"part": [TaskContext.get().partitionId()]})
    own = [r.part for r in neighbors.compare_tiles(cells, where, "part int").collect()]
    assert len(own) == n and len(set(own)) > n / 2
    none = neighbors.replace(cells, tree=neighbors.replace(cells.tree, reach=np.full(len(cells.tree.parent), np.inf)))
    pairs = [r.part for r in neighbors.compare_pairs(none, where, "part int").collect()]
    assert len(pairs) == n * (n - 1) / 2 and len(set(pairs)) > len(pairs) / 2
    assert [neighbors.parts_of(*a) for a in ((0, 0, 0), (9, 10, 1e3), (10**6, 10, 1e20), (10**6, 1 << 40, 1e20))] == [1, 15, neighbors.MOST_PARTS, 1 << 21]


def test_points_travel_together(spark):
    """Few rows for each pair of tiles, bounded in size, hold what one row per point and pair holds."""
    cells = cells_of(spark, np.random.default_rng(4).normal(size=(300, 3)), tile_rows=64, block_rows=8)
    cells = neighbors.replace(cells, points=cells.points.withColumn("way", F.col("id") / 7), tree=neighbors.replace(cells.tree, reach=np.full(len(cells.tree.parent), np.inf)))
    want = sorted((r.lo, r.hi, r.tile, r.id, *r.vec, r.way) for r in neighbors.tile_pairs(cells, ("way",)).collect())
    for most in (1 << 20, 240):
        together = neighbors.bundles(neighbors._with_partners(cells, ("way",)), ("way",), most).toPandas()
        assert len(together) < len(want) / 4 and max(len(v) for v in together["vecs"]) <= most
        got = []
        for key, part in together.groupby(["lo", "hi", "tile"]):
            p = neighbors._unpacked(part, ("way",))
            got += [(*key, i, *v, w) for i, v, w in zip(p["id"], p["vec"], p["way"])]
        assert sorted(got) == want
    none = neighbors._unpacked(together[:0], ("way",))
    assert list(none) == ["id", "vec", "way"] and not len(none)


def test_norm_is_taken_once_per_row(spark):
    """Not once per component: 48 rows of 4096 components would take minutes."""
    df = spark.range(48).select("id", F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda x: (x % 7).cast("double")).alias("embedding"))
    start = time.perf_counter()
    got = [r.embedding for r in V.with_unit(df).select(F.slice("embedding", 1, 8).alias("embedding")).collect()]
    assert time.perf_counter() - start < 10
    x = np.arange(1, 4097) % 7.0
    assert got[0] == pytest.approx((x / np.linalg.norm(x))[:8]) and V.with_unit(spark.sql("SELECT cast(null as array<double>) AS embedding")).first().embedding is None


def test_clustering_in_few_jobs(spark):
    """Counted on the sessions's own tracker: the number of jobs does not follow the depth of the tree."""
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(size=(500, 4)))
    sc = spark.sparkContext
    sc.setJobGroup("clustering", "count")
    assert density.hdbscan(df, normalize=False).count() == 500
    n_jobs = len(sc.statusTracker().getJobIdsForGroup("clustering"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < n_jobs <= 60


@pytest.mark.parametrize("min_samples", [1, 2, 4])
def test_core_distances_count_copies(spark, min_samples):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    x[10:14] = x[3]
    cells = cells_of(spark, x, tile_rows=16, block_rows=4)
    got = {r.id: r.core for r in neighbors.core_distances(cells, min_samples).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = np.sort(d, axis=1)[:, min_samples - 1]
    assert set(got) == set(range(50)) - {10, 11, 12, 13}
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in got)


def test_argument_checks(spark):
    df = frame(spark, [[1.0, 0.0]])
    for bad in ({"metric": "l1"}, {"min_samples": 0}, {"min_samples": 5}):
        with pytest.raises(ValueError):
            density.hdbscan(df, **bad)
    with pytest.raises(ValueError):
        losses.supcon_loss(df, 0.0)
    with pytest.raises(ValueError):
        train.TrainConfig(loss_type="triplet")
    with pytest.raises(ValueError):
        train.TrainConfig().override(colour=1)


Z, Y = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]], [0, 0, 1]


def batch(spark):
    return spark.createDataFrame([(0, y, z) for y, z in zip(Y, Z)], "batch long, label long, vec array<double>")


def test_losses_golden(spark):
    assert losses.supcon_loss(batch(spark), 0.5).first().loss == pytest.approx(0.392099, abs=1e-6)
    proxies = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "class_idx long, proxy array<double>")
    for block in (4096, 1):
        assert losses.proxy_anchor_loss(batch(spark), proxies, 0.1, 2.0, block).first().loss == pytest.approx(1.598216, abs=1e-6)


def test_product_is_cut_near_square(spark):
    for n, m in ((1, 1), (10, 5000), (1 << 30, 10), (1 << 24, 1 << 22), (0, 0), (0, 9), (123_456, 654_321)):
        rows, cols = losses.grid(n, m)
        assert n / rows <= losses.SIDE * losses.LONGEST and m / cols <= losses.SIDE * losses.LONGEST
    n, m = 1 << 24, 1 << 22
    rows, cols = losses.grid(n, m)
    # copies of both sides against the least possible for that number of pieces
    assert n * cols + m * rows <= 1.05 * 2 * (n * m * rows * cols) ** 0.5
    df = spark.createDataFrame([(k // 5, k % 3, [1.0, 0.0]) for k in range(100)], "batch long, label long, vec array<double>")
    proxies = spark.createDataFrame([(k, [0.0, 1.0]) for k in range(40)], "class_idx long, proxy array<double>")
    parts = losses.grid(100, 40, 16)
    left, right = losses.product(df, proxies, parts)
    assert parts == (6, 3) and left.count() == 100 * parts[1] and right.count() == 40 * parts[0]
    got, want = (sorted((r.batch, round(r.loss, 9)) for r in losses.proxy_anchor_loss(df, proxies, side=side).collect()) for side in (4, 4096))
    assert got == want


def test_erf():
    x = np.linspace(-7, 7, 20001)
    assert np.abs(head.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12


def test_lr_schedule(spark):
    df = spark.createDataFrame([(e,) for e in (0, 10, 20, 510, 999)], "e int")
    got = [r.lr for r in df.select("e", train.lr_at(F.col("e")).alias("lr")).orderBy("e").collect()]
    want = [0.0005, 0.00075, 0.001, 0.0005005, 1.0026e-6]
    assert got == pytest.approx(want, rel=1e-4)
    assert got == pytest.approx([train.lr_value(e, train.TrainConfig()) for e in (0, 10, 20, 510, 999)])


@pytest.mark.parametrize("loss", train.LOSSES)
def test_gradients(loss):
    rng = np.random.default_rng(1)
    cfg = train.TrainConfig(loss_type=loss, hidden=[5], output_dim=4, dropout=0.0, alpha=4.0, temperature=0.5)
    model = head.Head.create(6, [5], 4, seed=2)
    x, y = rng.normal(size=(9, 6)), rng.integers(0, 3, 9)
    proxies = train.init_proxies(3, 4, 0) if loss == "proxy_anchor" else None
    _, grads, _ = train.batch_step(model, proxies, x, y, cfg, rng)
    params = dict(model.params) | ({"proxies": proxies} if proxies is not None else {})
    for name, p in params.items():
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(3)]:
            old = p[at]
            p[at] = old + 1e-6
            up = train.batch_step(model, proxies, x, y, cfg, rng)[0]
            p[at] = old - 1e-6
            down = train.batch_step(model, proxies, x, y, cfg, rng)[0]
            p[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_training_learns_and_stops(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 6))
    rows = [(i, i % 3, [float(v) for v in centres[i % 3] + rng.normal(0, 0.2, 6)]) for i in range(96)]
    df = spark.createDataFrame(rows, "id long, label long, vec array<double>")
    cfg = train.TrainConfig(hidden=[8], output_dim=4, batch_size=32, world_size=3, epochs=4, warmup_epochs=1, lr=0.01, dropout=0.0)
    done = train.fit(df.where("id >= 24"), df.where("id < 24"), cfg)
    h = done.history.orderBy("epoch").collect()
    assert len(h) == 4 and h[-1].train_loss < h[0].train_loss
    assert train.best_epoch(done.history).first().epoch == done.best_epoch
    out = head.project(df.select("id", F.col("vec").alias("embedding")), done.head).collect()
    assert len(out) == 96 and all(np.linalg.norm(r.embedding) == pytest.approx(1) for r in out)


def test_early_stop_fold(spark):
    h = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.0, 3.99995, 4.5, 1.0])), "epoch long, val_loss double")
    rows = train.early_stop(h, patience=3).orderBy("epoch").collect()
    assert [(r.best, r.waited, r.stopped) for r in rows] == [(5, 0, False), (4, 0, False), (4, 1, False), (4, 2, False), (4, 3, True), (4, 3, True)]
