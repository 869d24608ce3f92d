"""Exact minimum spanning tree of the mutual-reachability graph.

A task returns the spanning tree of a tile, or a spanning forest of those edges between two tiles that may belong to the tree of both; their union contains
the minimum spanning tree of everything (cycle property). Each point knows the heaviest edge on its way, along the tree of its own part, to the center of
that part. An edge between two parts that is heavier than what its two ends have on their ways, and than one link of the parts, closes a cycle as its
heaviest edge. So only pairs within those bounds are measured. Borůvka rounds on that sparse edge table contract it; once the edges left fit in one task, which
is so from the start for small tables, that task makes the remaining rounds at once. Edges are ordered by (weight, smaller id, larger id) throughout,
with weights measured in one way, so the tree is unique and depends neither on tiles nor on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import matrix
from kinfold.operators.neighbors import PENDING, Cells, Hierarchy, Rows, blocks, compare_pairs, compare_tiles, distances, few, marked
from kinfold.session import checkpoint, checkpoint_counting

EDGE = "lo long, hi long, w double"
OWN = f"tile long, id long, way double, {EDGE}"  # one row per point: its way to the center, and the edge by which it was joined to a larger part
LEAF_ROWS = 64  # points of which all pairs are ordered
HOPS = 3  # links followed per round
LAST_EDGES = 1 << 18  # edges that one task contracts to the end


def _longest_link(weights: np.ndarray) -> float:
    """Largest weight of the spanning tree of a small complete graph."""
    best, inside = weights[0].copy(), np.zeros(len(weights), bool)
    inside[0], longest = True, 0.0
    for _ in range(len(weights) - 1):
        v = int(np.where(inside, np.inf, best).argmin())
        longest, inside[v] = max(longest, best[v]), True
        best = np.minimum(best, weights[v])
    return float(longest)


def _reach(tree: Hierarchy, longest: np.ndarray, core: np.ndarray) -> Hierarchy:
    """No tree edge between two points is longer than the reach of the smallest cell that holds both.

    The points of a tile hang together by its own tree, whose longest edge is known, and the cells of a cell by their pivots, which are points of
    theirs; an edge longer than every step of such a detour closes a cycle as its longest edge.
    """
    core = tree.upwards(core, np.zeros(len(tree.parent))).reach
    link = np.zeros(len(tree.parent))
    for v in np.flatnonzero(tree.first_child >= 0):
        kids = slice(tree.first_child[v], tree.first_child[v] + tree.n_children[v])
        link[v] = _longest_link(np.maximum(distances(tree.pivot[kids], tree.pivot[kids]), np.maximum(core[kids][:, None], core[kids][None, :])))
    return tree.upwards(longest, link)


def _join(n: int, i: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Places of the edges (i, j) of the minimum spanning forest of n points, lightest first; per edge the point whose part was joined to a larger one, and
    per point the one it hangs on (-1: the center of its part)."""
    a, b = i.tolist(), j.tolist()
    root, size, above = list(range(n)), [1] * n, [-1] * n
    kept, joined = [], []
    for e in np.lexsort((hi, lo, w)).tolist():
        x, y = a[e], b[e]
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            if size[x] > size[y] or (size[x] == size[y] and x < y):
                x, y = y, x
            root[x] = above[x] = y
            size[y] += size[x]
            kept.append(e)
            joined.append(x)
            if len(kept) == n - 1:
                break
    return kept, joined, above


def _forest(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest, lightest first."""
    ids, ends = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    return np.array(_join(len(ids), ends[: len(lo)], ends[len(lo) :], lo, hi, w)[0], int)


def _prim(d: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Spanning tree of a complete (square ``d``) or complete bipartite graph, as (row, column) index pairs.

    Edges are ordered by (weight, smaller id, larger id), so equal weights give the same tree in every task.
    """
    n = len(rows)
    ids = rows if same else np.concatenate([rows, cols])
    # weights from a node to all nodes; nodes of the same side of a bipartite graph are never adjacent
    dt = None if same else np.ascontiguousarray(d.T)

    def update(v: int) -> None:
        if same:
            part, at = d[v], slice(0, n)
        elif v < n:
            part, at = d[v], slice(n, None)
        else:
            part, at = dt[v - n], slice(0, n)
        b, w, t = best[at], via[at], todo[at]
        closer = t & (part < b)
        tied = np.flatnonzero(t & (part == b) & np.isfinite(b))
        if len(tied):
            mine, other = ids[v], ids[at][tied]
            old = ids[w[tied]]
            new_key = np.minimum(mine, other), np.maximum(mine, other)
            old_key = np.minimum(old, other), np.maximum(old, other)
            closer[tied] = (new_key[0] < old_key[0]) | ((new_key[0] == old_key[0]) & (new_key[1] < old_key[1]))
        b[closer], w[closer] = part[closer], v

    total = len(ids)
    best, via, todo = np.full(total, np.inf), np.zeros(total, int), np.ones(total, bool)
    todo[0] = False
    update(0)
    edges = []
    for _ in range(total - 1):
        v = int(best.argmin())
        ties = np.flatnonzero(best == best[v])
        if len(ties) > 1:
            a, b = ids[ties], ids[via[ties]]
            v = int(ties[np.lexsort((np.maximum(a, b), np.minimum(a, b)))[0]])
        u = int(via[v])
        edges.append((u, v) if same else (min(u, v), max(u, v) - n))
        todo[v], best[v] = False, np.inf
        update(v)
    return edges


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _named(x: Rows, y: Rows, found: Found) -> Found:
    """(lo, hi, w) of edges given by places."""
    a, b = x.ids[found[0]], y.ids[found[1]]
    return np.minimum(a, b), np.maximum(a, b), found[2]


def _between(x: Rows, y: Rows, rows: np.ndarray, cols: np.ndarray, way_x: np.ndarray, way_y: np.ndarray, block_rows: int) -> Found:
    """(i, j, w): the edges between ``rows`` of x and ``cols`` of y that are no heavier than the ways of their ends or the best link at hand.

    Points near the centers come first, so that the first block has a good link. In a block where that leaves many edges, all of equal weight for instance,
    the spanning tree of the block stands for them.
    """
    rows, cols = rows[np.argsort(way_x[rows], kind="stable")], cols[np.argsort(way_y[cols], kind="stable")]
    far, wide, link = way_x[rows], way_y[cols], np.inf
    left, right, slack = x.products(y, rows, cols, float(np.square(max(far[len(far) // 2], wide[len(wide) // 2]))))
    core = None if x.core is None else tuple(np.square(c).astype(left.dtype) for c in (x.core[rows], y.core[cols]))
    room, mask = np.empty(block_rows * block_rows, left.dtype), np.zeros(-(-block_rows * block_rows // 8) * 8, bool)
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[Found] = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    n_pending = n_found = 0

    def settle() -> None:
        nonlocal n_pending, n_found
        i, j = (np.concatenate(part) for part in zip(*pending))
        w = x.measure(y, i, j)[1]
        near = w <= np.maximum(np.maximum(way_x[i], way_y[j]), link)
        found.append((i[near], j[near], w[near]))
        n_found += np.count_nonzero(near)
        pending.clear()
        n_pending = 0
        if n_found > 2 * PENDING:
            every = tuple(np.concatenate(part) for part in zip(*found))
            kept = _forest(*_named(x, y, every))
            found[:] = [tuple(part[kept] for part in every)]
            n_found = len(kept)

    for r, c in blocks(len(rows), len(cols), False, block_rows):
        high, across = r.stop - r.start, c.stop - c.start
        f = np.matmul(left[r], right[c].T, out=room[: high * across].reshape(high, across))
        if core is not None:
            np.maximum(f, core[0][r][:, None], out=f)
            np.maximum(f, core[1][c][None, :], out=f)
        # ways rise, so the last of a block bounds all of it
        np.less_equal(f, float(np.square(max(far[r.stop - 1], wide[c.stop - 1], link)) + slack), out=mask[: f.size].reshape(f.shape))
        i = few(mask, f.size)
        if len(i) <= high + across:
            i, j = np.divmod(i, across)
            near = f[i, j] <= np.square(np.maximum(np.maximum(far[r][i], wide[c][j]), link)) + slack
            i, j = i[near], j[near]
        else:
            for again in (True, False):
                near = (f <= (np.square(np.maximum(far[r], link)) + slack)[:, None]) | (f <= (np.square(wide[c]) + slack)[None, :])
                n = np.count_nonzero(near)
                if not again or n <= high + across:
                    break
                a, b = np.divmod(np.maximum(f, np.square(np.maximum(far[r][:, None], wide[c][None, :]))).argmin(), across)
                link = min(link, max(float(x.measure(y, rows[r][[a]], cols[c][[b]])[1][0]), far[r][a], wide[c][b]))
            if n > 16 * (high + across):
                d = distances(x.x[rows[r]], y.x[cols[c]])
                if x.core is not None:
                    d = np.maximum(d, np.maximum(x.core[rows[r]][:, None], y.core[cols[c]][None, :]))
                i, j = np.array(_prim(d, x.ids[rows[r]], y.ids[cols[c]], False)).T
            else:
                i, j = marked(near)
        if len(i):
            pending.append((rows[r][i], cols[c][j]))
            n_pending += len(i)
            if n_pending >= PENDING:
                settle()
    if pending:
        settle()
    return tuple(np.concatenate(part) for part in zip(*found))


def _own_tree(x: Rows, block_rows: int) -> tuple[Found, np.ndarray, np.ndarray]:
    """Spanning tree of a tile, from those of its halves and so on; the way of each point, and the point that each edge joined to a larger part."""
    way = np.zeros(len(x.ids))

    def grow(start: int, stop: int) -> tuple[Found, np.ndarray]:
        n = stop - start
        if n <= LEAF_ROWS:
            i, j = np.triu_indices(n, 1)
            found = (i + start, j + start, x.measure(x, i + start, j + start)[1])
        else:
            half = (start + stop) // 2
            below = [grow(start, half)[0], grow(half, stop)[0], _between(x, x, np.arange(start, half), np.arange(half, stop), way, way, block_rows)]
            found = tuple(np.concatenate(part) for part in zip(*below))
        kept, joined, above = _join(n, found[0] - start, found[1] - start, *_named(x, x, found))
        found = tuple(part[kept] for part in found)
        far = [0.0] * n
        for p, w in zip(reversed(joined), reversed(found[2].tolist())):  # what a point hangs on was joined later
            far[p] = w if above[above[p]] < 0 else far[above[p]]
        way[start:stop] = far
        return found, np.array(joined, int) + start

    found, joined = grow(0, len(x.ids))
    return found, way, joined


def _tile_tree(block_rows: int, cored: bool):
    """The spanning tree of a tile, one row per point; the center has an edge to itself."""

    def local(pdf: pd.DataFrame, _: pd.DataFrame, same: bool) -> pd.DataFrame:
        x = Rows(pdf, cored)
        found, way, joined = _own_tree(x, block_rows)
        lo, hi, w = x.ids.copy(), x.ids.copy(), np.zeros(len(x.ids))
        lo[joined], hi[joined], w[joined] = _named(x, x, found)
        return pd.DataFrame({"tile": pdf["tile"].to_numpy(), "id": x.ids, "way": way, "lo": lo, "hi": hi, "w": w})

    return local


def _pair_forest(block_rows: int, cored: bool):
    """A spanning forest of the edges between two tiles that may be of the tree of both."""

    def local(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"lo": np.empty(0, int), "hi": np.empty(0, int), "w": np.empty(0)})
        x, y = Rows(left, cored), Rows(right, cored)
        lo, hi, w = _named(x, y, _between(x, y, np.arange(len(left)), np.arange(len(right)), left["way"].to_numpy(), right["way"].to_numpy(), block_rows))
        kept = _forest(lo, hi, w)
        return pd.DataFrame({"lo": lo[kept], "hi": hi[kept], "w": w[kept]})

    return local


def candidate_edges(cells: Cells, cores: DataFrame | None = None) -> DataFrame:
    """(lo, hi, w): a sparse edge table holding a minimum spanning tree of the distinct points.

    Without ``cores`` the weight is the distance; with (id, core) it is the mutual reachability.
    """
    extra: tuple[str, ...] = ()
    if cores is not None:
        cells, extra = replace(cells, points=checkpoint(cells.points.join(cores, "id"))), ("core",)
    own = compare_tiles(cells, _tile_tree(cells.block_rows, bool(extra)), OWN, extra)
    if (n := cells.tree.n_tiles) > 1:
        own = checkpoint(own)
    edges = own.where("lo <> hi").select("lo", "hi", "w")
    if n > 1:
        longest, core = np.zeros(n), np.zeros(n)
        seen = own.groupBy("tile").agg(F.max("w").alias("m")).toPandas()  # one row per tile
        longest[seen["tile"]] = seen["m"]
        if extra:
            worst = cells.points.groupBy("tile").agg(F.max("core").alias("m")).toPandas()  # one row per tile
            core[worst["tile"]] = worst["m"]
        points = checkpoint(cells.points.join(own.select("id", "way"), "id"))
        apart = replace(cells, points=points, tree=_reach(cells.tree, longest, core))
        edges = edges.unionByName(compare_pairs(apart, _pair_forest(cells.block_rows, bool(extra)), EDGE, (*extra, "way")))
    return edges


def copy_edges(rows: DataFrame, points: DataFrame, cores: DataFrame | None = None) -> DataFrame:
    """Edges from the carrier of each repeated vector to its copies, at distance 0 (or at the common core).

    ``rows`` is (id, vec). Only repeated vectors take part; the carriers' side has one row per vector, so a vector
    shared by a third of all rows is a hot key on one side only, which Spark splits at run time.
    """
    repeated = points.where(F.col("mult") > 1).select(F.col("id").alias("lo"), "vec")
    if cores is not None:
        repeated = repeated.join(cores.withColumnRenamed("id", "lo"), "lo")
    else:
        repeated = repeated.withColumn("core", F.lit(0.0))
    copies = rows.select(F.col("id").alias("hi"), "vec").join(repeated, "vec").where(F.col("hi") != F.col("lo"))
    return copies.select("lo", "hi", F.col("core").alias("w"))


STEP = "level int, comp long, n long, w double, lo long, hi long"
ROUND = f"{STEP}, root long, path array<struct<{', '.join(c.replace(' ', ': ', 1) for c in STEP.split(', '))}>>"


@dataclass
class Rounds:
    """All contraction rounds, one row per component and round.

    ``table``: level (the round), comp, n (its points), w, lo, hi (its lightest edge), root (the component it becomes part of) and ``path``: that
    component in the next round with the lightest edge it has there, the one it becomes part of, and so on up to everything, which has none.
    """

    table: DataFrame
    any: bool


def jump_to_roots(links: DataFrame) -> DataFrame:
    """(node, next, ...) to (node, root, ...): follow ``next`` until it points at itself.

    Each round looks ahead several links at once, so a path of n links takes log(n) rounds.
    """
    rest = [c for c in links.columns if c not in ("node", "next")]
    current = checkpoint(links)
    moved = 1
    while moved:
        step = current.withColumnRenamed("next", "_0")
        for i in range(HOPS):
            step = step.join(current.select(F.col("node").alias(f"_{i}"), F.col("next").alias(f"_{i + 1}")), f"_{i}")
        step = step.select("node", F.col(f"_{HOPS}").alias("next"), F.col(f"_{HOPS - 1}").alias("_was"), *rest)
        step, moved = checkpoint_counting(step, F.col("next") != F.col("_was"))
        current = step.drop("_was")
    return current.withColumnRenamed("next", "root")


def _round(current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over all edges: each component's choice, and the edges between the components that result."""
    one = lambda c, o: F.struct(F.col(f"c{c}").alias("c"), F.col(f"n{c}").alias("n"), F.col(f"c{o}").alias("o"))
    ends = current.select(F.explode(F.array(one("u", "v"), one("v", "u"))).alias("e"), "w", "lo", "hi")
    best = ends.groupBy("e.c").agg(F.min(F.struct("w", "lo", "hi", "e.o", "e.n")).alias("b")).select("c", "b.*")
    # an edge chosen from both sides closes the chain of choices: its smaller end is the root
    mutual = best.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("_n"), F.min("c").alias("_root"))
    ahead = F.when((F.col("_n") == 2) & (F.col("c") == F.col("_root")), F.col("c")).otherwise(F.col("o"))
    hooked = best.join(mutual, ["lo", "hi"]).select(F.col("c").alias("node"), ahead.alias("next"), "n", "w", "lo", "hi")
    choice = jump_to_roots(hooked).withColumnRenamed("node", "comp")
    total = choice.groupBy("root").agg(F.sum("n").alias("n"))
    lookup = checkpoint(choice.select("comp", "root").join(total, "root"))
    side = lambda c: lookup.select(F.col("comp").alias(f"c{c}"), F.col("root").alias(f"r{c}"), F.col("n").alias(f"m{c}"))
    moved = current.drop("nu", "nv").join(side("u"), "cu").join(side("v"), "cv").where("ru != rv")
    # of parallel edges only the lightest matters
    order = F.when(F.col("ru") < F.col("rv"), F.struct("mu", "mv")).otherwise(F.struct(F.col("mv").alias("mu"), F.col("mu").alias("mv")))
    lightest = moved.groupBy(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv")).agg(
        F.min(F.struct("w", "lo", "hi")).alias("b"), F.first(order).alias("n")
    )
    return choice, lightest.select("cu", "cv", F.col("n.mu").alias("nu"), F.col("n.mv").alias("nv"), "b.w", "b.lo", "b.hi")


def _last_rounds(edges: pd.DataFrame, level: int) -> pd.DataFrame:
    """All rounds over the edges at hand, with their paths."""
    edges = edges.iloc[np.lexsort((edges["hi"], edges["lo"], edges["w"]))]
    w, lo, hi = (edges[c].to_numpy() for c in ("w", "lo", "hi"))
    names, ends = np.unique(np.concatenate([edges["cu"], edges["cv"]]), return_inverse=True)
    u, v = ends[: len(w)].copy(), ends[len(w) :].copy()
    n = np.zeros(len(names), np.int64)
    n[u], n[v] = edges["nu"], edges["nv"]
    alive, live = np.arange(len(names)), np.arange(len(w))
    rounds: list[dict[str, np.ndarray]] = []
    while len(live):
        best = np.full(len(names), len(w))
        for side in (u, v):  # the first edge of each component, edges being in order
            mine = np.full(len(names), len(w))
            mine[side[live][::-1]] = live[::-1]
            best = np.minimum(best, mine)
        edge = best[alive]
        ahead = np.arange(len(names))
        ahead[alive] = u[edge] + v[edge] - alive
        mutual = (best[ahead[alive]] == edge) & (alive < ahead[alive])
        ahead[alive[mutual]] = alive[mutual]
        while (ahead != ahead[ahead]).any():
            ahead = ahead[ahead]
        rounds.append({"comp": alive, "root": ahead[alive], "n": n[alive], "edge": edge})
        n = np.bincount(ahead, np.where(np.isin(np.arange(len(names)), alive), n, 0), len(names)).astype(np.int64)
        u, v = ahead[u], ahead[v]
        live = live[u[live] != v[live]]
        alive = np.unique(ahead[alive])
    # everything, which has no edge to choose
    rounds.append({"comp": alive, "root": alive, "n": n[alive], "edge": np.full(len(alive), -1)})
    firsts = np.cumsum([0, *(len(r["comp"]) for r in rounds)])
    flat = {c: np.concatenate([r[c] for r in rounds]) for c in rounds[0]}
    up = np.full(firsts[-1], -1)
    for k, r in enumerate(rounds[:-1]):
        up[firsts[k] : firsts[k + 1]] = firsts[k + 1] + np.searchsorted(rounds[k + 1]["comp"], r["root"])
    at_level = level + np.repeat(np.arange(len(rounds)), np.diff(firsts))
    steps = [
        {"level": int(x), "comp": int(c), "n": int(m), "w": float(w[e]) if e >= 0 else None, "lo": int(lo[e]) if e >= 0 else None, "hi": int(hi[e]) if e >= 0 else None}
        for x, c, m, e in zip(at_level, names[flat["comp"]], flat["n"], flat["edge"])
    ]
    paths: list[list[dict]] = [[] for _ in steps]
    for k in range(len(steps) - 1, -1, -1):
        if up[k] >= 0:
            paths[k] = [steps[up[k]], *paths[up[k]]]
    ends = {c: pd.array([s[c] for s in steps], dtype="Int64") for c in ("lo", "hi")}
    return pd.DataFrame({"level": at_level, "comp": names[flat["comp"]], "n": flat["n"], "w": [s["w"] for s in steps], **ends, "root": names[flat["root"]], "path": paths})


def contract(edges: DataFrame, last_edges: int = LAST_EDGES) -> Rounds:
    """Borůvka rounds over (lo, hi, w) until every component is closed. Ties are broken by (w, lo, hi).

    Rounds run over all edges on Spark until at most ``last_edges`` are left, which one task contracts to the end.
    """
    one = F.lit(1).cast("long")
    start = edges.select(F.col("lo").alias("cu"), F.col("hi").alias("cv"), one.alias("nu"), one.alias("nv"), "w", "lo", "hi")
    current, left = checkpoint_counting(start, F.lit(True))
    some, done = bool(left), []
    while left > last_edges:
        choice, following = _round(current)
        done.append(choice)
        current, left = checkpoint_counting(following, F.lit(True))
    level = len(done)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]  # at most ``last_edges`` rows
        if parts:
            yield _last_rounds(pd.concat(parts, ignore_index=True), level)

    table = checkpoint(current.repartition(1).mapInPandas(finish, ROUND))
    if done and not left:
        # the last round on Spark left no edge: its root is everything
        whole = done[-1].groupBy("root").agg(F.sum("n").alias("n"))
        no = [F.lit(None).cast(k).alias(c) for c, k in (("w", "double"), ("lo", "long"), ("hi", "long"))]
        steps = table.schema["path"].dataType
        table = checkpoint(whole.select(F.lit(level).alias("level"), F.col("root").alias("comp"), "n", *no, "root", F.array().cast(steps).alias("path")))
    tables = [table]
    for k in range(level - 1, -1, -1):
        above = tables[-1].where(F.col("level") == k + 1)
        head = F.struct("level", "comp", "n", "w", "lo", "hi")
        above = above.select(F.col("comp").alias("root"), F.concat(F.array(head), "path").alias("path"))
        tables.append(checkpoint(done[k].join(above, "root").select(F.lit(k).alias("level"), "comp", "n", "w", "lo", "hi", "root", "path")))
    out = tables[0]
    for extra in tables[1:]:
        out = out.unionByName(extra)
    return Rounds(out, some)


def tree_edges(rounds: Rounds) -> DataFrame:
    """(lo, hi, w, level): the spanning tree and the round that took each edge."""
    return rounds.table.where(F.col("w").isNotNull()).groupBy("lo", "hi").agg(F.first("w").alias("w"), F.min("level").alias("level"))
