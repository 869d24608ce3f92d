"""Exact distance work over vectors, cut into cells inside cells and compared tile by tile.

A cell with more points than a tile may hold is split among pivots drawn from it, and so on, until every cell is small enough; neighbouring
small cells share a tile. One task compares two tiles, block by block, and returns a few rows or one tree instead of all pairs. A matrix product gives the
squares of all distances of two blocks up to rounding, whose bound is known; only pairs that may matter are measured exactly. Every
tile is first compared with itself, which bounds how far its points have to look; with that bound a point goes down the hierarchy, leaves out each
cell that the triangle inequality excludes, and travels to the tiles that remain, one copy to each. On data without structure nothing can be
excluded and a point travels to every tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.vectors import matrix
from kinfold.session import checkpoint, parts_for

BLOCK_ROWS = 512  # points whose distances are held at a time
TILE_ROWS = 64 * BLOCK_ROWS  # points of a tile at most
FAN = 64  # pivots of a cell at most
PIVOT_BYTES = 32 << 20  # pivots broadcast at a time while cells are split
CELL_BYTES = 256 << 20  # of the hierarchy, which is broadcast
SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 12  # pairs of points and pivots measured at a time: they stay in the cache
PENDING = 1 << 18  # pairs of points that wait to be measured
FINE = 1024  # by how much squares of interest exceed the rounding of single precision, where that is used
SPREAD = 4  # partitions per tile or pair of tiles, so that few of them meet in one
MOST_PARTS = 1 << 12  # partitions, as long as their rows ask for no more
TASK_PAIRS = 1 << 26  # pairs of points that are worth a task of their own
BUNDLE_BYTES = 1 << 20  # of the vectors that travel to a tile in one row


def distinct_points(df: DataFrame, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(id, vec, mult): one point per distinct vector, carried by the smallest id."""
    typed = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return typed.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult")).select("id", "vec", "mult")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension: the same number for a pair wherever it is measured."""
    total = np.zeros((len(x), len(y)))
    part = np.empty_like(total)
    for a, b in zip(x.T, y.T):
        np.subtract(a[:, None], b[None, :], out=part)
        np.multiply(part, part, out=part)
        total += part
    return np.sqrt(total, out=total)


def marked(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true entries, which are few."""
    return np.divmod(np.flatnonzero(of), of.shape[1])


def few(mask: np.ndarray, n: int) -> np.ndarray:
    """Places of the true entries among the first n, of which there are few: eight are looked at together."""
    words = np.flatnonzero(mask[: -(-n // 8) * 8].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[mask[at] & (at < n)]


class Rows:
    """Points of a task: for products of blocks, and dimension by dimension for single pairs."""

    def __init__(self, pdf: pd.DataFrame, cored: bool):
        self.ids = pdf["id"].to_numpy()
        self.x = matrix(pdf["vec"]) if len(pdf) else np.empty((0, 0))
        self.by_dim = np.ascontiguousarray(self.x.T)
        self.core = pdf["core"].to_numpy() if cored else None
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        one = np.ones(len(pdf))
        self.left, self.right = np.column_stack([-2 * self.x, self.square, one]), np.column_stack([self.x, one, self.square])

    def slack(self, other: Rows) -> float:
        """More than the rounding error of ``squares``, and of the square of a distance that is measured."""
        return 16 * (self.x.shape[1] + 8) * np.finfo(float).eps * (self.square.max(initial=0) + other.square.max(initial=0))

    def squares(self, other: Rows, r: np.ndarray | slice, c: np.ndarray | slice) -> np.ndarray:
        """Squared distances (reachabilities with cores) of two blocks, up to ``slack``."""
        out = self.left[r] @ other.right[c].T
        if self.core is not None:
            np.maximum(out, np.square(self.core[r])[:, None], out=out)
            np.maximum(out, np.square(other.core[c])[None, :], out=out)
        return out

    def products(self, other: Rows, rows: np.ndarray, cols: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Factors whose product gives the squares of ``rows`` by ``cols``, and their slack: of single precision where that is fine enough for squares of ``scale``."""
        left, right = self.left[rows], other.right[cols]
        largest = self.square.max(initial=0) + other.square.max(initial=0)
        # inputs, sums and bounds are rounded: (d + 4) eps of the largest squares, four times that for safety; nothing of that holds below the smallest normal number
        slack = 4 * (self.x.shape[1] + 8) * float(np.finfo(np.float32).eps) * largest + 2.0**-100
        if slack <= scale / FINE and largest < 2.0**100:
            return left.astype(np.float32), right.astype(np.float32), slack
        return left, right, self.slack(other)

    def measure(self, other: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and reachability of pairs, the same numbers as ``distances`` gives."""
        total = np.zeros(len(i))
        for a, b in zip(self.by_dim, other.by_dim):
            part = a[i] - b[j]
            np.multiply(part, part, out=part)
            total += part
        d = np.sqrt(total, out=total)
        return d, d if self.core is None else np.maximum(d, np.maximum(self.core[i], other.core[j]))


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


@dataclass
class Hierarchy:
    """Cells inside cells, one entry per cell, the root first; children of a cell follow each other."""

    parent: np.ndarray
    first_child: np.ndarray  # -1 for a cell that is not split
    n_children: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    tile: np.ndarray  # -1 for a cell that is split
    level: np.ndarray
    reach: np.ndarray  # how far a pair within the cell may have to look

    @property
    def n_tiles(self) -> int:
        return int(self.tile.max(initial=-1)) + 1

    def paths(self) -> np.ndarray:
        """[cell, level]: the cell's ancestor at each level, itself included; -1 below it."""
        out = np.full((len(self.parent), int(self.level.max()) + 1), -1)
        for c in range(len(self.parent)):  # parents come first
            if c:
                out[c] = out[self.parent[c]]
            out[c, self.level[c]] = c
        return out

    def upwards(self, of_tile: np.ndarray, link: np.ndarray) -> Hierarchy:
        """``reach`` from the bottom: that of the tile, then the largest of the children's and of the links among them."""
        reach = np.where(self.tile >= 0, of_tile[np.maximum(self.tile, 0)], link)
        for c in range(len(reach) - 1, 0, -1):
            reach[self.parent[c]] = max(reach[self.parent[c]], reach[c])
        return replace(self, reach=reach)


@dataclass
class Cells:
    """Checkpointed points (id, vec, mult, cell, tile) and the hierarchy of their cells."""

    points: DataFrame
    tree: Hierarchy
    block_rows: int = BLOCK_ROWS


def _split(points: DataFrame, crowded: dict[int, int], tile_rows: int, fan: int, first: int, attempt: int) -> tuple[DataFrame, pd.DataFrame]:
    """Points of crowded cells dealt to new cells from number ``first`` on, and these: parent, pivot, radius, n.

    Pivots are the points of the least hashes, a repeatable sample, another one at each level. A pivot stays in its own cell, so every cell gets smaller.
    """
    wanted = points.sparkSession.createDataFrame(pd.DataFrame({"cell": list(crowded), "_fan": [min(fan, -(-2 * n // tile_rows)) for n in crowded.values()]}))
    some = points.join(F.broadcast(wanted), "cell")  # one row per crowded cell
    nth = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(attempt)), "id"))
    few = checkpoint(some.withColumn("_k", nth).where(F.col("_k") <= fan).where("_k <= _fan").select("cell", "_k", "vec"))
    size = few.agg(F.sum(8 * F.size("vec"))).first()[0]
    n_parts = -(-size // PIVOT_BYTES)
    made: list[pd.DataFrame] = []
    for part in range(n_parts):
        mine = few if n_parts == 1 else few.where(F.pmod(F.xxhash64("cell"), F.lit(n_parts)) == part)
        pivots = mine.orderBy("cell", "_k").toPandas()  # bounded by PIVOT_BYTES
        pivots["new"] = np.arange(first, first + len(pivots))
        first += len(pivots)
        of = {int(cell): (matrix(g["vec"]), g["new"].to_numpy()) for cell, g in pivots.groupby("cell")}

        def deal(batches: Iterator[pd.DataFrame], of=of) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                cell, off = pdf["cell"].to_numpy().copy(), pdf["off"].to_numpy().copy()
                for c in np.unique(cell):
                    if int(c) in of:
                        at = np.flatnonzero(pdf["cell"].to_numpy() == c)
                        d = distances(matrix(pdf["vec"].iloc[at]), of[int(c)][0])
                        near = d.argmin(axis=1)
                        cell[at], off[at] = of[int(c)][1][near], d[np.arange(len(at)), near]
                yield pdf.assign(cell=cell, off=off)

        points = points.mapInPandas(deal, "id long, vec array<double>, mult long, cell long, off double")
        made.append(pivots)
    points = checkpoint(points)
    found = pd.concat(made, ignore_index=True).rename(columns={"cell": "parent"})
    stats = points.where(F.col("cell") >= int(found["new"].min())).groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
    return points, found.merge(stats, left_on="new", right_on="cell").sort_values("new")[["new", "parent", "vec", "radius", "n"]]


def build_cells(points: DataFrame, tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> Cells:
    """Cells and tiles of distinct points (id, vec, mult); the sizes are parameters and do not follow the table."""
    if fan < 2 or tile_rows < 1:
        raise ValueError("cells need two pivots and room for a point")
    points = checkpoint(points.select("id", "vec", "mult", F.lit(0).cast("long").alias("cell"), F.lit(float("inf")).alias("off")))
    n = points.count()
    width = len(row.vec) if (row := points.select("vec").first()) else 0
    cells = pd.DataFrame({"new": [0], "parent": [-1], "vec": [[0.0] * width], "radius": [np.inf], "n": [n]})
    attempt = 0
    while len(large := cells[(cells["n"] > tile_rows) & ~cells["new"].isin(cells["parent"])]):
        crowded = dict(zip(large["new"].astype(int).tolist(), large["n"].astype(int).tolist()))
        points, more = _split(points, crowded, tile_rows, fan, int(cells["new"].max()) + 1, attempt)
        cells, attempt = pd.concat([cells, more], ignore_index=True), attempt + 1
        if cells["n"].count() * (8 * width + 64) > CELL_BYTES:
            raise ValueError("the hierarchy is too large to broadcast: larger tiles make it smaller")
    return _numbered(points, cells, tile_rows, block_rows)


def _numbered(points: DataFrame, cells: pd.DataFrame, tile_rows: int, block_rows: int) -> Cells:
    """Cells in order of their numbers, level by level, and small cells of one parent packed into tiles."""
    names = cells["new"].to_numpy()
    place = {int(c): k for k, c in enumerate(names)}
    parent = np.array([place.get(int(p), -1) for p in cells["parent"]])
    first, n_children, level, tile = np.full(len(names), -1), np.zeros(len(names), int), np.zeros(len(names), int), np.full(len(names), -1)
    for k in range(1, len(names)):
        if first[parent[k]] < 0:
            first[parent[k]] = k
        n_children[parent[k]] += 1
        level[k] = level[parent[k]] + 1
    count, last, room, at = cells["n"].to_numpy(), None, 0, -1
    for k in range(len(names)):
        if n_children[k]:
            continue
        if parent[k] != last or room < count[k]:
            at, room, last = at + 1, tile_rows, parent[k]
        tile[k], room = at, room - count[k]
    tree = Hierarchy(parent, first, n_children, matrix(cells["vec"]), cells["radius"].to_numpy(float), tile, level, np.zeros(len(names)))
    layout = points.sparkSession.createDataFrame(pd.DataFrame({"_name": names, "_place": np.arange(len(names)), "tile": tile}))
    placed = points.join(F.broadcast(layout), points["cell"] == layout["_name"])  # bounded by CELL_BYTES
    return Cells(placed.select("id", "vec", "mult", F.col("_place").cast("long").alias("cell"), F.col("tile").cast("long").alias("tile")), tree, block_rows)


def targets(tree: Hierarchy, paths: np.ndarray, x: np.ndarray, own: np.ndarray, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, tile): the tiles that a point must be compared with, found by going down the hierarchy.

    ``own`` is each point's cell. With ``limit`` a cell matters if it is within the point's limit or within its own reach; without, if it is within
    the reach of the smallest cell that holds both.
    """
    rows, nodes = np.arange(len(x)), np.zeros(len(x), int)
    bound = np.full(len(x), np.inf)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        leaf = tree.first_child[nodes] < 0
        found.append((rows[leaf], tree.tile[nodes[leaf]]))
        rows, nodes, bound = rows[~leaf], nodes[~leaf], bound[~leaf]
        many = tree.n_children[nodes]
        above = np.repeat(nodes, many)
        child = np.repeat(tree.first_child[nodes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, bound = np.repeat(rows, many), np.repeat(bound, many)
        on_path = paths[own[row], tree.level[above]] == above
        bound = np.where(on_path, tree.reach[above], bound) if limit is None else np.maximum(limit[row], tree.reach[child])
        inside = paths[own[row], tree.level[child]] == child
        kept = np.zeros(len(row), bool)
        for at in range(0, len(row), PAIRS_AT_ONCE):
            s = slice(at, at + PAIRS_AT_ONCE)
            kept[s] = inside[s] | (_paired(x[row[s]], tree.pivot[child[s]]) - tree.radius[child[s]] <= bound[s] + SLACK * (1 + bound[s]))
        rows, nodes, bound = row[kept], child[kept], bound[kept]
    if not found:
        return rows, nodes
    row, tile = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return np.divmod(np.unique(row * tree.n_tiles + tile), tree.n_tiles)


def _with_partners(cells: Cells, extra: tuple[str, ...] = (), limit: str | None = None) -> DataFrame:
    """Points (id, vec, cell, tile, *extra) with the other tiles that may hold a partner within reach."""
    tree = cells.tree
    shipped = cells.points.sparkSession.sparkContext.broadcast((tree, tree.paths()))  # bounded by CELL_BYTES

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, paths = shipped.value
        for pdf in batches:
            if len(pdf):
                row, tile = targets(tree, paths, matrix(pdf["vec"]), pdf["cell"].to_numpy(), pdf[limit].to_numpy() if limit else None)
                other = tile != pdf["tile"].to_numpy()[row]
                row, tile = row[other], tile[other]
                yield pdf.assign(partners=np.split(tile, np.searchsorted(row, np.arange(1, len(pdf)))))

    kinds = "".join(f", {c} double" for c in extra)
    base = cells.points.select("id", "vec", "cell", "tile", *extra)
    return base.mapInPandas(spread, f"id long, vec array<double>, cell long, tile long{kinds}, partners array<long>")


def _each_pair(points: DataFrame, *columns: str) -> DataFrame:
    """One row per point and partner tile."""
    out = points.withColumn("partner", F.explode("partners"))
    return out.select(F.least("tile", "partner").alias("lo"), F.greatest("tile", "partner").alias("hi"), *columns)


def tile_pairs(cells: Cells, extra: tuple[str, ...] = (), limit: str | None = None) -> DataFrame:
    """Rows (lo, hi, tile, id, vec, *extra) of every pair of different tiles that may hold a pair within reach: one row per point and pair."""
    return _each_pair(_with_partners(cells, extra, limit), "tile", "id", "vec", *extra)


def bundles(points: DataFrame, extra: tuple[str, ...] = (), most: int = BUNDLE_BYTES) -> DataFrame:
    """Rows (lo, hi, tile, ids, vecs, numbers) of every pair of tiles: points that travel together, as bytes, with their columns ``extra``.

    On vectors without structure a point travels to every tile, so there are many more rows of single points than points.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row = np.repeat(np.arange(len(pdf)), [len(p) for p in pdf["partners"]])
            if not len(row):
                continue
            ids, x, numbers = pdf["id"].to_numpy(), matrix(pdf["vec"]), pdf[list(extra)].to_numpy(float)
            partner, tile = np.concatenate(pdf["partners"].to_list()), pdf["tile"].to_numpy()[row]
            order = np.lexsort((partner, tile))
            row, partner, tile = row[order], partner[order], tile[order]
            room = max(1, most // max(1, 8 * x.shape[1]))
            ends = [*(np.flatnonzero((np.diff(tile) != 0) | (np.diff(partner) != 0)) + 1).tolist(), len(row)]
            pieces = [slice(a, min(a + room, end)) for start, end in zip([0, *ends], ends) for a in range(start, end, room)]
            held = 0
            for nth, p in enumerate(pieces, 1):
                if not held:
                    made = []
                at, here, there = row[p], int(tile[p.start]), int(partner[p.start])
                made.append((min(here, there), max(here, there), here, ids[at].tobytes(), x[at].tobytes(), numbers[at].tobytes()))
                held += len(at)
                if held >= 8 * room or nth == len(pieces):
                    yield pd.DataFrame(made, columns=["lo", "hi", "tile", "ids", "vecs", "numbers"])
                    held = 0

    return points.mapInPandas(pack, "lo long, hi long, tile long, ids binary, vecs binary, numbers binary")


def _unpacked(part: pd.DataFrame, extra: tuple[str, ...]) -> pd.DataFrame:
    """The points (id, vec, *extra) of some bundles."""
    ids, x, numbers = (np.frombuffer(b"".join(part[c]), kind) for c, kind in (("ids", np.int64), ("vecs", float), ("numbers", float)))
    n = max(1, len(ids))
    return pd.DataFrame({"id": ids, "vec": list(x.reshape(len(ids), len(x) // n)), **dict(zip(extra, numbers.reshape(len(ids), len(numbers) // n).T))}, columns=["id", "vec", *extra])


def blocks(left: int, right: int, same: bool, rows: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of blocks of two tiles; within a tile each pair once."""
    for a in range(0, left, rows):
        for b in range(a if same else 0, right, rows):
            yield slice(a, min(a + rows, left)), slice(b, min(b + rows, right))


def parts_of(groups: int, rows: int, pairs: float) -> int:
    """Partitions for groups with so many pairs of points, which cost more than their bytes tell: Spark would put many into one task, one after the other."""
    return max(1, min(SPREAD * groups, MOST_PARTS, int(pairs // TASK_PAIRS)), parts_for(rows))


def compare_tiles(cells: Cells, local: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``local`` of each tile with itself."""
    rows = cells.points.select("id", "vec", "cell", "tile", *extra)
    if (n := cells.tree.n_tiles) > 1:
        size = F.col("count").cast("double")
        rows = rows.repartition(parts_of(n, 0, cells.points.groupBy("tile").count().agg(F.sum(size * size / 2)).first()[0] or 0), "tile")
    return rows.groupBy("tile").applyInPandas(lambda pdf: local(pdf, pdf, True), schema)


def compare_pairs(cells: Cells, local: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, extra: tuple[str, ...] = (), limit: str | None = None) -> DataFrame:
    """``local`` of each pair of different tiles within reach."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return local(_unpacked(pdf[pdf["tile"] == pdf["lo"]], extra), _unpacked(pdf[pdf["tile"] == pdf["hi"]], extra), False)

    points = checkpoint(_with_partners(cells, extra, limit))
    size = F.col("count").cast("double")
    total = _each_pair(points).groupBy("lo", "hi").count().agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows"), F.sum(size * size / 4).alias("pairs")).first()
    dealt = bundles(points, extra).repartition(parts_of(total.n, total.rows or 0, total.pairs or 0), "lo", "hi")
    return dealt.groupBy("lo", "hi").applyInPandas(run, schema)


NEAR = "id long, neighbor long, distance double, reach double"


class _Best:
    """The k best partners so far of some points, and the reachability beyond which a partner is none of them."""

    def __init__(self, k: int, limit: np.ndarray):
        self.k, self.limit = k, limit.copy()
        self.held = [np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0)]

    def add(self, row: np.ndarray, neighbor: np.ndarray, distance: np.ndarray, reach: np.ndarray) -> None:
        near = reach <= self.limit[row]
        row, neighbor, distance, reach = (np.concatenate([old, new[near]]) for old, new in zip(self.held, (row, neighbor, distance, reach)))
        order = np.lexsort((neighbor, reach, row))
        nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.held = [part[order] for part in (row, neighbor, distance, reach)]
        last = nth == self.k - 1
        self.limit[self.held[0][last]] = self.held[3][last]

    def within(self, f: np.ndarray, rows: np.ndarray | slice, slack: float) -> np.ndarray:
        """Up to which square a partner counts; of points without a limit yet, as far as this block has k partners."""
        bound = np.square(self.limit[rows]) + slack
        if self.k <= f.shape[1] and not np.isfinite(bound).all():
            bound = np.minimum(bound, np.partition(f, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
        return bound


def _top(k: int, block_rows: int, cored: bool) -> Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]:
    """The k closest points of one tile to each of the other, and the other way round; ``limit`` bounds those of a pair of tiles."""

    def table(ids: np.ndarray, best: _Best) -> pd.DataFrame:
        row, neighbor, distance, reach = best.held
        return pd.DataFrame({"id": ids[row], "neighbor": neighbor, "distance": distance, "reach": reach})

    def own(x: Rows) -> Iterator[pd.DataFrame]:
        n, slack = len(x.ids), x.slack(x)
        for at in range(0, n, block_rows):
            best, pending, n_pending, turn = _Best(k, np.full(min(block_rows, n - at), np.inf)), [], 0, 2
            r = slice(at, at + block_rows)
            starts = range(0, n, block_rows)
            for nth, start in enumerate(starts, 1):
                c = slice(start, start + block_rows)
                f = x.squares(x, r, c)
                if start == at:
                    np.fill_diagonal(f, np.inf)
                i, j = marked(f <= best.within(f, slice(None), slack)[:, None])
                other = i + at != j + start  # a point without a limit
                pending.append((i[other], j[other] + start))
                n_pending += len(pending[-1][0])
                # limits follow each doubling of what has been seen
                if nth in (1, turn, len(starts)) or n_pending >= PENDING:
                    turn = 2 * nth
                    i, j = (np.concatenate(part) for part in zip(*pending))
                    best.add(i, x.ids[j], *x.measure(x, i + at, j))
                    pending, n_pending = [], 0
            yield table(x.ids[r], best)

    def local(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.empty(0, int), "neighbor": np.empty(0, int), "distance": np.empty(0), "reach": np.empty(0)})
        if same:
            return pd.concat([none, *own(Rows(left, cored))], ignore_index=True)
        if not len(left) or not len(right):
            return none
        x, y = Rows(left, cored), Rows(right, cored)
        slack, ours, theirs = x.slack(y), _Best(k, left["limit"].to_numpy()), _Best(k, right["limit"].to_numpy())
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            i, j = (np.concatenate(part) for part in zip(*pending))
            d, reach = x.measure(y, i, j)
            ours.add(i, y.ids[j], d, reach)
            theirs.add(j, x.ids[i], d, reach)
            pending.clear()

        for r, c in blocks(len(left), len(right), False, block_rows):
            f = x.squares(y, r, c)
            i, j = marked((f <= ours.within(f, r, slack)[:, None]) | (f <= theirs.within(f.T, c, slack)[None, :]))
            if len(i):
                pending.append((i + r.start, j + c.start))
                if sum(len(p[0]) for p in pending) >= PENDING:
                    settle()
        if pending:
            settle()
        return pd.concat([none, table(x.ids, ours), table(y.ids, theirs)], ignore_index=True)

    return local


def nearest(cells: Cells, k: int, cores: DataFrame | None = None) -> DataFrame:
    """(id, neighbor, distance, reach, rank): the exact k nearest other points; ties go to the smaller id.

    With ``cores`` (id, core) they are ranked by mutual reachability, the largest of the distance and both cores; without, ``reach`` is the
    distance. What a point finds in its own tile bounds its search elsewhere: a closer point in reachability is within that distance.
    """
    if k < 1:
        raise ValueError("k must be positive")
    extra: tuple[str, ...] = ()
    if cores is not None:
        cells, extra = replace(cells, points=checkpoint(cells.points.join(cores, "id"))), ("core",)
    top = _top(k, cells.block_rows, cores is not None)
    found = compare_tiles(cells, top, NEAR, extra)
    if cells.tree.n_tiles > 1:
        found = checkpoint(found)
        kth = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("reach")).alias("limit"))
        bounded = checkpoint(cells.points.join(kth, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))))
        widest = bounded.groupBy("tile").agg(F.max("limit").alias("m")).toPandas()  # one row per tile
        of_tile = np.zeros(cells.tree.n_tiles)
        of_tile[widest["tile"]] = widest["m"]
        tree = cells.tree.upwards(of_tile, np.zeros(len(cells.tree.parent)))
        found = found.unionByName(compare_pairs(Cells(bounded, tree), top, NEAR, ("limit", *extra), "limit"))
    # a top-k filter on a row number is applied before the shuffle as well
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("reach", "neighbor")))
    return best.where(F.col("rank") <= k)


def core_distances(cells: Cells, min_samples: int, aside: int = 0, aside_distance: float = 0.0) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th closest original row, counting the row itself.

    Copies of a vector count as often as they occur; fewer rows than ``min_samples`` give an infinite core. ``aside``
    further rows, kept out of the cells, lie at ``aside_distance`` from every point.
    """
    mult = cells.points.select("id", "mult")
    if min_samples <= 1:
        return mult.select("id", F.lit(0.0).alias("core"))
    near = nearest(cells, min_samples - 1).join(mult.withColumnRenamed("id", "neighbor"), "neighbor")
    # at most min_samples rows per point from here on
    rows = near.select("id", "rank", "distance", "mult").unionByName(
        mult.select("id", F.lit(0).alias("rank"), F.lit(0.0).alias("distance"), "mult")
    )
    if aside:
        others = mult.select("id", F.lit(min_samples).alias("rank"), F.lit(aside_distance).alias("distance"), F.lit(aside).cast("long").alias("mult"))
        rows = rows.unionByName(others)
    have = F.sum("mult").over(W.partitionBy("id").orderBy("distance", "rank").rowsBetween(W.unboundedPreceding, 0))
    reached = rows.withColumn("_have", have).groupBy("id").agg(
        F.min(F.when(F.col("_have") >= min_samples, F.col("distance"))).alias("core")
    )
    return reached.select("id", F.coalesce("core", F.lit(float("inf"))).alias("core"))
