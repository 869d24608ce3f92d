"""Hard-negative mining with exact scores by the method of the Four Russians.

Vectors are whole numbers, floor(256 x). The dimensions are taken in groups of eight; for each group of an anchor all 256 sums over subsets of its
components are tabulated. A candidate's numbers are cut into bit planes, of which eight dimensions make a byte, and that byte is the index
of the subset to which the plane adds: the inner product is a sum of table entries, shifted by the place of the plane. Tables of many anchors lie
side by side, so one look-up serves all of them, and a score takes no multiplication.

Anchors are a stated query set. They are taken in blocks of bounded size, and every block is scored against all rows in two passes: rows of the
anchor's own label for its positives, then all others against the window that each positive opens. A task keeps the best few per anchor and window;
these are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import checkpoint

SCALE = 256.0
GROUP = 8  # dimensions to a table
ANCHOR_BYTES = 16 << 20  # anchors of a block, 4 bytes a component
TABLE_ANCHORS = 256  # whose tables lie side by side
BATCH_ROWS = 1024  # candidates scored at a time
PAIRS_A_TASK = 1 << 32
SPREAD = 256  # parts in which the best of all tasks are merged first
LOWEST = np.iinfo(np.int64).min


def whole_numbers(vectors: pa.ListArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has finite components only, and floor(256 x) of these. Vectors are filled with zeros, or cut, to ``width``."""
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy()), 0)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    owner = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(size)) > 0
    kept = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & ~bad)
    width = int(size.max(initial=0)) if width is None else width
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    used = (at < width) & ~bad[owner]
    if used.any() and np.abs(flat[used]).max() >= 2.0**31:
        raise OverflowError("a component beyond 2^23 has no exact score in 64 bits")
    out = np.zeros((len(size), width), np.int64)
    out[owner[used], at[used]] = flat[used]
    return kept, out[kept]


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """[plane, row, group]: bytes of eight dimensions each, two's complement, the lowest plane first; the last one is that of the signs."""
    n, width = numbers.shape
    most = int(np.abs(numbers).max(initial=0))
    filled = np.zeros((n, -(-width // GROUP) * GROUP), np.int64)
    filled[:, :width] = numbers
    bits = [((filled >> p) & 1).astype(np.uint8).reshape(n, -1, GROUP) for p in range(most.bit_length() + 1)]
    return np.stack([np.packbits(b, axis=2, bitorder="little")[:, :, 0] if b.size else np.zeros((n, 0), np.uint8) for b in bits])


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """[group, byte, anchor]: the sum of the components of each subset of eight dimensions."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    filled = np.zeros((n, groups * GROUP), kind)
    filled[:, :width] = anchors
    out = np.zeros((groups, 1 << GROUP, n), kind)
    for d in range(GROUP):
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + filled[:, d::GROUP].T[:, None, :]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products by look-up, from the plane of the signs down."""
    n, found = planes.shape[1], np.zeros((planes.shape[1], tables.shape[2]), tables.dtype)
    part = np.empty((n, tables.shape[2]), tables.dtype)
    for p in range(len(planes) - 1, -1, -1):
        found <<= 1
        for g, table in enumerate(tables):
            table.take(planes[p, :, g], axis=0, out=part, mode="clip")
            found += part
        if p == len(planes) - 1:
            np.negative(found, out=found)
    return found


@dataclass
class Anchors:
    """Anchors of a block, ordered by label, with the windows (least, most) of scores looked for; unused windows are empty."""

    ids: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray
    least: np.ndarray  # [anchor, window]
    most: np.ndarray
    same: bool  # rows of the anchor's own label, or of all others
    k: int


class Best:
    """The best ``k`` rows per anchor and window of what a task has seen: higher scores first, ties by id."""

    def __init__(self, anchors: Anchors) -> None:
        self.a = anchors
        shape = *anchors.least.shape, anchors.k
        self.score, self.id = np.full(shape, LOWEST), np.zeros(shape, np.int64)
        self._tables: dict[tuple[int, type], np.ndarray] = {}

    def _table(self, first: int, kind: type) -> np.ndarray:
        key = first, kind
        if key not in self._tables:
            if len(self._tables) >= 8:  # about 4 MB each at 64 dimensions
                self._tables.clear()
            self._tables[key] = subset_sums(self.a.numbers[first : first + TABLE_ANCHORS], kind)
        return self._tables[key]

    def add(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> None:
        for first in range(0, len(self.a.ids), TABLE_ANCHORS):
            span = slice(first, first + TABLE_ANCHORS)
            own = self.a.labels[span]
            rows = np.flatnonzero(np.isin(labels, own)) if self.a.same else np.arange(len(ids))
            for at in range(0, len(rows), BATCH_ROWS):
                r = rows[at : at + BATCH_ROWS]
                bound = numbers.shape[1] * int(np.abs(self.a.numbers[span]).max(initial=0)) << (int(np.abs(numbers[r]).max(initial=0)).bit_length() + 2)
                if bound >= 1 << 62:
                    raise OverflowError("scores do not fit in 64 bits")
                found = scores(bit_planes(numbers[r]), self._table(first, np.int32 if bound < 1 << 31 else np.int64))
                if self.a.same:
                    fits = (labels[r][:, None] == own) & (ids[r][:, None] != self.a.ids[span])
                else:
                    fits = labels[r][:, None] != own
                self._merge(first, ids[r], found, fits)

    def _merge(self, first: int, ids: np.ndarray, found: np.ndarray, fits: np.ndarray) -> None:
        span = slice(first, first + found.shape[1])
        for j in range(self.a.least.shape[1]):
            low = np.maximum(self.a.least[span, j], self.score[span, j, -1])
            row, anchor = np.nonzero(fits & (found >= low) & (found <= self.a.most[span, j]))
            if not len(row):
                continue
            touched = np.unique(anchor)
            old = self.score[first + touched, j], self.id[first + touched, j]
            held = old[0] > LOWEST
            who = np.concatenate([np.repeat(touched, held.sum(axis=1)), anchor])
            score = np.concatenate([old[0][held], found[row, anchor].astype(np.int64)])
            name = np.concatenate([old[1][held], ids[row]])
            order = np.lexsort((name, -score, who))
            who, score, name = who[order], score[order], name[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            few = place < self.a.k
            self.score[first + who[few], j, place[few]] = score[few]
            self.id[first + who[few], j, place[few]] = name[few]

    def rows(self) -> pa.RecordBatch:
        anchor, window, place = np.nonzero(self.score > LOWEST)
        cols = [pa.array(anchor.astype(np.int32)), pa.array(window.astype(np.int32))]
        cols += [pa.array(x[anchor, window, place]) for x in (self.id, self.score)]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "window", "id", "score"])


def _found(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """(anchor, window, id, score, rank) of the best rows; ``anchor`` is a place in the block."""
    shipped = rows.sparkSession.sparkContext.broadcast(anchors)  # bounded by ANCHOR_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shipped.value)
        for batch in batches:
            kept, numbers = whole_numbers(batch.column(2), shipped.value.numbers.shape[1])
            best.add(*(batch.column(c).to_numpy()[kept] for c in (0, 1)), numbers)
        yield best.rows()

    out = rows.mapInArrow(run, "anchor int, window int, id bigint, score bigint")
    order = [F.desc("score"), "id"]
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    few = out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    few = few.withColumn("rank", rank("anchor", "window", "part")).where(F.col("rank") <= anchors.k)
    return few.withColumn("rank", rank("anchor", "window")).where(F.col("rank") <= anchors.k).drop("part")


def _blocks(rows: DataFrame, which: Column, block_bytes: int) -> Iterator[pa.Table]:
    """The anchors in blocks of about ``block_bytes``; of several with one id the least by label and vector."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.where(which & F.col("vec").isNotNull() & finite).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    some = checkpoint(some)
    total = some.agg(F.sum(4 * F.size("vec") + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for block in range(n):
        part = some if n == 1 else some.where(F.pmod(F.xxhash64("id"), F.lit(n)) == block)
        if (table := part.orderBy("label", "id").toArrow()).num_rows:  # bounded by block_bytes
            yield table


def mine(
    df: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    positives: int = 5,
    k: int = 5,
    percent: int = 80,
    block_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` (a condition on columns of ``df``) holds.

    A row's score is its integer inner product with the anchor; higher scores come first, ties by smaller id. For an anchor and each of its first
    ``positives`` other rows of the same label, the first ``k`` rows of other labels whose score is at most the positive's and at least ``percent``
    hundredths of it: anchor_id, positive_id, ``rank`` from 1, negative_id, positive_score, negative_score.

    Ids and labels are integers. Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows with one id
    are candidates each, never of an anchor with that id, and one anchor: the least by label and vector. A missing component counts as 0, an
    empty vector scores 0 with everything. Components beyond 2^23 and scores beyond 2^62 raise OverflowError. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = df.sparkSession
    vec = F.col(vec_col).cast("array<float>") if "float" in dict(df.dtypes)[vec_col] else F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vec.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("which"))
    rows = rows.where("id is not null and label is not null and vec is not null")
    n_rows = rows.count()
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for block in _blocks(rows, F.col("which"), block_bytes):
        ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
        numbers = whole_numbers(block.column("vec").combine_chunks())[1]
        others = rows.select("id", "label", "vec")
        if (parts := -(-n_rows * len(ids) // PAIRS_A_TASK)) > others.rdd.getNumPartitions():
            others = others.repartition(parts)
        top = np.iinfo(np.int64).max
        first = Anchors(ids, labels, numbers, np.full((len(ids), 1), LOWEST + 1), np.full((len(ids), 1), top), True, positives)
        found = _found(others, first).select("anchor", F.col("rank") - 1, "id", "score").toArrow()  # bounded by the block
        anchor, place, name, score = (c.to_numpy() for c in found.columns)
        least, most = np.full((len(ids), positives), top), np.full((len(ids), positives), LOWEST + 1)
        names = np.zeros((len(ids), positives), np.int64)
        least[anchor, place], most[anchor, place], names[anchor, place] = -(-percent * score // 100), score, name
        second = Anchors(ids, labels, numbers, least, most, False, k)
        at = [x.astype(np.int32).ravel() for x in np.indices(least.shape)]
        cols = [*at, np.repeat(ids, positives), names.ravel(), most.ravel()]
        # bounded by the block
        opened = spark.createDataFrame(pa.table(cols, ["anchor", "window", "anchor_id", "positive_id", "positive_score"]))
        hits = _found(others, second).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        out = out.union(hits.join(opened, ["anchor", "window"]).select(*out.columns))
    return out


def sql() -> str:
    """The query over ``embeddings`` for DuckDB."""
    return """
        WITH numbered AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM numbered a JOIN numbered b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        ranked AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS "rank",
                other_id AS negative_id, positive_score, score AS negative_score
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT * FROM ranked WHERE "rank" <= 5"""
