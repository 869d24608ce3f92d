"""Global positions and running values without funnelling an ordered table through one task.

``row_number() over (order by ...)`` without a partition sends the whole table to a single task, and a window
over a hot key sends that key's rows to one. Here the rows are range-sorted, numbered inside each range, and the
ranges are stitched together by a table that has one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import checkpoint

CHUNK_ROWS = 1 << 20


def with_position(df: DataFrame, keys: list, name: str = "pos", total: str | None = None) -> DataFrame:
    """Dense 0-based position of each row in the order ``keys``, which must be unique.

    ``total`` optionally names a column holding the overall row count. The sorted rows are checkpointed, so the
    counting pass and the numbering pass see the same ranges whatever happens to an executor in between.
    """
    tagged = df.sort(*keys).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__row"))
    rows = checkpoint(tagged)
    ranges = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    # one row per shuffle range: a global window and a broadcast are both bounded by the partition count
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = ranges.select(
        "__range",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(everything).alias("__total"),
    )
    out = rows.join(F.broadcast(offsets), "__range")
    extra = [F.col("__total").alias(total)] if total else []
    return out.select(*df.columns, (F.col("__row") + F.col("__shift")).alias(name), *extra)


def _chunk(pos: str, chunk: int) -> Column:
    return F.floor(F.col(pos) / F.lit(chunk)).cast("long")


def running(
    df: DataFrame,
    group: list[str],
    pos: str,
    sums: dict[str, str] | None = None,
    maxes_before: dict[str, str] | None = None,
    single_chunk: bool = False,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Running sums (inclusive) and running maxima over the rows before, per group in ``pos`` order.

    A group is cut into stretches of ``chunk`` positions; each stretch is scanned on its own and the carry between
    stretches comes from one row per stretch. ``single_chunk`` skips the stitching for tables known to be shorter
    than a stretch.
    """
    sums, maxes = sums or {}, maxes_before or {}
    if single_chunk:
        w = W.partitionBy(*group).orderBy(pos)
        incl, excl = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
        cols = [F.sum(c).over(incl).alias(n) for n, c in sums.items()]
        cols += [F.max(c).over(excl).alias(n) for n, c in maxes.items()]
        return df.select("*", *cols)
    cut = df.withColumn("_chunk", _chunk(pos, chunk))
    w = W.partitionBy(*group, "_chunk").orderBy(pos)
    incl, excl = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.sum(c).over(incl).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.max(c).over(excl).alias(f"_l_{n}") for n, c in maxes.items()],
    )
    totals = cut.groupBy(*group, "_chunk").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in maxes.items()]
    )
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *group,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
    )
    out = local.join(carry, [*group, "_chunk"])
    return out.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes],
    )


def following(
    df: DataFrame, group: list[str], pos: str, col: str, name: str, single_chunk: bool = False, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Value of ``col`` on the next row of the group in ``pos`` order (null on the last)."""
    if single_chunk:
        return df.select("*", F.lead(col).over(W.partitionBy(*group).orderBy(pos)).alias(name))
    cut = df.withColumn("_chunk", _chunk(pos, chunk))
    local = cut.select(
        "*",
        F.lead(F.struct(F.col(col).alias("v"))).over(W.partitionBy(*group, "_chunk").orderBy(pos)).alias("_next"),
    )
    heads = cut.groupBy(*group, "_chunk").agg(F.min_by(F.struct(F.col(col).alias("v")), F.col(pos)).alias("_head"))
    after = heads.select(*group, "_chunk", F.lead("_head").over(W.partitionBy(*group).orderBy("_chunk")).alias("_after"))
    out = local.join(after, [*group, "_chunk"])
    return out.select(*df.columns, F.coalesce("_next", "_after")["v"].alias(name))
