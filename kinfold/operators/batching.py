"""Order-dependent batching: buckets, residue-budget batches, epoch batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.ordering import with_position
from kinfold.session import checkpoint

SUPER_CHUNKS = 4096


def length_buckets(
    df: DataFrame, bucket_size: int, order: str, length: str = "length", max_len: int | None = None
) -> DataFrame:
    """(order, length, bucket, rank_in_bucket): buckets of ``bucket_size`` consecutive rows, each by falling length.

    With ``max_len``, empty rows and rows longer than it are left out before buckets are counted off.

    ``order`` is a unique column giving the file order; it also breaks ties. Only it and the length are sorted, the
    sequences stay where they are until they are joined to their batch.
    """
    slim = checkpoint(df.select(order, length))  # lengths come from cleaning whole texts: computed once
    if max_len is not None:
        slim = slim.where((F.col(length) > 0) & (F.col(length) <= max_len))
    placed = with_position(slim, [order], "_pos")
    bucketed = placed.withColumn("bucket", F.floor(F.col("_pos") / bucket_size).cast("long"))
    w = W.partitionBy("bucket").orderBy(F.desc(length), "_pos")  # at most bucket_size rows each
    return bucketed.withColumn("rank_in_bucket", (F.row_number().over(w) - 1).cast("long")).drop("_pos")


def _next_start(lengths: np.ndarray, max_batch: int, max_residues: int, max_len: int | None) -> np.ndarray:
    """For each row, where the following batch would start if a batch started here."""
    n = len(lengths)
    idx = np.arange(n)
    total = np.cumsum(lengths)
    before = total - lengths
    full = np.searchsorted(total, before + max_residues, side="left")
    # a row of length 0 can precede the start with the same running total
    full = np.maximum(full, idx)
    end = np.minimum(idx + max_batch - 1, full)
    if max_len is not None:
        breaks = np.where(lengths > max_len, idx, n)
        end = np.minimum(end, np.minimum.accumulate(breaks[::-1])[::-1])
    return np.minimum(end, n - 1) + 1


def _check(max_batch: int, max_residues: int) -> None:
    if max_batch < 1 or max_residues < 1:
        raise ValueError("max_batch and max_residues must be positive")


def bucket_batches(
    bucketed: DataFrame, max_batch: int = 256, max_residues: int = 12000, length: str = "length", id_col: str = "id"
) -> DataFrame:
    """(id, bucket, batch): batches inside each bucket, in ``rank_in_bucket`` order.

    A batch closes with the row that brings it to ``max_batch`` rows or ``max_residues`` residues. A bucket has a fixed
    maximal size, so one group is bounded.
    """
    _check(max_batch, max_residues)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank_in_bucket", ignore_index=True)
        nxt = _next_start(pdf["length"].to_numpy(np.int64), max_batch, max_residues, None)
        batch = np.empty(len(pdf), np.int64)
        at = number = 0
        while at < len(pdf):
            batch[at : nxt[at]] = number
            at, number = nxt[at], number + 1
        return pd.DataFrame({"id": pdf["id"], "bucket": pdf["bucket"], "batch": batch})

    slim = bucketed.select(F.col(id_col).alias("id"), "bucket", "rank_in_bucket", F.col(length).cast("long").alias("length"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.groupBy("bucket").applyInPandas(assign, f"id {kind}, bucket long, batch long")
    return out.withColumnRenamed("id", id_col)


def stream_batches(
    df: DataFrame,
    order: list[str],
    max_batch: int = 100,
    max_residues: int = 4000,
    max_len: int | None = 1000,
    length: str = "length",
    id_col: str = "id",
    chunk: int = 1 << 16,
) -> DataFrame:
    """(id, pos, batch): batches over the whole input in file order.

    A batch closes with the row that brings it to ``max_batch`` rows or ``max_residues`` residues, or that is itself
    longer than ``max_len``. The rule carries state from the first row to the last, but a batch never spans more
    than ``max_batch`` rows, so a stretch of rows can only be entered at one of its first ``max_batch`` rows. Each
    stretch is summarised by where it would be left for each of those entries; the summaries are chained, and a second
    pass numbers the rows of each stretch from its true entry.
    """
    _check(max_batch, max_residues)
    chunk = max(chunk, max_batch)
    keys = [f"_o{i}" for i in range(len(order))]
    ordered = [F.col(c).alias(k) for c, k in zip(order, keys)]
    slim = checkpoint(df.select(F.col(id_col).alias("id"), F.col(length).cast("long").alias("length"), *ordered))
    placed = with_position(slim, keys)
    rows = placed.select("id", "length", "pos", F.floor(F.col("pos") / chunk).cast("long").alias("chunk"))

    # every stretch also sees the first rows of the next one, where its last batch may end
    spill = (F.col("pos") % chunk < max_batch) & (F.col("chunk") > 0)
    homes = F.when(spill, F.array("chunk", F.col("chunk") - 1)).otherwise(F.array("chunk"))
    seen = rows.select("length", "pos", F.explode(homes).alias("chunk"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        own = int((pdf["pos"] // chunk == pdf["chunk"]).sum())
        nxt = _next_start(pdf["length"].to_numpy(np.int64), max_batch, max_residues, max_len).tolist()
        leave, count = list(range(own, own + max_batch)), [0] * max_batch
        leave, count = [0] * own + leave, [0] * own + count
        for i in range(own - 1, -1, -1):
            leave[i], count[i] = leave[nxt[i]], count[nxt[i]] + 1
        entries = np.arange(max_batch)
        return pd.DataFrame({
            "chunk": pdf["chunk"].iloc[0] if len(pdf) else 0,
            "entry": entries,
            "exit": [max(leave[e] - chunk, 0) if e < len(leave) else 0 for e in entries],
            "n": [count[e] if e < len(count) else 0 for e in entries],
        })

    maps = seen.groupBy("chunk").applyInPandas(exits, "chunk long, entry int, exit int, n long")
    # written, as two branches read it and each would run the pass over all rows
    maps = checkpoint(maps.withColumn("super", F.floor(F.col("chunk") / SUPER_CHUNKS).cast("long")))

    def tables(pdf: pd.DataFrame, unit: str):
        for key, part in pdf.sort_values([unit, "entry"]).groupby(unit, sort=True):
            yield key, part["exit"].to_numpy(), part["n"].to_numpy()

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        at, n = np.arange(max_batch), np.zeros(max_batch, np.int64)
        for _, leave, count in tables(pdf, "chunk"):
            n, at = n + count[at], leave[at]
        return pd.DataFrame({"super": pdf["super"].iloc[0], "entry": np.arange(max_batch), "exit": at, "n": n})

    def walk(pdf: pd.DataFrame, unit: str, entry: int, first: int) -> pd.DataFrame:
        out = []
        for key, leave, count in tables(pdf, unit):
            out.append((key, entry, first))
            entry, first = int(leave[entry]), first + int(count[entry])
        return pd.DataFrame(out, columns=[unit, "entry_at", "first"])

    # max_batch rows per SUPER_CHUNKS * chunk input rows: chaining them takes one small task
    supers = maps.groupBy("super").applyInPandas(compose, "super long, entry int, exit int, n long")
    super_entry = supers.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        lambda pdf: walk(pdf, "super", 0, 0), "super long, entry_at int, first long"
    )
    entries = (
        maps.join(super_entry, "super")
        .groupBy("super")
        .applyInPandas(
            lambda pdf: walk(pdf, "chunk", int(pdf["entry_at"].iloc[0]), int(pdf["first"].iloc[0])),
            "chunk long, entry_at int, first long",
        )
    )

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        nxt = _next_start(pdf["length"].to_numpy(np.int64), max_batch, max_residues, max_len)
        at, label = int(pdf["entry_at"].iloc[0]), int(pdf["first"].iloc[0])
        batch = np.full(len(pdf), label - 1, np.int64)  # rows before the entry close the previous batch
        while at < len(pdf):
            batch[at : nxt[at]] = label
            at, label = nxt[at], label + 1
        return pd.DataFrame({"id": pdf["id"], "pos": pdf["pos"], "batch": batch})

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(entries, "chunk").groupBy("chunk").applyInPandas(number, f"id {kind}, pos long, batch long")
    return out.withColumnRenamed("id", id_col)


def epoch_batches(
    df: DataFrame, id_col: str, epochs: int, batch_size: int, rank: Column | None = None, seed: int = 42
) -> DataFrame:
    """(epoch, id, batch): a fresh pseudo-random order per epoch cut into batches; the last one may be short.

    ``rank`` may use the column ``epoch``; the default hashes (id, epoch, seed).
    """
    rank = F.xxhash64(F.col(id_col), F.col("epoch"), F.lit(seed)) if rank is None else rank
    each = df.select(id_col).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = with_position(each.withColumn("_r", rank), ["epoch", "_r", id_col], "_pos", total="_n")
    within = F.col("_pos") - F.col("epoch") * (F.col("_n") / epochs).cast("long")
    return placed.select("epoch", id_col, F.floor(within / batch_size).cast("long").alias("batch"))
