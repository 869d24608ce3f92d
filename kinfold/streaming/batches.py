"""The residue-budget rule over a stream: an open batch is carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinfold.operators.batching import _check, _next_start


def carry(lengths: np.ndarray, held: tuple[int, int, int], max_batch: int, max_residues: int, max_len: int | None) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Batch of each row, and what is open afterwards, as (rows, residues, number) of the open batch."""
    rows, residues, number = held
    batch = np.full(len(lengths), number, np.int64)
    full = (rows + np.arange(1, len(lengths) + 1) >= max_batch) | (residues + np.cumsum(lengths) >= max_residues)
    if max_len is not None:
        full |= lengths > max_len
    if not full.any():
        return batch, (rows + len(lengths), residues + int(lengths.sum()), number)
    at, number = int(full.argmax()) + 1, number + 1
    starts = _next_start(lengths, max_batch, max_residues, max_len)
    while at < len(lengths):
        end = int(starts[at])
        batch[at:end] = number
        last = slice(at, end)
        closed = end - at >= max_batch or lengths[last].sum() >= max_residues or (max_len is not None and lengths[end - 1] > max_len)
        if not closed:  # only the last one can be open
            return batch, (end - at, int(lengths[last].sum()), number)
        at, number = end, number + 1
    return batch, (0, 0, number)


def stream_batches(
    stream: DataFrame,
    max_batch: int = 100,
    max_residues: int = 4000,
    max_len: int | None = 1000,
    order: str = "pos",
    length: str = "length",
    id_col: str = "id",
    source: str | None = None,
) -> DataFrame:
    """(source, id, pos, batch) of a stream whose micro-batches arrive in ascending ``order``; within one the rows may come in any order.

    The batches are those of ``operators.batching.stream_batches`` over all that has arrived, however it was cut into micro-batches. The rule is
    sequential, so each ``source`` (by default there is one) is a key with its own numbering and the slim rows of one micro-batch of it meet in a task.
    """
    _check(max_batch, max_residues)
    kind = stream.schema[id_col].dataType.simpleString()
    key = F.col(source).cast("string") if source else F.lit("")
    slim = stream.select(key.alias("source"), F.col(id_col).alias("id"), F.col(order).alias("_order"), F.col(length).cast("long").alias("length"))

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pieces), ignore_index=True).sort_values("_order", ignore_index=True)
        held = state.get if state.exists else (0, 0, 0, 0)
        batch, after = carry(rows["length"].to_numpy(np.int64), held[:3], max_batch, max_residues, max_len)
        state.update((*after, held[3] + len(rows)))
        yield pd.DataFrame({"source": key[0], "id": rows["id"], "pos": held[3] + np.arange(len(rows)), "batch": batch})

    schema = f"source string, id {kind}, pos long, batch long"
    out = slim.groupBy("source").applyInPandasWithState(step, schema, "n long, residues long, number long, pos long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("id", id_col)
