"""Keyed ingestion with Structured Streaming: each key is processed once, however often it arrives or the job restarts.

Which keys have been seen is state of the stream, kept by key in Spark's state store and versioned with its checkpoint; no batch reads what
earlier batches have stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Transform = Callable[[DataFrame], DataFrame]


def read_stored(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Everything stored so far.

    A batch that is replayed after a failure between writing and committing leaves its number in the path, so it
    overwrites its own output instead of adding to it.
    """
    if not _has_batches(spark, path):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(path).drop("batch_id")


def _has_batches(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().startswith("batch_id=") for s in fs.listStatus(p))


def new_keys(stream: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """The first row, by ``order``, of every key in the micro-batch in which it first arrives; a null key is a key.

    The rows of one key in one micro-batch pass through a task piece by piece, so only the size of a micro-batch matters, which its source bounds.
    """

    def first(_: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for piece in pieces:
            if not state.exists:
                least = piece.sort_values(order, na_position="last").head(1)
                best = least if best is None else pd.concat([best, least]).sort_values(order, na_position="last", kind="stable").head(1)
        if best is not None:
            state.update((True,))
            yield best

    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def store_batches(stream: DataFrame, path: str, checkpoint_dir: str, transform: Transform | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch, after ``transform``, to a folder of its own number below ``path``; a replayed one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # a transform may read it more than once
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def ingest(
    stream: DataFrame,
    path: str,
    checkpoint_dir: str,
    key: str = "key",
    order: str = "pos",
    transform: Transform | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start ingesting ``stream`` into the Parquet table at ``path``: the first row of each new key goes through ``transform`` (for instance
    cleaning and embedding) and is written. What has been seen is left out before the transform, so nothing is embedded twice."""
    return store_batches(new_keys(stream, key, order), path, checkpoint_dir, transform, trigger)
