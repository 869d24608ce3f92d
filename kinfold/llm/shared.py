"""Files in the folder all executors share, and small helpers of the operators."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import scratch_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the application's shared scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (``file:``, ``s3:``, ``gs:``, ``hdfs:``) or of an absolute path."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def text_key(*cols: str) -> Column:
    """128 bits that stand for the values of ``cols``; equal values, nulls included, have equal keys."""
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[df[c] for c in df.columns])
