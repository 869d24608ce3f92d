"""Vector arithmetic on array columns, and half-precision byte codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TORCH_EPS = 1e-12  # clamp of the norm in the projection head
HALF = np.dtype("<f2")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def divisor(length: Column, zero: str = "keep") -> Column:
    """What a vector is divided by: ``keep`` leaves zero vectors alone, ``nan`` lets 0/0 show, ``clamp`` floors it."""
    if zero == "keep":
        return F.when(length == 0, F.lit(1.0)).otherwise(length)
    if zero == "nan":
        return F.when(length == 0, F.lit(float("nan"))).otherwise(length)
    if zero == "clamp":
        return F.greatest(length, F.lit(TORCH_EPS))
    raise ValueError("zero must be keep, nan or clamp")


def with_unit(df: DataFrame, col: str = "embedding", zero: str = "keep", out: str | None = None) -> DataFrame:
    """Replace (or add) the L2-normalised vector; the norm is computed once per row."""
    wide = df.withColumn("_v", as_double(F.col(col)))
    # a variable of an outer lambda: Spark would put the expression of a column in its place and take the norm anew for every component
    length = F.array(divisor(norm(F.col("_v")), zero))
    return wide.withColumn(out or col, F.transform(length, lambda d: F.transform("_v", lambda x: x / d))[0]).drop("_v")


def mean_pool(df: DataFrame, key: str, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    """Mean of the vectors of a key, dimension by dimension.

    Partial sums are formed per (key, dimension) before the shuffle, so one key owning a third of the rows costs
    no more than any other.
    """
    long = df.select(key, F.posexplode(as_double(F.col(vec))).alias("_dim", "_x"))
    per_dim = long.groupBy(key, "_dim").agg(F.avg("_x").alias("_x"))
    # one entry per dimension, a fixed width
    packed = per_dim.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_dim", "_x"))).alias("_p"))
    return packed.select(key, F.transform("_p", lambda s: s["_x"]).alias(out))


def encode_half(v: Column) -> Column:
    """Array to raw little-endian float16 bytes."""

    @F.pandas_udf(T.BinaryType())
    def encode(s: pd.Series) -> pd.Series:
        here = s.notna().to_numpy()
        sizes = np.array([len(a) for a in s[here]], np.int64)
        flat = np.concatenate([np.empty(0), *s[here]]).astype(HALF).tobytes()  # one conversion for the batch
        ends = np.cumsum(sizes) * HALF.itemsize
        out = np.full(len(s), None, object)
        out[here] = [flat[e - n * HALF.itemsize : e] for e, n in zip(ends, sizes)]
        return pd.Series(out)

    return encode(v)


def decode_half(v: Column, dim: int) -> Column:
    """Raw float16 bytes to array; a buffer of any other length than ``dim`` items is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(s: pd.Series) -> pd.Series:
        here = s.notna().to_numpy()
        bad = next((len(b) for b in s[here] if len(b) != dim * HALF.itemsize), None)
        if bad is not None:
            raise ValueError(f"vector has {bad // HALF.itemsize} items, expected {dim}")
        out = np.full(len(s), None, object)
        if here.any():
            rows = np.frombuffer(b"".join(s[here]), dtype=HALF).astype(np.float32).reshape(-1, dim)
            for k, row in zip(np.flatnonzero(here), rows):
                out[k] = row
        return pd.Series(out)

    return decode(v)


def matrix(s: pd.Series) -> np.ndarray:
    """Series of equally long arrays to a float64 matrix."""
    return np.stack(s.to_numpy()).astype(np.float64, copy=False) if len(s) else np.empty((0, 0))
