"""Cluster sizes and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ordering import with_position

LOG_BINS = 34  # 35 edges, log-spaced from 1 to the largest size + 1


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def size_summary(sizes: DataFrame) -> DataFrame:
    """Number of clusters and the share of singletons, null when there is no cluster."""
    n = F.count(F.lit(1))
    return sizes.agg(
        n.alias("n_clusters"),
        (F.lit(100.0) * F.count_if(F.col("size") == 1) / F.nullif(n, F.lit(0))).alias("pct_singletons"),
    )


def ccdf(sizes: DataFrame) -> DataFrame:
    """(cluster, size, ccdf): 1 - rank/n with distinct ranks for equal sizes; the last one is 0."""
    ranked = with_position(sizes.select("cluster", "size"), ["size", "cluster"], "_pos", total="_n")
    return ranked.select("cluster", "size", (1 - (F.col("_pos") + 1) / F.col("_n")).alias("ccdf"))


def log_histogram(sizes: DataFrame) -> DataFrame:
    """(method, bin, n_clusters) on log-spaced bins shared by all methods, empty bins included.

    ``sizes`` is (method, size). Bins are half-open, the last one is closed. Only (method, size) frequencies are
    binned: there are far fewer of them than clusters.
    """
    freq = sizes.groupBy("method", "size").agg(F.count(F.lit(1)).alias("n"))
    step = freq.agg((F.log10(F.max("size") + 1) / LOG_BINS).alias("step")).scalar()
    binned = freq.withColumn("_step", step).withColumn(
        "_edges", F.transform(F.sequence(F.lit(0), F.lit(LOG_BINS)), lambda i: F.pow(F.lit(10.0), i * F.col("_step")))
    )
    below = F.size(F.filter("_edges", lambda e: e <= F.col("size"))) - 1
    counts = (
        binned.select("method", F.least(below, F.lit(LOG_BINS - 1)).alias("bin"), "n")
        .groupBy("method", "bin")
        .agg(F.sum("n").alias("n"))
    )
    spine = freq.select("method").distinct().select(
        "method", F.explode(F.sequence(F.lit(0), F.lit(LOG_BINS - 1))).alias("bin")
    )
    filled = spine.join(counts, ["method", "bin"], "left")
    return filled.select("method", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n_clusters"))
