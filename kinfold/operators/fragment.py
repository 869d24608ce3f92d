"""Fragmentation of terms over clusters, and comparison of two methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.purity import percent


def split_counts(counts: DataFrame) -> DataFrame:
    """(term, split_count): in how many clusters each term occurs, from (cluster, term, n)."""
    # counts hold a (cluster, term) pair once, so a plain count is the distinct count
    return counts.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("split_count"))


def split_summary(splits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Total clusters (annotated or not), total terms, exact median split count, share of unsplit terms.

    ``clusters`` lists each cluster at least once. The median is taken over (value, frequency) pairs: there are at
    most about sqrt(2 * total) distinct values, so its state stays small.
    """
    freq = splits.groupBy("split_count").agg(F.count(F.lit(1)).alias("n"))
    n_clusters = clusters.agg(F.count_distinct("cluster").alias("c")).scalar()
    return freq.agg(
        n_clusters.alias("total_clusters"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_ec4_terms"),
        F.coalesce(F.percentile("split_count", 0.5, F.col("n")), F.lit(0.0)).alias("median_split_count"),
        percent(F.coalesce(F.sum(F.when(F.col("split_count") == 1, F.col("n"))), F.lit(0)), F.sum("n")).alias(
            "pct_terms_in_one_cluster"
        ),
    )


def bin_of(value: Column) -> Column:
    """``1``, ``2-5`` or ``>5``."""
    return F.when(value == 1, "1").when(value.between(2, 5), "2-5").when(value > 5, ">5")


def split_bins(splits: DataFrame, col: str = "split_count") -> DataFrame:
    v = F.col(col)
    return splits.agg(
        F.count_if(v == 1).alias("split_1"),
        F.count_if(v.between(2, 5)).alias("split_2_5"),
        F.count_if(v > 5).alias("split_over_5"),
    )


def compare_splits(base: DataFrame, other: DataFrame) -> DataFrame:
    """(term, split_count_base, split_count_other) for the terms both methods have."""
    return base.select("term", F.col("split_count").alias("split_count_base")).join(
        other.select("term", F.col("split_count").alias("split_count_other")), "term"
    )


def compare_counts(merged: DataFrame) -> DataFrame:
    b, o = F.col("split_count_base"), F.col("split_count_other")
    return merged.agg(
        F.count_if(o > b).alias("n_above"), F.count_if(o < b).alias("n_below"), F.count_if(o == b).alias("n_equal")
    )


def method_delta(base: DataFrame, other: DataFrame) -> DataFrame:
    """Change of mean EC4 purity, of the cluster count (% of the baseline) and of the singleton share (points).

    Both sides are one-row tables (avg_ec4_purity, n_clusters, pct_singletons).
    """
    cols = ["avg_ec4_purity", "n_clusters", "pct_singletons"]
    both = base.select(F.lit(0).alias("side"), *cols).unionByName(other.select(F.lit(1).alias("side"), *cols))

    def of(side: int, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))

    return both.agg(
        (of(1, cols[0]) - of(0, cols[0])).alias("delta_avg_ec4_purity"),
        (F.lit(100.0) * (of(1, cols[1]) - of(0, cols[1])) / F.nullif(of(0, cols[1]), F.lit(0))).alias(
            "delta_clusters_pct"
        ),
        (of(1, cols[2]) - of(0, cols[2])).alias("delta_singleton_points"),
    )
