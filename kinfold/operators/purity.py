"""Annotation purity of clusters at two levels of a dotted term hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.ids import parent_term
from kinfold.session import TASK_ROWS, checkpoint, frequent, parts_for

PREFIX_MODES = ("raw", "dotted")


def term_counts(members: DataFrame, annotations: DataFrame, keep_unannotated: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """(cluster, term, n): how often each term occurs in each cluster.

    ``members`` is a multiset (cluster, accession): a member contributes all terms of its accession, and contributes
    them again each time it is listed. ``annotations`` (accession, term) is a set. With ``keep_unannotated`` a cluster
    without any annotation keeps one row with a null term.

    The join is an ordinary equi-join: Spark broadcasts the annotations while they are under its own threshold and
    shuffles (splitting hot accessions at run time) beyond it. Its rows are dealt by cluster to as many tasks as members and
    annotations ask for, and stay there for all that is counted per cluster. Clusters with more than ``task_rows`` members are counted apart,
    partially before the shuffle, so that one holding a third of all members sends one row per term and task.
    """
    known = annotations.select("accession", "term").dropDuplicates()
    how = "left" if keep_unannotated else "inner"
    members = members.select("cluster", "accession")

    def counted(joined: DataFrame) -> DataFrame:
        return joined.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))

    # a member has a few terms
    parts, hot = parts_for(2 * members.count(), task_rows), frequent(members, "cluster", task_rows)
    rest = members if hot is None else members.join(F.broadcast(hot), "cluster", "left_anti")  # at most rows / task_rows of them
    counts = counted(rest.join(known, "accession", how).repartition(parts, "cluster"))
    if hot is not None:
        counts = counts.unionByName(counted(members.join(F.broadcast(hot), "cluster", "left_semi").join(known, "accession", how)))
    return counts.withColumn("n", F.when(F.col("term").isNotNull(), F.col("n")).otherwise(F.lit(0)).cast("long"))


def parent_candidates(terms: DataFrame, prefix_mode: str = "raw") -> DataFrame:
    """(term, parents): for each distinct term, the parents of any term that are a prefix of it, its own one flagged.

    ``raw`` is the plain string prefix, so ``1.1.1`` also covers ``1.1.10.2``; ``dotted`` asks for whole components.
    Each term expands to its own prefixes, at most one per character, and an equi-join keeps those that exist.
    """
    if prefix_mode not in PREFIX_MODES:
        raise ValueError(f"prefix_mode must be one of {PREFIX_MODES}")
    distinct = terms.select("term").where(F.col("term").isNotNull()).distinct()
    parents = distinct.select(parent_term(F.col("term")).alias("parent")).distinct()
    lengths = F.sequence(F.lit(0), F.length("term"))
    prefixes = distinct.select("term", F.explode(lengths).alias("_len"))
    prefixes = prefixes.select("term", F.expr("left(term, _len)").alias("parent"))
    if prefix_mode == "dotted":
        whole = (F.col("term") == F.col("parent")) | F.startswith("term", F.concat("parent", F.lit(".")))
        prefixes = prefixes.where(whole | (F.col("parent") == parent_term(F.col("term"))))
    known = prefixes.join(parents, "parent", "left_semi")
    flagged = F.struct("parent", (F.col("parent") == parent_term(F.col("term"))).alias("own"))
    return known.groupBy("term").agg(F.collect_list(flagged).alias("parents"))


def purity_of_counts(counts: DataFrame, terms: DataFrame | None = None, prefix_mode: str = "raw") -> DataFrame:
    """(cluster, n_occurrences, n_terms, ec4_purity, ec3_purity) from term counts.

    EC4 purity is the share of the most frequent term among all occurrences. EC3 purity is the largest share that the
    parent of one of the cluster's terms covers by prefix. ``terms`` may name a smaller table holding the term
    domain (the annotations); by default it is read off the counts.
    """
    # written first, so that its size is known: where it is small, counts stay dealt by cluster
    candidates = checkpoint(parent_candidates(counts if terms is None else terms, prefix_mode))
    spread = counts.join(candidates, "term", "left").select("cluster", "n", F.explode_outer("parents").alias("p"))
    own = F.col("p.own")
    per_parent = spread.groupBy("cluster", F.col("p.parent").alias("parent")).agg(
        F.sum("n").alias("covered"),
        # each term is counted once, on the row of its own parent
        F.sum(F.when(own, F.col("n"))).alias("own"),
        F.max(F.when(own, F.col("n"))).alias("top"),
        F.count_if(own).alias("terms"),
    )
    per_cluster = per_parent.groupBy("cluster").agg(
        F.coalesce(F.sum("own"), F.lit(0)).cast("long").alias("n_occurrences"),
        F.sum("terms").cast("long").alias("n_terms"),
        F.max("top").alias("_top"),
        F.max(F.when(F.col("terms") > 0, F.col("covered"))).alias("_covered"),
    )
    total = F.nullif(F.col("n_occurrences"), F.lit(0))
    return per_cluster.select(
        "cluster",
        "n_occurrences",
        "n_terms",
        (F.col("_top") / total).alias("ec4_purity"),
        (F.col("_covered") / total).alias("ec3_purity"),
    )


def cluster_purity(
    members: DataFrame, annotations: DataFrame, prefix_mode: str = "raw", keep_unannotated: bool = False
) -> DataFrame:
    return purity_of_counts(term_counts(members, annotations, keep_unannotated), annotations, prefix_mode)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where there is no whole."""
    return F.coalesce(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def summary(purity: DataFrame) -> DataFrame:
    """The ten-metric report from per-cluster rows that include the unannotated clusters.

    Thresholds are strict. The share of annotated clusters is null when there is no cluster at all; the other shares
    are 0 when nothing is annotated.
    """
    ec4, terms = F.col("ec4_purity"), F.col("n_terms")
    annotated = F.count(ec4)

    def share(condition: Column) -> Column:
        return percent(F.count_if(condition), annotated)

    return purity.agg(
        (F.lit(100.0) * annotated / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pct_with_ec"),
        share(ec4 > 0.8).alias("pct_ec4_over_80"),
        share(ec4 > 0.9).alias("pct_ec4_over_90"),
        share(ec4 == 1.0).alias("pct_ec4_100"),
        F.coalesce(F.avg(ec4), F.lit(0.0)).alias("avg_ec4_purity"),
        F.coalesce(F.avg("ec3_purity"), F.lit(0.0)).alias("avg_ec3_purity"),
        share(terms == 1).alias("pct_1_ec"),
        share(terms == 2).alias("pct_2_ec"),
        share(terms == 3).alias("pct_3_ec"),
        share(terms >= 4).alias("pct_4_or_more_ec"),
    )


def purity_summary(members: DataFrame, annotations: DataFrame, prefix_mode: str = "raw") -> DataFrame:
    return summary(cluster_purity(members, annotations, prefix_mode, keep_unannotated=True))


def top_terms(counts: DataFrame) -> DataFrame:
    """Most frequent term of each cluster; the smallest term wins a tie."""
    ranked = counts.where(F.col("term").isNotNull())
    best = ranked.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("term"))).alias("b"))
    return best.select("cluster", F.col("b.term").alias("term"), (-F.col("b.m")).alias("n"))


def long_form(metrics: DataFrame) -> DataFrame:
    """One row per metric (metric, value) from a one-row report."""
    return metrics.select(*[F.col(c).cast("double").alias(c) for c in metrics.columns]).unpivot(
        [], metrics.columns, "metric", "value"
    )
