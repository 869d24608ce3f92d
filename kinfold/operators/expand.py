"""From cluster labels of representatives to families of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.ids import cluster_file
from kinfold.operators.ordering import with_position
from kinfold.session import TASK_ROWS, checkpoint, frequent, parts_for

NOISE = -1
SPARSE = 16  # members per representative beyond which most of them are taken to be those of others


def families(assignment: DataFrame) -> DataFrame:
    """(rep, pos, label) to (rep, pos, label, cluster_id).

    Every noise point (label -1) is a family of its own; families are numbered from 0 by the first appearance of one
    of their representatives in ``pos`` order. ``pos`` is unique.
    """
    noise = F.col("label") == NOISE
    # one key per family: the label, or the position of the noise point
    keyed = assignment.select(
        "rep", "pos", "label", noise.alias("_noise"), F.when(noise, F.col("pos")).otherwise(F.col("label")).cast("long").alias("_key")
    )
    first = keyed.groupBy("_noise", "_key").agg(F.min("pos").alias("_first"))
    numbered = with_position(first, ["_first"], "cluster_id").drop("_first")
    return keyed.join(numbered, ["_noise", "_key"]).select("rep", "pos", "label", "cluster_id")


def expand_members(reps: DataFrame, members: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Attach the members of each representative; one that has none stands for itself.

    ``reps`` carries ``rep`` and any further columns, ``members`` is the multimap (rep, member). Both are dealt by ``rep`` to as many tasks as their rows
    ask for, except those of representatives with more than ``task_rows`` members. Members of others than ``reps`` are left out first where there are many.
    """
    members = members.select("rep", "member").where(F.col("rep").isNotNull())
    n_members, n_reps = members.count(), reps.count()
    if n_members > SPARSE * n_reps:
        reps = checkpoint(reps)  # its size is known then: where it is small, members need not move
        members = checkpoint(members.join(reps.select("rep"), "rep", "left_semi"))
        n_members = members.count()
    parts = parts_for(n_members + n_reps, task_rows)
    hot, many = frequent(members, "rep", task_rows), None
    if hot is not None:
        hot = F.broadcast(hot)  # at most rows / task_rows of them
        # an inner join lets Spark split the members of a frequent representative, an outer one would not
        many = reps.join(hot, "rep", "left_semi").join(members.join(hot, "rep", "left_semi"), "rep")
        reps, members = reps.join(hot, "rep", "left_anti"), members.join(hot, "rep", "left_anti")
    known = members.withColumn("_has", F.lit(True)).repartition(parts, "rep")
    found = reps.repartition(parts, "rep").join(known, "rep", "left")
    found = found.withColumn("member", F.when(F.col("_has"), F.col("member")).otherwise(F.col("rep"))).drop("_has")
    return found if many is None else found.unionByName(many)


def with_file_name(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster_file", cluster_file(F.col("cluster_id")))
