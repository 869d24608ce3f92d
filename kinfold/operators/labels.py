"""Label maps: class numbering, last-wins assignment, and the join of sequences with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.operators.ordering import with_position

MISSING_WARN_SHARE = 0.1


def class_index(mapping: DataFrame) -> DataFrame:
    """(family, class_idx) numbered by first appearance in ``pos`` order."""
    first = mapping.groupBy("family").agg(F.min("pos").alias("_first"))
    return with_position(first, ["_first", "family"], "class_idx").select("family", "class_idx")


def label_map(mapping: DataFrame) -> DataFrame:
    """(seq_id, family, class_idx); the last line of a sequence wins."""
    last = mapping.groupBy("seq_id").agg(F.max_by("family", "pos").alias("family"))
    return last.join(class_index(mapping), "family").select("seq_id", "family", "class_idx")


def num_classes(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count_distinct("family").alias("num_classes"))


def join_labels(sequences: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences that have a label (with it), and those that have none; both keyed by ``seq_id``."""
    return sequences.join(labels, "seq_id"), sequences.join(labels, "seq_id", "left_anti")


def label_quality(sequences: DataFrame, labels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Matched and missing counts, and whether the missing exceed a tenth of the matched."""
    flagged = sequences.join(labels.select("seq_id", F.lit(1).alias("_hit")).dropDuplicates(["seq_id"]), "seq_id", "left")
    out = flagged.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count("_hit").alias("n_matched"),
        (F.count(F.lit(1)) - F.count("_hit")).alias("n_missing"),
    )
    return out.withColumn("warn", F.col("n_missing") > F.col("n_matched") * F.lit(MISSING_WARN_SHARE))


def first_missing(missing: DataFrame, n: int = 5) -> DataFrame:
    """The report of the first few sequences without a label."""
    return missing.orderBy("pos").limit(n)


def write_complete(
    rows: DataFrame, needed: dict[str, Column], path: str, most_missing: float | None = MISSING_WARN_SHARE, order: str = "pos", id_col: str | None = None, first: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Write the rows that have all that is ``needed`` and report what the others lack, both in the one pass that writes.

    Returns the rows written and the report: ``what``, ``n_total``, ``n_missing``, ``warn`` (over a tenth of those that have it), and with ``id_col`` also
    ``first_missing``, the ids of the ``first`` rows without it in ``order`` (empty if none lacks it), for which the rows are read again. If more than ``most_missing`` of the rows lack something the call fails, and the table does not
    appear at ``path``: it is written beside it and renamed when the counts are known. Without a limit (None) it always appears.
    """
    spark, seen = rows.sparkSession, Observation()
    facts = [F.count(F.lit(1)).alias("n"), *[F.count_if(value.isNull()).alias(f"n_{what}") for what, value in needed.items()]]
    complete = F.lit(True)
    for value in needed.values():
        complete = complete & value.isNotNull()
    draft = f"{path.rstrip('/')}.draft"
    rows.observe(seen, *facts).where(complete).write.mode("overwrite").parquet(draft)
    got = seen.get
    short = {what: got[f"n_{what}"] for what in needed}
    if most_missing is not None and any(n > most_missing * got["n"] for n in short.values()):
        raise ValueError(f"of {got['n']} rows too many lack something: {short}")
    at, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, draft))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) or not fs.rename(new, at):
        raise OSError(f"could not put the table at {path}")
    lines = [(what, got["n"], n, n > MISSING_WARN_SHARE * (got["n"] - n)) for what, n in short.items()]
    schema = "what string, n_total bigint, n_missing bigint, warn boolean"
    if id_col:
        ids = {w: [str(r[0]) for r in rows.where(v.isNull()).select(id_col, order).orderBy(order).limit(first).collect()] for w, v in needed.items()}
        lines, schema = [(*line, ",".join(ids[line[0]])) for line in lines], f"{schema}, first_missing string"
    report = spark.createDataFrame(lines, schema)
    return spark.read.schema(rows.schema).parquet(path), report
