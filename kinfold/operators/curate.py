"""Record curation: cleaning, length filters with counters, first-wins dedup, resume, exact-size splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import sequences as S


def clean_records(df: DataFrame, family: str = "esm", is_3di: bool = False, seq: str = "sequence") -> DataFrame:
    """Strip gaps and whitespace, mask rare residues, add the length."""
    fresh = S.mask_rare(S.clean(F.col(seq), True), family) if is_3di else S.clean_and_mask(F.col(seq), family)
    cleaned = df.withColumn(seq, fresh)
    return cleaned.withColumn("length", S.n_residues(F.col(seq)))


def status(length: Column, max_len: int) -> Column:
    return F.when(length == 0, "empty").when(length > max_len, "long").otherwise("ok")


def keep_embeddable(df: DataFrame, max_len: int) -> DataFrame:
    return df.where((F.col("length") > 0) & (F.col("length") <= max_len))


def run_stats(df: DataFrame, max_len: int, store: DataFrame | None = None, key: str = "key") -> DataFrame:
    """One row of run counters: seen, empty, long, already stored, to be written, and their average length."""
    tagged = df.withColumn("_s", status(F.col("length"), max_len))
    if store is not None:
        tagged = tagged.join(store.select(key, F.lit(1).alias("_hit")).dropDuplicates([key]), key, "left")
    else:
        tagged = tagged.withColumn("_hit", F.lit(None).cast("int"))
    todo = (F.col("_s") == "ok") & F.col("_hit").isNull()
    return tagged.agg(
        F.count(F.lit(1)).alias("n_seen"),
        F.count_if(F.col("_s") == "empty").alias("n_empty"),
        F.count_if(F.col("_s") == "long").alias("n_long"),
        F.count_if((F.col("_s") == "ok") & F.col("_hit").isNotNull()).alias("n_existing"),
        F.count_if(todo).alias("n_written"),
        F.coalesce(F.avg(F.when(todo, F.col("length"))), F.lit(0.0)).alias("avg_length"),
    )


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first row (by ``order``, unique within a key) of each key.

    The minimum is found on (key, order) alone with partial aggregation, so a key owning a third of the rows costs one
    row per task, and only the kept rows travel with their payload in the semi-join.
    """
    return df.join(df.groupBy(key).agg(F.min(order).alias(order)), [key, order], "left_semi")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the last row of each key; otherwise as ``first_wins``."""
    return df.join(df.groupBy(key).agg(F.max(order).alias(order)), [key, order], "left_semi")


def first_text_wins(df: DataFrame, text: str, order: str) -> DataFrame:
    """``first_wins`` on a long text: the shuffle carries a 256-bit digest of the whole text instead of the text."""
    keyed = df.withColumn("_digest", F.sha2(text, 256))
    first = keyed.groupBy("_digest").agg(F.min(order).alias(order))
    return keyed.join(first, ["_digest", order], "left_semi").drop("_digest")


def pending(df: DataFrame, store: DataFrame, key: str = "key", overwrite: bool = False) -> DataFrame:
    """Rows still to be embedded: those whose key is not stored yet, or all of them when overwriting."""
    return df if overwrite else df.join(store.select(key), key, "left_anti")


def exact_split(
    df: DataFrame, id_col: str, fraction: float, rank: Column | None = None, seed: int = 42, shift: int = 44
) -> DataFrame:
    """Add ``split``: exactly ``floor(n * fraction)`` rows are ``val``, the rest ``train``.

    Rows are ranked by a pseudo-random number of their id (``rank``, a 64-bit hash by default), ties by id. No sort
    of the table: one pass counts rows per rank bucket (``rank >> shift``, about a million buckets), the bucket in
    which the quota runs out is the only one that is ordered, and a second pass compares with the cut found there.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    rank = F.xxhash64(F.col(id_col), F.lit(seed)) if rank is None else rank
    ranked = df.select(F.col(id_col), rank.alias("_r")).withColumn("_b", F.shiftright("_r", shift))
    freq = ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    cumulated = freq.select("_b", "_n", upto.alias("_upto"), F.floor(total * F.lit(fraction)).alias("_want"))
    before = F.col("_upto") - F.col("_n")
    edge = cumulated.where((before < F.col("_want")) & (F.col("_want") <= F.col("_upto"))).select(
        "_b", (F.col("_want") - before).alias("_need")
    )
    # a single row
    last = ranked.join(F.broadcast(edge), "_b").withColumn(
        "_k", F.row_number().over(W.partitionBy("_b").orderBy("_r", id_col))
    )
    cut = last.where(F.col("_k") <= F.col("_need")).agg(F.max(F.struct("_r", id_col)).alias("cut")).scalar()
    chosen = F.coalesce(F.struct(rank.alias("_r"), F.col(id_col)) <= cut, F.lit(False))
    return df.withColumn("split", F.when(chosen, "val").otherwise("train"))
