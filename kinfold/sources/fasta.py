"""Sequence files as tables. Large files are read in parallel splits, one row per record, in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import ids, sequences
from kinfold.session import checkpoint

RECORD_BREAK = "\n>"


def _records(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(src, pos, text): record texts without their leading ``>``, numbered over all files in the order of their paths.

    The record break is the reader's line separator, so a file splits like any text file. A first pass counts the
    records of each split; that table (one row per split, written so that its size is known and Spark can decide to
    broadcast it) tells where a split starts. Records are not shuffled to be numbered. The first row of a file is a
    record only if the file starts with ``>``; anything before the first header is dropped. ``pos`` is unique.
    """
    reader = spark.read.option("lineSep", RECORD_BREAK)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    # rows of a split are numbered consecutively
    splits = raw.groupBy("src", "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_row").alias("_start"),
        F.min_by(F.startswith("value", F.lit(">")), F.col("_row")).alias("_opens"),
    )
    splits = checkpoint(splits.withColumn("_lost", ((F.col("_block") == 0) & ~F.col("_opens")).cast("int")))
    before = W.orderBy("src", "_block").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("_n") - F.col("_lost")).over(before), F.lit(0))
    layout = splits.select("src", "_block", "_start", "_lost", (offset - F.col("_start") - F.col("_lost")).alias("_shift"))
    placed = raw.join(layout, ["src", "_block"])
    first = (F.col("_block") == 0) & (F.col("_row") == F.col("_start"))
    kept = placed.where(~(first & (F.col("_lost") == 1)))
    text = F.when(first, F.expr("substr(value, 2)")).otherwise(F.col("value"))
    return kept.select("src", (F.col("_row") + F.col("_shift")).alias("pos"), text.alias("text"))


def _header(text: Column) -> Column:
    return F.regexp_extract(text, r"\A([^\n]*)", 1)


def _body(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[^\n]*\n?", "")


def read_fasta(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(src, pos, header, sequence): headers keep their ``>``, line ends are stripped, empty sequences stay."""
    df = _records(spark, paths, glob)
    space = f"[{ids.WHITESPACE}]"
    return df.select(
        "src",
        "pos",
        F.concat(F.lit(">"), ids.rstrip(_header(F.col("text")))).alias("header"),
        F.regexp_replace(_body(F.col("text")), f"{space}*\\n|{space}+\\z", "").alias("sequence"),
    )


def read_datasets(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """(dataset, src, pos, header, sequence) of several files, each record with the name of its dataset; ``files.resolve_fasta`` finds them."""
    records = read_fasta(spark, list(datasets.values()))
    names = spark.createDataFrame([(path.rsplit("/", 1)[-1], name) for name, path in datasets.items()], "_file string, dataset string")
    # one row per file
    return records.withColumn("_file", F.url_decode(F.substring_index("src", "/", -1))).join(F.broadcast(names), "_file").select("dataset", "src", "pos", "header", "sequence")


def read_embedder_input(
    spark: SparkSession, paths: str | list[str], split_char: str = "!", id_field: int = 0, is_3di: bool = False, glob: str | None = None
) -> DataFrame:
    """(src, pos, seq_id, key, sequence): the id field of the header, its store key and the cleaned sequence."""
    return embedder_columns(read_fasta(spark, paths, glob), split_char, id_field, is_3di)


def embedder_columns(records: DataFrame, split_char: str = "!", id_field: int = 0, is_3di: bool = False) -> DataFrame:
    header = ids.strip(F.expr("substr(header, 2)"))
    return records.select("src", "pos", ids.header_field(header, split_char, id_field).alias("seq_id"), "sequence").select(
        "src", "pos", "seq_id", ids.embedder_key(F.col("seq_id")).alias("key"), sequences.clean(F.col("sequence"), is_3di).alias("sequence")
    )


def read_headers(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(src, header): header lines only, one row each."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("src"), F.col("value").alias("header"))
    return lines.where(F.startswith("header", F.lit(">")))


def read_ids(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(src, pos, fasta_id, export_key, store_key) in file order."""
    df = read_fasta(spark, paths, glob)
    fasta_id = F.regexp_replace(ids.strip(F.col("header")), "^>+", "")
    return df.select(
        "src", "pos", fasta_id.alias("fasta_id"), ids.export_key(fasta_id).alias("export_key"), ids.fasta_key(F.col("header")).alias("store_key")
    )


def write_fasta(df: DataFrame, path: str) -> None:
    """Header line and sequence line per record; the header keeps its ``>``."""
    df.select(F.concat_ws("\n", "header", "sequence").alias("value")).write.text(path)
