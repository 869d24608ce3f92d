"""Cleaning pipeline over ``documents``: each stage applies one operator of ``kinfold.llm`` to all that the stage before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``. Stages do not look at each other: every one works
on whatever documents it gets, in one or several files, with further columns or without, empty or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, decontaminate, line_windows, minhash, toxicity, vocab
from kinfold.llm.shared import new_folder
from kinfold.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier rejects go. It learns from the labels of ``sf_dir`` that the operator may learn from."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later occurrences of repeated three-line windows go. A document of which nothing is left goes as a whole;
    ``n_chars``, where there is one, follows the new text."""
    done = line_windows.remove_repeated(docs).where("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of documents linked at a similarity of 0.8 the one with the least id stays."""
    ship_package(spark)
    return minhash.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item of ``benchmark`` go."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every document, with digests of the ids and of the bytes they decode to."""
    ship_package(spark)
    return bpe.encode_documents(docs, vocab.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The classifier, signatures and merges are beyond SQL; the tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; between two stages the documents are a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
