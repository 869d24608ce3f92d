"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bottomk, bpe, decontaminate, hard_negatives, langid, lexical, line_windows, minhash, record_files, surrogates, token_count, toxicity, vocab, warc
from kinfold.llm.shared import new_folder
from kinfold.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"))


@query
def op8_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = record_files.write_records(docs, vocab.path("word_bpe_49k.json"), new_folder(spark, "records"), end_id=2)
    rows = record_files.read_records(record_files.with_starts(index), digest=True)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.tiktoken"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.record_table(_table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    last = warc.read_archives(archives, with_payload=False)
    ids = [F.col(c).cast("bigint").alias(c) for c in ("page_id", "refers_to")]
    return last.select(ids[0], "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", ids[1])


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.replace(_table(spark, sf_dir, "documents"), key="kinfold")
    return done.select("row.doc_id", "n_entities", "text")


@query
def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_windows.remove_repeated(_table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_removed", "text")


ORACLES["op5_line_windows"] = line_windows.sql()


@query
def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.edit_likeness(_table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = lexical.sql()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.sql()


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))
