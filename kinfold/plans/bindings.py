"""How the domain roles (families, members, annotations, sequences, vectors) map to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Annotation view; the text is valid in Spark SQL and in DuckDB.
EC_VIEW = """
SELECT p_partkey AS accession, concat_ws('.', p_size%6+1, p_size%4+1, p_size%12+1, p_partkey%5+1) AS term FROM part
UNION
SELECT p_partkey, concat_ws('.', p_size%6+1, p_size%4+1, (p_size+3)%12+1, p_partkey%3+1) FROM part WHERE p_partkey%3=0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(EC_VIEW.replace("part WHERE", "{part} WHERE").replace("FROM part\n", "FROM {part}\n"), part=table(spark, sf, "part"))


def members(spark: SparkSession, sf: str, cluster: str = "l_orderkey") -> DataFrame:
    """Family members: lineitem by order (many small families) or by supplier (few large ones)."""
    return table(spark, sf, "lineitem").select(F.col(cluster).alias("cluster"), F.col("l_partkey").alias("accession"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sequence records; the header follows ``source/doc_id-n_chars``."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit(">"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("-"), F.col("n_chars").cast("string")).alias("header"),
        F.col("text").alias("sequence"),
    )


def lehmer(column: str) -> "F.Column":
    """Pseudo-random rank both engines can compute."""
    return F.expr(f"({column} * 48271) % 2147483647")
