"""The driver's tables as the engine's entities: catalog, chunks, queries, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the source of the document of the same id as their document; sources 0 to 6 are academic."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return vectors.join(docs, "chunk_id").withColumn("doc_type", F.when(F.col("doc").rlike("^src[0-6]$"), "academic").otherwise("public"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a question, the next one as its translation; neither is searched."""
    vectors = table(spark, sf_dir, "embeddings")
    original = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("original"))
    translated = vectors.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("translated"))
    return original.join(translated, "query_id").withColumn("exclude", F.array("query_id", F.col("query_id") + 1))
