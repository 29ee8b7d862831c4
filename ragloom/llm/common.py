"""What several of the operators share: words of a text, hashes, checkpoints, batches, hash samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filter_after, unused
from ..sources.sinks import checkpointed, delete, shared_folder, small_batches

__all__ = ["checkpointed", "count_of", "crc32_text", "delete", "filter_after", "hash_sample", "shared_folder", "shuffle_partitions", "small_batches", "unused", "words", "written"]

#: Words are what lies between runs of these (space, tab, line feed, vertical tab, form feed, return).
SPACE = "[ \\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text that isn't null, as an array; no words: an empty array."""
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, keep: str) -> Column:
    """How many characters of the class ``[keep]`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes; null for null."""
    return F.crc32(text.cast("binary"))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its path for ``delete``: a checkpoint of which a reader takes the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/ragloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, key: str, rows: int, total: int, seed: int = 17) -> DataFrame:
    """About ``rows`` of ``total`` rows, those whose seeded hash of ``key`` is lowest; the same on any cluster."""
    share = min(1.0, rows / max(1, total))
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
