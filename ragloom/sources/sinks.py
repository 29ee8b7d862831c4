"""Sinks: Parquet, JSON and CSV tables, upserts, append-only logs, and checkpoints in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine may name none: it gets one of its own. On a cluster that is an error, as each
    executor would write to its own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ragloom-"))
    return context.getCheckpointDir().rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch to a Python worker holds, by rows and bytes, so that a batch of very long texts fits it. A lower bound of the session's stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None) or "-1"
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its path for ``delete``: a reader takes the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/ragloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that is needed no more from the shared folder, in whatever store that lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, a folder for each strategy."""
    chunks.write.mode("overwrite").partitionBy("strategy").json(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """One Parquet table; the vector is a column of the chunk's row, a folder for each strategy."""
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(path)


def write_run(rows: DataFrame, path: str, run_id: str, settings: str) -> None:
    """Evaluation rows with their run and settings as columns, a folder for each run."""
    rows.withColumn("settings", F.lit(settings)).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_csv(rows: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header, its first name behind a byte order mark, so that spreadsheets read UTF-8; in order, if one is given."""
    first = rows.columns[0]
    marked = rows.orderBy(order) if order else rows
    marked.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").option("header", True).csv(path)


def write_tables(sheets: dict[str, DataFrame], path: str) -> None:
    """Several tables, a folder of CSV for each."""
    for name, rows in sheets.items():
        write_csv(rows, f"{path}/{name}")


def append_log(rows: DataFrame, path: str) -> None:
    """Append only."""
    rows.write.mode("append").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    """Newest first."""
    return spark.read.parquet(path).orderBy(F.desc("id"))


def upsert_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and the last (by ``seq``) row of each key of ``new``."""
    last = new.withColumn("n_last", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).filter("n_last = 1").drop("n_last", "seq")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def write_lines(lines: DataFrame, path: str, sheet: str = "sheet_id") -> None:
    """Text lines (sheet_id, order, line) with CRLF ends, in order: a folder for each sheet, in as many tasks as there are sheets."""
    placed = lines.withColumn("value", F.when(F.row_number().over(Window.partitionBy(sheet).orderBy("order")) == 1, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")))
    placed.repartition(sheet).sortWithinPartitions(sheet, "order").select(sheet, "value").write.mode("overwrite").partitionBy(sheet).option("lineSep", "\r\n").text(path)
