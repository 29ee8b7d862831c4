"""Extra (the reference has no streaming): the idempotent catalog upsert (C1) and the append-only log (W7) as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_versions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """For each url and day of ``ts``, the last version's hash; state older than ``late`` is let go."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day.alias("day"), "url").agg(F.max(F.struct("ts", "sha256")).alias("last"), F.count("*").alias("versions")).select("day.start", "url", "last.sha256", "versions")


def append_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events to a Parquet log once each, then stop at what is there now; run again to go on."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
