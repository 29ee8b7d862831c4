"""A stored catalog with versions (C1, C3, W1): each is written aside, then made the current one by a pointer that is switched at once.

A version is a Parquet table in a folder of its own, which nothing writes to again. The pointer is a small file; a new one is
written beside it and renamed over it, which the store does as a whole or not at all. A run that fails in between leaves the
catalog as it was, and a folder that no pointer names. Old versions can be read, or made the current one again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalog
from .sinks import delete

POINTER, LIST = "CURRENT", "versions"


class VersionMoved(RuntimeError):
    """Another run has made a version since the one that this run began with."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths below it."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda *names: of("/".join([path, *names]))


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version; None for a catalog that has none yet."""
    files, at = _files(spark, path)
    if not files.exists(at(POINTER)):
        return None
    stream = files.open(at(POINTER))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of all whole versions, oldest first. A folder that a failed run has left isn't one."""
    files, at = _files(spark, path)
    if not files.exists(at(LIST)):
        return []
    return sorted(str(f.getPath().getName()) for f in files.listStatus(at(LIST)) if files.exists(at(LIST, f.getPath().getName(), "_SUCCESS")))


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A version's rows, the current one's if none is named."""
    name = version or current(spark, path)
    if name is None:
        raise FileNotFoundError(f"no catalog in {path}")
    return spark.read.parquet(f"{path}/{LIST}/{name}")


def prepare(rows: DataFrame, path: str) -> str:
    """Write ``rows`` aside as a version that isn't the current one yet; its name."""
    spark = rows.sparkSession
    last = max([int(v.split("-")[0]) for v in versions(spark, path)], default=0)
    name = f"{last + 1:08d}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{path}/{LIST}/{name}")
    return name


def switch(spark: SparkSession, path: str, version: str, expected: str | None) -> None:
    """Make a version the current one, if ``expected`` still is; otherwise VersionMoved."""
    files, at = _files(spark, path)
    if version not in versions(spark, path):
        raise FileNotFoundError(f"no whole version {version} in {path}")
    beside = at(f".{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    if current(spark, path) != expected:
        files.delete(beside, False)
        raise VersionMoved(f"the catalog in {path} is no longer at {expected}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(beside), files.makeQualified(at(POINTER)), over)


def run(spark: SparkSession, path: str, incoming: DataFrame, first: DataFrame) -> str:
    """The catalog after a run over ``incoming``, stored as a new version; ``first`` is the one to begin with.

    Rows of the version before are kept or updated, never dropped. Statuses are stored with the rows.
    """
    before = current(spark, path)
    snapshot = first if before is None else read(spark, path, before).drop("status")
    name = prepare(catalog.upsert(snapshot, incoming), path)
    switch(spark, path, name, before)
    return name


def forget(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete all but the last ``keep`` whole versions and the current one; their names."""
    now, gone = current(spark, path), versions(spark, path)[: -keep or None]
    for name in (found := [v for v in gone if v != now]):
        delete(spark, f"{path}/{LIST}/{name}")
    return found
