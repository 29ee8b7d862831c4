"""``python -m ragloom list``, ``python -m ragloom run QUERY SF_DIR [--out PATH] [--only SOURCE ...] [--dry-run]`` and
``python -m ragloom freeze BASELINE SETTINGS [--files FOLDER] [--write]``: settings are a JSON file; exit code 1 if anything
differs from the baseline, or if there is none."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import repro
from .plans import registry


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Lists the queries, or runs one and writes Parquet or shows it. A dry run shows the plan and reads nothing."""
    parser = argparse.ArgumentParser(prog="ragloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(registry.queries()))
    run.add_argument("sf_dir")
    run.add_argument("--out", help="folder of the Parquet table; without one 20 rows are shown")
    run.add_argument("--only", nargs="*", help="sources to keep, where the result has a source")
    run.add_argument("--dry-run", action="store_true")
    freeze = commands.add_parser("freeze")
    freeze.add_argument("baseline", help="folder of the baseline")
    freeze.add_argument("settings", help="JSON file; values under keys that begin with text: count by their fingerprint")
    freeze.add_argument("--files", help="folder of files whose bytes count")
    freeze.add_argument("--write", action="store_true", help="make what there is now the baseline")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "freeze":
        return _freeze(spark, given)
    rows = registry.queries()[given.query](spark, given.sf_dir)
    if given.only and "source" in rows.columns:
        rows = rows.filter(F.col("source").isin(*given.only))
    if given.dry_run:
        rows.explain("formatted")
    elif given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        rows.show(20)
    return 0


def _freeze(spark: SparkSession, given: argparse.Namespace) -> int:
    with open(given.settings, encoding="utf-8") as file:
        settings = json.load(file)
    files = None
    if given.files:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(given.files)
        files = raw.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "content")
    rows = repro.snapshot(spark, settings, files)
    if given.write:
        repro.write_baseline(rows, given.baseline)
        return 0
    code, diff = repro.gate(rows, given.baseline)
    if diff is None:
        print("no baseline")
    else:
        diff.show(50, truncate=False)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
