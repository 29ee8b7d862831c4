"""Scans: registries, questions, page texts, chunks and raw files, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = "source_id name kind url page_range list_filter detail_pattern file_pattern body_selector query max_count license memo".split()
QUESTIONS = "number disease audience type expected_scope question rubric evidence gold".split()
PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("ocr", T.BooleanType())])


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header as strings under our column names; missing cells are ''. A byte order mark is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(_strings(columns)).csv(path)
    return rows.na.fill("").withColumn(columns[0], F.regexp_replace(columns[0], "^\\uFEFF", ""))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The source registry."""
    return read_strings(spark, path, REGISTRY)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with a gold position."""
    return read_strings(spark, path, QUESTIONS).filter(F.trim("gold") != "")


def read_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, page, text, ocr) of JSON lines, one file a document; else of its text file as page 0."""
    name = F.regexp_extract(F.input_file_name(), "([^/]+)\\.(?:jsonl|txt)$", 1)
    pages = spark.read.schema(PAGE).option("pathGlobFilter", "*.jsonl").json(folder).select(name.alias("doc_id"), "page", "text", F.coalesce("ocr", F.lit(False)).alias("ocr"), F.lit(0).alias("n_kind"))
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(name.alias("doc_id"), F.lit(0).alias("page"), F.col("value").alias("text"), F.lit(False).alias("ocr"), F.lit(1).alias("n_kind"))
    both = pages.unionByName(texts)
    return both.withColumn("n_best", F.min("n_kind").over(Window.partitionBy("doc_id"))).filter("n_kind = n_best").drop("n_kind", "n_best")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Local documents (key, path, content, sha256) of the three formats that are taken over by hand."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = raw.filter(F.lower("path").rlike("\\.(pdf|hwp|hwpx)$"))
    return kept.select(F.concat(F.lit("manual://"), F.regexp_extract("path", "([^/]+/[^/]+)$", 1)).alias("key"), "path", "content", F.sha2("content", 256).alias("sha256"))


def read_fetched(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched files of mixed kinds (key, kind, path, content, charset): the kind is the name of the folder that a file lies in.

    Files are read by Spark's own reader, in whatever store they are, which passes over empty ones; the key is a hash of the
    last two names of the path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    names = F.split("path", "/")
    return raw.select(F.xxhash64(F.element_at(names, -2), F.element_at(names, -1)).alias("key"), F.element_at(names, -2).alias("kind"), "path", "content", F.lit(None).cast("string").alias("charset"))


def import_notes(files: DataFrame, known: DataFrame, note: str) -> DataFrame:
    """Rows (key, sha256, note) of local files in order of their key; ``note`` is put once behind what ``known`` (key, note) has."""
    joined = files.select("key", "sha256").join(known.select("key", F.col("note").alias("before")), "key", "left")
    before = F.coalesce("before", F.lit(""))
    grown = F.when(F.contains(before, F.lit(note)), before).otherwise(F.concat_ws(" | ", F.when(before != "", before), F.lit(note)))
    return joined.select("key", "sha256", grown.alias("note")).orderBy("key")


def kept_index(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """One strategy of an index, kept in the executors' memory and disks for many searches; ``unpersist`` lets it go."""
    return read_index(spark, path, strategy).persist()


def read_index(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """One strategy of an index; an error if it has none."""
    rows = spark.read.parquet(path).filter(F.col("strategy") == strategy)
    if rows.isEmpty():
        raise FileNotFoundError(f"no index of strategy {strategy} in {path}")
    return rows


def strategies(spark: SparkSession, path: str) -> DataFrame:
    """The strategies that have an index."""
    return spark.read.parquet(path).select("strategy").distinct()
