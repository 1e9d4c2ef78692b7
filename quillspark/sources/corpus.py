"""Sources and sinks: Markdown folders, bibliographies, JSON logs, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import versions

SKIPPED = ["readme.md", "index.md"]

CANDIDATES = "ts string, key string, label string, source string, doc string, judge string, venue string, span string, why string"
BASELINE = "file string, judge string, score int"


def read_folder(spark: SparkSession, paths: str | list[str], pattern: str = "*.md", filtered: bool = True) -> DataFrame:
    """stem and text of the files of folders, not below them.

    ``filtered`` leaves out dot files, readme.md and index.md.  Bytes that are
    no UTF-8 are dropped."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("text"))
    if filtered:
        rows = rows.where(~F.col("name").startswith(".") & ~F.lower("name").isin(SKIPPED))
    return rows.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "path", "text")


def long_enough(docs: DataFrame, over: int = 400) -> DataFrame:
    """Documents of more than so many words of prose."""
    return docs.where(F.regexp_count(T.prose(F.col("text")), F.lit(T.WORD)) > over)


def read_corpus(spark: SparkSession, paths: str | list[str], over: int = 400) -> DataFrame:
    return long_enough(read_folder(spark, paths), over)


def read_generated(spark: SparkSession, paths: str | list[str], over: int = 300) -> DataFrame:
    """ai_*.md files of more than so many space-separated words of prose."""
    rows = read_folder(spark, paths, "ai_*.md", filtered=False)
    return rows.where(T.spaced_words(T.prose(F.col("text"))) > over)


def read_bibliography(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, pos and line of all .bib files' lines that aren't blank."""
    rows = read_folder(spark, paths, "*.bib", filtered=False)
    return rows.select("path", F.posexplode(F.split("text", r"\r\n|[\r\n]")).alias("pos", "line")).where(F.trim("line") != "")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log with an explicit schema, all its batches; bad lines are
    dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Add rows to a log, once for each ``batch`` name however often it is tried;
    whether they were added now.  Without a name every call adds."""
    return versions.add_once(rows, path, batch or uuid.uuid4().hex, "json")


def cached(rows: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Compute once and keep as Parquet; read it afterwards unless refreshed.  A
    refresh is a version of its own: until it is whole, and if it fails, the last
    one is read."""
    spark = rows.sparkSession
    if refresh or versions.current(spark, path) is None:
        versions.publish(rows, path)
    return spark.read.parquet(versions.current(spark, path))


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Documents from any format Spark reads (parquet, orc, json, csv, text)."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
