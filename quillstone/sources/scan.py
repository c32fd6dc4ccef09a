"""Incremental directory scans: only files whose fingerprint is new are classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINGERPRINT = ["path", "modificationTime", "length"]


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length of the files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select(*FINGERPRINT)


def with_cache(files: DataFrame, cache: DataFrame, keys: list[str] = FINGERPRINT) -> DataFrame:
    """files with what the cache knows of the same fingerprint, else nulls."""
    return files.join(cache, keys, "left")


def pending(files: DataFrame, cache: DataFrame, keys: list[str] = FINGERPRINT) -> DataFrame:
    return files.join(cache, keys, "left_anti")


def pruned(cache: DataFrame, files: DataFrame, keys: list[str] = FINGERPRINT) -> DataFrame:
    """The cache without entries of files that are gone."""
    return cache.join(files, keys, "left_semi")


def page_lines(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, text): stripped lines that are not blank, numbered as they stand."""
    lines = pages.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.select("doc", "line_no", F.trim("line").alias("text")).where("text <> ''")
