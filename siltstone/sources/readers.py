"""Sources: corpora of Parquet folders, query cases, files by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import glob_match
from siltstone.operators.evaluation import all_pages

CASES = "query string, archive_id string, expected_pages array<int>, expected_page int, expected_terms array<string>, note string"


def query_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of query cases; blank queries are dropped, both page fields become one."""
    raw = spark.read.schema(CASES).option("multiLine", True).json(path)
    return raw.select(F.trim("query").alias("query_text"), "archive_id", all_pages(F.col("expected_pages"), F.col("expected_page")).alias("expected_pages"), F.transform("expected_terms", lambda t: F.trim(t)).alias("expected_terms"), "note").where("query_text <> ''")


def discover(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True, excludes: list[str] | None = None) -> DataFrame:
    """relative_path, size, mtime of files below root, without their contents; sorted by lower-cased path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    relative = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    found = files.select(relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return found.where(~glob_match(F.col("relative_path"), excludes or [])).orderBy(F.lower("relative_path"))


def _quoted(s: str) -> str:
    import re

    return re.escape(s)


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, hash (SHA-256 of the content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("hash"))
