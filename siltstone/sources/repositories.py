"""Reading repositories: files on disk, manifests and evaluation scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of
from ..operators.filters import IGNORED, ignored


def scan(spark: SparkSession, root: str, repo: str, patterns=IGNORED) -> DataFrame:
    """Files below ``root`` with path, language, size, kind and text.

    A file is binary when its first 64 KiB hold a zero byte or it is not valid UTF-8;
    binary files have no text. Ignored paths are left out before contents are decoded.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", rf"^(?:file:)?/*{base.lstrip('/')}/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    rows = rows.filter(~ignored(F.col("path"), patterns))
    text = F.col("content").cast("string")
    binary = (F.position(F.lit(b"\x00"), F.substring("content", 1, 65536)) > 0) | ~F.is_valid_utf8(text)
    return rows.select(F.lit(repo).alias("repo"), "path", language_of(F.col("path")).alias("language"), "size", "mtime", binary.alias("is_binary"), F.when(~binary, text).alias("text"))


def without_prefixes(paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """Paths outside the given directories (such as submodules)."""
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("path").startswith(p.rstrip("/") + "/")
    return paths.filter(~cond)


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation scenarios from a JSON file or a tree of them (an object or a list a file)."""
    result = "array<struct<file:string,symbol:string,relevance:double>>"
    schema = f"id string, query string, repo string, expected_results {result}, metadata struct<category:string,difficulty:string>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.select("id", "query", "repo", F.col("expected_results").alias("expected"), "metadata.category", "metadata.difficulty").filter("id is not null")


def instances(spark: SparkSession, path: str, repos: list[str] | None = None) -> DataFrame:
    """Benchmark instances, one JSON object a line, of the given repositories."""
    rows = spark.read.schema("instance_id string, repo string, problem_statement string, patch string").json(path)
    return rows.filter(F.col("repo").isin(*repos)) if repos else rows
