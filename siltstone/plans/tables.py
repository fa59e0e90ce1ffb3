"""The driver's tables as the operators want them: one row per key, typed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Matching common table expressions for the SQL twins.
FILES = "f AS (SELECT DISTINCT file_id, repo, path, language, text, is_binary FROM files)"
CHUNKS = "c AS (SELECT DISTINCT chunk_id, file_id, repo, path, ordinal, text, start_line, end_line, text_hash, symbol_kind, symbol_name, symbol_path, h1, h2, h3 FROM chunks)"
VECTORS = "v AS (SELECT DISTINCT vec_id, id, embed_model, repo, path, start_line, end_line, text_hash, language, symbol_kind, token_count, vector, created_at FROM vectors)"
PENDING = "p AS (SELECT DISTINCT id, repo, path, change_type, detected_at, processed FROM pending_changes)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", "repo", "path", "language", "text", "is_binary").distinct()


def file_keys(spark: SparkSession, d: str) -> DataFrame:
    """Files without their texts."""
    return table(spark, d, "files").select("file_id", "repo", "path", "language", "is_binary").distinct()


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "chunks")
    return df.select("chunk_id", *columns).distinct() if columns else df.drop("token_count").distinct()


def vectors(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "vectors").select("vec_id", *columns).distinct()


def pending(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pending_changes").select("id", "repo", "path", "change_type", "detected_at", "processed").distinct()
    return rows


def stamp(column: str):
    """A zoneless timestamp as an instant (the session zone is UTC)."""
    return F.col(column).cast("timestamp")
