"""The registry of core queries: each family module contributes queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import indexing, maintenance, relational, searching

FAMILIES = [relational, maintenance, searching, indexing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        out.update(family.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in FAMILIES:
        out.update(family.ORACLES)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and vectors fused by rank."""
    return searching.hybrid_search(spark, sf_dir)
