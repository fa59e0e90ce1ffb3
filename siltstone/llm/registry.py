"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import authorship, neighbours
from . import pack as packing
from . import split as splitting
from . import leakage, personal, secrets, validity
from .common import TOKEN, read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_files(spark, sf_dir).select(F.col("file_id").cast("long").alias("file_id"))


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authorship.not_hand_written(read(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked(neighbours.nearest(read(spark, sf_dir, "vectors"), k=10, min_similarity=0.9, probes=5))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over the stated query set: every id divisible by 20, against all rows."""
    found = neighbours.nearest(read(spark, sf_dir, "vectors"), k=10, queries_every=20, probes=48)
    return found.select("embed_model", "vec_id", "rank", "neighbour_id", F.round("similarity", 6).alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "window_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_secrets(spark, sf_dir).select(F.col("chunk_id").cast("long").alias("chunk_id"), "line_no").distinct()


def p4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "chunks"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact(read(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_files(spark, sf_dir).filter("not valid").select(F.col("file_id").cast("long").alias("file_id"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.check_files(read(spark, sf_dir, "files"), read(spark, sf_dir, "window_limits"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.rates(p5_files(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pack(spark, sf_dir).filter("n_pieces > 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(p6_pack(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("scenario_id").cast("long").alias("scenario_id")).distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "scenarios"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_items(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "kind", "line_no").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(read(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_files, p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p4_secrets, p4_redacted, p5_found, p5_files, p5_rates, p6_found, p6_pack, p6_containers, p7_found, p7_leaks, p8_found, p8_items, p8_redacted)}


#: Brute force over the well-formed vectors: each with its ten most similar ones.
NEAREST = """v AS (SELECT DISTINCT vec_id, embed_model, CAST(vector AS DOUBLE[]) AS x FROM vectors WHERE vector IS NOT NULL AND len(vector) = CASE embed_model WHEN 'small' THEN 64 WHEN 'large' THEN 96 END
      AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
    s AS (SELECT a.embed_model, a.vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.x, b.x) AS similarity FROM v a JOIN v b ON a.embed_model = b.embed_model AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY embed_model, vec_id ORDER BY round(similarity, 12) DESC, neighbour_id) AS rank FROM s)"""

SIZE = f"len(regexp_extract_all({{0}}, '{TOKEN}'))"


def oracle_sql() -> dict[str, str]:
    size = SIZE.format("c.text")
    return {
        "p2_found": f"WITH {NEAREST} SELECT DISTINCT least(vec_id, neighbour_id) AS vec_a, greatest(vec_id, neighbour_id) AS vec_b FROM r WHERE rank <= 10 AND similarity >= 0.9",
        "p2_neighbours": f"WITH {NEAREST} SELECT embed_model, vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10 AND vec_id % 20 = 0",
        "p3_found": f"""
            SELECT DISTINCT c.chunk_id FROM chunks c
            LEFT JOIN window_limits w ON w.ext = regexp_extract(lower(c.path), '[^/](\\.[^./]+)$', 1)
            CROSS JOIN (SELECT window_tokens AS rest FROM window_limits WHERE ext IS NULL) d
            WHERE {size} > coalesce(w.window_tokens, d.rest)""",
        "p6_found": f"SELECT doc_id FROM documents WHERE {SIZE.format('text')} > 2048",
    }
