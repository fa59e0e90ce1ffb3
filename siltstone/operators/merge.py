"""Maintenance operators as pure functions from old and new rows to merged rows.

They write nothing; :mod:`siltstone.sources.versions` swaps a written result in at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """One row per key: the first in the given order (nulls last)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """Full outer merge: a new value wins unless null; ``keep_old`` columns keep the old value."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = []
    for c in old.columns:
        first, second = ("o", "n") if c in keep_old else ("n", "o")
        out.append(F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c))
    return o.join(n, cond, "full_outer").select(*out)


def prune(rows: DataFrame, scope: DataFrame, scope_keys: Sequence[str], keep: DataFrame, keep_keys: Sequence[str]) -> DataFrame:
    """Rows outside the scope, and rows within it that are to be kept."""
    outside = rows.join(scope.select(*scope_keys).distinct(), list(scope_keys), "left_anti")
    inside = rows.join(scope.select(*scope_keys).distinct(), list(scope_keys), "left_semi")
    return outside.unionByName(inside.join(keep.select(*keep_keys).distinct(), list(keep_keys), "left_semi"))


def difference(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Keys with their ``action``: added, deleted, modified or unchanged."""
    o = old.select(*keys, F.struct(*compare).alias("_o"))
    n = new.select(*keys, F.struct(*compare).alias("_n"))
    action = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("modified")
    return o.join(n, list(keys), "full_outer").select(*keys, action.alias("action"))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def ensure_schema(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns by name with type and default; missing ones are added, null ones filled."""
    out = []
    for name, (kind, default) in wanted.items():
        fill = F.lit(default).cast(kind)
        out.append((F.coalesce(F.col(name).cast(kind), fill) if name in df.columns else fill).alias(name))
    return df.select(*out)


def chunk_diff_stats(new: DataFrame, existing: DataFrame, key: str = "text_hash") -> DataFrame:
    """total, to_embed, unchanged, deleted and reuse_pct (truncated) of a re-indexing."""
    old = existing.select(key).distinct().withColumn("_old", F.lit(1))
    have = new.select(key).join(old, key, "left")
    fresh = have.agg(F.count("*").alias("total"), F.count_if(F.col("_old").isNull()).alias("to_embed"), F.count_distinct(F.when(F.col("_old").isNotNull(), F.col(key))).alias("unchanged"))
    gone = existing.select(key).distinct().join(new.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("deleted")).scalar()
    pct = F.when(F.col("total") > 0, (F.col("unchanged") * 100 / F.col("total")).cast("int")).otherwise(0)
    return fresh.select("total", "to_embed", "unchanged", gone.alias("deleted"), pct.alias("reuse_pct"))
