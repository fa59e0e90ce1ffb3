"""Change events: coalescing them by path, and what an index has drifted from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _next(state: Column, event: Column) -> Column:
    """A path's pending change after an event: a deletion wins, a path that comes back after
    one is modified, otherwise the first kind stays."""
    return (
        F.when(state.isNull(), event)
        .when(event == "deleted", F.lit("deleted"))
        .when(state == "deleted", F.lit("modified"))
        .otherwise(state)
    )


def coalesce(events: DataFrame) -> DataFrame:
    """One pending change by (repo, path) from ``events(id, repo, path, change_type, detected_at)``.

    Repeated rows count once; ``created`` and ``added`` are one kind. Events apply in the
    order of (detected_at, id); rows without path or kind are left out.
    """
    kind = F.when(F.col("change_type").isin("created", "added"), "added").otherwise(F.col("change_type"))
    rows = events.select("id", "repo", "path", "detected_at", kind.alias("kind")).filter("path is not null and kind is not null").distinct()
    by = rows.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("detected_at", "id", "kind"))).alias("_e"))
    state = F.aggregate("_e", F.lit(None).cast("string"), lambda s, e: _next(s, e["kind"]))
    return by.select("repo", "path", state.alias("change_type"), F.size("_e").cast("long").alias("n_events"), F.element_at("_e", -1)["detected_at"].alias("last_detected_at"))


def drift(manifest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Paths of the snapshot that are gone or changed: a different size or time counts only
    with a different hash."""
    m = manifest.select("repo", "path", F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("content_hash").alias("_h"))
    joined = snapshots.join(m, ["repo", "path"], "left")
    moved = (F.col("size") != F.col("_s")) | ~F.col("mtime").eqNullSafe(F.col("_t"))
    kind = F.when(F.col("_h").isNull(), "deleted").when(moved & (F.col("content_hash") != F.col("_h")), "modified")
    return joined.select("repo", "path", kind.alias("drift")).filter("drift is not null")
