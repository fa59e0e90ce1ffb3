"""Change events as a stream: stateful coalescing, and merging in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import ignored
from ..sources.versions import BucketedTable

EVENTS = "id long, repo string, path string, change_type string, detected_at timestamp"
PENDING = "repo string, path string, change_type string, n_events long, last_detected_at timestamp"
STATE = "kind string, n long, at timestamp, last_id long"


def _apply(kind: str | None, event: str) -> str:
    event = "added" if event == "created" else event
    if kind is None or event == "deleted":
        return event
    return "modified" if kind == "deleted" else kind


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kind, n, at, last = state.get if state.exists else (None, 0, None, -1)
    rows = pd.concat(list(frames)).drop_duplicates(["id"]).sort_values(["detected_at", "id"])
    for row in rows.itertuples(index=False):
        kind, n, at, last = _apply(kind, row.change_type), n + 1, row.detected_at, row.id
    state.update((kind, n, at, last))
    yield pd.DataFrame({"repo": [key[0]], "path": [key[1]], "change_type": [kind], "n_events": [n], "last_detected_at": [at]})


def relevant(events: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Events outside version control's own directory and outside the ignored patterns."""
    kept = events.filter("path is not null and not (path rlike '(^|/)[.]git(/|$)')")
    return kept.filter(~ignored(F.col("path"), patterns)) if patterns else kept


def coalesced(events: DataFrame, late: str = "7 days") -> DataFrame:
    """The pending change of each path that a batch touches, kept in state by (repo, path).

    Repeated events are dropped within the watermark. Events of one batch apply in the
    order of (detected_at, id).
    """
    fresh = events.filter("path is not null and change_type is not null").withWatermark("detected_at", late).dropDuplicatesWithinWatermark(["id"])
    return fresh.groupBy("repo", "path").applyInPandasWithState(_update, PENDING, STATE, "update", GroupStateTimeout.NoTimeout)


def merge_into(table: BucketedTable):
    """A ``foreachBatch`` function that merges each batch; a batch that comes again changes nothing.

    Only the buckets of the table that a batch touches are written.
    """
    keys = table.keys

    def run(batch: DataFrame, _epoch: int) -> None:
        batch = batch.groupBy(*keys).agg(F.max(F.struct("n_events", *[c for c in batch.columns if c not in (*keys, "n_events")])).alias("_r"))
        table.merge(batch.select(*keys, "_r.*"))

    return run


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows, with a watermark for late events."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
