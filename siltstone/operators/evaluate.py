"""Retrieval quality: reciprocal rank, precision, recall and average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results with ``relevant``: the file is expected, and the symbol where one is named.

    ``results(scenario_id, rank, file, symbol)``, ``expected(scenario_id, file, symbol)``.
    """
    e = expected.select(F.col("scenario_id").alias("_s"), F.col("file").alias("_f"), F.col("symbol").alias("_y")).distinct()
    cond = (F.col("scenario_id") == F.col("_s")) & (F.col("file") == F.col("_f")) & (F.col("_y").isNull() | F.col("_y").eqNullSafe(F.col("symbol")))
    hit = results.join(e, cond, "left_semi").select("scenario_id", "rank").withColumn("relevant", F.lit(1))
    return results.join(hit, ["scenario_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


def metrics(results: DataFrame, expected: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per scenario: reciprocal rank, average precision, precision and recall at depths.

    A precision at a depth beyond the results is 0.
    """
    rows = judged(results, expected)
    upto = Window.partitionBy("scenario_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.sum("relevant").over(upto) / F.col("rank"))
    wanted = expected.groupBy("scenario_id").agg(F.count_distinct(F.struct("file", "symbol")).alias("n_expected"))
    aggs = [F.max(F.when(F.col("relevant") == 1, 1.0 / F.col("rank"))).alias("_rr"), F.sum(F.when(F.col("relevant") == 1, F.col("_p"))).alias("_ap"), F.max("rank").alias("_n")]
    aggs += [F.sum(F.when(F.col("rank") <= d, F.col("relevant"))).alias(f"_h{d}") for d in depths]
    got = wanted.join(rows.groupBy("scenario_id").agg(*aggs), "scenario_id", "left")
    out = ["scenario_id", "n_expected", F.coalesce("_rr", F.lit(0.0)).alias("mrr"), F.coalesce(F.col("_ap") / F.col("n_expected"), F.lit(0.0)).alias("map")]
    for d in depths:
        out.append(F.when(F.col("_n") >= d, F.col(f"_h{d}") / d).otherwise(0.0).alias(f"p_at_{d}"))
        out.append(F.coalesce(F.col(f"_h{d}") / F.col("n_expected"), F.lit(0.0)).alias(f"r_at_{d}"))
    return got.select(*out)


def summary(per_scenario: DataFrame, groups: tuple[str, ...] = (), mrr_gate: float = 0.85) -> DataFrame:
    """Means over scenarios and the share at or above the gate, by group or overall."""
    names = [c for c in per_scenario.columns if c in ("mrr", "map") or c.startswith(("p_at", "r_at"))]
    return per_scenario.groupBy(*groups).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names), F.avg((F.col("mrr") >= mrr_gate).cast("double")).alias("pass_rate"))


def compare(baseline: DataFrame, current: DataFrame, gate: float = 0.85) -> DataFrame:
    """Scenarios that passed before and fail now, or the reverse."""
    b, c = baseline.select("scenario_id", F.col("mrr").alias("_b")), current.select("scenario_id", F.col("mrr").alias("_c"))
    change = F.when((F.col("_b") >= gate) & (F.col("_c") < gate), "regressed").when((F.col("_b") < gate) & (F.col("_c") >= gate), "fixed")
    return b.join(c, "scenario_id").select("scenario_id", F.col("_b").alias("before"), F.col("_c").alias("after"), change.alias("change")).filter("change is not null")
