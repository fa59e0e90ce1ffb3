"""Fusing ranked lists, and choosing diverse results.

A ranked frame has ``query_id, list_no, rank, id, score``; order is always a column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, list_no: int, descending: bool = True) -> DataFrame:
    """Ranks from 1 within each query; equal scores rank by id."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return scores.select("query_id", F.lit(list_no).alias("list_no"), rank.alias("rank"), "id", "score")


def reciprocal_rank(lists: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """Sum of 1/(k+rank) by id. Rows without id keep their rank but are left out; an id that
    stands twice in a list counts twice."""
    parts = lists.filter("id is not null").groupBy("query_id", "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.count("*").alias("appearances"),
        F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank"))), lambda s: s["rank"]).alias("rankings"),
    )
    return cut(parts, top_k)


def weighted(lists: DataFrame, weights: Sequence[float], normalise: bool = True, top_k: int | None = None) -> DataFrame:
    """Weighted sum of scores, scaled to 0..1 within each list (all equal: 1)."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    whole = Window.partitionBy("query_id", "list_no")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)) if normalise else F.col("score")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("list_no"))
    parts = lists.filter("id is not null").withColumn("part", scaled * weight)
    return cut(parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("contributions")), top_k)


def with_confidence(fused: DataFrame, lists: int, column: str = "appearances") -> DataFrame:
    return fused.withColumn("confidence", F.col(column) / F.lit(lists))


def fuse(method: str):
    """The fusion of that name."""
    if method not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {method}")
    return reciprocal_rank if method == "rrf" else weighted


def cut(scored: DataFrame, top_k: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id"))
    out = scored.withColumn("rank", rank)
    return out.filter(F.col("rank") <= top_k) if top_k is not None else out


def diversify(candidates: DataFrame, queries: DataFrame, top_k: int = 10, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each query's candidates.

    ``candidates(query_id, id, score, vector)``, at most a few thousand a query, as they are
    the cut of a ranked list. A candidate without a vector stands at the query's. Greedy:
    the score weighs ``balance``, the closest chosen candidate the rest; ties go to the
    higher score, then the smaller id.
    """
    joined = candidates.join(queries.select("query_id", F.col("vector").alias("_q")), "query_id", "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rows = [v if v is not None and len(v) else q for v, q in zip(frame["vector"], frame["_q"], strict=True)]
        size = max((len(v) for v in rows if v is not None), default=1)
        x = np.array([np.asarray(v, float) if v is not None and len(v) == size else np.zeros(size) for v in rows])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score = frame["score"].to_numpy(float)
        left, chosen, value = list(range(len(frame))), [], []
        closest = np.full(len(frame), -np.inf)
        while left and len(chosen) < top_k:
            worth = balance * score[left] - (1 - balance) * (closest[left] if chosen else 0.0)
            best = int(np.argmax(np.round(worth, 12)))
            pick = left.pop(best)
            chosen.append(pick)
            value.append(worth[best])
            closest = np.maximum(closest, x @ x[pick])
        return pd.DataFrame({"query_id": frame["query_id"].iloc[chosen].to_numpy(), "id": frame["id"].iloc[chosen].to_numpy(), "mmr_score": value, "rank": range(1, len(chosen) + 1)})

    kind = dict(candidates.dtypes)
    return joined.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, mmr_score double, rank int")


def rerank(hits: DataFrame, scorer, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """Hits with a second score from ``scorer(query, text)`` (a Column or an Arrow UDF)."""
    out = hits.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    if threshold is not None:
        out = out.filter(F.col("rerank_score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "id"))
    out = out.withColumn("rank", rank)
    return out.filter(F.col("rank") <= top_k) if top_k is not None else out
