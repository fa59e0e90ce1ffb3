"""Vector search: exact blocks, and probing of cluster partitions.

A stated set of queries is compared with all rows: few queries are broadcast to the rows,
many are dealt into blocks against blocks of rows. Each task keeps its k best per query, and
only those k rows a task and query are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries compared in one pass over the rows, which bounds what is broadcast.
BLOCK = 65_536
#: Rows that are compared with a block of queries in one task, where queries are many.
CELL = 131_072
#: Rows and queries of one matrix product.
ROWS, ASKED = 2048, 512
RANKED = "query_id long, id long, distance double"
#: With the rounded distance that ranks go by.
FOUND = RANKED + ", near double"


@dataclass(frozen=True)
class Tuning:
    """Clusters to visit and the factor of candidates that are ranked again exactly."""

    nprobes: int = 10
    refine: int = 5
    use_index: bool = True

    def __post_init__(self):
        if self.nprobes < 1 or self.refine < 1:
            raise ValueError("nprobes and refine must be at least 1")

    @staticmethod
    def preset(name: str) -> Tuning:
        # The named presets.
        return {"speed": Tuning(10, 5), "accuracy": Tuning(30, 20), "exact": Tuning(1000, 100, False)}[name]

    @staticmethod
    def adaptive(kind: str, top_k: int, rows: int) -> Tuning:
        clusters = max(rows // 100, 10)
        root = int(math.sqrt(clusters))
        if kind == "identifier":
            return Tuning(max(1, min(2 * root, 50)), 20)
        if top_k <= 5:
            return Tuning(max(1, root), 10)
        return Tuning(max(root // 2, 10), 5)

    def speedup(self) -> float:
        return 200.0 / (self.nprobes * self.refine)

    def adjusted(self, latencies: list[float], target: float) -> Tuning:
        """After at least ten measurements: fewer clusters when slow, more when fast."""
        if len(latencies) < 10:
            return self
        mean = sum(latencies[-20:]) / len(latencies[-20:])
        if mean > 1.2 * target:
            return replace(self, nprobes=max(5, int(self.nprobes * 0.8)), refine=max(5, int(self.refine * 0.9)))
        if mean < 0.8 * target:
            return replace(self, nprobes=min(50, int(self.nprobes * 1.2)), refine=min(15, int(self.refine * 1.1)))
        return self


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine distance, squared Euclidean distance or negative dot product, in doubles."""
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(x, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (q @ x.T) / (nq @ nx.T)
        return 1.0 - np.nan_to_num(s)
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0.0)
    if metric == "dot":
        return -(q @ x.T)
    raise ValueError(f"unknown metric {metric}")


def keep_best(k: int, digits: int, kept: np.ndarray, own: np.ndarray, rows: np.ndarray, d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Takes candidates into the k best of each row, in place; returns the rows that had any.

    ``kept`` and ``own`` are the values and ids so far, k wide and infinite where empty;
    ``rows`` (ascending), ``d`` and ``i`` are row, value and id of the candidates. Values are
    compared after rounding to ``digits``, equal ones by the smaller id.
    """
    count = np.bincount(rows, minlength=len(kept))
    some = np.flatnonzero(count)
    if not len(some):
        return some
    count = count[some]
    at = np.repeat(np.arange(len(some)), count)
    place = k + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    value, name = np.full((len(some), k + count.max()), np.inf), np.zeros((len(some), k + count.max()), dtype=np.int64)
    value[:, :k], name[:, :k] = kept[some], own[some]
    value[at, place], name[at, place] = d, i
    rounded = np.round(value, digits)
    best = rounded <= np.partition(rounded, k - 1, axis=1)[:, k - 1 : k]
    tied = best.sum(axis=1) > k
    kept[some[~tied]], own[some[~tied]] = value[~tied][best[~tied]].reshape(-1, k), name[~tied][best[~tied]].reshape(-1, k)
    order = np.lexsort((name[tied], rounded[tied]), axis=1)[:, :k]
    kept[some[tied]], own[some[tied]] = np.take_along_axis(value[tied], order, 1), np.take_along_axis(name[tied], order, 1)
    return some


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms in doubles and the vectors of length 1 in single precision; zero vectors stay zero."""
    norm = np.linalg.norm(x, axis=1)
    return norm, (x / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)


def _true(flags: np.ndarray) -> np.ndarray:
    """Flat places of the few true flags, looked for eight at a time."""
    if flags.size % 8:
        return np.flatnonzero(flags)
    some = np.flatnonzero(flags.reshape(-1).view(np.uint64))
    return (8 * some[:, None] + np.arange(8))[flags.reshape(-1, 8)[some]]


class _Closest:
    """The k best of all rows added, for each query; ties go to the smaller id.

    Cosines are first computed in single precision. Its error is below ``slack``, so a row
    farther than the k-th best by more than that cannot be among the k best; all others are
    computed in double precision, and only these values count.
    """

    def __init__(self, metric: str, k: int, ids: np.ndarray, q: np.ndarray):
        self.metric, self.k, self.ids, self.q = metric, k, ids, q
        self.kept, self.own = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), dtype=np.int64)
        self.bound = np.full(len(ids), np.inf)
        if metric == "cosine":
            self.norm, self.unit = np.empty(len(ids)), np.empty(q.shape, dtype=np.float32)
            for lo in range(0, len(ids), ROWS):
                self.norm[lo : lo + ROWS], self.unit[lo : lo + ROWS] = _unit(q[lo : lo + ROWS].astype(np.float64))
        # Twice the bound of a sum of rounded products, which is (length + 3) half units in the last place.
        self.slack = (q.shape[1] + 8) * 2.0**-23 if metric == "cosine" else 0.0

    def add(self, frame: pd.DataFrame) -> None:
        ok = frame["vector"].map(lambda v: v is not None and len(v) == self.q.shape[1])
        frame = frame[ok.to_numpy(dtype=bool)]
        for lo in range(0, len(frame), ROWS):
            part = frame.iloc[lo : lo + ROWS]
            x = np.stack(part["vector"].to_numpy()).astype(np.float64)
            fine = np.isfinite(x).all(axis=1)
            x, own = x[fine], part["id"].to_numpy()[fine]
            norm, unit = _unit(x) if self.metric == "cosine" else (None, None)
            for at in range(0, len(self.ids) if len(x) else 0, ASKED):
                self._compare(at, x, own, norm, unit)

    def _compare(self, at: int, x: np.ndarray, own: np.ndarray, norm: np.ndarray, unit: np.ndarray) -> None:
        mine = slice(at, at + ASKED)
        q = self.q[mine]
        # Nearness, the greater the nearer: cosines in single precision, else distances below zero.
        rough = self.unit[mine] @ unit.T if self.metric == "cosine" else -distances(self.metric, q.astype(np.float64), x)
        least = (1.0 if self.metric == "cosine" else 0.0) - self.bound[mine]
        fresh, width = np.isinf(least), rough.shape[1]
        if fresh.any() and width > self.k:
            least[fresh] = np.partition(rough[fresh], width - self.k, axis=1)[:, width - self.k] - self.slack
        # The last places of the rounding belong to the k-th best, too.
        least = np.nextafter((least - self.slack - 2e-12).astype(rough.dtype), np.array(-np.inf, dtype=rough.dtype))
        r, c = np.divmod(_true(rough >= least[:, None]), width)
        if self.metric == "cosine":
            d = np.empty(len(r))
            for lo in range(0, len(r), 32_768):
                some = slice(lo, lo + 32_768)
                d[some] = np.einsum("ij,ij->i", q[r[some]].astype(np.float64), x[c[some]])
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 1.0 - np.nan_to_num(d / (self.norm[mine][r] * norm[c]))
        else:
            d = -rough[r, c]
        changed = keep_best(self.k, 12, self.kept[mine], self.own[mine], r, d, own[c])
        self.bound[at + changed] = np.round(self.kept[at + changed], 12).max(axis=1)

    def found(self) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(self.ids), ROWS):
            d = self.kept[lo : lo + ROWS]
            there = np.isfinite(d)
            yield pd.DataFrame({"query_id": np.repeat(self.ids[lo : lo + ROWS], self.k)[there.ravel()], "id": self.own[lo : lo + ROWS][there], "distance": d[there], "near": np.round(d[there], 12)})


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries of each length."""
    for _, same in frame.groupby(frame["vector"].map(len)):
        yield same["query_id"].to_numpy(dtype=np.int64), np.stack(same["vector"].to_numpy())


def _cell(metric: str, k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for ids, q in _by_length(right) if len(left) and len(right) else ():
            best = _Closest(metric, k, ids, q)
            best.add(left)
            found += best.found()
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "distance": [], "near": []})

    return run


def exact(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Rows ``query_id, id, distance, rank``: the k nearest of ``rows(id, vector)``.

    Null, empty, non-finite and wrongly sized vectors take no part. Equal distances rank by
    the smaller id. Filters belong before this operator, not after it.

    Up to ``block`` queries are broadcast to the rows, which are read by two tasks a core, so
    that the number of rows found does not grow with the number of partitions. More stay distributed:
    queries and rows are dealt into blocks by hash, and each pair of blocks is one task of
    at most about ``block`` queries and ``cell`` rows.
    """
    spark = rows.sparkSession
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").filter("query_id is not null and size(vector) > 0").filter(good).distinct()
    items = rows.select(F.col("id").cast("long").alias("id"), "vector").filter("id is not null and size(vector) > 0")
    count = asked.count()
    if count <= block:
        shared = spark.sparkContext.broadcast(list(_by_length(asked.toArrow().to_pandas())) if count else [])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = [_Closest(metric, k, ids, q) for ids, q in shared.value]
            for frame in batches:
                for one in best:
                    one.add(frame)
            for one in best:
                yield from one.found()

        out = items.coalesce(2 * spark.sparkContext.defaultParallelism).mapInPandas(run, FOUND)
    else:
        q_blocks, r_blocks = -(-count // block), max(1, -(-items.count() // cell))
        left = items.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(r_blocks).cast("long"))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")))
        right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks).cast("long"))).withColumn("rb", F.explode(F.expr(f"sequence(0L, {r_blocks - 1}L)")))
        out = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(_cell(metric, k), FOUND)
    order = Window.partitionBy("query_id").orderBy("near", "id")
    again = (F.lag("id").over(order) == F.col("id")) & (F.lag("near").over(order) == F.col("near"))
    once = out.withColumn("again", F.coalesce(again, F.lit(False))).filter("not again")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def clusters(rows: DataFrame, count: int, sample_rows: int = 20_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of ``count`` clusters, fitted on a bounded sample of the rows."""
    # Rows by the smallest hashes of their ids; a bound on the hash leaves few to sort.
    share = min(1.0, 1.2 * sample_rows / max(1, rows.count()))
    few = rows.select("id", "vector").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    sample = few.orderBy(F.xxhash64("id")).limit(sample_rows).toPandas()
    x = np.stack(sample["vector"].to_numpy()).astype(np.float64)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances("l2", x, centre).argmin(axis=1)
        for c in range(len(centre)):
            if (near == c).any():
                centre[c] = x[near == c].mean(axis=0)
    return centre


def assign(rows: DataFrame, centre: np.ndarray, probes: int = 1) -> DataFrame:
    """Rows with the numbers of their ``probes`` nearest clusters (one row each)."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)
    names = [f.name for f in rows.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                d = distances("l2", np.stack(frame["vector"].to_numpy()).astype(np.float64), shared.value)
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                for p in range(near.shape[1]):
                    yield frame.assign(cluster=near[:, p].astype(np.int32))[[*names, "cluster"]]

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType())]))


def probed(rows: DataFrame, queries: DataFrame, k: int, tuning: Tuning, count: int | None = None) -> DataFrame:
    """The k nearest rows among the clusters that each query visits, ranked exactly."""
    n = rows.count()
    if n < 256 or not tuning.use_index:
        return exact(rows, queries, k)
    centre = clusters(rows, count or max(10, int(math.sqrt(n))))
    placed = assign(rows.select("id", "vector"), centre)
    asked = assign(queries.select(F.col("query_id").alias("id"), "vector"), centre, min(tuning.nprobes, len(centre)))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        d = distances("cosine", np.stack(right["vector"].to_numpy()).astype(np.float64), np.stack(left["vector"].to_numpy()).astype(np.float64))
        near = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, : k * tuning.refine]
        ids = left["id"].to_numpy()
        return pd.DataFrame({"query_id": np.repeat(right["id"].to_numpy(), near.shape[1]), "id": ids[near].ravel(), "distance": np.take_along_axis(d, near, 1).ravel()})

    pairs = placed.groupBy("cluster").cogroup(asked.groupBy("cluster")).applyInPandas(search, RANKED)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(approximate: DataFrame, exact_: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, by query."""
    a = approximate.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact_.join(a, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
