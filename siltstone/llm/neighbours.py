"""The k most similar vectors of every vector, through a forest of random-projection trees.

The trees are fitted on a bounded sample; every row is then routed to one leaf of each tree.
A query also visits the leaves that a priority queue shared by all trees yields next: the
priority of a leaf is the smallest signed margin on its path, so popping the queue and
sorting the leaves by priority visit the same leaves in the same order. Within a leaf the
candidates are ranked by the exact cosine similarity of the stored numbers.

Equal vectors form one class. Only one row of a class is indexed (each partition of the
scan ships a vector once), and classes are expanded to rows at the end, so a vector that
holds a third of all rows costs one leaf entry per partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a well-formed vector by model.
DIMENSIONS = {"small": 64, "large": 96}

#: Trees, rows wanted in a leaf, and rows of the sample that the trees of one model are fitted on.
TREES, LEAF_ROWS, SAMPLE_ROWS = 4, 2048, 16384

KEY = ["embed_model", "k1", "k2"]
PAIRS = "embed_model string, a1 long, a2 long, b1 long, b2 long, similarity double"


@dataclass
class Tree:
    """A complete binary tree: node i splits to 2i+1 and 2i+2; leaves are numbered from 0."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.normals[node]) > self.offsets[node]
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """Per row and leaf, the smallest signed margin on the path (larger: nearer)."""
        best = np.full((len(x), 1), np.inf, dtype=np.float32)
        for level in range(self.depth):
            nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            margin = x @ self.normals[nodes].T - self.offsets[nodes]
            best = np.stack([np.minimum(best, -margin), np.minimum(best, margin)], axis=2).reshape(len(x), -1)
        return best


def fit_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Split by the direction between two centres, at the median of the projections."""
    inner = 2**depth - 1
    normals = np.zeros((inner, sample.shape[1]), dtype=np.float32)
    offsets = np.zeros(inner, dtype=np.float32)
    rows: dict[int, np.ndarray] = {0: np.arange(len(sample))}
    for node in range(inner):
        here = rows.pop(node, np.zeros(0, dtype=np.int64))
        direction = rng.standard_normal(sample.shape[1]).astype(np.float32)
        if len(here) >= 4:
            some = sample[rng.choice(here, min(len(here), 256), replace=False)]
            one, two = some[0], some[1]
            for _ in range(5):
                near = some @ (one - two) > 0
                if near.all() or not near.any():
                    break
                one, two = some[near].mean(0), some[~near].mean(0)
            if np.linalg.norm(one - two) > 1e-6:
                direction = one - two
        direction /= np.linalg.norm(direction)
        shadow = sample[here] @ direction
        normals[node], offsets[node] = direction, np.median(shadow) if len(here) else 0.0
        rows[2 * node + 1], rows[2 * node + 2] = here[shadow <= offsets[node]], here[shadow > offsets[node]]
    return Tree(normals, offsets, depth)


def well_formed(dimensions: dict[str, int]) -> Column:
    size = F.lit(None).cast("int")
    for model, d in dimensions.items():
        size = F.when(F.col("embed_model") == model, d).otherwise(size)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size("vector") == size) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame, dimensions: dict[str, int]) -> DataFrame:
    """Well-formed rows with the 128-bit key of their vector."""
    picked = vectors.select("vec_id", "embed_model", F.col("vector").cast("array<float>").alias("vector"))
    picked = picked.filter(F.col("vec_id").isNotNull() & well_formed(dimensions))
    return picked.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.reverse("vector")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32, copy=False)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def fit_forest(rows: DataFrame, trees: int, leaf_rows: int, sample_rows: int) -> dict[str, list[Tree]]:
    """Trees by model, fitted on at most ``sample_rows`` rows of each model.

    The rows with the smallest hashes are taken, so the sample does not depend on order.
    """
    counts = {r["embed_model"]: r["n"] for r in rows.groupBy("embed_model").agg(F.count("*").alias("n")).collect()}
    forest: dict[str, list[Tree]] = {}
    for model, n in sorted(counts.items()):
        share = min(1.0, 1.2 * sample_rows / n)
        bound = int(-(2**63) + share * (2**64 - 1))
        picked = rows.filter((F.col("embed_model") == model) & (F.xxhash64("vec_id") <= min(bound, 2**63 - 1)))
        sample = picked.select("vector").limit(sample_rows).toPandas()
        if not len(sample):
            sample = rows.filter(F.col("embed_model") == model).select("vector").limit(sample_rows).toPandas()
        x = _unit(_matrix(sample["vector"]))
        # No deeper than the sample can tell apart: at least eight of its rows in a leaf.
        depth = int(max(0, min(np.ceil(np.log2(n / leaf_rows)), np.floor(np.log2(max(1, len(x) / 8))))))
        rng = np.random.default_rng(7)
        forest[model] = [fit_tree(x, depth, rng) for _ in range(trees)]
    return forest


ROUTED = "embed_model string, tree int, leaf int, k1 long, k2 long, vector array<float>, is_query boolean, is_item boolean"


def _route(forest, probes: int, every: int):
    """Rows to the leaves of all trees as items, and to ``probes`` leaves as queries.

    ``every`` is 0 where all rows query their own leaves, else rows whose id it divides query.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for frame in batches:
            query = (frame["vec_id"] % every == 0).to_numpy() if every else np.ones(len(frame), dtype=bool)
            keep = []
            for i, key in enumerate(zip(frame["k1"], frame["k2"], query, strict=True)):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            frame, query = frame.iloc[keep], query[keep]
            for model, part in frame.assign(q=query).groupby("embed_model", sort=False):
                trees = forest.value[model]
                x = _unit(_matrix(part["vector"]))
                base = part[["embed_model", "k1", "k2", "vector"]]
                homes = np.stack([t.home(x) for t in trees], axis=1)
                asks = part["q"].to_numpy()
                # Home leaves come first in the queue: their entries as items serve the queries too.
                home = not probes or probes >= len(trees)
                for t in range(len(trees)):
                    yield base.assign(tree=t, leaf=homes[:, t], is_query=asks if home else False, is_item=True)[NAMES]
                if probes and asks.any():
                    rank = np.concatenate([t.priorities(x[asks]) for t in trees], axis=1)
                    width = 2 ** trees[0].depth
                    np.put_along_axis(rank, homes[asks] + width * np.arange(len(trees)), np.inf, axis=1)
                    top = np.argsort(-rank, axis=1, kind="stable")[:, len(trees) if home else 0 : probes]
                    some = base[asks]
                    for p in range(top.shape[1]):
                        yield some.assign(tree=top[:, p] // width, leaf=top[:, p] % width, is_query=True, is_item=False)[NAMES]

    return run


NAMES = [c.split()[0] for c in ROUTED.split(", ")]


def _leaf(k: int, least: float):
    """The k best items of a leaf for each of its queries, by exact similarity."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        items = frame[frame["is_item"]].drop_duplicates(["k1", "k2"]).sort_values(["k1", "k2"])
        queries = frame[frame["is_query"]].drop_duplicates(["k1", "k2"]).sort_values(["k1", "k2"])
        names = [c.split()[0] for c in PAIRS.split(", ")]
        if not len(items) or not len(queries):
            return pd.DataFrame({n: [] for n in names})
        raw_i, raw_q = _matrix(items["vector"]).astype(np.float64), _matrix(queries["vector"]).astype(np.float64)
        raw_i /= np.linalg.norm(raw_i, axis=1, keepdims=True)
        raw_q /= np.linalg.norm(raw_q, axis=1, keepdims=True)
        x, q = raw_i.astype(np.float32), raw_q.astype(np.float32)
        i1, i2, q1, q2 = (f[c].to_numpy() for f in (items, queries) for c in ("k1", "k2"))
        want = min(len(x), k + 6)  # room for the query itself and for near ties in single precision
        out = []
        for lo in range(0, len(q), 512):
            s = q[lo : lo + 512] @ x.T
            if want < len(x):
                if least > -1:
                    rows = np.flatnonzero(s.max(axis=1) >= least - 1e-4)
                else:
                    rows = np.arange(len(s))
                cand = np.argpartition(-s[rows], want - 1, axis=1)[:, :want]
            else:
                rows = np.arange(len(s))
                cand = np.tile(np.arange(len(x)), (len(s), 1))
            a = np.repeat(rows + lo, cand.shape[1])
            b = cand.ravel()
            near = s[a - lo, b] >= least - 1e-4
            near &= (i1[b] != q1[a]) | (i2[b] != q2[a])
            a, b = a[near], b[near]
            exact = np.einsum("ij,ij->i", raw_q[a], raw_i[b])
            fine = exact >= least
            a, b, exact = a[fine], b[fine], exact[fine]
            order = np.lexsort((b, -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < k
            out.append(pd.DataFrame({"embed_model": frame["embed_model"].iloc[0], "a1": q1[a[top]], "a2": q2[a[top]], "b1": i1[b[top]], "b2": i2[b[top]], "similarity": exact[top]}))
        return pd.concat(out)[names]

    return run


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair for both of its sides: where all rows query, a find of one serves the other."""
    there = F.struct("embed_model", "a1", "a2", "b1", "b2", "similarity")
    back = F.struct("embed_model", F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), "similarity")
    return pairs.select(F.inline(F.array(there, back)))


def nearest(
    vectors: DataFrame,
    k: int = 10,
    min_similarity: float = -1.0,
    queries_every: int = 0,
    probes: int = 0,
    dimensions: dict[str, int] | None = None,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows ``embed_model, vec_id, rank, neighbour_id, similarity``: the k most similar rows.

    Equal similarities rank by the smaller id. ``min_similarity`` keeps only neighbours of
    at least that cosine; it does not change which ones come first. ``queries_every`` takes
    as queries the rows whose id it divides (0: all rows); ``probes`` sends each query to
    that many leaves of the shared queue, its own leaves first (0: only to its own leaf of
    every tree).

    Malformed vectors (null, wrong length, null or non-finite numbers, all zero), unknown
    models and null ids take no part; repeated rows count once. Other columns are ignored.
    """
    dimensions = DIMENSIONS if dimensions is None else dimensions
    spark = vectors.sparkSession
    rows = _rows(vectors, dimensions)
    forest = spark.sparkContext.broadcast(fit_forest(rows, trees, leaf_rows, sample_rows))
    routed = rows.mapInPandas(_route(forest, probes, queries_every), ROUTED)
    found = routed.groupBy("embed_model", "tree", "leaf").applyInPandas(_leaf(k, min_similarity), PAIRS)
    if probes and not queries_every:
        found = _both_ways(found)
    pairs = found.groupBy("embed_model", "a1", "a2", "b1", "b2").agg(F.max("similarity").alias("similarity"))
    if probes and not queries_every:
        first = Window.partitionBy("embed_model", "a1", "a2").orderBy(F.desc("similarity"))
        pairs = pairs.withColumn("n", F.rank().over(first)).filter(F.col("n") <= k).drop("n")

    # Classes of equal vectors: their k+1 smallest ids, taken in two steps so that a class
    # of many rows is cut down in parts first.
    ids = rows.select(*KEY, "vec_id").distinct()
    part = Window.partitionBy(*KEY, F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy(*KEY).orderBy("vec_id")
    few = ids.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= k + 1)
    classes = few.groupBy(*KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("members"))

    target = classes.select("embed_model", F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.slice("members", 1, k).alias("members"))
    lists = (
        pairs.join(target, ["embed_model", "b1", "b2"])
        .groupBy("embed_model", F.col("a1").alias("k1"), F.col("a2").alias("k2"))
        .agg(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "members")).alias("near"))
    )
    hits = F.flatten(F.transform("near", lambda c: F.transform(c["members"], lambda m: F.struct(c["d"].alias("d"), m.alias("id")))))
    own = F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("d"), m.alias("id")))
    asking = ids.filter(F.pmod("vec_id", F.lit(queries_every)) == 0) if queries_every else ids
    merged = classes.join(lists, KEY, "left").select(*KEY, F.slice(F.array_sort(F.concat(own, F.coalesce(hits, F.array().cast("array<struct<d:double,id:bigint>>")))), 1, 2 * k + 1).alias("hits"))
    each = asking.join(merged, KEY).select(
        "embed_model", "vec_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("vec_id")), 1, k).alias("hits")
    )
    flat = each.select("embed_model", "vec_id", F.posexplode("hits").alias("p", "h"))
    return flat.select("embed_model", "vec_id", (F.col("p") + 1).alias("rank"), F.col("h.id").alias("neighbour_id"), (-F.col("h.d")).alias("similarity"))


def linked(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one row is among the nearest of the other."""
    a, b = F.col("vec_id").cast("long"), F.col("neighbour_id").cast("long")
    return neighbours.select(F.least(a, b).alias("vec_a"), F.greatest(a, b).alias("vec_b")).distinct()
