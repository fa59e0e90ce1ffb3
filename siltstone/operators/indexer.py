"""The index job: contents of files, their chunks and vectors, built wholly or by changes.

A row belongs to one chunk of one file and carries the file's content hash, so the index
itself is the manifest that the next run is compared with. Vectors belong to texts: a text
that the index holds already, in whatever file, is not embedded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_of, text_hash, words
from . import chunking, merge

#: Numbers of the built-in vectors.
SIZE = 16
#: Texts that a provider gets at once.
BATCH = 256

Provider = Callable[[list[str]], np.ndarray]


def hashed(text: Column) -> Column:
    """A vector of ``SIZE`` numbers: words counted by the first digit of their MD5, to length 1.

    A text without words has zeros. Needs no model and stays in the JVM.
    """
    digits = F.array(F.concat_ws("", F.transform(words(text), lambda w: F.substring(F.md5(w), 1, 1))))
    # A value bound by a one-element transform is computed once, however often it is used.
    counts = F.transform(digits, lambda s: F.array(*((F.length(s) - F.length(F.replace(s, F.lit(f"{d:x}")))).cast("double") for d in range(SIZE))))
    norm = F.transform(counts, lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.transform(norm, lambda v: F.transform(v["c"], lambda x: F.when(v["n"] > 0, x / v["n"]).otherwise(F.lit(0.0))))[0]


def embed(df: DataFrame, provider: Provider | None = None, batch: int = BATCH) -> DataFrame:
    """``df`` with ``vector``, made from its column ``text``; null texts have none.

    ``provider`` takes a list of texts and returns one row of numbers for each; it runs on
    the executors, ``batch`` texts at a time. Without one, :func:`hashed` is used.
    """
    if provider is None:
        return df.withColumn("vector", F.when(F.col("text").isNotNull(), hashed(F.col("text"))).cast("array<float>"))
    names = [f.name for f in df.schema.fields if f.name != "vector"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[np.ndarray | None] = [None] * len(frame)
            some = [i for i, t in enumerate(frame["text"]) if t is not None]
            for lo in range(0, len(some), batch):
                at = some[lo : lo + batch]
                for i, v in zip(at, provider([frame["text"].iloc[i] for i in at]), strict=True):
                    out[i] = np.asarray(v, dtype=np.float32)
            yield frame.assign(vector=out)

    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name != "vector"), T.StructField("vector", T.ArrayType(T.FloatType()))])
    return df.select(*names).mapInPandas(run, schema)


def plan(files: DataFrame, index: DataFrame | None) -> DataFrame:
    """Rows ``file_id, action`` (added, modified, deleted, unchanged) against what is indexed."""
    now = files.filter("file_id is not null and text is not null").select("file_id", text_hash(F.col("text")).alias("file_hash")).distinct()
    then = index.select("file_id", "file_hash").distinct() if index is not None else now.limit(0)
    return merge.difference(then, now, ["file_id"], ["file_hash"])


def build(files: DataFrame, known: DataFrame | None = None, provider: Provider | None = None, budget: int = 350) -> DataFrame:
    """Index rows of ``files(file_id, repo, path, text)``.

    ``known(text_hash, vector)`` holds vectors that need not be made again.
    """
    rows = files.filter("file_id is not null and text is not null").withColumn("language", language_of(F.col("path")))
    pieces = chunking.chunk(rows, budget).withColumn("text_hash", text_hash(F.col("text")))
    keys = rows.select("file_id", "repo", "path", text_hash(F.col("text")).alias("file_hash"))
    texts = pieces.groupBy("text_hash").agg(F.min("text").alias("text"))
    if known is None:
        vectors = embed(texts, provider).select("text_hash", "vector")
    else:
        old = known.groupBy("text_hash").agg(F.first("vector").alias("vector"))
        fresh = embed(texts.join(old, "text_hash", "left_anti"), provider).select("text_hash", "vector")
        vectors = old.join(texts.select("text_hash"), "text_hash", "left_semi").unionByName(fresh)
    return pieces.join(keys, "file_id").join(vectors, "text_hash").select("file_id", "repo", "path", "file_hash", "ordinal", "start_line", "end_line", "symbol_kind", "symbol_name", "text_hash", "vector")


def update(files: DataFrame, index: DataFrame, provider: Provider | None = None, budget: int = 350) -> DataFrame:
    """The index after the files changed: only new and changed files are read and chunked.

    Rows of files that are gone or changed leave; everything else stays as it is.
    """
    actions = plan(files, index)
    changed = files.join(actions.filter("action in ('added', 'modified')"), "file_id", "left_semi")
    kept = index.join(actions.filter("action = 'unchanged'"), "file_id", "left_semi")
    return kept.unionByName(build(changed, index.select("text_hash", "vector"), provider, budget))
