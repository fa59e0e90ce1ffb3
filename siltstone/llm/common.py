"""Expressions shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The counting rule: a run of ASCII letters, a run of ASCII digits, or any other single
#: character that is not a space, tab, CR or LF.
TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\r\n]"


def token_count(text: Column) -> Column:
    """Size of a text by the counting rule; a null text has size 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def extension(path: Column) -> Column:
    """Lower-cased extension of the last part of a path, with its dot; null without one."""
    return F.nullif(F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1), F.lit(""))


def with_language(df: DataFrame, limits: DataFrame, path: str = "path") -> DataFrame:
    """Add ``language``, ``window_tokens`` and ``overlap_tokens`` by the path's extension.

    ``limits`` is the small dimension ``window_limits``; the row whose ``ext`` is null holds
    for every unlisted extension. Spark broadcasts it only while its size is below the
    session's threshold.
    """
    lim = limits.select(
        F.coalesce(F.lower("ext"), F.lit("")).alias("_ext"),
        F.struct(F.col("language").alias("l"), F.col("window_tokens").alias("w"), F.col("overlap_tokens").alias("o")).alias("_lim"),
    ).dropDuplicates(["_ext"])
    # An aggregate without keys: exactly one row, also for an empty dimension.
    rest = lim.agg(F.max(F.when(F.col("_ext") == "", F.col("_lim"))).alias("_rest")).scalar()
    out = df.drop("language", "window_tokens", "overlap_tokens").withColumn("_key", extension(F.col(path)))
    out = out.join(lim, F.col("_key") == F.col("_ext"), "left").withColumn("_found", F.coalesce(F.col("_lim"), rest))
    found = F.col("_found")
    return (
        out.withColumn("language", F.coalesce(found["l"], F.lit("text")))
        .withColumn("window_tokens", found["w"])
        .withColumn("overlap_tokens", found["o"])
        .drop("_key", "_ext", "_lim", "_found")
    )


#: Stands for a null id on the way through pandas, which would turn integers to floats.
NO_ID = -(2**63)


def solid(id_: str) -> Column:
    return F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)).alias(id_)


def restored(id_: str) -> Column:
    return F.nullif(F.col(id_), F.lit(NO_ID)).alias(id_)


def char_classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text and the class of each: 0 blank, 1 letter, 2 digit, 3 other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.full(128, 3, dtype=np.uint8)
    table[[9, 10, 13, 32]] = 0
    table[65:91] = table[97:123] = 1
    table[48:58] = 2
    kinds = np.full(len(codes), 3, dtype=np.uint8)
    low = codes < 128
    kinds[low] = table[codes[low]]
    return codes, kinds


def token_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text and the character offset at which each token starts."""
    codes, kinds = char_classes(text)
    if not len(codes):
        return codes, np.zeros(0, dtype=np.int64)
    prev = np.concatenate([[0], kinds[:-1]])
    return codes, np.flatnonzero((kinds == 3) | ((kinds != 0) & (kinds != prev)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
