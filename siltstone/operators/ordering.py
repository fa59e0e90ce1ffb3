"""Positions and moving windows within keys, without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: str, cuts: int = 200) -> DataFrame:
    """Rows with ``i``, their 0-based place by ``order`` within the key, and ``n``, the count.

    ``order`` is a number that is unique within a key. Approximate quantiles cut a key into
    ranges; each range is sorted by itself and shifted by the counts of the ranges before
    it. Rows without ``order`` are left out.
    """
    rows = df.filter(F.col(order).isNotNull())
    edges = F.percentile_approx(order, F.array(*(F.lit(i / cuts) for i in range(1, cuts))), 10_000)
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.array_distinct(edges).alias("_edges"))
    placed = rows.join(stats, key).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    counts = placed.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    before = (F.sum("_c").over(Window.partitionBy(key).orderBy("_b")) - F.col("_c")).alias("_start")
    inner = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    joined = placed.withColumn("_i", inner).join(counts.select(key, "_b", before), [key, "_b"])
    return joined.withColumn("i", F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def moving(rows: DataFrame, key: str, name: str, value: Column, back: int, block: int = 4096) -> DataFrame:
    """``value`` (an aggregate) over each row and the ``back`` rows before it, as ``name``.

    ``rows`` are numbered. They are cut into blocks; the last rows of a block are also sent
    to the next one, so that every window lies within one block. A window may not be longer
    than a block.
    """
    if not 0 <= back <= block:
        raise ValueError(f"a window of {back} rows before a row does not fit into blocks of {block}")
    here = F.floor(F.col("i") / block)
    late = (F.col("i") % block >= block - back) & (back > 0)
    own, halo = F.struct(here.alias("b"), F.lit(False).alias("h")), F.struct((here + 1).alias("b"), F.lit(True).alias("h"))
    sent = rows.withColumn("_to", F.explode(F.when(late, F.array(own, halo)).otherwise(F.array(own))))
    sent = sent.withColumn("_b", F.col("_to")["b"]).withColumn("_h", F.col("_to")["h"]).drop("_to")
    w = Window.partitionBy(key, "_b").orderBy("i").rowsBetween(-back, 0)
    return sent.withColumn(name, value.over(w)).filter("not _h").drop("_b", "_h")
