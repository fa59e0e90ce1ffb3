"""Filling fixed-capacity containers: bounded-space online best-fit.

A fixed number of bins is open at a time. A bitset keyed by free space finds the open bin
that an item fits most tightly; when no bin fits and all places are taken, the fullest bin
closes. Each partition packs its own rows in one pass. The few bins left open then travel
(bins, not their items) through rounds in which those of 32 groups are packed together as
units; what closes in a round leaves, so a round's group has at most 32 times the open bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import restored, solid, token_count

#: Bins kept open at once, and groups that one task of a later round joins.
OPEN_BINS, FAN_IN = 64, 32

ROWS = "doc_id long, piece_no int, n_pieces int, token_start long, token_end long, tokens int, part long, bin long, is_open boolean"


class OpenBins:
    """Open bins by free space; an item goes where the least space is left over."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.mask, self.count = 0, 0
        self.at: dict[int, list[int]] = {}
        self.made = 0
        self.closed: list[int] = []

    def _put(self, free: int, bin_: int) -> None:
        self.at.setdefault(free, []).append(bin_)
        self.mask |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        here = self.at[free]
        bin_ = here.pop(0)
        if not here:
            self.mask &= ~(1 << free)
        self.count -= 1
        return bin_

    def add(self, size: int) -> int:
        """The bin for an item of at most the capacity."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.places:
                self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, bin_ = self.capacity, self.made
            self.made += 1
        if free > size:
            self._put(free - size, bin_)
        else:
            self.closed.append(bin_)
        return bin_

    def still_open(self) -> set[int]:
        return {b for bins in self.at.values() for b in bins}


def _first_pass(capacity: int, places: int):
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        bins = OpenBins(capacity, places)
        waiting: dict[int, list[tuple]] = {}
        done: list[tuple] = []
        for frame in batches:
            for doc, size in zip(frame["doc_id"], frame["tokens"], strict=True):
                pieces = max(1, -(-size // capacity))
                for k in range(pieces):
                    lo = k * capacity
                    hi = min(size, lo + capacity)
                    bin_ = bins.add(hi - lo)
                    waiting.setdefault(bin_, []).append((doc, k, pieces, lo, hi, hi - lo, part, bin_))
                for bin_ in bins.closed:
                    done += [(*r, False) for r in waiting.pop(bin_)]
                bins.closed.clear()
            yield pd.DataFrame(done, columns=names)
            done = []
        yield pd.DataFrame([(*r, True) for rows in waiting.values() for r in rows], columns=names)

    return run


MOVES = "part long, bin long, to_part long, to_bin long, tokens long, is_open boolean"


def _join_bins(capacity: int, places: int, last: bool):
    """Packs open bins together: rows are bins of the first pass and the bin each is in now."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["to_part", "to_bin", "part", "bin"], kind="stable")
        used = frame.groupby(["to_part", "to_bin"], sort=True)["tokens"].sum()
        bins = OpenBins(capacity, places)
        home = {key: bins.add(int(size)) for key, size in used.items()}
        # A new bin is named after the first of its bins.
        name: dict[int, tuple] = {}
        for key, b in home.items():
            name.setdefault(b, key)
        open_ = set() if last else bins.still_open()
        now = [home[key] for key in zip(frame["to_part"], frame["to_bin"], strict=True)]
        frame["is_open"] = [b in open_ for b in now]
        frame["to_part"], frame["to_bin"] = [name[b][0] for b in now], [name[b][1] for b in now]
        return frame

    return run


def pack(documents: DataFrame, capacity: int = 2048, places: int = OPEN_BINS) -> DataFrame:
    """Containers of ``capacity`` tokens for all documents.

    One row per document, or per piece of a document above the capacity: ``container_id``
    (null for a text without tokens, which needs no room), ``doc_id``, ``piece_no``,
    ``n_pieces``, ``token_start`` and ``token_end`` (token offsets within the document) and
    ``tokens``. Only a text above the capacity is split; its pieces but the last are full.
    Repeated rows are packed as often as they occur. Null ids are kept. Other columns of
    the input are ignored.

    Only ids and sizes reach Python, in the partitions of the scan; nothing but the bins
    left open (at most ``places`` a partition) and their items is shuffled.
    """
    sized = documents.select(solid("doc_id"), token_count(F.col("text")).alias("tokens"))
    first = cut_lineage(sized.mapInPandas(_first_pass(capacity, places), ROWS))
    closed, waiting = first.filter("not is_open and tokens > 0"), first.filter("is_open and tokens > 0")
    bins = waiting.groupBy("part", "bin").agg(F.sum("tokens").alias("tokens"))
    bins = bins.select("part", "bin", F.col("part").alias("to_part"), F.col("bin").alias("to_bin"), "tokens", F.lit(True).alias("is_open"))
    moved, width, groups = None, FAN_IN, first.rdd.getNumPartitions()
    while True:
        last = width >= groups
        bins = bins.groupBy(F.floor(F.col("to_part") / width)).applyInPandas(_join_bins(capacity, places, last), MOVES)
        if not last:
            bins = cut_lineage(bins)
        left = bins.filter("not is_open")
        moved = left if moved is None else moved.unionByName(left)
        if last:
            break
        bins, width = bins.filter("is_open"), width * FAN_IN
    moved = moved.select("part", "bin", "to_part", "to_bin")
    open_ = waiting.join(moved, ["part", "bin"]).withColumn("part", F.col("to_part")).withColumn("bin", F.col("to_bin")).drop("to_part", "to_bin")
    nothing = first.filter("tokens = 0").withColumn("container", F.lit(None).cast("string"))
    name = F.concat_ws("-", F.col("part").cast("string"), F.col("bin").cast("string"))
    rows = closed.unionByName(open_).withColumn("container", name).unionByName(nothing)
    return rows.select(F.col("container").alias("container_id"), restored("doc_id"), "piece_no", "n_pieces", "token_start", "token_end", "tokens")


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Per container: its documents or pieces, tokens used and left over."""
    return (
        packed.filter("container_id is not null")
        .groupBy("container_id")
        .agg(F.count("*").alias("n_items"), F.sum("tokens").alias("used_tokens"))
        .withColumn("free_tokens", F.lit(capacity) - F.col("used_tokens"))
    )
