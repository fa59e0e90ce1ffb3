"""Cutting texts above a size limit at natural boundaries, with overlap.

Every token position is a possible start of a piece. It is joined to its farthest legal
successor: the start of the next piece, after the overlap. Squaring that successor table
(pointer doubling) yields in log2(n) steps every start that the greedy walk from position 0
visits, for all texts of a batch at once, instead of walking piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import token_count, token_starts, with_language

#: A blank-line boundary is taken when the piece is at least this full, a line or a
#: sentence boundary when it is at least so full; otherwise the cut falls between tokens.
FULL_BLOCK, FULL_LINE = 0.75, 0.5

PIECES = (
    "chunk_id long, piece_no int, n_pieces int, text string, start_line long, end_line long, "
    "token_count int, overlap_tokens int, language string, window_tokens int"
)


def _last_at_most(marks: np.ndarray) -> np.ndarray:
    """For each position, the last marked position at or before it (-1: none)."""
    at = np.where(marks, np.arange(len(marks)), -1)
    return np.maximum.accumulate(at)


def _first_at_least(marks: np.ndarray) -> np.ndarray:
    """For each position, the first marked position at or after it (len: none)."""
    n = len(marks)
    at = np.where(marks, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def boundaries(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token positions 0..n that open a block, a line, a sentence."""
    n = len(starts)
    block, line, sentence = (np.zeros(n + 1, dtype=bool) for _ in range(3))
    feeds = np.cumsum(codes == 10)
    before = feeds[starts]  # line feeds up to each token
    prev = np.concatenate([[0], before[:-1]])
    line[:n] = before > prev
    block[:n] = before > prev + 1
    line[0] = block[0] = line[n] = block[n] = True
    ends = np.isin(codes[starts], np.array([33, 44, 46, 58, 59, 63, 0x3002], dtype=codes.dtype))  # ! , . : ; ? and the ideographic stop
    gap = np.zeros(n, dtype=bool)
    gap[1:] = starts[1:] > starts[:-1] + 1
    sentence[1:n] = ends[:-1] & gap[1:]
    return block, line, line | sentence


def successors(n: int, limit: int, overlap: int, block: np.ndarray, line: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a piece starting at each token 0..n: its end, and the start of the next piece."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, (limit - 1) // 2))
    at = np.arange(n + 1)
    far = np.minimum(at + limit, n)
    end = far.copy()
    open_ = far < n
    for marks, full in ((sentence, FULL_LINE), (line, FULL_LINE), (block, FULL_BLOCK)):
        cut = _last_at_most(marks)[far]
        take = open_ & (cut >= at + np.maximum(1, int(full * limit))) & (cut > at + overlap)
        end = np.where(take, cut, end)
    back = np.maximum(end - overlap, 0)
    nxt = back.copy()
    for marks in (sentence, line):
        cut = _first_at_least(marks)[np.minimum(back, n)]
        take = cut < end
        nxt = np.where(take, cut, nxt)
    nxt = np.where(end >= n, n, np.maximum(nxt, at + 1))
    nxt[n] = n
    return end, nxt


def visited(nxt: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All nodes on the paths from the roots along ``nxt``, by squaring the table."""
    seen = np.zeros(len(nxt), dtype=bool)
    seen[roots] = True
    jump = nxt
    while True:
        seen[jump[seen]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump):
            return seen
        jump = squared


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        parts, base, nodes = [], 0, []
        for row in frame.itertuples(index=False):
            codes, starts = token_starts(row.text)
            n = len(starts)
            end, nxt = successors(n, int(row.window_tokens), int(row.overlap_tokens), *boundaries(codes, starts))
            parts.append((row, codes, starts, end, base))
            nodes.append(nxt + base)
            base += n + 1
        if not parts:
            continue
        seen = visited(np.concatenate(nodes), np.array([p[4] for p in parts]))
        out: list[tuple] = []
        for row, codes, starts, end, base in parts:
            n = len(starts)
            first = np.flatnonzero(seen[base : base + n])
            feeds = np.concatenate([[0], np.cumsum(codes == 10)])
            top = 1 if pd.isna(row.start_line) else int(row.start_line)
            reached = 0
            for k, s in enumerate(first):
                e = end[s]
                # The text runs from the line's indent (or the token) to just after the last token.
                lo = int(starts[s]) if s else 0
                while s and lo > 0 and codes[lo - 1] in (32, 9):
                    lo -= 1
                hi = len(codes) if e == n else int(starts[e])
                while e < n and hi > lo and codes[hi - 1] in (32, 9, 10, 13):
                    hi -= 1
                text = codes[lo:hi].tobytes().decode("utf-32-le", "surrogatepass")
                last = hi - 1
                while last > lo and codes[last] in (10, 13):
                    last -= 1
                out.append((row.chunk_id, k, len(first), text, top + int(feeds[lo]), top + int(feeds[last]), int(e - s), max(0, int(reached - s)) if k else 0, row.language, int(row.window_tokens)))
                reached = e
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every chunk whose text is above the limit of its file's language.

    Chunks within the limit, null or empty texts and null ids yield no row. Repeated rows of a
    ``chunk_id`` count once (the row kept is the smallest by text and line, so the result
    does not depend on order). A null ``start_line`` counts as 1. A limit below 1 is taken
    as 1. Further columns of the input are ignored.

    Texts are sized in the JVM; only oversized ones are shuffled (to drop repeats) and
    reach Python.
    """
    picked = chunks.select("chunk_id", "path", "text", F.col("start_line").cast("long").alias("start_line")).filter("chunk_id is not null and text is not null and text <> ''")
    sized = with_language(picked, limits).filter(F.length("text") > F.col("window_tokens"))
    over = sized.filter(token_count(F.col("text")) > F.col("window_tokens"))
    once = over.groupBy("chunk_id").agg(F.min(F.struct("text", "start_line", "language", "window_tokens", "overlap_tokens")).alias("r")).select("chunk_id", "r.*")
    return once.mapInPandas(_pieces, PIECES)
