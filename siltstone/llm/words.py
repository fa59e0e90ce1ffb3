"""Words of many texts at once, as hashes, by array operations.

A word is a run of letters and digits, with underscores inside it. Letter case, mark-up,
character references and invisible characters fall away. The hash of a word is a
polynomial over its characters; prefix sums give it for all words of a block of texts.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np

TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_BREAK, _LETTER, _LINK, _HIDDEN = 0, 1, 2, 3


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its class and its small letter; the last entry stands for higher ones."""
    kind, small = np.zeros(0x10001, np.uint8), np.arange(0x10001, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalnum():
            kind[i] = _LETTER
            low = c.lower()
            if len(low) == 1:
                small[i] = ord(low)
    kind[ord("_")] = _LINK
    for i in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF):
        kind[i] = _HIDDEN
    return kind, small


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead), np.cumprod(back)


def plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return TAG.sub(" ", text) if "<" in text else text


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the place in the list of the text it stands in."""
    kind_of, small = _tables()
    texts = [plain(t) for t in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(codes, 0x10000)
    kind = kind_of[low]
    letters = small[low]
    # A text ends where its line feed was put; those of the texts themselves count too.
    ends = np.cumsum([len(t) + 1 for t in texts])
    if (kind == _HIDDEN).any():
        keep = kind != _HIDDEN
        gone = np.concatenate([[0], np.cumsum(~keep)])
        ends = ends - gone[np.minimum(ends, len(kind))]
        kind, letters = kind[keep], letters[keep]
    inside = kind == _LETTER
    if (kind == _LINK).any():
        # Underscores belong to a word that goes on behind them.
        links = np.flatnonzero(kind == _LINK)
        first = np.flatnonzero(np.diff(links, prepend=-2) != 1)
        size = np.diff(first, append=len(links))
        head, tail = links[first] - 1, links[first] + size
        held = (head >= 0) & (tail < len(kind))
        held[held] = inside[head[held]] & inside[tail[held]]
        inside = inside.copy()
        inside[links[np.repeat(held, size)]] = True
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, int(len(kind)).bit_length())
    ahead, back = _powers(size)
    sums = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * ahead[: len(kind)], out=sums[1:])
    value = (sums[stop] - sums[start]) * back[start]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    return value, np.searchsorted(ends, start, side="right")
