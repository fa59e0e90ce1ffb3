"""Personal information inside free text: finding and replacing it.

A character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled
spans, reads every text wholly through overlapping windows. Windows are decoded apart; of
two verdicts on a character the one farther from its window's edge counts. What the tagger
marks is an item; its form only trims the marked stretch and rejects what no item can be.

The labelled spans come from a generator of invented sentences (see ``sentences``).
"""

from __future__ import annotations

import pickle
import re
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tagger
from .common import restored, solid
from .sentences import ID_LABELS, KINDS, TEL_LABELS, VOCABULARY, examples

TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind

#: Characters of a window and the part of it at either end that neighbours share.
WINDOW, MARGIN = 512, 24
#: Size of the training set, of its stretches and of the network; passes over the set.
EXAMPLES, STRETCH, HIDDEN, EPOCHS = 48000, 240, 24, 7
#: Characters that are tagged at once.
BLOCK = 4_000_000

# Forms that trim a marked stretch.
EMAIL = re.compile(r"[\w.+%-]+\s?(?:[@＠]|\(at\)|\[at\]|\{at\}|\bat\b)\s?[\w-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b)\s?)[\w-]+)+", re.I)
PHONE = re.compile(r"(?<![\w.+/-])(?:\+\d{1,3}|\(\d{2,5}\)|\d+)(?:[ ./()\u00a0-]{0,3}\d+){0,7}(?:\s?(?:ext\.?|x|Durchwahl)\s?\d{1,5})?(?!\w)", re.I)
IDENTITY = re.compile(r"(?<!\w)(?=[A-Za-z \u00a0.-]*\d)[A-Z0-9](?:[ .\u00a0-]?[A-Z0-9])+(?!\w)")
ADDRESS = re.compile(r"\S.*\S", re.S)
NAME = re.compile(r"[^\W\d_][^\d_@|<>\"`]*[^\W\d_]\.?", re.S)
# Articles; other words that open a sentence before a noun; small words within names.
ARTICLES = ("the", "a", "an", "der", "die", "das", "den", "dem", "des", "ein", "eine", "les", "un", "une", "el", "los", "las")
OPENERS = ("no", "each", "every", "any", "anyone", "kein", "keine", "jede", "jeder", "ohne", "mit", "sans", "avec", "chaque", "sin", "con", "cada")
PARTICLES = frozenset("van von der den de da di del della do dos du la le los las y e zu zum ter".split())
FORMS = {"email": EMAIL, "phone": PHONE, "id_number": IDENTITY, "address": ADDRESS, "name": NAME}


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _possible(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a trimmed stretch can be an item of its kind at all."""
    s = text[a:b]
    if kind == "email":
        # Remotes of version control have the shape of an address and a path behind it.
        return not re.match(r":[\w~/]", text[b : b + 2]) and not re.search(r"://$", text[max(0, a - 3) : a])
    if kind == "phone":
        return 7 <= _digits(s) <= 17 and not re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", s)
    if kind == "id_number":
        return 7 <= sum(c.isalnum() for c in s) <= 16 and _digits(s) >= 5
    if kind == "address":
        return _digits(s) > 0 and (re.search(r"[^\W\d_a-zß-öø-ÿ][^\W\d_]{2,}|[Bb]ox|BP|B\.P\.", s) is not None)
    words = [w for w in re.findall(r"[^\W\d_][^\W\d_.'’-]*(?:['’-][^\W\d_]+)*", s) if w not in PARTICLES]
    if sum(len(w) > 1 for w in words) < 2:
        return False
    # Things have articles, persons have none.
    if words[0].lower() in ARTICLES + OPENERS or re.search(rf"(?<!\w)(?:{'|'.join(ARTICLES)})\s$", text[max(0, a - 6) : a], re.I):
        return False
    # A given and a family name have capitals, unless the text has none at all.
    return all(w[0].isupper() for w in words) or text == text.lower()


def _labelled(text: str, at: int) -> str | None:
    """The kind that a label right before a number names."""
    before = text[max(0, at - 40) : at].rstrip(" \u00a0:(,.\"'").lower()
    return next((kind for kind, labels in (("phone", TEL_LABELS), ("id_number", ID_LABELS)) for l in labels if re.search(rf"(?<!\w){re.escape(l.rstrip(' :.').lower())}$", before)), None)


def _trim(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The longest form of the kind in a marked stretch, which is first widened to whole words."""
    wide = r"\w@.+-" if kind == "email" else r"\w+(" if kind == "phone" else r"\w"
    while a > 0 and re.match(f"[{wide}]", text[a - 1]):
        a -= 1
    while b < len(text) and re.match(r"[\w@-]|\.\w" if kind == "email" else r"\w", text[b : b + 2]):
        b += 1
    found = max(FORMS[kind].finditer(text, a, b), key=lambda m: m.end() - m.start(), default=None)
    if found is None:
        return None
    if kind == "address":
        # The street stands on the first line; a number on the line before is none.
        first = text.find("\n", found.start(), found.end())
        if first >= 0 and not _possible(kind, text, found.start(), first):
            found = ADDRESS.search(text, first, found.end())
    return found.span() if found and _possible(kind, text, *found.span()) else None


def spans_of(text: str, at: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Items of a text, in order, from the tags of the marked characters ``at``."""
    out: list[tuple[int, int, str]] = []
    if not len(at):
        return out
    kinds = (tags - 1) // 2
    cut = np.flatnonzero((np.diff(at) > 1) | (kinds[1:] != kinds[:-1]) | ((tags[1:] % 2 == 1) & (tags[:-1] % 2 == 0))) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        kind = KINDS[kinds[lo]]
        a, b = int(at[lo]), int(at[hi - 1]) + 1
        if b - a < 3:
            continue
        if kind in ("phone", "id_number"):
            kind = _labelled(text, a) or kind
        item = _trim(kind, text, a, b)
        if item and (not out or item[0] >= out[-1][1]):
            out.append((*item, kind))
    return out


# ---------------------------------------------------------------- the operator

_MODELS: dict[tuple, tagger.Weights] = {}
_LOCK = threading.Lock()


def model(spark: SparkSession | None = None, count: int = EXAMPLES, hidden: int = HIDDEN, epochs: int = EPOCHS, vocabulary: str = VOCABULARY) -> tagger.Weights:
    """The trained tagger; trained once in a process for given settings.

    With a session the training runs in a task (about two minutes), else in this process.
    """

    def fit() -> tagger.Weights:
        return tagger.train(examples(count, STRETCH, vocabulary=vocabulary), TAGS, hidden=hidden, epochs=epochs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"weights": [pickle.dumps(fit())] * len(frame)})

    key = (count, hidden, epochs, vocabulary)
    with _LOCK:
        if key not in _MODELS:
            _MODELS[key] = fit() if spark is None else pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(run, "weights binary").head()["weights"])
        return _MODELS[key]


FOUND = "doc_id long, kind string, line_no long, start long, end long"
REDACTED = "doc_id long, text string, n_items int"


def _clean(text: str) -> tuple[str, np.ndarray | None]:
    """The text without invisible characters, and where each kept character stood."""
    if text.isascii():
        return text, None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = ~(((codes >= 0x200B) & (codes <= 0x200F)) | (codes == 0x2060) | (codes == 0xFEFF) | (codes == 0xAD))
    if keep.all():
        return text, None
    return codes[keep].tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(keep)


def _items(decoder: tagger.Decoder, texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Items of each text, tagged a block of texts at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BLOCK):
            size += len(texts[stop])
            stop += 1
        cleaned = [_clean(t) for t in texts[at:stop]]
        tagged = tagger.tag(decoder, [c[0] for c in cleaned], WINDOW, MARGIN)
        for (text, where), (places, tags) in zip(cleaned, tagged, strict=True):
            spans = spans_of(text, places, tags)
            yield spans if where is None else [(int(where[a]), int(where[b - 1]) + 1, k) for a, b, k in spans]
        at = stop


def find_personal(documents: DataFrame, weights: tagger.Weights | None = None) -> DataFrame:
    """Rows ``doc_id, kind, line_no, start, end``, one per item.

    ``line_no`` counts lines from 1, ``start`` and ``end`` are character offsets. Null and
    empty texts and null ids give no rows; repeated rows count once; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights or model(documents.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = tagger.Decoder(shared.value)
        for frame in batches:
            texts = frame["text"].tolist()
            out = []
            for doc, text, spans in zip(frame["doc_id"], texts, _items(decoder, texts), strict=True):
                out += [(doc, kind, text.count("\n", 0, a) + 1, a, b) for a, b, kind in spans]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "line_no", "start", "end"])

    return documents.select("doc_id", "text").filter("doc_id is not null and text is not null and text <> ''").mapInPandas(run, FOUND).distinct()


def redact(documents: DataFrame, weights: tagger.Weights | None = None) -> DataFrame:
    """Rows ``doc_id, text, n_items``: every row, its items replaced by ``[KIND]``.

    Null texts stay null, empty ones empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights or model(documents.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = tagger.Decoder(shared.value)
        for frame in batches:
            texts = frame["text"].tolist()
            new, counts = [], []
            for text, spans in zip(texts, _items(decoder, [t or "" for t in texts]), strict=True):
                pieces, at = [], 0
                for a, b, kind in spans:
                    pieces += [text[at:a], f"[{kind.upper()}]"]
                    at = b
                new.append("".join(pieces) + text[at:] if spans else text)
                counts.append(len(spans))
            frame["text"], frame["n_items"] = new, counts
            yield frame[["doc_id", "text", "n_items"]]

    return documents.select(solid("doc_id"), "text").mapInPandas(run, REDACTED).select(restored("doc_id"), "text", "n_items")
