"""Evaluation texts leaking into a corpus, by latent semantic retrieval.

Documents are cut into overlapping passages of words, and all passages into TF-IDF vectors
with the document frequencies of the whole corpus. The leading right singular vectors of a
bounded sample of passages, with the evaluation texts, come from a distributed randomised
SVD with power iterations. Every passage of every document is projected into that space
and compared by cosine with the evaluation texts; near ones are candidates, and nothing
else is. Candidates are then checked word by word: a run of common words, a longest common
subsequence over the whole text, which finds paraphrases with changed words, and whether
the answer to the item stands in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import plain, words

#: Words of a passage; half a passage lies between two starts, so a stretch of half a
#: passage lies whole in one.
PASSAGE = 32
#: Hashed TF-IDF features, rank of the latent space, extra columns and power iterations.
FEATURES, RANK, EXTRA, POWERS = 8192, 64, 8, 2
#: Passages of the corpus that the space is fitted on, at most.
SAMPLE = 6000
#: Least cosine of a candidate.
COSINE = 0.5
#: Words in a row, or the part of a text's words in order, that make a case.
RUN, WHOLE = 15, 0.85
#: Evaluation items that are looked for at once, and words read at once.
BLOCK, WORDS = 5000, 200_000


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FEATURES)).astype(np.int64)


class Item:
    """One evaluation text: its words, the blank-separated word of each, its answers."""

    def __init__(self, scenario: int, kind: str, text: str, answers: list[np.ndarray]):
        self.scenario, self.kind, self.answers = scenario, kind, answers
        self.ids, self.belongs = words(plain(text).split())
        self.where: dict[int, list[int]] = {}
        for j, h in enumerate(self.ids.tolist()):
            self.where.setdefault(h, []).append(j)

    def starts(self) -> list[int]:
        """Starts of its passages; the last one ends with the text."""
        n, half = len(self.ids), PASSAGE // 2
        return sorted({*range(0, max(1, n - PASSAGE), half), max(0, n - PASSAGE)})


def _answers(expected) -> list[np.ndarray]:
    """Words of each expected file and symbol."""
    out = []
    for row in expected or ():
        out += [words([v])[0] for v in (row["file"], row["symbol"]) if v]
    return [a for a in out if len(a)]


class Probe:
    """The evaluation texts of one block, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str | None, str | None, list]]):
        self.items = [i for s, query, passage, expected in rows for k, t in (("query", query), ("passage", passage)) for i in [Item(s, k, t or "", _answers(expected))] if len(i.ids)]
        sizes = np.array([len(i.ids) for i in self.items], dtype=np.int64)
        #: Words of a document within which a changed copy of the item lies.
        self.sizes, self.reach = sizes, sizes + sizes // 5 + 4
        self.vocabulary = np.unique(np.concatenate([i.ids for i in self.items])) if self.items else np.zeros(0, np.uint64)
        self.holds = np.zeros((len(self.items), len(self.vocabulary) + 1), dtype=bool)
        for n, i in enumerate(self.items):
            self.holds[n, np.searchsorted(self.vocabulary, i.ids)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary; its size for any other word."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))


# ---------------------------------------------------------------- passages


def _blocks(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some documents, the words of all of them, and the end of each one's words."""
    texts, ids = frame["text"].tolist(), frame["doc_id"].to_numpy()
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 6 * WORDS):
            size += len(texts[stop])
            stop += 1
        hashes, owner = words(texts[at:stop])
        yield ids[at:stop], hashes, np.searchsorted(owner, np.arange(stop - at), side="right")
        at = stop


def _halves(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the half passages of all documents, and the document of each."""
    half = PASSAGE // 2
    begins = np.concatenate([[0], ends[:-1]])
    count = -(-(ends - begins) // half)
    owner = np.repeat(np.arange(len(ends)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return begins[owner] + place * half, owner


COUNTED = "priority long, features array<int>, df array<long>"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies of all features, and the passages with the smallest hashes."""
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    kept: list[tuple[int, np.ndarray]] = []
    for frame in batches:
        for _, hashes, ends in _blocks(frame):
            df[FEATURES] += len(ends)
            if not len(hashes):
                continue
            features = _features(hashes)
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            seen = np.zeros((len(ends), FEATURES), dtype=bool) if len(ends) < 4096 else None
            if seen is not None:
                seen[owner, features] = True
                df[:FEATURES] += seen.sum(axis=0)
            else:
                df[:FEATURES] += np.bincount(np.unique(owner * FEATURES + features) % FEATURES, minlength=FEATURES)
            starts, of = _halves(ends)
            # The priority of a passage is a hash of its words.
            priority = (np.add.reduceat(hashes, starts) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            for i in np.argsort(priority, kind="stable")[:SAMPLE]:
                kept.append((int(priority[i]), features[starts[i] : min(starts[i] + PASSAGE, ends[of[i]])]))
            if len(kept) > 4 * SAMPLE:
                kept = sorted(kept, key=lambda k: k[0])[:SAMPLE]
    kept = sorted(kept, key=lambda k: k[0])[:SAMPLE]
    yield pd.DataFrame({"priority": [k[0] for k in kept], "features": [k[1] for k in kept], "df": [None] * len(kept)})
    yield pd.DataFrame({"priority": [None], "features": [None], "df": [df]})


def _row(features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF row of a passage: features and weights."""
    f, n = np.unique(features, return_counts=True)
    w = idf[f] * n
    return f, w / (np.linalg.norm(w) or 1.0)


# ---------------------------------------------------------------- the latent space

PARTIAL = "block int, data binary"
BLOCKS = 16


def _accumulate(total: np.ndarray, x: np.ndarray, features: np.ndarray, idf: np.ndarray) -> None:
    f, w = _row(features, idf)
    total[f] += w[:, None] * (w @ x[f])


def _product(idf: np.ndarray, basis):
    """Adds A'(A X) of a partition's passages; A is never held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = basis.value
        total = np.zeros_like(x)
        for frame in batches:
            for features in frame["features"]:
                _accumulate(total, x, np.asarray(features), idf)
        size = FEATURES // BLOCKS
        yield pd.DataFrame({"block": range(BLOCKS), "data": [total[b * size : (b + 1) * size].astype(np.float32).tobytes() for b in range(BLOCKS)]})

    return run


def _sum_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(d, dtype=np.float32).astype(np.float64) for d in frame["data"]], axis=0)
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "data": [total.astype(np.float32).tobytes()]})


def latent_space(sample: DataFrame, texts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages (features x rank).

    ``texts`` holds the features of passages of evaluation texts, which are added.
    """
    sc = sample.sparkSession.sparkContext
    rng = np.random.default_rng(11)
    width = RANK + EXTRA

    def product(x: np.ndarray) -> np.ndarray:
        basis = sc.broadcast(x.astype(np.float32))
        parts = sample.select("features").mapInPandas(_product(idf, basis), PARTIAL)
        summed = parts.groupBy("block").applyInPandas(_sum_blocks, PARTIAL).toPandas()
        size = FEATURES // BLOCKS
        total = np.zeros((FEATURES, width))
        for b, data in zip(summed["block"], summed["data"], strict=True):
            total[b * size : (b + 1) * size] = np.frombuffer(data, dtype=np.float32).reshape(size, width)
        for features in texts:
            _accumulate(total, x, features, idf)
        return total

    x = rng.standard_normal((FEATURES, width))
    for _ in range(POWERS):
        x, _ = np.linalg.qr(product(x))
    values, turn = np.linalg.eigh(x.T @ product(x))
    return (x @ turn[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def _sums(weighted: np.ndarray, features: np.ndarray, starts: np.ndarray, of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``weighted`` over the words of each half passage."""
    # A row of zeros stands for the words that the last half of a document lacks.
    features = np.append(features, FEATURES)
    out = weighted[features[starts]]
    for j in range(1, PASSAGE // 2):
        at = starts + j
        out += weighted[features[np.where(at < ends[of], at, len(features) - 1)]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


# ---------------------------------------------------------------- word checks


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        u = row & masks.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def longest_run(item: Item, ids: np.ndarray) -> int:
    """Most blank-separated words of the item that follow one another in the document.

    A blank-separated word counts only with all of its parts.
    """
    best, before = 0, {}
    belongs, last = item.belongs, len(item.ids) - 1
    for h in ids.tolist():
        now = {}
        for j in item.where.get(h, ()):
            k = now[j] = before.get(j - 1, 0) + 1
            if k > best:
                i = j - k + 1
                head, tail = belongs[i], belongs[j]
                count = int(tail - head) + 1 - (i > 0 and belongs[i - 1] == head) - (j < last and belongs[j + 1] == tail)
                best = max(best, count)
        before = now
    return best


def in_order(item: Item, ids: np.ndarray, spots: np.ndarray) -> float:
    """Part of the item's words that occur in order in a stretch that opens near a spot."""
    m, best, last = len(item.ids), 0.0, -1
    step, reach = max(1, m // 8), m + m // 5 + 4
    for s in spots.tolist():
        if s >= last:
            last = s + step
            best = max(best, lcs(item.ids, ids[s : s + reach]) / m)
    return best


def answered(item: Item, ids: np.ndarray) -> float:
    """Part of the item's answers whose words all stand in the document."""
    if not item.answers:
        return 0.0
    there = set(ids.tolist())
    return sum(there.issuperset(a.tolist()) for a in item.answers) / len(item.answers)


def _check(probe: Probe, candidates: np.ndarray, ids: np.ndarray, run_words: int, whole: float, loose: float, kinds: tuple[str, ...]) -> Iterator[tuple[int, int, float, float]]:
    """Candidates that are cases: place of the item, run, share and answered part."""
    hits = probe.holds[candidates][:, probe.numbers(ids)]
    sums = np.concatenate([np.zeros((len(candidates), 1), np.int32), np.cumsum(hits, axis=1, dtype=np.int32)], axis=1)
    start = np.arange(len(ids))
    # A run consists of words of the item only.
    runs = (sums[:, run_words:] - sums[:, :-run_words] == run_words).any(axis=1)
    enough = sums[:, -1] >= loose * probe.sizes[candidates]
    for n in np.flatnonzero(runs | enough).tolist():
        c, total, may_run = int(candidates[n]), sums[n], bool(runs[n])
        item = probe.items[c]
        longest, share, spots = 0, 0.0, ()
        if enough[n] and item.kind in kinds:
            # Common words in any order bound the subsequence from above.
            common = total[np.minimum(start + probe.reach[c], len(ids))] - total[:-1]
            spots = np.flatnonzero(common >= loose * len(item.ids))
        if may_run or len(spots):
            longest = longest_run(item, ids)
            if longest < run_words and len(spots):
                share = in_order(item, ids, spots)
            if longest >= run_words or share >= loose:
                answer = answered(item, ids)
                if longest >= run_words or share >= whole or answer > 0:
                    yield c, longest, share, answer


FOUND = "doc_id long, scenario_id long, kind string, cosine double, run int, share double, answer double"


def _search(shared, idf: np.ndarray, space, cosine: float, run_words: int, whole: float, loose: float, kinds: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe, v = shared.value, space.value
        weighted = np.concatenate([v * idf[:, None].astype(np.float32), np.zeros((1, v.shape[1]), np.float32)])
        asked, owner = [], []
        for n, item in enumerate(probe.items):
            for s in item.starts():
                f, w = _row(_features(item.ids[s : s + PASSAGE]), idf)
                asked.append(w @ v[f])
                owner.append(n)
        asked_ = np.ascontiguousarray(_unit(np.array(asked, dtype=np.float32)).T)
        first = np.flatnonzero(np.diff(np.array(owner), prepend=-1))
        for frame in batches:
            out = []
            for ids, hashes, ends in _blocks(frame):
                if not len(hashes):
                    continue
                starts, of = _halves(ends)
                half = _sums(weighted, _features(hashes), starts, of, ends)
                # A passage is a half and the next one of its document; a lone half is one too.
                follows = np.append(of[1:] == of[:-1], False)
                passages = half.copy()
                passages[:-1][follows[:-1]] += half[1:][follows[:-1]]
                alone = ~follows & (np.append(False, of[1:] == of[:-1]))
                passages, at = _unit(passages[~alone]), of[~alone]
                near: dict[int, np.ndarray] = {}
                for lo in range(0, len(passages), 512):
                    similar = passages[lo : lo + 512] @ asked_
                    for r in np.flatnonzero(similar.max(axis=1) >= cosine):
                        best = np.maximum.reduceat(similar[r], first)
                        d = int(at[lo + r])
                        near[d] = np.maximum(near[d], best) if d in near else best
                for d, best in near.items():
                    mine = hashes[ends[d - 1] if d else 0 : ends[d]]
                    for c, longest, share, answer in _check(probe, np.flatnonzero(best >= cosine), mine, run_words, whole, loose, kinds):
                        item = probe.items[c]
                        out.append((ids[d], item.scenario, item.kind, float(best[c]), longest, share, answer))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return run


def find_leaks(
    documents: DataFrame,
    scenarios: DataFrame,
    cosine: float = COSINE,
    run_words: int = RUN,
    whole: float = WHOLE,
    loose: float | None = None,
    kinds: tuple[str, ...] = ("passage",),
    block: int = BLOCK,
) -> DataFrame:
    """Rows ``doc_id, scenario_id, kind, cosine, run, share, answer``: what leaked where.

    ``kind`` is query or passage, ``cosine`` that of the nearest passages in the latent
    space, ``run`` the longest run of common words, ``share`` the part of the text found in
    order (computed where no run decides, for the kinds in ``kinds``) and ``answer`` the
    part of the item's expected files and symbols that stand in the document. A pair is a
    case by a run of ``run_words``, by a share of ``whole``, or by a share of ``loose``
    (default: ``whole``) where an answer stands in the document as well.

    Null and empty texts and null ids give no rows; evaluation texts without words cannot be
    cases. Repeated rows give one row. Other columns are ignored.

    The space is fitted once, on at most ``SAMPLE`` passages of the corpus and of the
    evaluation texts each; every passage is projected and compared. The evaluation set is
    read on the driver and looked for in blocks of ``block`` items.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    loose = whole if loose is None else loose
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null and text <> ''")
    asked = scenarios.select("scenario_id", "query", "passage", "expected" if "expected" in scenarios.columns else F.lit(None).alias("expected"))
    rows = [(r["scenario_id"], r["query"], r["passage"], r["expected"]) for r in asked.filter("scenario_id is not null").distinct().orderBy("scenario_id").toLocalIterator()]
    probes = [p for lo in range(0, len(rows), block) if (p := Probe(rows[lo : lo + block])).items]
    if not probes:
        return spark.createDataFrame([], FOUND)
    counted = cut_lineage(docs.mapInPandas(_count, COUNTED))
    summed = counted.filter("df is not null").select(F.posexplode("df").alias("f", "n")).groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[summed["f"]] = summed["n"]
    idf = 1 + np.log((df[FEATURES] + 2) / (df[:FEATURES] + 1))
    sample = cut_lineage(counted.filter("df is null").orderBy("priority").limit(SAMPLE).repartition(4))
    texts = [_features(i.ids[s : s + PASSAGE]) for p in probes for i in p.items for s in i.starts()]
    space = sc.broadcast(latent_space(sample, texts[:: -(-len(texts) // SAMPLE)], idf))
    found = None
    for probe in probes:
        one = docs.mapInPandas(_search(sc.broadcast(probe), idf, space, cosine, run_words, whole, loose, kinds), FOUND)
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("cosine", "run", "share", "answer")).alias("r")
    return found.groupBy("doc_id", "scenario_id", "kind").agg(best).select("doc_id", "scenario_id", "kind", "r.*")
