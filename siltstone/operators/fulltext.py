"""Full-text ranking: postings, BM25 and boolean, phrase and prefix queries."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import cut_lineage
from .knn import keep_best

K1, B = 1.2, 0.75
#: Rows of query terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The same for ``best``, which broadcasts numbers, not words.
BEST_ROWS = 2_000_000
#: Documents that ``best`` scores at a time, at first and at most; queries whose candidates it keeps at a time.
FIRST, MOST, ASKED = 8192, 32_768, 1024


@dataclass
class Index:
    """Postings with term frequencies, and the length of each document."""

    postings: DataFrame  # id, term, tf
    lengths: DataFrame  # id, len

    def persist(self) -> Index:
        self.postings.persist()
        self.lengths.persist()
        return self


def build(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
    """Index of ``docs``. Null texts have no terms; repeated ids add up as one document."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("_w"))
    postings = rows.select("id", F.explode("_w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    lengths = rows.groupBy("id").agg(F.sum(F.size("_w").cast("long")).alias("len")).filter("len > 0")
    return Index(postings, lengths)


def bm25(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Rows ``query_id, id, score`` for every document that holds a term of the query.

    ``queries`` has ``query_id`` and ``query``. The idf is ln((N-n+0.5)/(n+0.5)), at least
    1e-6; all statistics are of the whole corpus, so filters are applied afterwards.
    Only the postings of the queries' terms are joined with the lengths. Query terms are
    broadcast while they are few, which one cheap pass over the queries finds out.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    wanted = index.postings.join(small(terms.select("term").distinct()), "term", "left_semi")
    total = index.lengths.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("avg")).alias("t")).scalar()
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    counted = df.withColumn("_t", total).select("term", "df", F.col("_t")["n"].alias("n_docs"), F.col("_t")["avg"].alias("avg_len"))
    weights = terms.join(counted, "term").select("query_id", "term", idf.alias("idf"), "avg_len")
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # Postings meet the lengths partitioned by document; with the weights broadcast, the sum
    # by query and document needs no further shuffle.
    scored = (wanted.repartition("id") if few else wanted).join(index.lengths, "id").join(small(weights), "term")
    return scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def _counted(vocabulary: pa.Array):
    """Batches of ``id, words`` as ``id, len, terms, tfs`` with the numbers of known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(size)), size)[term >= 0]
            key, tf = np.unique(doc * len(vocabulary) + term[term >= 0], return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *lists], ["id", "len", "terms", "tfs"])

    return run


def _postings(terms: pa.Array, tfs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, position of the document and frequency, by term; repeated terms add up."""
    doc = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    key, tf = terms.flatten().to_numpy().astype(np.int64) * max(1, len(terms)) + doc, tfs.flatten().to_numpy()
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    tf = np.add.reduceat(tf[order].astype(np.int64), first) if len(first) else tf
    return *np.divmod(key, max(1, len(terms))), tf


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term; -1 stands for those with any word, -2 for all words."""
    for batch in batches:
        size = batch.column(1).to_numpy()
        term, n = np.unique(_postings(batch.column(2), batch.column(3))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], term]), pa.int64()), pa.array(np.concatenate([[(size > 0).sum(), size.sum()], n]), pa.int64())], ["term", "n"])


class _Best:
    """The k best documents of each query among those added; equal scores go to the smaller id.

    ``start`` and ``term`` are the terms of each query. A document is passed over only if the
    greatest weights that its block has for the query's terms cannot reach the k-th best.
    """

    def __init__(self, k: int, start: np.ndarray, term: np.ndarray, idf: np.ndarray, average: float, k1: float, b: float):
        self.k, self.idf, self.average, self.k1, self.b = k, idf, average, k1, b
        # Rare terms first: they raise the score most and meet the fewest documents.
        of = np.repeat(np.arange(len(start) - 1), np.diff(start))
        self.start, self.term = start, term[np.lexsort((term, -idf[term], of))]
        self.kept, self.own = np.full((len(start) - 1, k), np.inf), np.zeros((len(start) - 1, k), dtype=np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray, terms: pa.Array, tfs: pa.Array) -> None:
        term, doc, tf = _postings(terms, tfs)
        if not len(term):
            return
        weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size[doc] / self.average))
        here, first = np.unique(term, return_index=True)
        top, lo, hi = np.zeros(len(self.idf)), np.zeros(len(self.idf), dtype=np.int64), np.zeros(len(self.idf), dtype=np.int64)
        top[here], lo[here], hi[here] = np.maximum.reduceat(weight, first), first, np.append(first[1:], len(term))
        most = np.add.reduceat(top[self.term], self.start[:-1])
        # Scores count as rounded to nine digits, so what is less by more than that is less.
        least = -self.kept.max(axis=1) - 1e-8
        score, found = np.zeros(len(ids)), []
        dense: dict[int, np.ndarray] = {}

        def whole(t: int) -> np.ndarray | None:
            """The weights of a term for all documents of the block, if many hold it."""
            if t not in dense and 8 * (hi[t] - lo[t]) > len(ids):
                dense[t] = np.zeros(len(ids))
                dense[t][doc[lo[t] : hi[t]]] = weight[lo[t] : hi[t]]
            return dense.get(t)

        asked = np.flatnonzero((most > 0) & (most >= least))
        # Plain lists: the loop below takes single values.
        lo, hi, top, least, start, terms = lo.tolist(), hi.tolist(), top.tolist(), least.tolist(), self.start.tolist(), self.term.tolist()
        for n, q in enumerate(asked.tolist()):
            need, mine = least[q], [t for t in terms[start[q] : start[q + 1]] if hi[t] > lo[t]]
            rest = list(itertools.accumulate(top[t] for t in reversed(mine)))[::-1]
            used = 0
            while used < len(mine) and (not used or rest[used] >= need):
                t = mine[used]
                if (all_of := whole(t)) is not None:
                    score += all_of
                else:
                    score[doc[lo[t] : hi[t]]] += weight[lo[t] : hi[t]]
                used += 1
            # Documents without any term so far cannot reach the k-th best by the other terms.
            hit = (score > max(0.0, need - (rest[used] if used < len(mine) else 0.0))).nonzero()[0]
            got = score[hit]
            score.fill(0.0)
            for t in mine[used:]:
                if (all_of := whole(t)) is not None:
                    got += all_of[hit]
                else:
                    at = lo[t] + np.searchsorted(doc[lo[t] : hi[t]], hit)
                    at = np.where(at < hi[t], at, lo[t])
                    got += np.where(doc[at] == hit, weight[at], 0.0)
            if used < len(mine):
                hit, got = hit[got >= need], got[got >= need]
            if len(hit) > 2 * self.k:
                value = np.round(got, 9)
                fit = value >= np.partition(value, len(hit) - self.k)[len(hit) - self.k]
                hit, got = hit[fit], got[fit]
                if len(hit) > 2 * self.k:
                    fit = np.lexsort((ids[hit], -value[fit]))[: self.k]
                    hit, got = hit[fit], got[fit]
            found.append((q, hit, got))
            if len(found) == ASKED or n == len(asked) - 1:
                rows = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                keep_best(self.k, 9, self.kept, self.own, rows, -np.concatenate([x[2] for x in found]), ids[np.concatenate([x[1] for x in found])])
                found = []


def best(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Rows ``query_id, id, score, rank``: the k best of ``docs(id, text)`` by ``bm25``.

    Scores are rounded to nine digits; equal ones rank by the smaller id. The documents'
    query terms are counted once and kept; then the query terms are broadcast as numbers,
    and two tasks a core score blocks of documents and keep the k best, so neither pairs of
    queries and documents nor the postings are shuffled. More than ``BEST_ROWS`` query terms
    stay distributed.
    """
    spark = docs.sparkSession
    pairs = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).filter("query_id is not null").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if pairs.limit(BEST_ROWS + 1).count() > BEST_ROWS:
        out = bm25(build(docs), queries, k1, b).withColumn("score", F.round("score", 9))
        return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = pairs.select(F.col("query_id").cast("long"), "term").toArrow()
    coded = asked.column("term").combine_chunks().dictionary_encode()
    vocabulary, term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    by_query = np.lexsort((term, asked.column("query_id").to_numpy()))
    names, start = np.unique(asked.column("query_id").to_numpy()[by_query], return_index=True)
    term, start = term[by_query], np.append(start, len(term))
    counted = docs.select("id", words(F.col("text")).alias("w")).mapInArrow(_counted(vocabulary), f"id {dict(docs.dtypes)['id']}, len long, terms array<int>, tfs array<int>")
    merged = counted.groupBy("id").agg(F.sum("len").alias("len"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs"))
    kept = cut_lineage(merged)
    total = kept.mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(total.column("term").to_pylist(), total.column("n").to_pylist(), strict=True))
    df = np.array([n.get(t, 0) for t in range(len(vocabulary))], dtype=np.float64)
    count = n.get(-1, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        idf = np.fmax(np.log((count - df + 0.5) / (df + 0.5)), 1e-6)
    shared = spark.sparkContext.broadcast((names, start, term, idf, n.get(-2, 0) / max(1, count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, term, idf, average = shared.value
        held = _Best(k, start, term, idf, average, k1, b)
        waiting, most = [], FIRST

        def score(some: list[pa.RecordBatch]) -> None:
            block = pa.Table.from_batches(some).combine_chunks()
            one = [block.column(x).combine_chunks() for x in ("id", "len", "terms", "tfs")]
            held.add(one[0].to_numpy(), one[1].to_numpy(), *one[2:])

        for batch in batches:
            while batch.num_rows:
                room = most - sum(x.num_rows for x in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(x.num_rows for x in waiting) == most:
                    score(waiting)
                    waiting, most = [], MOST
        if waiting:
            score(waiting)
        for lo in range(0, len(names), ASKED):
            there = np.isfinite(held.kept[lo : lo + ASKED])
            name = np.repeat(names[lo : lo + ASKED], k)[there.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(held.own[lo : lo + ASKED][there], pa.int64()), pa.array(np.round(-held.kept[lo : lo + ASKED][there], 9))], ["query_id", "id", "score"])

    scored = kept.filter("id is not null and size(terms) > 0").coalesce(2 * spark.sparkContext.defaultParallelism)
    out = scored.select(F.col("id").cast("long").alias("id"), "len", "terms", "tfs").mapInArrow(run, "query_id long, id long, score double")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prepare(query: str) -> str:
    """Joins the words of a plain query with OR; operators and quotes leave it as it is."""
    parts = query.split()
    if len(parts) <= 1 or '"' in query or any(p.upper() in ("AND", "OR", "NOT", "NEAR") for p in parts):
        return query
    return " OR ".join(parts)


def safe(query: str) -> bool:
    return bool(query.strip()) and not any(c in query for c in ";\\\0")


class _Parser:
    """query := or; or := and (OR and)*; and := not ((AND)? not)*; not := NOT? leaf."""

    def __init__(self, query: str):
        self.tokens = re.findall(r'NEAR\([^()]*\)|"[^"]*"|\(|\)|[^\s()"]+', query)
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self):
        node = self.both()
        while self.peek() == "OR":
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.leaf()
        while self.peek() not in (None, "OR", ")"):
            kind = "and"
            if self.peek() in ("AND", "NOT"):
                kind = self.take().lower()
                if kind == "and" and self.peek() == "NOT":
                    kind = self.take().lower()
            node = (kind, node, self.leaf())
        return node

    def leaf(self):
        token = self.take() if self.peek() is not None else ""
        if token == "(":
            node = self.either()
            if self.peek() == ")":
                self.take()
            return node
        if token.startswith("NEAR("):
            inner, _, gap = token[5:-1].partition(",")
            return ("near", re.findall(r"[^\W_]+", inner.lower()), int(gap) if gap.strip().isdigit() else 10)
        found = re.findall(r"[^\W_]+", token.lower())
        if token.startswith('"') and len(found) > 1:
            return ("phrase", found)
        return ("prefix" if token.endswith("*") else "term", found[0] if found else "")


def _places(col: Column, term: str) -> Column:
    return F.filter(F.transform(col, lambda w, i: F.when(w == term, i)), lambda i: i.isNotNull())


def _close(a: Column, b: Column, most: int) -> Column:
    """Whether some place of one list lies at most ``most`` from some place of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= most))


def matching(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids of the documents that match a boolean query with phrases, prefixes and NEAR(a b, n).

    NEAR holds where each word has the next one within ``n`` words in between (10 if not
    said), in either order.

    The query is folded into one predicate over each document's words, so no set of ids is
    shuffled however many operators it has.
    """
    if not safe(query):
        return docs.select(F.col(id_col).alias("id")).limit(0)
    tree = _Parser(query).either()
    col = F.col("_w")

    def cond(node):
        kind = node[0]
        if kind == "or":
            return cond(node[1]) | cond(node[2])
        if kind == "and":
            return cond(node[1]) & cond(node[2])
        if kind == "not":
            return cond(node[1]) & ~cond(node[2])
        if kind == "term":
            return F.array_contains(col, node[1])
        if kind == "near":
            places = [_places(col, t) for t in node[1]]
            held = F.size(places[0]) > 0 if places else F.lit(False)
            for a, b in zip(places, places[1:], strict=False):
                held = held & _close(a, b, node[2] + 1)
            return held
        if kind == "prefix":
            return F.exists(col, lambda w: w.startswith(node[1]))
        return F.contains(F.concat(F.lit(" "), F.concat_ws(" ", col), F.lit(" ")), F.lit(" " + " ".join(node[1]) + " "))

    return docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("_w")).filter(cond(tree)).select("id").distinct()


# ------------------------------------------------------------------ stemming

_VOWEL = "[aeiouy]"


def stem(word: str) -> str:
    """The public suffix-stripping algorithm of 1980 for English words."""
    if len(word) <= 2:
        return word

    def cons(w: str, i: int) -> bool:
        c = w[i]
        if c in "aeiou":
            return False
        return not (c == "y" and i and cons(w, i - 1)) if c == "y" else True

    def m(w: str) -> int:
        kinds = "".join("c" if cons(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", kinds))

    def has_vowel(w: str) -> bool:
        return any(not cons(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w: str) -> bool:
        return len(w) > 2 and cons(w, len(w) - 1) and not cons(w, len(w) - 2) and cons(w, len(w) - 3) and w[-1] not in "wxy"

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if m(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = None
        if w.endswith("ed") and has_vowel(w[:-2]):
            cut = w[:-2]
        elif w.endswith("ing") and has_vowel(w[:-3]):
            cut = w[:-3]
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif m(w) == 1 and cvc(w):
                w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # Suffixes of the second and third step with their replacements.
    second = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    third = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    fourth = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
    for table in (second, third):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if m(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted((*fourth, "ion"), key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if m(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


def stemmed(index: Index) -> Index:
    """The index over stems. Only the distinct terms pass through Python."""
    @F.pandas_udf("string")
    def to_stem(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    table = index.postings.select("term").distinct().withColumn("stem", to_stem("term"))
    postings = index.postings.join(table, "term").groupBy("id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return Index(postings, index.lengths)
