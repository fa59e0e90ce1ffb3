"""Nearest neighbours against brute force, the tagger on held-out text, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import neighbours, personal, registry, sentences, tagger

DIMS = {"small": 8}


def brute(x, ids, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(x)):
        order = np.lexsort((ids, -s[i]))
        out[ids[i]] = [int(ids[j]) for j in order[:k] if j != i]
    return out


def test_exact_within_one_leaf_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[40:55] = x[3]  # copies: ties go to the smaller id
    rows = [(int(i), "small", [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(100, "small", None), (101, "small", [0.0] * 8), (102, "small", [1.0] * 7), (103, "small", [float("nan")] * 8), (104, "other", [1.0] * 8), (None, "small", [1.0] * 8), (105, "small", [1.0] * 7 + [None])]
    df = spark.createDataFrame(rows + rows[:9] + bad, "vec_id long, embed_model string, vector array<float>").withColumn("leaf", F.lit("clash")).withColumn("rank", F.lit(1))
    got: dict = {}
    for r in neighbours.nearest(df, k=5, dimensions=DIMS).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    assert got == brute(x.astype(np.float64), np.arange(60), 5)
    assert neighbours.nearest(df.limit(0), dimensions=DIMS).count() == 0


def test_recall_over_many_leaves(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((300, 8))
    x = (centre[rng.integers(0, 300, 3000)] + 0.15 * rng.standard_normal((3000, 8))).astype(np.float32)
    df = spark.createDataFrame([(int(i), "small", [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embed_model string, vector array<float>")
    want = brute(x.astype(np.float64), np.arange(3000), 10)
    out = neighbours.nearest(df, dimensions=DIMS, leaf_rows=200, queries_every=20, probes=12).collect()
    hits = sum(r["neighbour_id"] in want[r["vec_id"]] for r in out)
    assert len(out) == 1500 and hits / 1500 >= 0.9
    near = {(r["vec_id"], r["neighbour_id"]) for r in neighbours.nearest(df, dimensions=DIMS, leaf_rows=200, min_similarity=0.9).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, js in want.items() for j in js if unit[i] @ unit[j] >= 0.9}
    assert len(near & true) / len(true) >= 0.9


def test_pairs_split_in_every_tree_are_found_through_the_queue(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((1500, 8)), 2, axis=0)
    x = (x + 0.1 * rng.standard_normal((3000, 8))).astype(np.float32)
    df = spark.createDataFrame([(int(i), "small", [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embed_model string, vector array<float>")
    want = brute(x.astype(np.float64), np.arange(3000), 10)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = {(min(i, j), max(i, j)) for i, js in want.items() for j in js if unit[i] @ unit[j] >= 0.9}

    def found(probes):
        near = neighbours.nearest(df, dimensions=DIMS, leaf_rows=50, min_similarity=0.9, probes=probes)
        return {tuple(r) for r in neighbours.linked(near).collect()}

    homes, queue = found(0), found(24)
    assert len(true - queue) < 0.3 * len(true - homes) and len(queue & true) / len(true) >= 0.97


def test_found_uses_the_queue(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(registry, "read", lambda *a: None)
    monkeypatch.setattr(neighbours, "linked", lambda found: found)
    monkeypatch.setattr(neighbours, "nearest", lambda vectors, **given: asked.update(given))
    registry.p2_found(spark, "")
    assert asked["probes"] > neighbours.TREES


def test_a_vector_that_holds_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.lit("small").alias("embed_model"), F.when(F.col("id") % 3 == 0, F.array(*(F.lit(1.0) for _ in range(8)))).otherwise(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id")))).alias("vector"))
    out = neighbours.nearest(df, k=3, min_similarity=0.999, dimensions=DIMS, leaf_rows=100)
    first = {r["vec_id"]: r["neighbour_id"] for r in out.filter("rank = 1").collect()}
    assert first[300] == 0 and first[0] == 3 and out.filter("vec_id % 3 = 0").count() == 3000


# ------------------------------------------------------------------ tagger


def test_gradient():
    """The analytic gradient against differences."""
    w = tagger.fresh(5, 5, 2)
    rng = np.random.default_rng(0)
    for a in w.arrays():
        a += rng.normal(0, 0.1, a.shape).astype(np.float32)
    x, y = rng.integers(0, 90, (3, 12)).astype(np.uint8), rng.integers(0, 5, (12, 3))
    _, grads = tagger.loss(w, x, y)
    for array, grad in zip(w.arrays(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old = array[at]
        array[at] = old + 1e-2
        up = tagger.loss(w, x, y)[0]
        array[at] = old - 1e-2
        down = tagger.loss(w, x, y)[0]
        array[at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-2, rel=2e-2)


def test_decoder_skips_only_what_is_outside():
    """Decoding with the bound equals Viterbi over every window, for weights of any kind."""
    rng = np.random.default_rng(1)
    for seed in range(4):
        w = tagger.fresh(6, 5, seed)
        w.steps += rng.normal(0, 1, w.steps.shape).astype(np.float32)
        w.bias.reshape(tagger.STRIDE, 5)[:, 0] += seed / 4
        d = tagger.Decoder(w)
        x = rng.integers(1, 90, (200, 48)).astype(np.uint8)
        e = tagger.emissions(w, x)[0]
        full = tagger.viterbi(d.steps, d.start, np.ascontiguousarray(e - e[:, :1])).T
        got = d.decode(x)
        assert 0 < (full != 0).any(1).sum() and np.mean(got == full) > 0.999


def test_windows_cover_and_divide():
    lengths = np.array([0, 5, 512, 513, 4000, 0, 977])
    text, place, start, end = tagger.windows(lengths, 512, 24)
    for t, n in enumerate(lengths):
        mine = text == t
        assert mine.sum() == 0 if n == 0 else (start[mine][0] == 0 and end[mine][-1] == n)
        assert ((end - start)[mine] <= 512).all() and (end[mine][:-1] - start[mine][1:] == 48).all()


@pytest.fixture(scope="module")
def weights(spark):
    return personal.model(spark, count=16000)


def test_held_out_accuracy(weights):
    held = sentences.examples(400, personal.STRETCH, seed=99)
    got = tagger.tag(tagger.Decoder(weights), [t for t, _ in held], personal.WINDOW, personal.MARGIN)
    right = 0
    for (places, tags), (_, y) in zip(got, held, strict=True):
        full = np.zeros(len(y), np.int8)
        full[places] = tags
        right += (full == y).sum()
    assert right / sum(len(y) for _, y in held) > 0.97


TEXT = """# Notes
Thanks to Maren Ostrander for tracking down the queue.
Questions go to maren.ostrander [at] mail [dot] example or +1 555-014-2290.
Ship the spare disk to 117 Saltmarsh Street, Valmont 26383.
> my passport is P99568680, please merge the account
git clone git@git.example.org:garnet/queue.git
Listening on 10.26.21.72:8570 since 2024-05-18 16:30:52.
Order 2444-0415-75 of the layer took 161 ms on Main Branch 7.
The Cold Watcher and the Nettle Header share one lock.
"""


def test_items(spark, weights):
    df = spark.createDataFrame([(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "w " * 60_000, "x"), (None, "Thanks to Maren Ostrander for it.", "x"), (5, "Thanks to Ma\u200bren Ostrander for it.", "x")], "doc_id long, text string, kind string")
    got = {(r["doc_id"], r["kind"], r["line_no"]) for r in personal.find_personal(df, weights).collect()}
    assert got == {(1, "name", 2), (1, "email", 3), (1, "phone", 3), (1, "address", 4), (1, "id_number", 5), (5, "name", 1)}
    out = {r["doc_id"]: r for r in personal.redact(df.distinct(), weights).collect()}
    assert "[NAME]" in out[1]["text"] and "Maren" not in out[1]["text"] and out[1]["text"].count("\n") == TEXT.count("\n") and out[1]["n_items"] == 5
    assert (out[2]["text"], out[3]["text"], len(out[4]["text"]), out[None]["n_items"]) == (None, "", 120_000, 1)
    assert personal.find_personal(df.limit(0), weights).count() == 0
