"""Operators on small inputs: expected values, brute force, and odd inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import scores as S
from siltstone.functions import text as X
from siltstone.operators import changes, chunking, evaluate, filters, fulltext, fusion, graph, knn, merge, ordering


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


# ------------------------------------------------------------------ text


@pytest.mark.parametrize(
    ("text", "want"),
    [("", "\n"), ("  \n ", "\n"), ("a\r\nb", "a\nb\n"), ("\n\na \t\n\nb\n\n", "a\n\nb\n"), ("x\u00a0\n", "x\n"), ("a\rb", "a\nb\n"), (None, None)],
)
def test_canonical(spark, text, want):
    assert one(spark, X.canonical(F.lit(text).cast("string"))) == want


def test_hash(spark):
    assert one(spark, X.text_hash(F.lit("hello world"))).startswith("a948904f2f0f")
    assert one(spark, X.text_hash(F.lit("a\r\nb"))) == one(spark, X.text_hash(F.lit("a\nb\n")))


@pytest.mark.parametrize(("name", "want"), [("IngestionPipeline", ["ingestion", "pipeline"]), ("HTMLParser", ["html", "parser"]), ("MyBigClassName", ["my", "big", "class", "name"]), ("", [])])
def test_camel(spark, name, want):
    assert one(spark, X.camel_parts(F.lit(name))) == want


@pytest.mark.parametrize(("path", "want"), [("kb/ingest/pipeline.py", ["kb", "ingest", "pipeline"]), ("a/b/c/deep_module.py", ["a", "b", "c", "deep_module"]), ("x/a.test.ts", ["x", "a"])])
def test_path_parts(spark, path, want):
    assert one(spark, X.path_parts(F.lit(path))) == want


def test_enrichment(spark):
    e = X.enrich(F.lit("body"), F.lit("src/a.py"), F.lit("fooBar"), F.lit("Baz.fooBar"))
    assert one(spark, e).endswith("src a foo bar baz")
    assert one(spark, X.strip_enrichment(e)) == "body"
    assert one(spark, X.enrich(F.lit("body"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "body"


def test_cursor(spark):
    c = X.encode_cursor(F.lit("q"), F.lit(0.5), F.lit("id"))
    assert one(spark, X.decode_cursor(c, F.lit("q")))["s"] == 0.5
    assert one(spark, X.decode_cursor(c, F.lit("other"))) is None
    assert one(spark, X.decode_cursor(F.lit("?!"), F.lit("q"))) is None


def test_normalisers(spark):
    anchors = [(0.0, 0.0), (1.0, 0.05), (5.0, 0.25), (8.0, 0.5), (12.0, 0.75), (20.0, 0.95), (30.0, 0.99), (40.0, 1.0)]
    assert [one(spark, S.quantile(F.lit(v), anchors)) for v in (6.5, -5.0, 80.0)] == [0.375, 0.0, 1.0]
    assert [one(spark, S.min_max(F.lit(v), F.lit(0.0), F.lit(40.0))) for v in (-10.0, 50.0, 20.0)] == [0.0, 1.0, 0.5]
    low, mid, high = (one(spark, S.sigmoid(F.lit(v), 5)) for v in (-10.0, 0.0, 10.0))
    assert low < mid < high


def test_score_statistics_need_a_hundred(spark):
    assert S.statistics(spark.range(99).select(F.col("id").cast("double").alias("score"))).count() == 0
    row = S.statistics(spark.range(101).select(F.col("id").cast("double").alias("score"))).collect()[0]
    assert (row["median"], row["p05"], row["sample_size"]) == (50.0, 5.0, 101)


# ------------------------------------------------------------------ fusion and search


def test_rrf_ties_and_repeats(spark):
    rows = [(1, 1, 1, "A", 0.9), (1, 1, 2, "B", 0.8), (1, 2, 1, "B", 0.9), (1, 2, 2, "A", 0.8), (1, 2, 3, None, 0.1)]
    out = fusion.reciprocal_rank(spark.createDataFrame(rows, "query_id int, list_no int, rank int, id string, score double")).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["A", "B"]
    assert out[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    twice = spark.createDataFrame([(1, 1, 1, "A", 1.0), (1, 1, 2, "A", 1.0)], "query_id int, list_no int, rank int, id string, score double")
    assert fusion.reciprocal_rank(twice).collect()[0]["appearances"] == 2


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        fusion.weighted(spark.createDataFrame([], "query_id int, list_no int, rank int, id string, score double"), [0.5, 0.6])
    with pytest.raises(ValueError):
        fusion.fuse("median")


def test_mmr(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0]), (1, 4, 0.1, None)]
    c = spark.createDataFrame(rows, "query_id int, id int, score double, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r["id"] for r in fusion.diversify(c, q, 2, 0.5).orderBy("rank").collect()] == [1, 3]
    assert fusion.diversify(c, q, 10, 0.5).count() == 4
    assert fusion.diversify(c.limit(0), q).count() == 0


def test_knn_ties_and_bad_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("rank", F.lit("clash"))
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r["id"] for r in knn.exact(v.select("id", "vector").distinct(), q, 2).orderBy("rank").collect()] == [1, 2]
    assert knn.exact(v.limit(0), q, 2).count() == 0


def test_tuning():
    assert (knn.Tuning.adaptive("concept", 10, 100_000).nprobes, knn.Tuning.adaptive("identifier", 10, 100_000).nprobes, knn.Tuning.adaptive("concept", 5, 100_000).nprobes) == (15, 50, 31)
    with pytest.raises(ValueError):
        knn.Tuning(0, 1)
    slow = knn.Tuning(20, 10).adjusted([300.0] * 20, 150.0)
    assert (slow.nprobes, slow.refine) == (16, 9)


def test_bm25_against_brute_force(spark):
    import math

    docs = {1: "red fox red", 2: "blue fox", 3: "", 4: "green tree tree"}
    index = fulltext.build(spark.createDataFrame([*docs.items(), (5, None)], "id int, text string"))
    got = {r["id"]: r["score"] for r in fulltext.bm25(index, spark.createDataFrame([(1, "Red tree")], "query_id int, query string")).collect()}
    n, avg = 3, (3 + 2 + 3) / 3
    want = {}
    for d, t in docs.items():
        w = t.split()
        for term in ("red", "tree"):
            df = sum(term in x.split() for x in docs.values())
            tf = w.count(term)
            if tf:
                want[d] = want.get(d, 0) + max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("query", "want"), [("fox NOT red", [2]), ("fox AND red", [1]), ("gre*", [4]), ('"red fox"', [1]), ("(blue OR green) NOT tree", [2]), ("a;b", [])])
def test_boolean_queries(spark, query, want):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "Blue fox"), (3, None), (4, "green tree")], "id int, text string")
    assert sorted(r["id"] for r in fulltext.matching(docs, query).collect()) == want


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("relational", "relat"), ("hopping", "hop"), ("adjustment", "adjust"), ("probate", "probat"), ("sky", "sky")])
def test_stems(word, want):
    assert fulltext.stem(word) == want


def test_prepare():
    assert [fulltext.prepare(q) for q in ("word", "two words", "a and b", '"x y"', "")] == ["word", "two OR words", "a and b", '"x y"', ""]


# ------------------------------------------------------------------ filters


def test_filters_equal_a_naive_form(spark):
    import fnmatch

    paths = ["src/a.py", "src", "srcx/a.py", "./src/b.md", ".github/x.yml", "docs/test_a.py", "a/b/test.js", ""]
    df = spark.createDataFrame([(i, "r", p) for i, p in enumerate(paths)], "id int, repo string, path string")
    got = [r["path"] for r in filters.hits(df, include=["src/", ".github"], exclude_globs=["*.md"]).orderBy("id").collect()]
    clean = lambda p: p[2:] if p.startswith("./") else p
    want = [p for p in paths if any(clean(p) == x or clean(p).startswith(x + "/") for x in ("src", ".github")) and not fnmatch.fnmatch(p, "*.md")]
    assert got == want


def test_ignored_and_contained(spark):
    df = spark.createDataFrame([("a/node_modules/x.js",), ("a/x.min.js",), (".env",), ("src/env.py",), (None,)], "path string")
    assert [r[0] for r in df.select(filters.ignored(F.col("path"))).collect()] == [True, True, True, False, False]
    df = spark.createDataFrame([("a/../b",), ("../b",), ("/etc",), ("a/../../b",)], "path string")
    assert [r[0] for r in df.select(filters.contained(F.col("path"))).collect()] == [True, False, False, False]


def test_combined_criteria():
    c = filters.combine(filters.Criteria(repos=["b"], min_tokens=5), filters.Criteria(repos=["a"], min_tokens=3, max_tokens=9))
    assert (c.repos, c.min_tokens, c.max_tokens) == (["a", "b"], 3, 9)
    assert filters.Criteria().column() is None


# ------------------------------------------------------------------ chunks and graphs


def test_window_ranges(spark):
    def spans(n):
        return [(s["start"], s["stop"]) for s in one(spark, chunking.window_ranges(F.lit(n)))]

    assert spans(0) == []
    assert spans(400) == [(0, 400)]
    assert spans(1000) == [(0, 400), (360, 760), (720, 1000)]


@settings(max_examples=20, deadline=None)
@given(n=st.integers(1, 3000), target=st.integers(1, 500), overlap=st.integers(0, 499))
def test_windows_cover_everything(spark, n, target, overlap):
    spans = [(s["start"], s["stop"]) for s in one(spark, chunking.window_ranges(F.lit(n), target, overlap))]
    assert spans[0][0] == 0 and spans[-1][1] == n
    assert all(b[0] <= a[1] and b[1] - b[0] <= target for a, b in zip(spans, spans[1:], strict=False))


def test_markdown_sections(spark):
    text = "intro\n# A\nx\n## B\n```\n# no heading\n```\n### C ##\ny\n# D\nz"
    rows = chunking.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("section").collect()
    assert [(r["h1"], r["h2"], r["h3"]) for r in rows] == [(None, None, None), ("A", None, None), ("A", "B", None), ("A", "B", "C"), ("D", None, None)]
    assert "# no heading" in rows[2]["text"]


def test_statements():
    sql = "select 1;\nselect ';'\nfrom t; select 2;\n$$a;\n$$;\n-- ;\nselect 3"
    assert [(a, b) for a, b, _ in chunking.statements(sql)] == [(1, 1), (2, 3), (4, 5), (6, 7)]


@pytest.mark.parametrize(("sql", "want"), [("CREATE TABLE x", "table"), ("create or replace view x", "view"), ("CREATE PROCEDURE p", "procedure"), ("WITH a AS (SELECT 1)", "cte"), ("select 1", "query"), ("DROP x", "statement")])
def test_statement_kinds(spark, sql, want):
    assert one(spark, chunking.statement_kind(F.lit(sql))) == want


def test_sql_statements(spark, tmp_path):
    from siltstone.plans import indexing

    large = "select\n" + ",\n".join(f"  a{i} as b{i}" for i in range(300)) + "\nfrom t;"
    text = "-- a note\ncreate table x (a int);\n/* of */ create or replace view v as select 1;\n" + large + "\n{% macro m(a) %}\nselect 1;\n{% endmacro %}\nselect * from {{ ref('x') }};\nwith a as (select 1) select * from a"
    files = [(1, "r", "a.sql", "sql", text, False), (2, "r", "b.SQL", None, "select 1; -- {", False), (3, "r", "c.sql", "sql", None, False), (4, "r", "d.py", "python", "select = 1", False)]
    spark.createDataFrame(files, "file_id long, repo string, path string, language string, text string, is_binary boolean").write.parquet(str(tmp_path / "files.parquet"))
    got = [tuple(r) for r in indexing.sql_statements(spark, str(tmp_path)).orderBy("file_id", "ordinal").collect()]
    kinds = [k for f, _, _, _, k in got if f == 1]
    assert kinds[:2] == ["table", "view"] and kinds[-3:] == ["macro", "template", "cte"] and [k for f, *_, k in got if f == 2] == ["query"]
    parts = [(a, b) for f, _, a, b, k in got if k == "query_part"]
    assert len(parts) > 1 and all(b + 1 == c for (_, b), (c, _) in zip(parts, parts[1:], strict=False)) and {f for f, *_ in got} == {1, 2}
    assert {r["symbol_kind"] for r in indexing.chunk_files(spark, str(tmp_path)).collect()} >= {"table", "view", "macro", "template", "cte", "query_part"}


def test_chunkers(spark):
    files = [
        (1, "a.py", "python", "class A:\n    def m(self):\n        pass\n\ndef f():\n    pass\n"),
        (2, "b.ts", "typescript", "export class B {\n  run(x: number): void {\n  }\n}\nconst g = (x) => x;\n"),
        (3, "c.svelte", "svelte", "<script>\nfunction h() {}\n</script>\n<p>hi</p>\n<style>p {}</style>\n"),
        (4, "bad.py", "python", "def ("),
        (5, "e.py", "python", None),
    ]
    rows = chunking.chunk(spark.createDataFrame(files, "file_id long, path string, language string, text string")).collect()
    got = {(r["file_id"], r["symbol_kind"], r["symbol_name"], r["start_line"], r["end_line"]) for r in rows}
    assert {(1, "class", "A", 1, 3), (1, "method", "m", 2, 3), (1, "function", "f", 5, 6)} <= got
    assert {(2, "class", "B", 1, 4), (2, "method", "run", 2, 3)} <= got and any(r["symbol_name"] == "g" for r in rows)
    assert (3, "script_function", "h", 2, 2) in got and any(r["symbol_kind"] == "template" for r in rows)
    assert any(r["file_id"] == 4 and r["symbol_kind"] is None for r in rows)


def test_code_graph():
    nodes, edges = graph.python_graph("import os\nclass A(B):\n    @dec\n    def m(self):\n        f()\ndef f():\n    pass\n")
    assert {(n[1], n[2]) for n in nodes} == {("A", "class"), ("A.m", "method"), ("f", "function")}
    assert {("A", "B", "inherits", 2), ("A.m", "dec", "decorated_by", 3), ("A.m", "f", "calls", 5), ("<module>", "os", "imports", 1)} <= set(edges)


def test_resolution_prefers_the_file(spark):
    edges = spark.createDataFrame([(1, "a", "f", "calls", 3), (2, "b", "f", "calls", 4), (2, "b", "nowhere", "calls", 5)], "file_id long, source string, target string, edge_type string, line int")
    nodes = spark.createDataFrame([(1, "f", 10), (3, "f", 30)], "file_id long, name string, node_id long")
    assert {(r["file_id"], r["target_id"]) for r in graph.resolve(edges, nodes).collect()} == {(1, 10), (2, 30)}


def test_import_candidates(spark):
    assert one(spark, graph.import_candidates(F.lit("a.b"), F.lit("x.py"))) == ["a/b.py", "a/b/__init__.py"]
    assert "src/lib/u.ts" in one(spark, graph.import_candidates(F.lit("../lib/u"), F.lit("src/app/x.ts")))
    assert one(spark, graph.import_candidates(F.lit("react"), F.lit("x.ts"))) is None
    assert one(spark, graph.import_candidates(F.lit("..io.read"), F.lit("app/core/x.py"))) == ["app/io/read.py", "app/io/read/__init__.py"]
    assert one(spark, graph.import_candidates(F.lit("."), F.lit("app/core/x.py"))) == ["app/core/__init__.py"]


def test_import_edges_and_base_classes(spark, tmp_path):
    from siltstone.plans import indexing

    files = [
        (1, "r", "a/b.py", "import os\nclass Base:\n    pass\n"),
        (2, "r", "a/b/__init__.py", ""),
        (3, "r", "main.py", "import a.b\nfrom a.b import Base\nclass Child(Base):\n    pass\nclass Other(Unknown):\n    pass\n"),
        (4, "r", "s/x.ts", "export class Root {\n}\n"),
        (5, "r", "s/x/index.ts", "export const q = 1;\n"),
        (6, "r", "s/use.ts", "import { Root } from './x';\nimport r from 'react';\nclass Leaf extends Root {\n}\n"),
        (7, "other", "main.py", "import a.b\n"),
        (8, "r", "s/c.svelte", "<script>\nimport q from './x';\n</script>\n"),
        (9, "r", "t.pyi", "import a.b\n"),
    ]
    df = spark.createDataFrame([(i, r, p, None, t, False) for i, r, p, t in files], "file_id long, repo string, path string, language string, text string, is_binary boolean")
    df.write.parquet(str(tmp_path / "files.parquet"))
    assert {r["file_id"]: r["n"] for r in indexing.import_edges(spark, str(tmp_path)).collect()} == {3: 2, 6: 1, 8: 1, 9: 1}
    got = {(r["file_id"], r["source"], r["base_file"], r["base_line"]) for r in indexing.base_classes(spark, str(tmp_path)).collect()}
    assert got == {(3, "Child", 1, 2), (6, "Leaf", 4, 1)}


def test_pagerank_and_betweenness(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 2), (3, 1), (4, 3)], "src long, dst long")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges, 30).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert ranks[3] > ranks[2] > ranks[4]
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, edges.select(F.col("src").alias("node"))).collect()}
    assert between[3] == 3.0 and between[2] == 1.0  # 3 lies on 2-1, 4-1, 4-2; 2 on 1-3
    assert graph.pagerank(edges.limit(0)).count() == 0


# ------------------------------------------------------------------ maintenance and evaluation


def test_communities_settle(spark):
    stars = [(hub, hub + i) for hub in (100, 200) for i in range(1, 6)] + [(302, 301), (301, 302), (303, 301), (None, 301), (302, None), (304, 304)]
    edges = spark.createDataFrame(stars, "src long, dst long")
    got = {r["node"]: r["label"] for r in graph.communities(edges).collect()}
    assert all(got[hub + i] == got[hub] for hub in (100, 200) for i in range(1, 6)) and got[100] != got[200]
    assert got[301] == got[302] == got[303] and 304 not in got
    assert graph.communities(edges.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        graph.communities(edges, rounds=1)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = merge.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, merge.upsert(once, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_difference_with_nulls(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, h string")
    assert {tuple(r) for r in merge.difference(old, old, ["id"], ["h"]).select("action").distinct().collect()} == {("unchanged",)}
    new = spark.createDataFrame([(1, "z"), (3, "y"), (4, "n")], "id int, h string")
    assert dict(map(tuple, merge.difference(old, new, ["id"], ["h"]).collect())) == {1: "modified", 2: "deleted", 3: "unchanged", 4: "added"}


def test_chunk_diff_of_nothing(spark):
    none = spark.createDataFrame([], "text_hash string")
    assert tuple(merge.chunk_diff_stats(none, none).collect()[0]) == (0, 0, 0, 0, 0)
    three = spark.createDataFrame([("a",), ("b",), ("b",)], "text_hash string")
    assert tuple(merge.chunk_diff_stats(three, spark.createDataFrame([("a",), ("z",)], "text_hash string")).collect()[0]) == (3, 2, 1, 1, 33)


def test_coalescing(spark):
    rows = [(1, "r", "p", "created", 1), (2, "r", "p", "deleted", 2), (3, "r", "p", "modified", 3), (4, "r", "q", "modified", 1), (4, "r", "q", "modified", 1), (5, "r", "d", "deleted", 9), (6, "r", "d", "modified", 1), (7, "r", None, "deleted", 1)]
    e = spark.createDataFrame(rows, "id long, repo string, path string, change_type string, detected_at long")
    assert {(r["path"], r["change_type"], r["n_events"]) for r in changes.coalesce(e).collect()} == {("p", "modified", 3), ("q", "modified", 1), ("d", "deleted", 2)}


def test_drift(spark):
    m = spark.createDataFrame([("r", "same", 1, 1, "h"), ("r", "edited", 2, 2, "n"), ("r", "touched", 1, 9, "h")], "repo string, path string, size long, mtime long, content_hash string")
    s = spark.createDataFrame([("r", p, 1, 1, "h") for p in ("same", "edited", "touched", "gone")], "repo string, path string, size long, mtime long, content_hash string")
    assert {(r["path"], r["drift"]) for r in changes.drift(m, s).collect()} == {("edited", "modified"), ("gone", "deleted")}


def test_metrics(spark):
    results = spark.createDataFrame([("s", i, f, None) for i, f in enumerate("xaybz", 1)], "scenario_id string, rank int, file string, symbol string")
    expected = spark.createDataFrame([("s", "a", None), ("s", "b", None), ("t", "c", None)], "scenario_id string, file string, symbol string")
    out = {r["scenario_id"]: r for r in evaluate.metrics(results, expected).collect()}
    assert out["s"]["mrr"] == 0.5 and out["s"]["map"] == pytest.approx((1 / 2 + 2 / 4) / 2) and out["s"]["p_at_5"] == 0.4 and out["s"]["p_at_10"] == 0.0
    assert out["t"]["mrr"] == 0.0
    assert evaluate.compare(evaluate.metrics(results, expected), evaluate.metrics(results.limit(0), expected), gate=0.5).collect()[0]["change"] == "regressed"


def test_snippets_of_every_chunk(spark, tmp_path):
    from siltstone.plans import indexing

    texts = ["one", "a\nb", "a\nb\nc", "a\nb\nc\nd\ne\nf\ng", "", None] + ["\n".join(str(i) * n for i, n in enumerate(sizes)) for sizes in ((900, 900, 3, 3, 900, 900), (5, 5, 1000, 1000, 5, 5), (2000, 1, 700, 701, 1, 2000), (10, 10, 1590, 5, 9, 9), (10, 10, 799, 799, 9, 9))]
    spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").write.parquet(str(tmp_path / "chunks.parquet"))

    def brute(text):
        lines = text.split("\n")
        head, body, tail = ("\n".join(x) for x in (lines[:2], lines[2:4], lines[4:6]))
        if len(head) + len(body) + len(tail) <= 1600:
            return head, body, tail
        half = max(0, 1600 - len(body)) // 2
        return head[len(head) - half :] if 0 < half < len(head) else head if half else "", body[:1600], tail[:half]

    got = {r["chunk_id"]: (r["before"], r["match"], r["after"]) for r in indexing.snippet_windows(spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts) if t is not None}


def test_types_of_every_path(spark, tmp_path):
    from siltstone.plans import indexing

    want = {"README": ("text/markdown", "markdown"), "docs/readme.md": ("text/markdown", "markdown"), "Makefile": ("text/plain", "make"), "Dockerfile": ("text/plain", "docker"), "LICENSE": ("text/plain", ""), "a.py": ("text/x-python", "python"), "a.pyi": ("text/x-python", "python"), "b.tsx": ("text/typescript", "typescript"), "c.sh": ("application/x-sh", "bash"), "d.sql": ("application/sql", "sql"), "e.json": ("application/json", "json"), "f.bin": ("text/plain", "")}
    files = [(i, "r", p, None, False) for i, p in enumerate(want)]
    spark.createDataFrame(files, "file_id long, repo string, path string, language string, is_binary boolean").write.parquet(str(tmp_path / "files.parquet"))
    got = {files[r["file_id"]][2]: (r["media"], r["fence"]) for r in indexing.path_types(spark, str(tmp_path)).collect()}
    assert got == want


def test_snippet_budget(spark):
    text = "\n".join("abcdefghij" for _ in range(9))
    s = one(spark, X.snippet(F.lit(text), F.lit(4), F.lit(5), 3, 3, 10))
    assert s["match"] == "abcdefghij\nabcdefghij" and len(s["before"]) == 9 and s["before"].endswith("j") and s["after"] == "abcdefghi"
    assert one(spark, X.snippet(F.lit(text), F.lit(1), F.lit(1), 3, 0))["before"] == ""
    assert one(spark, X.snippet(F.lit("x" * 99), F.lit(1), F.lit(1), 1, 1, 5))["match"] == "x" * 20


def test_component_graph_and_flow():
    _, edges = graph.component_graph("<script>\nimport A from './A.svelte';\nexport let size;\n$store;\ndispatch('done');\n</script>\n<A/>\n")
    assert {(e[1], e[2]) for e in edges} == {("./A.svelte", "imports"), ("size", "accepts_prop"), ("store", "subscribes_to"), ("done", "dispatches_event"), ("A", "uses_component")}
    assert graph.data_flow("def f(a):\n    b = a\n    b = 2\n    return b\n") == [("f", "a", 1, 2), ("f", "b", 2, 4)]


def test_normaliser_choice(spark):
    stats = {"sample_size": 200, "min": 0, "p05": 1, "p25": 5, "median": 8, "p75": 12, "p95": 20, "p99": 30, "max": 40}
    assert one(spark, S.normaliser("quantile", stats)(F.lit(6.5))) == 0.375
    assert one(spark, S.normaliser("minmax", {"sample_size": 5})(F.lit(0.0))) == 0.5


def test_nearest_rank_against_sorting(spark):
    import random

    rng = random.Random(4)
    values = {"even": [float(rng.randrange(50)) for _ in range(1000)], "hot": [7.0] * 900 + [float(i) for i in range(100)], "one": [3.0], "spread": [rng.random() for _ in range(3001)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("none", None)], "k string, x double")
    out = {r["k"]: r for r in S.nearest_rank(df, "k", "x", {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95)}, 20).collect()}
    assert set(out) == set(values)
    for k, vs in values.items():
        assert (out[k]["p50"], out[k]["p95"]) == (sorted(vs)[len(vs) // 2], sorted(vs)[int(0.95 * len(vs))])


def test_positions_and_moving_windows(spark):
    import random

    ids = random.Random(2).sample(range(10_000), 700)
    df = spark.createDataFrame([("a" if n % 3 else "b", i, float(i % 11)) for n, i in enumerate(ids)] + [("a", None, 1.0)], "k string, id long, v double")
    rows = ordering.numbered(df, "k", "id", 16)
    got = {(r["k"], r["id"]): (r["i"], r["n"], r["m"]) for r in ordering.moving(rows, "k", "m", F.sum("v"), 4, block=32).collect()}
    assert len(got) == 700
    for k in "ab":
        mine = sorted(i for n, i in enumerate(ids) if ("a" if n % 3 else "b") == k)
        for place, i in enumerate(mine):
            assert got[(k, i)] == (place, len(mine), sum(x % 11 for x in mine[max(0, place - 4) : place + 1]))


def test_block_ends_skip_comments_patterns_and_templates():
    for body in ["/* don't { */", "// it's {", "const r = /['\"{]/;", "const t = `a } ${f({b: '}'})} {`;", "const d = a / b; const e = '{';", "return /}/.test(x);"]:
        text = f"function a() {{\n  {body}\n}}\nfunction b() {{\n}}\n"
        got = {r[4]: (r[1], r[2]) for r in chunking.script_symbols(text)}
        assert got["a"] == (1, 3) and got["b"] == (4, 5), body


def test_many_queries_stay_distributed(spark):
    from siltstone.operators import knn

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(300)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = df.withColumnRenamed("id", "query_id")
    few = {tuple(r) for r in knn.exact(df, asked, 4).collect()}
    many = {tuple(r) for r in knn.exact(df, asked, 4, block=64, cell=100).collect()}
    assert len(few) == 1200 and {(a, b, r) for a, b, _, r in few} == {(a, b, r) for a, b, _, r in many}


def test_moving_windows_fit_into_a_block(spark):
    from siltstone.operators import ordering

    with pytest.raises(ValueError):
        ordering.moving(spark.range(3).withColumnRenamed("id", "i"), "i", "x", F.sum("i"), 10, block=5)


@pytest.mark.parametrize("query,found", [("NEAR(alpha beta, 1)", {1, 2}), ("NEAR(alpha beta)", {1, 2, 3}), ("NEAR(alpha beta, 0) OR gamma", {2, 4}), ("NEAR(alpha missing, 5)", set())])
def test_near(spark, query, found):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "Beta, alpha"), (3, "alpha a b c d beta"), (4, "gamma"), (5, None), (6, "")], "id long, text string")
    assert {r["id"] for r in fulltext.matching(docs, query).collect()} == found


def test_incremental_index_equals_a_full_one(spark):
    from siltstone.operators import indexer

    def provider(texts):
        return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    before = spark.createDataFrame([(1, "r", "a.py", "def a():\n    return 1\n"), (2, "r", "b.md", "# B\n\ntext a\n"), (3, "r", "c.txt", "gone"), (5, "r", "e.py", None)], "file_id long, repo string, path string, text string")
    now = spark.createDataFrame([(1, "r", "a.py", "def a():\n    return 2\n"), (2, "r", "b.md", "# B\n\ntext a\n"), (4, "r", "d.py", "def a():\n    return 1\n"), (5, "r", "e.py", None)], "file_id long, repo string, path string, text string")
    for p in (None, provider):
        index = indexer.build(before, provider=p)
        assert {(r["file_id"], r["action"]) for r in indexer.plan(now, index).collect()} == {(1, "modified"), (2, "unchanged"), (3, "deleted"), (4, "added")}
        got, want = indexer.update(now, index, p), indexer.build(now, provider=p)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 3
    assert indexer.build(before.limit(0)).count() == 0
    lengths = {round(sum(x * x for x in r["vector"]), 4) for r in indexer.embed(before.select("text")).filter("vector is not null").collect()}
    assert lengths == {1.0}


def test_best_documents_are_those_of_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 12), p=np.arange(40, 0, -1) / 820)) for _ in range(6000)]
    # Ids that stand twice count as one document; copies have equal scores.
    rows = [(i % 5900 if i % 7 else 5999 - i, t) for i, t in enumerate(texts)] + [(9000 + i, texts[i]) for i in range(300)] + [(9990, None), (9991, ""), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, size=rng.integers(1, 5)))) for i in range(60)] + [(70, "w3 unknown w3"), (71, "unknown"), (72, ""), (73, None)], "query_id long, query string")
    scored = fulltext.bm25(fulltext.build(docs), asked).withColumn("score", F.round("score", 9))
    want = {tuple(r) for r in fusion.cut(scored, 7).select("query_id", "id", "score", "rank").collect()}
    assert len(want) > 400
    assert {tuple(r) for r in fulltext.best(docs, asked, 7).collect()} == want
    assert fulltext.best(docs, asked.limit(0), 7).count() == 0 and fulltext.best(docs.limit(0), asked, 7).count() == 0
    monkeypatch.setattr(fulltext, "BEST_ROWS", 5)
    assert {tuple(r) for r in fulltext.best(docs, asked, 7).collect()} == want


def test_exact_search_tells_apart_what_single_precision_does_not(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal(8)
    # Distances that differ by about 1e-9, in no order of the ids, and copies that tie.
    near = [(i, [float(x) for x in base + 3e-5 * rng.standard_normal(8)]) for i in range(3000)]
    rows = near + [(5000 + i, v) for i, v in near[:50]] + [(8000 + i, [float(x) for x in rng.standard_normal(5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(9)
    asked = spark.createDataFrame([(1, [float(x) for x in base]), (2, rows[-1][1])], "query_id long, vector array<double>")
    got = {q: [r["id"] for r in knn.exact(df, asked, 20).filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2)}
    for q, v in ((1, base), (2, np.array(rows[-1][1]))):
        d = {i: 1 - v @ x / np.linalg.norm(v) / np.linalg.norm(x) for i, x in ((i, np.array(x)) for i, x in rows) if len(x) == len(v)}
        assert got[q] == sorted(d, key=lambda i: (round(d[i], 12), i))[:20]
