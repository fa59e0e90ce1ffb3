"""Full-text, vector and hybrid search, fusion, pagination and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import evaluate, filters, fulltext, fusion, knn, merge
from ..session import table
from . import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WELL = "(CASE embed_model WHEN 'small' THEN len(vector) = 64 ELSE len(vector) = 96 END) AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def well_formed(spark, d):
    """Well-formed vectors of all models; those of two models differ in length and never meet."""
    v = T.vectors(spark, d, "embed_model", "repo", "path", "text_hash", "vector").filter("size(vector) = case embed_model when 'small' then 64 when 'large' then 96 end")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return v.filter(good).withColumnRenamed("vec_id", "id")


ALL = f"s AS (SELECT vec_id AS id, embed_model, repo, path, text_hash, vector FROM v WHERE embed_model IN ('small', 'large') AND vector IS NOT NULL AND {WELL})"


@query(f"""WITH e AS (SELECT vec_id AS id, embedding AS vector FROM embeddings), r AS (SELECT q.id AS query_id, e.id, 1 - {COS.format(a='q.vector', b='e.vector')} AS x FROM e, e q WHERE q.id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12), id) AS rank FROM r) SELECT query_id, id, round(x, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def knn_cosine_topk(spark, d):
    """The ten nearest rows of every stated query (ids divisible by 20)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = knn.exact(e, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), r AS (SELECT q.id AS query_id, e.id, list_distance(q.vector, e.vector) ** 2 AS x FROM e, e q WHERE q.id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12), id) AS rank FROM r) SELECT query_id, id, round(1 / (1 + x), 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def knn_l2_score(spark, d):
    """Squared Euclidean distance and the score made of it."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = knn.exact(e, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, "l2")
    return found.select("query_id", "id", F.round(S.distance_score(F.col("distance")), 6).alias("score"), "rank")


@query(f"""WITH {T.VECTORS}, {ALL}, r AS (SELECT q.id AS query_id, s.id, 1 - {COS.format(a='q.vector', b='s.vector')} AS x FROM s JOIN s q ON s.embed_model = q.embed_model WHERE q.id % 20 = 0 AND s.repo <> 'atlas-mono'),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12), id) AS rank FROM r) SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8""")
def knn_filtered(spark, d):
    """The repository filter stands before the search, so no page comes up short."""
    s = well_formed(spark, d)
    found = knn.exact(s.filter("repo <> 'atlas-mono'"), s.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 8)
    return found.select("query_id", "id", "rank")


@query()
def knn_probed(spark, d):
    """V3/V4/V9: cluster partitions visited by each query; recall against the exact search."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return knn.recall(knn.probed(e, q, 10, knn.Tuning.preset("accuracy")), knn.exact(e, q, 10))


TOK = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
#: Queries of the text searches: the scenarios' own.
BM = f"""docs AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), tok AS (SELECT id, unnest({TOK.format(t='text')}) AS term FROM docs), post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
    len AS (SELECT id, sum(tf) AS len FROM post GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS a FROM len), qt AS (SELECT DISTINCT scenario_id AS query_id, unnest({TOK.format(t='query')}) AS term FROM scenarios),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term), bm AS (SELECT qt.query_id, post.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score
      FROM qt JOIN post USING (term) JOIN df USING (term) JOIN len ON len.id = post.id CROSS JOIN st GROUP BY ALL),
    br AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm)"""


def _bm25(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    asked = table(spark, d, "scenarios").select(F.col("scenario_id").alias("query_id"), "query")
    return fulltext.bm25(fulltext.build(docs), asked)


@query(f"WITH {BM} SELECT query_id, id, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank <= 20")
def bm25_topk(spark, d):
    """The 20 best documents of every scenario's query."""
    s = fusion.cut(_bm25(spark, d).withColumn("score", F.round("score", 9)), 20)
    return s.select("query_id", "id", F.round("score", 3).alias("score"), "rank")


@query("""SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])snapshot([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])scanner') AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])planner([^\\p{L}\\p{N}]|$)')""")
def boolean_search(spark, d):
    """Terms, a prefix and a negation."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    return fulltext.matching(docs, "snapshot AND scanner* NOT planner")


@query("""SELECT doc_id AS id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'umber') OR contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' holds the lock ')""")
def phrase_search(spark, d):
    """A phrase or a term."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    return fulltext.matching(docs, 'umber OR "holds the lock"')


@query("""WITH w AS (SELECT DISTINCT doc_id AS id, unnest(range(len(t))) AS i, unnest(t) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL))
    SELECT DISTINCT a.id FROM w a JOIN w b ON a.id = b.id AND a.w = 'tests' AND b.w = 'fixtures' AND abs(a.i - b.i) <= 7""")
def near_search(spark, d):
    """Two words with at most six between them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    return fulltext.matching(docs, "NEAR(tests fixtures, 6)")


@query()
def bm25_stemmed(spark, d):
    """B1 with stems: only the distinct terms pass through Python."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    index = fulltext.stemmed(fulltext.build(docs))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""WITH {BM}, l AS (SELECT query_id, 1 AS list_no, rank, id FROM br WHERE rank <= 40 UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY len.len, id), id FROM (SELECT query_id, id FROM br WHERE rank <= 60) JOIN len USING (id)),
    f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, count(*) AS appearances FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM f)
    SELECT query_id, id, round(score, 9) AS score, appearances, appearances / 2.0 AS confidence, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def rrf_fuse(spark, d):
    """Reciprocal-rank fusion of relevance and brevity."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    ranked = fusion.cut(_bm25(spark, d).withColumn("score", F.round("score", 9)), 60)
    one = ranked.filter("rank <= 40").select("query_id", F.lit(1).alias("list_no"), "rank", "id", "score")
    two = ranked.select("query_id", "id").join(fulltext.build(docs).lengths.withColumn("score", F.col("len").cast("double")), "id")
    lists = one.unionByName(fusion.ranked(two, 2, descending=False))
    f = fusion.with_confidence(fusion.reciprocal_rank(lists, 60, 10), 2)
    return f.select("query_id", "id", F.round("score", 9).alias("score"), "appearances", "confidence", "rank")


@query(f"""WITH {BM}, l AS (SELECT query_id, 1 AS list_no, id, score FROM br WHERE rank <= 30 UNION ALL SELECT query_id, 2, id, CAST(len AS DOUBLE) FROM (SELECT query_id, id FROM br WHERE rank <= 30) JOIN len USING (id)),
    m AS (SELECT query_id, list_no, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * CASE list_no WHEN 1 THEN 0.7 ELSE 0.3 END AS p FROM l WINDOW w AS (PARTITION BY query_id, list_no))
    SELECT query_id, id, round(sum(p), 4) AS score, count(*) AS contributions FROM m GROUP BY ALL""")
def weighted_fuse(spark, d):
    """Weighted fusion of min-max scaled lists."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter("text is not null")
    top = fusion.cut(_bm25(spark, d).withColumn("score", F.round("score", 9)), 30)
    two = top.select("query_id", "id").join(fulltext.build(docs).lengths, "id").select("query_id", F.lit(2).alias("list_no"), F.lit(0).alias("rank"), "id", F.col("len").cast("double").alias("score"))
    lists = top.select("query_id", F.lit(1).alias("list_no"), "rank", "id", "score").unionByName(two)
    return fusion.weighted(lists, [0.7, 0.3]).select("query_id", "id", F.round("score", 4).alias("score"), "contributions")


@query()
def mmr_diversify(spark, d):
    """K6/K7: diverse results among the nearest of every stated query."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    near = knn.exact(e, q, 40).select("query_id", "id", (1 - F.col("distance")).alias("score")).join(e, "id")
    return fusion.diversify(near, q, 10).select("query_id", "id", "rank", F.round("mmr_score", 6).alias("mmr_score"))


@query(f"""WITH {BM}, t AS (SELECT query_id, id FROM br WHERE rank <= 20), x AS (SELECT t.query_id, t.id, list_distinct({TOK.format(t='d.text')}) AS a, list_distinct({TOK.format(t='s.query')}) AS b FROM t JOIN documents d ON d.doc_id = t.id JOIN scenarios s ON s.scenario_id = t.query_id),
    y AS (SELECT query_id, id, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(b) AS rerank_score FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM y WHERE rerank_score >= 0.1)
    SELECT query_id, id, round(rerank_score, 6) AS rerank_score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 5""")
def rerank_hits(spark, d):
    """K8: a second score (here the share of the query's words) with threshold and cut."""
    top = fusion.cut(_bm25(spark, d).withColumn("score", F.round("score", 9)), 20).select("query_id", "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "scenarios").select(F.col("scenario_id").alias("query_id"), "query")

    def scorer(query, text):
        return F.size(F.array_intersect(X.words(query), X.words(text))) / F.size(F.array_distinct(X.words(query)))

    out = fusion.rerank(top.join(docs, "id").join(asked, "query_id"), scorer, 0.1, 5)
    return out.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"""WITH {BM}, t AS (SELECT query_id, id, score FROM br WHERE rank <= 50), r AS (SELECT query_id, id, round(1 / (1 + exp(-score / 10)), 4) AS sigmoid, round(CASE WHEN mx = mn THEN 1.0 ELSE (score - mn) / (mx - mn) END, 4) AS scaled FROM (SELECT *, min(score) OVER (PARTITION BY query_id) mn, max(score) OVER (PARTITION BY query_id) mx FROM t)) SELECT * FROM r""")
def normalise_scores(spark, d):
    """Sigmoid and min-max scores."""
    t = fusion.cut(_bm25(spark, d).withColumn("score", F.round("score", 9)), 50)
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    return t.select("query_id", "id", F.round(S.sigmoid(F.col("score")), 4).alias("sigmoid"), F.round(scaled, 4).alias("scaled"))


@query("""SELECT event_id, round(CASE WHEN value <= 0 THEN 0.0 WHEN value <= 5 THEN value / 5 * 0.25 WHEN value <= 20 THEN 0.25 + (value - 5) / 15 * 0.5 WHEN value <= 80 THEN 0.75 + (value - 20) / 60 * 0.25 ELSE 1.0 END, 6) AS share FROM events""")
def quantile_norm(spark, d):
    """Piecewise linear normalisation over anchors."""
    anchors = [(0.0, 0.0), (5.0, 0.25), (5.0, 0.5), (20.0, 0.75), (80.0, 1.0)]
    return table(spark, d, "events").select("event_id", F.round(S.quantile(F.col("value"), anchors), 6).alias("share"))


@query(f"WITH {T.VECTORS} SELECT vec_id, round(CAST(vec_id % 7 AS DOUBLE) / 7, 6) AS score FROM v WHERE vec_id % 7 / 7.0 < 0.4 - 1e-9 OR (abs(vec_id % 7 / 7.0 - 0.4) < 1e-9 AND id > 'm')")
def cursor_page(spark, d):
    """What follows the last hit of a page."""
    score = (F.pmod("vec_id", F.lit(7)) / 7).alias("score")
    v = T.vectors(spark, d, "id").select("vec_id", "id", score)
    return v.filter(filters.after_cursor(F.col("score"), F.col("id"), 0.4, "m")).select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT scenario_id, substr(sha256(query), 1, 8) AS q, CAST(scenario_id / 4.0 AS DOUBLE) AS s, id AS i FROM scenarios""")
def cursor_roundtrip(spark, d):
    """T5: cursors encoded and decoded; a cursor of another query yields nothing."""
    s = table(spark, d, "scenarios").select("scenario_id", "id", "query")
    token = X.encode_cursor(F.col("query"), F.col("scenario_id") / 4.0, F.col("id"))
    got = s.withColumn("token", token).select("scenario_id", X.decode_cursor(F.col("token"), F.col("query")).alias("c"))
    return got.select("scenario_id", "c.q", "c.s", "c.i")


@query(f"""WITH {BM}, x AS (SELECT scenario_id, unnest(expected, recursive := true) FROM scenarios), hits AS (SELECT query_id AS scenario_id, rank, d.path AS file FROM br JOIN documents d ON d.doc_id = br.id WHERE rank <= 10)
    SELECT count(*) AS n, CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM x WHERE x.scenario_id = hits.scenario_id AND x.file = hits.file)) AS BIGINT) AS relevant FROM hits""")
def retrieval_hits(spark, d):
    """Results judged against the expected files."""
    top = fusion.cut(_bm25(spark, d).withColumn("score", F.round("score", 9)), 10)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("path").alias("file"))
    results = top.join(docs, "id").select(F.col("query_id").alias("scenario_id"), "rank", "file", F.lit(None).cast("string").alias("symbol"))
    x = table(spark, d, "scenarios").select("scenario_id", F.explode("expected").alias("e")).select("scenario_id", "e.file", F.lit(None).cast("string").alias("symbol"))
    return evaluate.judged(results, x).agg(F.count("*").alias("n"), F.sum("relevant").cast("long").alias("relevant"))


@query("""WITH x AS (SELECT scenario_id, unnest(list_distinct(list_transform(expected, lambda e: e.file))) AS file FROM scenarios), n AS (SELECT scenario_id, count(*) AS k FROM x GROUP BY 1), r AS (SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY md5(file)) AS rank, (ascii(file) % 2 = 0) AS rel FROM x),
    p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY scenario_id ORDER BY rank) / rank AS pr FROM r)
    SELECT scenario_id, max(k) AS n_expected, round(coalesce(max(CASE WHEN rel THEN 1.0 / rank END), 0), 6) AS mrr, round(coalesce(sum(CASE WHEN rel THEN pr END), 0) / max(k), 6) AS map FROM p JOIN n USING (scenario_id) GROUP BY scenario_id""")
def ir_metrics(spark, d):
    """Reciprocal rank and average precision of a ranking in which some files are right."""
    x = table(spark, d, "scenarios").select("scenario_id", F.explode(F.array_distinct(F.transform("expected", lambda e: e["file"]))).alias("file"))
    rank = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.md5("file")))
    right = F.when(F.ascii("file") % 2 == 0, F.col("file")).otherwise(F.concat(F.lit("not/"), "file"))
    results = x.select("scenario_id", rank.alias("rank"), right.alias("file"), F.lit(None).cast("string").alias("symbol"))
    m = evaluate.metrics(results, x.withColumn("symbol", F.lit(None).cast("string")))
    return m.select("scenario_id", "n_expected", F.round("mrr", 6).alias("mrr"), F.round("map", 6).alias("map"))


PART = "array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({p}, '\\.[^/\\\\]+$', '')), '[/\\\\]'), lambda w: w <> ''), ' ')"
HYBRID = f"""{T.VECTORS}, {T.CHUNKS}, {ALL}, q AS (SELECT id AS query_id, {PART.format(p='path')} AS query, embed_model, vector FROM s WHERE id % 20 = 0),
    docs AS (SELECT text_hash, min(chunk_id) AS id, min(text) AS text FROM c GROUP BY text_hash), vd AS (SELECT embed_model, text_hash, min(id) AS vid FROM s GROUP BY embed_model, text_hash),
    tok AS (SELECT id, unnest({TOK.format(t='text')}) AS term FROM docs), post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT id, sum(tf) AS len FROM post GROUP BY id),
    st AS (SELECT count(*) AS n, avg(len) AS a FROM len), qt AS (SELECT DISTINCT query_id, unnest({TOK.format(t='query')}) AS term FROM q), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    bm AS (SELECT qt.query_id, post.id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 9) AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN len ON len.id = post.id CROSS JOIN st GROUP BY ALL),
    b AS (SELECT query_id, 1 AS list_no, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm),
    vx AS (SELECT q.query_id, s.id AS vid, row_number() OVER (PARTITION BY q.query_id ORDER BY round(1 - {COS.format(a='q.vector', b='s.vector')}, 12), s.id) AS rank FROM q JOIN s ON q.embed_model = s.embed_model),
    vr AS (SELECT query_id, 2 AS list_no, docs.id, vx.rank FROM vx JOIN vd ON vd.vid = vx.vid JOIN docs ON docs.text_hash = vd.text_hash WHERE vx.rank <= 40),
    fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, list_no, id, rank FROM b WHERE rank <= 40 UNION ALL SELECT query_id, list_no, id, rank FROM vr) GROUP BY ALL),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fu)"""


@query(f"WITH {HYBRID} SELECT query_id, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10 AND score >= 0.005")
def hybrid_search(spark, d):
    """BM25 and vector search over one set of contents, fused by rank.

    The stated queries are the vectors whose id 20 divides; their texts are the words of
    their paths. Forty candidates of each list are fused, ten are kept above the cutoff.
    """
    s = well_formed(spark, d)
    docs = table(spark, d, "chunks").groupBy("text_hash").agg(F.min("chunk_id").alias("id"), F.min("text").alias("text"))
    asked = s.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", X.path_parts(F.col("path"))).alias("query"), "vector")
    one = fulltext.best(docs, asked, 40).select("query_id", F.lit(1).alias("list_no"), "rank", "id", "score")
    near = knn.exact(s.select("id", "vector"), asked, 40)
    to_content = s.groupBy("embed_model", "text_hash").agg(F.min("id").alias("vid")).join(docs.select("text_hash", "id"), "text_hash")
    two = near.withColumnRenamed("id", "vid").join(to_content, "vid").select("query_id", F.lit(2).alias("list_no"), "rank", "id", F.col("distance").alias("score"))
    fused = fusion.reciprocal_rank(one.unionByName(two), 60, 10).filter("score >= 0.005")
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), "rank")
