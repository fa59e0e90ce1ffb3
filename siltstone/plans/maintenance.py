"""Merging, pruning, consistency and change tracking over the catalog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes, indexer, merge
from ..session import cut_lineage, table
from . import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CONTENT = f"{T.CHUNKS}, cc AS (SELECT repo, file_id, text_hash, substr(sha256(repo || ':' || file_id || ':' || text_hash), 1, 32) AS content_id FROM c GROUP BY ALL)"


def contents(spark, d):
    c = T.chunks(spark, d, "repo", "file_id", "text_hash").select("repo", "file_id", "text_hash").distinct()
    return c.withColumn("content_id", X.content_id(F.col("repo"), F.col("file_id"), F.col("text_hash")))


@query(f"WITH {CONTENT} SELECT content_id, repo, file_id, text_hash FROM cc")
def content_rows(spark, d):
    """One content row per (repo, file, hash) with a derived id."""
    return contents(spark, d).select("content_id", "repo", "file_id", "text_hash")


@query(f"""WITH {T.VECTORS}, n AS (SELECT vec_id, id, repo, path FROM v WHERE embed_model = 'small'), o AS (SELECT vec_id + 1 AS vec_id, id, repo, 'old' AS path FROM v WHERE embed_model = 'small')
    SELECT o.* FROM o WHERE o.id NOT IN (SELECT id FROM n WHERE repo < 'm') UNION ALL SELECT * FROM n WHERE repo < 'm'""")
def upsert_vectors(spark, d):
    """Rows of the new batch replace those of the same id."""
    v = T.vectors(spark, d, "id", "repo", "path", "embed_model").filter("embed_model = 'small'").drop("embed_model")
    old = v.select((F.col("vec_id") + 1).alias("vec_id"), "id", "repo", F.lit("old").alias("path"))
    return merge.upsert(old, v.filter("repo < 'm'"), ["id"])


@query(f"""WITH {T.VECTORS}, s AS (SELECT DISTINCT repo, path FROM v WHERE language = 'python'), k AS (SELECT DISTINCT id FROM v WHERE start_line = 1)
    SELECT vec_id FROM v WHERE (repo, path) NOT IN (SELECT repo, path FROM s) OR id IN (SELECT id FROM k)""")
def prune_file_rows(spark, d):
    """Within touched files only the kept rows stay."""
    v = T.vectors(spark, d, "id", "repo", "path", "language", "start_line")
    return merge.prune(v, v.filter("language = 'python'"), ["repo", "path"], v.filter("start_line = 1"), ["id"]).select("vec_id")


@query(f"WITH {T.VECTORS} SELECT embed_model, count(*) AS n FROM v WHERE repo <> 'atlas-mono' GROUP BY embed_model")
def drop_repo(spark, d):
    """What is left after a repository is dropped."""
    return T.vectors(spark, d, "repo", "embed_model").filter("repo <> 'atlas-mono'").groupBy("embed_model").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT file_id, repo, path, max(language) AS language FROM files GROUP BY ALL), n AS (SELECT file_id, min(repo) repo, min(path) path, CASE WHEN file_id > 100 THEN 'seen' END AS language FROM files GROUP BY file_id)
    SELECT o.file_id, o.repo, o.path, coalesce(n.language, o.language) AS language FROM o FULL JOIN n ON o.file_id = n.file_id""")
def merge_files(spark, d):
    """A merge in which null new values keep the old ones."""
    f = table(spark, d, "files")
    old = f.groupBy("file_id", "repo", "path").agg(F.max("language").alias("language"))
    new = f.groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("path").alias("path")).withColumn("language", F.when(F.col("file_id") > 100, "seen"))
    return merge.merge(old, new, ["file_id"])


@query(f"""WITH {T.CHUNKS}, e AS (SELECT DISTINCT text_hash, start_line, end_line, coalesce(symbol_name, '') AS s FROM c WHERE repo < 'p'), w AS (SELECT text_hash, start_line, end_line, max(coalesce(symbol_kind, '')) AS s FROM c WHERE repo > 'h' GROUP BY ALL), o AS (SELECT text_hash, start_line, end_line, max(s) AS s FROM e GROUP BY ALL)
    SELECT CASE WHEN o.s IS NULL THEN 'added' WHEN w.s IS NULL THEN 'deleted' WHEN o.s = w.s THEN 'unchanged' ELSE 'modified' END AS action, count(*) AS n FROM o FULL JOIN w USING (text_hash, start_line, end_line) GROUP BY ALL""")
def sync_locations(spark, d):
    """Inserted, updated, deleted and untouched locations."""
    c = T.chunks(spark, d, "repo", "text_hash", "start_line", "end_line", "symbol_name", "symbol_kind")
    key = ["text_hash", "start_line", "end_line"]
    old = c.filter("repo < 'p'").groupBy(*key).agg(F.max(F.coalesce("symbol_name", F.lit(""))).alias("s"))
    new = c.filter("repo > 'h'").groupBy(*key).agg(F.max(F.coalesce("symbol_kind", F.lit(""))).alias("s"))
    return merge.difference(old, new, key, ["s"]).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {CONTENT} SELECT content_id FROM cc WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.text_hash = cc.text_hash)")
def plan_upserts(spark, d):
    """Contents that are not embedded yet."""
    return contents(spark, d).join(table(spark, d, "vectors").select("text_hash").distinct(), "text_hash", "left_anti").select("content_id")


@query(f"WITH {T.VECTORS} SELECT vec_id FROM v WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.text_hash = v.text_hash)")
def prune_invalid(spark, d):
    """Vectors whose content is no longer current."""
    return merge.orphans(T.vectors(spark, d, "text_hash"), table(spark, d, "chunks"), ["text_hash"]).select("vec_id")


@query(f"""WITH {T.CHUNKS}, {T.VECTORS}, {T.PENDING}
    SELECT 'chunks without file' AS problem, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.file_id = c.file_id)
    UNION ALL SELECT 'vectors without chunk', count(*) FROM v WHERE NOT EXISTS (SELECT 1 FROM chunks k WHERE k.repo = v.repo AND k.path = v.path)
    UNION ALL SELECT 'changes without file', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = p.repo AND f.path = p.path)
    UNION ALL SELECT 'files without repo', count(*) FROM (SELECT DISTINCT file_id, repo FROM files) f WHERE NOT EXISTS (SELECT 1 FROM repos r WHERE r.name = f.repo)""")
def consistency(spark, d):
    """Orphans of every kind."""
    files, chunks = table(spark, d, "files").select("file_id", "repo", "path"), table(spark, d, "chunks").select("repo", "path")
    repos = table(spark, d, "repos").select(F.col("name").alias("repo"))
    checks = [
        ("chunks without file", merge.orphans(T.chunks(spark, d, "file_id"), files, ["file_id"])),
        ("vectors without chunk", merge.orphans(T.vectors(spark, d, "repo", "path"), chunks, ["repo", "path"])),
        ("changes without file", merge.orphans(T.pending(spark, d), files, ["repo", "path"])),
        ("files without repo", merge.orphans(files.select("file_id", "repo").distinct(), repos, ["repo"])),
    ]
    out = None
    for name, df in checks:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {T.VECTORS} SELECT vec_id FROM v WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo = v.repo AND f.path = v.path) AND EXISTS (SELECT 1 FROM chunks c WHERE c.text_hash = v.text_hash)")
def repair(spark, d):
    """Rows left after orphans are removed bottom-up."""
    v = T.vectors(spark, d, "repo", "path", "text_hash")
    live = v.join(table(spark, d, "files").select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return live.join(table(spark, d, "chunks").select("text_hash").distinct(), "text_hash", "left_semi").select("vec_id")


@query(f"""WITH {T.CHUNKS}, n AS (SELECT text_hash FROM c WHERE repo >= 'g'), e AS (SELECT DISTINCT text_hash FROM vectors), t AS (SELECT count(*) total, count(*) FILTER (WHERE text_hash NOT IN (SELECT text_hash FROM e)) to_embed, count(DISTINCT text_hash) FILTER (WHERE text_hash IN (SELECT text_hash FROM e)) unchanged FROM n)
    SELECT total, to_embed, unchanged, (SELECT count(*) FROM e WHERE text_hash NOT IN (SELECT text_hash FROM n)) AS deleted, CAST(trunc(unchanged * 100.0 / total) AS INTEGER) AS reuse_pct FROM t""")
def chunk_diff(spark, d):
    """What a re-indexing embeds, keeps and deletes."""
    new = T.chunks(spark, d, "repo", "text_hash").filter("repo >= 'g'")
    return merge.chunk_diff_stats(new, table(spark, d, "vectors"))


@query(f"""WITH RECURSIVE {T.PENDING}, s AS (SELECT repo, path, CASE WHEN change_type = 'created' THEN 'added' ELSE change_type END kind, detected_at, row_number() OVER (PARTITION BY repo, path ORDER BY detected_at, id) n FROM (SELECT DISTINCT id, repo, path, change_type, detected_at FROM p) WHERE change_type IS NOT NULL AND path IS NOT NULL),
    w AS (SELECT repo, path, n, kind, detected_at FROM s WHERE n = 1 UNION ALL SELECT s.repo, s.path, s.n, CASE WHEN s.kind = 'deleted' THEN 'deleted' WHEN w.kind = 'deleted' THEN 'modified' ELSE w.kind END, s.detected_at FROM w JOIN s ON s.repo = w.repo AND s.path = w.path AND s.n = w.n + 1)
    SELECT repo, path, max_by(kind, n) AS change_type, max(n) AS n_events, max_by(detected_at, n) AS last_detected_at FROM w GROUP BY repo, path""")
def pending_coalesce(spark, d):
    """One pending change by path."""
    return changes.coalesce(T.pending(spark, d))


@query("""WITH m AS (SELECT repo, path, max(size_bytes) AS size, max(updated_at) AS mtime, max(latest_commit_sha) AS h FROM files WHERE repo <> 'atlas-mono' GROUP BY ALL), s AS (SELECT repo, path, min(size_bytes) + 1 AS size, min(updated_at) AS mtime, CASE WHEN min(file_id) > 300 THEN 'x' ELSE max(latest_commit_sha) END AS h FROM files GROUP BY ALL)
    SELECT repo, path, drift FROM (SELECT s.repo, s.path, CASE WHEN m.h IS NULL THEN 'deleted' WHEN (s.size <> m.size OR s.mtime IS DISTINCT FROM m.mtime) AND s.h <> m.h THEN 'modified' END AS drift FROM s LEFT JOIN m ON s.repo = m.repo AND s.path = m.path) WHERE drift IS NOT NULL""")
def drift(spark, d):
    """Snapshots that no longer hold."""
    f = table(spark, d, "files")
    m = f.filter("repo <> 'atlas-mono'").groupBy("repo", "path").agg(F.max("size_bytes").alias("size"), F.max("updated_at").alias("mtime"), F.max("latest_commit_sha").alias("content_hash"))
    s = f.groupBy("repo", "path").agg((F.min("size_bytes") + 1).alias("size"), F.min("updated_at").alias("mtime"), F.when(F.min("file_id") > 300, F.lit("x")).otherwise(F.max("latest_commit_sha")).alias("content_hash"))
    return changes.drift(m, s)


@query(f"WITH {T.PENDING} SELECT id, repo, path, (processed OR change_type = 'deleted') AS processed FROM p WHERE NOT (processed AND detected_at < TIMESTAMP '2024-03-01')")
def mark_changes(spark, d):
    """Changes flagged as processed, old processed ones removed."""
    p = T.pending(spark, d).filter("not (processed and detected_at < timestamp_ntz'2024-03-01')")
    return p.select("id", "repo", "path", (F.col("processed") | (F.col("change_type") == "deleted")).alias("processed"))


@query("""SELECT user_id, max_by(event_type, (ts, event_id)) AS status, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failures, max(ts) AS ended_at FROM events GROUP BY user_id""")
def session_state(spark, d):
    """The latest state of each session from its log."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("ended_at"))


@query("SELECT file_id, repo, path, coalesce(min(language), 'text') AS language, coalesce(max(size_bytes), 0) AS size_bytes, 'main' AS branch FROM files GROUP BY file_id, repo, path")
def backfill(spark, d):
    """Missing columns and nulls filled with defaults."""
    f = table(spark, d, "files").groupBy("file_id", "repo", "path").agg(F.min("language").alias("language"), F.max("size_bytes").alias("size_bytes"))
    return merge.ensure_schema(f, {"file_id": ("long", None), "repo": ("string", None), "path": ("string", None), "language": ("string", "text"), "size_bytes": ("long", 0), "branch": ("string", "main")})


@query(f"""WITH {T.CHUNKS}, {T.VECTORS} SELECT c.chunk_id, v.vec_id, c.symbol_name FROM c LEFT JOIN v ON v.repo = c.repo AND v.path = c.path AND v.text_hash = c.text_hash AND v.start_line = c.start_line AND v.end_line = c.end_line AND v.embed_model = 'small'""")
def hydrate(spark, d):
    """Contents with files, models and locations, left where no vector is."""
    c = T.chunks(spark, d, "repo", "path", "text_hash", "start_line", "end_line", "symbol_name")
    v = T.vectors(spark, d, "repo", "path", "text_hash", "start_line", "end_line", "embed_model").filter("embed_model = 'small'").drop("embed_model")
    return c.join(v, ["repo", "path", "text_hash", "start_line", "end_line"], "left").select("chunk_id", "vec_id", "symbol_name")


@query(f"""WITH {T.VECTORS}, r AS (SELECT text_hash, embed_model, count(*) n FROM v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY CASE embed_model WHEN 'large' THEN 0 ELSE 1 END, embed_model) x FROM r) SELECT text_hash, embed_model, n FROM k WHERE x = 1""")
def hydrate_pref_model(spark, d):
    """The preferred model of a content, else the first by name."""
    r = T.vectors(spark, d, "text_hash", "embed_model").groupBy("text_hash", "embed_model").agg(F.count("*").alias("n"))
    return merge.latest(r, ["text_hash"], F.when(F.col("embed_model") == "large", 0).otherwise(1), F.col("embed_model"))


OLD = """f AS (SELECT DISTINCT file_id, repo, path, text FROM files WHERE file_id IS NOT NULL AND text IS NOT NULL), ch AS (SELECT DISTINCT repo, path, change_type FROM pending_changes),
    o AS (SELECT file_id, CASE WHEN bool_or(change_type = 'modified') THEN 'modified' ELSE 'unchanged' END AS action, coalesce(bool_or(change_type = 'created'), false) AS made FROM f LEFT JOIN ch USING (repo, path) GROUP BY file_id, text)"""


def _before(spark, d):
    """The files as they were before the pending changes: created ones absent, modified ones older."""
    f = table(spark, d, "files").select("file_id", "repo", "path", "text").filter("file_id is not null and text is not null").distinct()
    ch = table(spark, d, "pending_changes").groupBy("repo", "path").agg(F.bool_or(F.col("change_type") == "created").alias("made"), F.bool_or(F.col("change_type") == "modified").alias("modified"))
    joined = f.join(ch, ["repo", "path"], "left")
    old = joined.filter(~F.coalesce("made", F.lit(False))).withColumn("text", F.when(F.col("modified"), F.concat("text", F.lit("\n# before"))).otherwise(F.col("text")))
    return f, old.select("file_id", "repo", "path", "text")


@query(f"WITH {OLD} SELECT file_id, CASE WHEN made THEN 'added' ELSE action END AS action FROM o")
def index_plan(spark, d):
    """What an incremental run has to do for each file."""
    now, before = _before(spark, d)
    held = before.select("file_id", X.text_hash(F.col("text")).alias("file_hash"))
    return indexer.plan(now, held)


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra")
def index_incremental(spark, d):
    """An index brought up to date by the changes differs in no row from one built anew."""
    now, before = _before(spark, d)
    key = ["file_id", "file_hash", "ordinal", "start_line", "end_line", "text_hash", F.col("vector").cast("string").alias("vector")]
    updated = indexer.update(now, cut_lineage(indexer.build(before))).select(*key).withColumn("u", F.lit(1))
    anew = indexer.build(now).select(*key).withColumn("a", F.lit(1))
    sides = updated.unionByName(anew, allowMissingColumns=True).groupBy(*[k if isinstance(k, str) else "vector" for k in key]).agg(F.count("u").alias("u"), F.count("a").alias("a"))
    return sides.agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.col("u"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("u") - F.col("a"), F.lit(0))), F.lit(0)).alias("extra"))


@query("""WITH c AS (SELECT text_hash, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY text_hash), w AS (SELECT text_hash, list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: md5(x)[1]) AS d FROM c),
    n AS (SELECT text_hash, list_transform(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], lambda h: CAST(len(list_filter(d, lambda x: x = h)) AS DOUBLE)) AS n FROM w), s AS (SELECT *, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS norm FROM n)
    SELECT text_hash, round(CASE WHEN norm > 0 THEN n[1] / norm ELSE 0 END, 5) AS first, round(CASE WHEN norm > 0 THEN list_max(n) / norm ELSE 0 END, 5) AS largest FROM s""")
def embed_contents(spark, d):
    """H4: built-in vectors of all distinct contents."""
    c = table(spark, d, "chunks").filter("text is not null").groupBy("text_hash").agg(F.min("text").alias("text"))
    v = c.select("text_hash", indexer.hashed(F.col("text")).alias("vector"))
    return v.select("text_hash", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.array_max("vector"), 5).alias("largest"))
