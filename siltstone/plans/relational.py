"""Scans, lookups, filters, set operations, aggregates and windows over the catalog tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scores import nearest_rank
from ..operators import filters, merge, ordering
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


@query(f"""WITH {T.FILES} SELECT repo, path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM f
    WHERE text IS NOT NULL AND NOT regexp_matches(path, '(?:^|/)(?:node_modules|\\.git|__pycache__|dist|build|\\.venv|[^/]*\\.min\\.js|[^/]*\\.lock|[^/]*\\.map|\\.env|\\.env\\.[^/]*|[^/]*\\.pem|id_rsa|[^/]*\\.key|\\.netrc|\\.npmrc)(?:/|$)')""")
def scan_files(spark, d):
    """Text files that no ignore rule leaves out."""
    f = T.files(spark, d).filter("text is not null")
    return f.filter(~filters.ignored(F.col("path"))).select("repo", "path", F.octet_length("text").cast("long").alias("size"))


@query("""WITH o AS (SELECT DISTINCT repo, path, latest_commit_sha h FROM files WHERE updated_at < TIMESTAMP '2024-03-01'), n AS (SELECT DISTINCT repo, path, latest_commit_sha h FROM files WHERE ingested_at >= TIMESTAMP '2024-02-01')
    SELECT coalesce(o.repo, n.repo) repo, coalesce(o.path, n.path) path,
      CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'modified' END AS action
    FROM o FULL JOIN n ON o.repo = n.repo AND o.path = n.path""")
def manifest_diff(spark, d):
    """Added, deleted, modified and unchanged paths of two manifests."""
    f = table(spark, d, "files")
    old = f.filter("updated_at < timestamp_ntz'2024-03-01'").select("repo", "path", F.col("latest_commit_sha").alias("h")).distinct()
    new = f.filter("ingested_at >= timestamp_ntz'2024-02-01'").select("repo", "path", F.col("latest_commit_sha").alias("h")).distinct()
    return merge.difference(old, new, ["repo", "path"], ["h"])


@query("SELECT DISTINCT repo, path FROM files WHERE NOT (path LIKE 'apps/%' OR path LIKE 'libs/%')")
def submodule_filter(spark, d):
    """Paths outside given directories."""
    from ..sources.repositories import without_prefixes

    return without_prefixes(table(spark, d, "files").select("repo", "path").distinct(), ["apps", "libs/"])


@query(f"WITH {T.VECTORS} SELECT repo, embed_model, text_hash, max(vec_id) AS vec_id FROM v WHERE text_hash IN (SELECT text_hash FROM chunks WHERE symbol_kind = 'class') GROUP BY ALL")
def vectors_by_hash(spark, d):
    """Vectors of wanted hashes, the last row of each hash."""
    wanted = T.chunks(spark, d, "text_hash", "symbol_kind").filter("symbol_kind = 'class'").select("text_hash").distinct()
    v = T.vectors(spark, d, "repo", "embed_model", "text_hash")
    return v.join(wanted, "text_hash", "left_semi").groupBy("repo", "embed_model", "text_hash").agg(F.max("vec_id").alias("vec_id"))


@query(f"WITH {T.VECTORS} SELECT repo, embed_model, count(*) AS n FROM v GROUP BY ALL")
def repo_vector_counts(spark, d):
    """S13."""
    return T.vectors(spark, d, "repo", "embed_model").groupBy("repo", "embed_model").agg(F.count("*").alias("n"))


@query(f"WITH {T.CHUNKS} SELECT file_id, count(*) AS n_chunks, min(start_line) AS first_line, max(end_line) AS last_line FROM c GROUP BY file_id")
def file_listing(spark, d):
    """Chunks of each file."""
    c = T.chunks(spark, d, "file_id", "start_line", "end_line")
    return c.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query(f"WITH {T.FILES} SELECT file_id, array_to_string(string_split(text, chr(10))[3:7], chr(10)) AS slice, CAST(len(string_split(text, chr(10))) AS INTEGER) AS total_lines FROM f WHERE text IS NOT NULL")
def file_slice(spark, d):
    """Lines 3 to 7 of every file."""
    f = T.files(spark, d).filter("text is not null")
    return f.select("file_id", X.slice_lines(F.col("text"), F.lit(3), F.lit(7)).alias("slice"), F.size(F.split("text", "\n")).alias("total_lines"))


@query(f"WITH {T.FILES} SELECT file_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM f WHERE text IS NOT NULL AND length(text) - length(replace(text, chr(10), '')) + 1 <= 50000")
def file_lines(spark, d):
    """Line counts of files of at most 50,000 lines."""
    f = T.files(spark, d).filter("text is not null").select("file_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    return f.filter("n_lines <= 50000")


@query("SELECT id, name, root_path, coalesce(default_embed_model, 'large') AS model FROM repos")
def repo_list(spark, d):
    """Repositories with their model, large by default."""
    return table(spark, d, "repos").select("id", "name", "root_path", F.coalesce("default_embed_model", F.lit("large")).alias("model"))


@query("SELECT f.repo, max_by(f.latest_commit_sha, f.updated_at) FILTER (WHERE f.latest_commit_sha IS NOT NULL) AS sha FROM (SELECT repo, updated_at, max(latest_commit_sha) AS latest_commit_sha FROM files GROUP BY repo, updated_at) f GROUP BY f.repo")
def last_commit(spark, d):
    """The newest known commit of each repository."""
    f = table(spark, d, "files").groupBy("repo", "updated_at").agg(F.max("latest_commit_sha").alias("sha"))
    known = f.filter("sha is not null").groupBy("repo").agg(F.max_by("sha", "updated_at").alias("sha"))
    return f.select("repo").distinct().join(known, "repo", "left")


@query(f"WITH {T.CHUNKS} SELECT text_hash, string_agg(DISTINCT start_line || '-' || end_line, ',' ORDER BY start_line || '-' || end_line) AS spans FROM c GROUP BY text_hash")
def content_locations(spark, d):
    """The line ranges of each content."""
    c = T.chunks(spark, d, "text_hash", "start_line", "end_line")
    return c.groupBy("text_hash").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.concat_ws("-", "start_line", "end_line")))).alias("spans"))


@query(f"""WITH {T.VECTORS}, {T.CHUNKS}, r AS (SELECT c.chunk_id, v.vec_id, v.embed_model, row_number() OVER (PARTITION BY c.chunk_id ORDER BY CASE v.embed_model WHEN 'small' THEN 0 ELSE 1 END, v.vec_id) n
      FROM c JOIN v ON c.repo = v.repo AND c.path = v.path AND c.text_hash = v.text_hash AND c.start_line = v.start_line AND c.end_line = v.end_line)
    SELECT chunk_id, vec_id, embed_model FROM r WHERE n = 1""")
def chunk_lookup(spark, d):
    """The vector of each chunk, the small model first."""
    c = T.chunks(spark, d, "repo", "path", "text_hash", "start_line", "end_line")
    v = T.vectors(spark, d, "embed_model", "repo", "path", "text_hash", "start_line", "end_line")
    joined = c.join(v, ["repo", "path", "text_hash", "start_line", "end_line"])
    first = merge.latest(joined, ["chunk_id"], F.when(F.col("embed_model") == "small", 0).otherwise(1), F.col("vec_id"))
    return first.select("chunk_id", "vec_id", "embed_model")


@query(f"""WITH {T.VECTORS} SELECT vec_id, repo, path FROM v WHERE (path = 'apps' OR path LIKE 'apps/%' OR path = 'libs' OR path LIKE 'libs/%')
    AND NOT (path = 'apps/quillon-0' OR path LIKE 'apps/quillon-0/%') AND NOT regexp_matches(path, '\\.md$|(?:^|/)test[^/]*$')""")
def filter_hits(spark, d):
    """Include and exclude prefixes and patterns, in one pass."""
    v = T.vectors(spark, d, "repo", "path")
    return filters.hits(v, include=["apps/", "./libs"], exclude=["apps/quillon-0"], exclude_globs=["*.md", "test*"]).select("vec_id", "repo", "path")


@query(f"""WITH {T.VECTORS} SELECT vec_id FROM v WHERE language IN ('python', 'typescript') AND symbol_kind = 'function' AND token_count >= 20 AND token_count <= 300 AND NOT path LIKE 'packages/%' AND regexp_matches(path, '^.*\\.py$|^.*\\.ts$')""")
def filter_criteria(spark, d):
    """Combined criteria on vector rows."""
    one = filters.Criteria(languages=["python"], kinds=["function"], min_tokens=20, include_globs=["*.py"])
    two = filters.Criteria(languages=["typescript"], max_tokens=300, exclude_paths=["packages/"], include_globs=["*.ts"])
    return filters.combine(one, two).apply(T.vectors(spark, d, "repo", "path", "language", "symbol_kind", "token_count")).select("vec_id")


@query(f"WITH {T.CHUNKS} SELECT repo, count(DISTINCT file_id) AS files, count(*) AS chunks, count(*) * 200 AS total_tokens FROM c GROUP BY repo")
def repo_counts(spark, d):
    """A2/A4: files, chunks and estimated tokens by repository."""
    c = T.chunks(spark, d, "repo", "file_id")
    return c.groupBy("repo").agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("chunks"), (F.count("*") * 200).alias("total_tokens"))


@query("SELECT (SELECT count(*) FROM repos) AS repos, (SELECT count(DISTINCT file_id) FROM files) AS files, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks")
def summarize(spark, d):
    """A1: totals."""
    r = table(spark, d, "repos").agg(F.count("*").alias("repos"))
    f = table(spark, d, "files").agg(F.count_distinct("file_id").alias("files"))
    c = table(spark, d, "chunks").agg(F.count_distinct("chunk_id").alias("chunks"))
    return r.select("repos", f.scalar().alias("files"), c.scalar().alias("chunks"))


@query(f"""WITH {T.CHUNKS}, {T.VECTORS}, {T.PENDING} SELECT repo, kind, count(*) AS n FROM (SELECT repo, 'chunks' kind FROM c UNION ALL SELECT repo, 'vectors' FROM v UNION ALL SELECT repo, 'pending' FROM p) GROUP BY ALL""")
def dependency_counts(spark, d):
    """Counts of every table by repository, as one union."""
    parts = [("chunks", T.chunks(spark, d, "repo")), ("vectors", T.vectors(spark, d, "repo")), ("pending", T.pending(spark, d).select("id", "repo"))]
    rows = None
    for name, df in parts:
        part = df.groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.lit(name).alias("kind"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(f"WITH {T.CHUNKS} SELECT repo, count(DISTINCT text_hash) AS contents, count(*) AS occurrences FROM c GROUP BY repo")
def distinct_hashes(spark, d):
    """A5."""
    return T.chunks(spark, d, "repo", "text_hash").groupBy("repo").agg(F.count_distinct("text_hash").alias("contents"), F.count("*").alias("occurrences"))


@query(f"WITH {T.CHUNKS} SELECT file_id, text_hash, min(ordinal) AS first_ordinal, count(*) AS n, min_by(chunk_id, (ordinal, chunk_id)) AS representative FROM c GROUP BY ALL")
def desired_map(spark, d):
    """Occurrences of each content of a file and its first chunk."""
    c = T.chunks(spark, d, "file_id", "text_hash", "ordinal")
    return c.groupBy("file_id", "text_hash").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n"), F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("representative"))


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY event_type""")
def score_statistics(spark, d):
    """A10: exact percentiles and population deviation."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    return e.select("event_type", F.round(F.col("p")[0], 6).alias("p05"), F.round(F.col("p")[1], 6).alias("median"), F.round(F.col("p")[2], 6).alias("p95"), F.round("s", 6).alias("std"), "n")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = CAST(floor(0.95 * n) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_percentiles(spark, d):
    """Nearest-rank percentiles (not interpolated)."""
    places = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95)}
    return nearest_rank(table(spark, d, "events"), "event_type", "value", places)


@query("""SELECT event_type, date_trunc('minute', ts) AS minute, count(*) / 60.0 AS rate, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def rate_by_minute(spark, d):
    """Rates in one-minute windows."""
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("minute", "ts").alias("minute"))
    return e.agg((F.count("*") / 60.0).alias("rate"), F.round(F.sum("value"), 6).alias("total")).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""WITH b AS (SELECT event_type, CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 ELSE 1000000 END AS le, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, le, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY le) AS BIGINT) AS cumulative FROM b""")
def histogram_buckets(spark, d):
    """Cumulative histogram buckets."""
    v = F.col("value")
    le = F.when(v <= 10, 10).when(v <= 50, 50).when(v <= 100, 100).otherwise(1000000).alias("le")
    b = table(spark, d, "events").groupBy("event_type", le).agg(F.count("*").alias("n"))
    return b.select("event_type", "le", F.sum("n").over(Window.partitionBy("event_type").orderBy("le")).alias("cumulative"))


@query(f"WITH {T.CHUNKS} SELECT file_id, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM c GROUP BY file_id")
def token_estimates(spark, d):
    """A19."""
    return T.chunks(spark, d, "file_id", "text").groupBy("file_id").agg(F.sum(X.estimated_tokens(F.col("text")).cast("long")).alias("tokens"))


@query(f"WITH {T.CHUNKS}, r AS (SELECT file_id, chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY end_line - start_line DESC, chunk_id) n FROM c) SELECT file_id, chunk_id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 5")
def top_per_key(spark, d):
    """The five longest chunks of each file."""
    w = Window.partitionBy("file_id").orderBy((F.col("end_line") - F.col("start_line")).desc(), "chunk_id")
    return T.chunks(spark, d, "file_id", "start_line", "end_line").select("file_id", "chunk_id", F.row_number().over(w).alias("n")).filter("n <= 5")


@query(f"WITH {T.PENDING}, r AS (SELECT repo, path, id, change_type, row_number() OVER (PARTITION BY repo, path ORDER BY detected_at DESC NULLS LAST, id DESC) n FROM p) SELECT repo, path, id, change_type FROM r WHERE n = 1")
def latest_per_key(spark, d):
    """The newest change of each path."""
    return merge.latest(T.pending(spark, d), ["repo", "path"], F.col("detected_at").desc_nulls_last(), F.col("id").desc()).select("repo", "path", "id", "change_type")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events""")
def rolling_mean(spark, d):
    """Mean of the last 20."""
    rows = ordering.numbered(table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id")
    return ordering.moving(rows, "event_type", "rolling", F.avg("value"), 19).select("event_id", F.round("rolling", 6).alias("rolling"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 4) AS used FROM events""")
def sliding_rate(spark, d):
    """Requests and amounts in a sliding time window."""
    e = table(spark, d, "events").withColumn("_t", F.unix_micros(T.stamp("ts")))
    w = Window.partitionBy("user_id").orderBy("_t").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("used"))


@query("""WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) n FROM events),
    e AS (SELECT event_type, n, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.event_type, o.n, 0.2 * o.value + 0.8 * e.ema FROM e JOIN o ON o.event_type = e.event_type AND o.n = e.n + 1)
    SELECT event_type, round(max_by(ema, n), 6) AS ema FROM e GROUP BY event_type""")
def moving_average(spark, d):
    """Exponential moving average. Written as a weighted sum of ordered rows, so that no
    key's values are gathered in one place."""
    e = ordering.numbered(table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id")
    weight = F.when(F.col("i") == 0, F.pow(F.lit(0.8), F.col("n") - 1)).otherwise(0.2 * F.pow(F.lit(0.8), F.col("n") - 1 - F.col("i")))
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value") * weight), 6).alias("ema"))


@query(f"WITH {T.VECTORS}, r AS (SELECT repo, path, min(vec_id) AS first_id FROM v GROUP BY ALL) SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY first_id) AS INTEGER) AS place FROM r")
def first_unique_paths(spark, d):
    """Paths of a list in the order of their first place."""
    r = T.vectors(spark, d, "repo", "path").groupBy("repo", "path").agg(F.min("vec_id").alias("first_id"))
    return r.select("repo", "path", F.row_number().over(Window.partitionBy("repo").orderBy("first_id")).alias("place"))


@query(f"WITH {T.PENDING} SELECT id, repo, path FROM p WHERE NOT processed ORDER BY detected_at, id LIMIT 500")
def pending_fifo(spark, d):
    """The oldest 500 open changes (the limit is the feature)."""
    return T.pending(spark, d).filter("not processed").orderBy("detected_at", "id").limit(500).select("id", "repo", "path")


@query("""(SELECT text_hash FROM chunks INTERSECT SELECT text_hash FROM vectors) EXCEPT SELECT text_hash FROM chunks WHERE repo = 'atlas-mono'""")
def hash_sets(spark, d):
    """O2: set operations on hashes."""
    c, v = table(spark, d, "chunks").select("text_hash", "repo"), table(spark, d, "vectors").select("text_hash")
    return c.select("text_hash").intersect(v).subtract(c.filter("repo = 'atlas-mono'").select("text_hash"))


@query("""SELECT coalesce(category, '(all)') AS category, coalesce(difficulty, '(all)') AS difficulty, count(*) AS n, round(avg(len(expected)), 6) AS mean_expected
    FROM scenarios WHERE difficulty IS NOT NULL GROUP BY GROUPING SETS ((category), (difficulty), ())""")
def scenario_groups(spark, d):
    """Overall and by group in one pass."""
    s = table(spark, d, "scenarios").filter("difficulty is not null").select("category", "difficulty", F.size("expected").alias("e"))
    g = s.groupingSets([["category"], ["difficulty"], []], "category", "difficulty").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean_expected"))
    return g.select(F.coalesce("category", F.lit("(all)")).alias("category"), F.coalesce("difficulty", F.lit("(all)")).alias("difficulty"), "n", "mean_expected")


@query("""SELECT n_name, o_orderpriority, count(*) AS n_orders, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""")
def star_join(spark, d):
    """Extension: a star join with aggregation over the commerce tables."""
    l = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("r"))
    j = l.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum("r").cast("double").alias("revenue"))
