"""Text functions, chunking, code graphs and event windows over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, graph
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


BL = "\\t\\x0B-\\x0D\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
CANON = f"regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[{BL}]+(\\n|\\z)', '\\1', 'g'), '\\A\\n+|\\n+\\z', '', 'g') || chr(10)"


@query(f"SELECT doc_id, sha256({CANON}) AS hash FROM documents WHERE text IS NOT NULL")
def canonical_hash(spark, d):
    """Hashes of canonical texts."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", X.text_hash(F.col("text")).alias("hash"))


@query("WITH c AS (SELECT DISTINCT chunk_id, text, text_hash FROM chunks) SELECT chunk_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10)) = text_hash AS same FROM c")
def verify_hashes(spark, d):
    """Stored hashes against the texts."""
    unix = F.concat(F.regexp_replace("text", r"\r\n?", "\n"), F.lit("\n"))
    return T.chunks(spark, d, "text", "text_hash").select("chunk_id", (F.sha2(unix, 256) == F.lower("text_hash")).alias("same"))


@query(f"WITH {T.VECTORS} SELECT vec_id, split_part(id, ':', 1) AS repo, split_part(id, ':', 3) AS model, TRY_CAST(split_part(id, ':', 5) AS INTEGER) AS start_line, TRY_CAST(split_part(id, ':', 6) AS INTEGER) AS end_line FROM v")
def parse_ids(spark, d):
    """Row ids taken apart."""
    p = T.vectors(spark, d, "id").select("vec_id", X.parse_row_id(F.col("id")).alias("p"))
    return p.select("vec_id", "p.repo", "p.model", "p.start_line", "p.end_line")


@query(f"""WITH {T.CHUNKS}, n AS (SELECT chunk_id, symbol_name, lower(regexp_replace(regexp_replace(symbol_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')) AS w FROM c WHERE symbol_name IS NOT NULL) SELECT chunk_id, w AS words FROM n""")
def camel_words(spark, d):
    """Words of camel-case symbols."""
    c = T.chunks(spark, d, "symbol_name").filter("symbol_name is not null")
    return c.select("chunk_id", F.concat_ws(" ", X.camel_parts(F.col("symbol_name"))).alias("words"))


@query(f"WITH {T.FILES} SELECT file_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(path, '\\.[^/\\\\]+$', '')), '[/\\\\]'), lambda w: w <> ''), ' ') AS words FROM f")
def path_words(spark, d):
    """Words of paths."""
    return T.file_keys(spark, d).select("file_id", F.concat_ws(" ", X.path_parts(F.col("path"))).alias("words"))


@query(f"WITH {T.CHUNKS} SELECT chunk_id, length(text) AS n FROM c")
def enrichment_roundtrip(spark, d):
    """Enriching and stripping gives the text back."""
    c = T.chunks(spark, d, "text", "path", "symbol_name", "symbol_path")
    e = X.enrich(F.col("text"), F.col("path"), F.col("symbol_name"), F.col("symbol_path"))
    return c.select("chunk_id", F.length(X.strip_enrichment(e)).cast("long").alias("n"))


@query(f"""WITH {T.FILES}, e AS (SELECT file_id, regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1) AS e, split_part(regexp_extract(lower(path), '([^/]*)$', 1), '.', 1) AS s FROM f)
    SELECT file_id, CASE WHEN s = 'readme' THEN 'markdown' WHEN s = 'makefile' THEN 'make' WHEN s = 'dockerfile' THEN 'docker' WHEN s = 'license' THEN 'text' WHEN e IN ('py','pyi','pyw') THEN 'python' WHEN e IN ('js','mjs','cjs','jsx') THEN 'javascript' WHEN e IN ('ts','mts','cts','tsx') THEN 'typescript'
      WHEN e IN ('md','mdx','markdown') THEN 'markdown' WHEN e IN ('json','toml','sql','html','css','svelte','go','java','c','cpp','php') THEN e WHEN e = 'h' THEN 'c' WHEN e IN ('yaml','yml') THEN 'yaml' WHEN e IN ('sh','bash','zsh') THEN 'shell' WHEN e = 'rs' THEN 'rust' WHEN e = 'rb' THEN 'ruby' ELSE 'text' END AS language FROM e""")
def classify_language(spark, d):
    """Languages by name and extension."""
    return T.file_keys(spark, d).select("file_id", X.language_of(F.col("path")).alias("language"))


@query("""SELECT scenario_id, CASE WHEN regexp_matches(lower(query), 'function|class |method|variable|\\(\\)|_|::|->') THEN 'identifier' WHEN regexp_matches(lower(query), 'example|how to|how do|usage|sample') THEN 'example' ELSE 'concept' END AS kind FROM scenarios""")
def query_kinds(spark, d):
    """Kinds of queries."""
    return table(spark, d, "scenarios").select("scenario_id", X.query_type(F.col("query")).alias("kind"))


@query(f"WITH {T.CHUNKS} SELECT chunk_id, CAST(length(substr(text, 1, 200)) - length(replace(substr(text, 1, 200), chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(regexp_extract(text, '\\A(\\n*)', 1)) AS INTEGER) AS leading FROM c")
def offset_lines(spark, d):
    """Lines of offsets, line feeds at the edges."""
    c = T.chunks(spark, d, "text")
    return c.select("chunk_id", X.line_of_offset(F.col("text"), F.lit(200)).alias("line"), X.edge_feeds(F.col("text"))["leading"].alias("leading"))


@query(f"WITH {T.VECTORS} SELECT vec_id, 'kb://' || repo || '/' || path || '#L' || start_line || '-L' || end_line AS link FROM v")
def links(spark, d):
    """Links of hits."""
    return T.vectors(spark, d, "repo", "path", "start_line", "end_line").select("vec_id", X.link(F.col("repo"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("link"))


@query("SELECT scenario_id, substr(sha256(query || '|' || repo), 1, 16) AS key FROM scenarios")
def cache_keys(spark, d):
    """X31."""
    return table(spark, d, "scenarios").select("scenario_id", X.cache_key(F.col("query"), F.col("repo")).alias("key"))


@query("SELECT file_id, min(regexp_replace(path, '^(\\./+|/+)+', '')) AS path, bool_and(NOT contains(path, '../')) AS contained FROM files GROUP BY file_id")
def safe_paths(spark, d):
    """normal paths, and whether they stay below their base."""
    from ..operators.filters import contained

    f = table(spark, d, "files").select("file_id", X.normal_path(F.col("path")).alias("path"), contained(F.col("path")).alias("c"))
    return f.groupBy("file_id").agg(F.min("path").alias("path"), F.bool_and("c").alias("contained"))


@query("""WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, '\\S+') AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT id, t, len(t) AS n FROM t WHERE len(t) > 0), w AS (SELECT id, t, n, unnest(range(0, CAST(greatest(ceil((n - 400) / 360.0), 0) AS BIGINT) + 1)) AS ordinal FROM n)
    SELECT id, CAST(ordinal AS INTEGER) AS ordinal, CAST(ordinal * 360 AS INTEGER) AS start_token, CAST(least(ordinal * 360 + 400, n) AS INTEGER) AS stop_token, array_to_string(t[ordinal * 360 + 1 : least(ordinal * 360 + 400, n)], ' ') AS text FROM w""")
def token_windows(spark, d):
    """Windows of 400 tokens with 40 of overlap."""
    return chunking.token_windows(table(spark, d, "documents"), id_col="doc_id")


@query(f"""WITH l AS (SELECT DISTINCT file_id, text FROM files WHERE text IS NOT NULL AND regexp_matches(path, '\\.md$')), x AS (SELECT file_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS n FROM l),
    g AS (SELECT *, CAST(regexp_matches(line, '^ {{0,3}}(```|~~~)') AS INT) AS fe FROM x), h AS (SELECT *, sum(fe) OVER (PARTITION BY file_id ORDER BY n) - fe AS b FROM g),
    m AS (SELECT *, (b % 2 = 0 AND fe = 0 AND regexp_matches(line, '^#{{1,6}}[ \\t]+\\S')) AS head FROM h), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_id ORDER BY n) AS section FROM m),
    r AS (SELECT file_id AS id, section, min(n) AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS text FROM s WHERE NOT head GROUP BY ALL)
    SELECT id, CAST(section AS BIGINT) AS section, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, text FROM r WHERE regexp_matches(text, '\\S')""")
def md_sections(spark, d):
    """Sections of markdown files."""
    f = table(spark, d, "files").filter("text is not null and path like '%.md'").select("file_id", "text").distinct()
    return chunking.sections(f, id_col="file_id").select("id", "section", "start_line", "end_line", "text")


@query(f"""WITH {T.FILES} SELECT file_id, CASE WHEN regexp_matches(text, '(?i)^\\s*CREATE\\s+TABLE\\b') THEN 'table' WHEN regexp_matches(text, '(?i)^\\s*CREATE\\s+VIEW\\b') THEN 'view' WHEN regexp_matches(text, '(?i)^\\s*SELECT\\b') THEN 'query' WHEN regexp_matches(text, '(?i)^\\s*WITH\\b') THEN 'cte' ELSE 'statement' END AS kind FROM f WHERE path LIKE '%.sql' AND text IS NOT NULL AND NOT regexp_matches(text, '--|/\\*|\\{{')""")
def sql_kinds(spark, d):
    """Kinds of plain SQL files of one statement, as the twin has them; ``sql_statements`` has all."""
    f = T.files(spark, d).filter(F.col("path").endswith(".sql") & F.col("text").isNotNull() & ~F.col("text").rlike(r"--|/\*|\{"))
    return f.select("file_id", chunking.statement_kind(F.col("text")).alias("kind"))


@query()
def sql_statements(spark, d):
    """Statements of all SQL files by kind, large ones in parts."""
    f = T.files(spark, d).filter(F.lower("path").endswith(".sql")).withColumn("language", F.lit("sql"))
    c = chunking.chunk(f).filter("symbol_kind is not null")
    return c.select("file_id", "ordinal", "start_line", "end_line", F.col("symbol_kind").alias("kind"))


@query(f"""WITH {T.FILES} SELECT file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\b(?:from|join)\\s+([a-z_][a-z0-9_.]*)', 1))), ',') AS refs FROM f WHERE text IS NOT NULL AND regexp_matches(path, '\\.(sql|py)$')""")
def sql_lineage(spark, d):
    """Names after FROM and JOIN."""
    f = T.files(spark, d).filter(F.col("text").isNotNull() & F.col("path").rlike(r"\.(sql|py)$"))
    return f.select("file_id", F.concat_ws(",", graph.table_references(F.col("text"))).alias("refs"))


@query(f"WITH {T.CHUNKS}, s AS (SELECT chunk_id, string_split(text, chr(10)) AS l FROM c) SELECT chunk_id, array_to_string(l[1:2], chr(10)) AS before, substr(array_to_string(l[3:4], chr(10)), 1, 1600) AS match, array_to_string(l[5:6], chr(10)) AS after FROM s WHERE length(array_to_string(l[1:6], chr(10))) <= 1600 AND len(l) >= 4")
def snippets(spark, d):
    """Lines around a match, of the chunks within the budget, as the twin has them; ``snippet_windows`` has all."""
    c = T.chunks(spark, d, "text").filter(F.size(F.split("text", "\n")) >= 4)
    c = c.filter(F.length(F.concat_ws("\n", F.slice(F.split("text", "\n"), 1, 6))) <= 1600)
    return c.select("chunk_id", X.snippet(F.col("text"), F.lit(3), F.lit(4)).alias("s")).select("chunk_id", "s.before", "s.match", "s.after")


@query()
def snippet_windows(spark, d):
    """Lines around a match in every chunk, cut to the budget."""
    c = T.chunks(spark, d, "text").filter("text is not null")
    return c.select("chunk_id", X.snippet(F.col("text"), F.lit(3), F.lit(4)).alias("s")).select("chunk_id", "s.before", "s.match", "s.after")


@query("""WITH f AS (SELECT DISTINCT file_id, regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1) AS e FROM files WHERE NOT regexp_matches(lower(path), '(^|/)(readme|makefile|dockerfile|license)[^/]*$'))
    SELECT file_id, CASE WHEN e IN ('py','pyi','pyw') THEN 'text/x-python' WHEN e IN ('js','mjs','cjs','jsx') THEN 'text/javascript' WHEN e IN ('ts','mts','cts','tsx') THEN 'text/typescript' WHEN e IN ('md','mdx','markdown') THEN 'text/markdown' WHEN e = 'json' THEN 'application/json' WHEN e IN ('yaml','yml') THEN 'application/yaml'
      WHEN e = 'html' THEN 'text/html' WHEN e = 'css' THEN 'text/css' WHEN e = 'toml' THEN 'application/toml' WHEN e IN ('sh','bash','zsh') THEN 'application/x-sh' WHEN e = 'sql' THEN 'application/sql' ELSE 'text/plain' END AS media, CASE WHEN e IN ('sh','bash','zsh') THEN 'bash' WHEN e = 'py' THEN 'python' END AS fence FROM f""")
def media_types(spark, d):
    """Media types and fence names by path, as the twin has them; ``path_types`` has all."""
    f = T.file_keys(spark, d).filter(~F.lower("path").rlike(r"(^|/)(readme|makefile|dockerfile|license)[^/]*$"))
    fence = X.fence_language(F.col("path"))
    return f.select("file_id", X.media_type(F.col("path")).alias("media"), F.when(F.col("path").rlike(r"(?i)\.(py|sh|bash|zsh)$"), fence).alias("fence")).distinct()


@query()
def path_types(spark, d):
    """Media types and fence names of every path."""
    f = T.file_keys(spark, d)
    return f.select("file_id", X.media_type(F.col("path")).alias("media"), X.fence_language(F.col("path")).alias("fence")).distinct()


@query()
def data_flow(spark, d):
    """Definitions and the uses after them, within Python functions."""
    f = T.files(spark, d).withColumn("language", X.language_of(F.col("path")))
    return graph.flows(f).groupBy("file_id").agg(F.count("*").alias("n_uses"), F.count_distinct("function", "variable").alias("n_variables"))


@query("""SELECT file_id, bool_or(latest_commit_sha IS DISTINCT FROM 'x' OR size_bytes > 5) AS stale FROM files WHERE latest_commit_sha IS NOT NULL AND size_bytes IS NOT NULL GROUP BY file_id""")
def stale_graphs(spark, d):
    """Kept graphs that are to be rebuilt."""
    f = table(spark, d, "files").filter("latest_commit_sha is not null and size_bytes is not null")
    return f.groupBy("file_id").agg(F.bool_or(graph.stale(F.col("latest_commit_sha"), F.lit("x"), F.col("size_bytes"), F.lit(0))).alias("stale"))


@query()
def chunk_files(spark, d):
    """Chunks of every file by its language."""
    f = T.files(spark, d).withColumn("language", X.language_of(F.col("path")))
    return chunking.chunk(f).groupBy("symbol_kind").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


@query()
def code_graph(spark, d):
    """Calls and other edges resolved to nodes."""
    f = T.files(spark, d).withColumn("language", X.language_of(F.col("path")))
    nodes, edges = graph.extract(f)
    nodes = nodes.withColumn("node_id", F.concat_ws(":", "file_id", "qualified_name", "start_line"))
    return graph.resolve(edges, nodes).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


@query()
def import_edges(spark, d):
    """Imports joined to the file each means, the first of its candidates that exists."""
    f = T.files(spark, d).withColumn("language", X.language_of(F.col("path")))
    _, edges = graph.extract(f)
    i = edges.filter("edge_type = 'imports'").join(f.select("file_id", "repo", "path"), "file_id")
    c = i.select("file_id", "repo", "target", "line", F.posexplode(graph.import_candidates(F.col("target"), F.col("path"))).alias("p", "path"))
    met = c.join(f.select(F.col("file_id").alias("to_file"), "repo", "path"), ["repo", "path"])
    first = met.groupBy("file_id", "repo", "target", "line").agg(F.min_by("to_file", F.struct("p", "to_file")).alias("to_file"))
    return first.groupBy("file_id").agg(F.count("*").alias("n"))


@query()
def base_classes(spark, d):
    """Classes joined to their base classes, the first class of that name anywhere."""
    f = T.files(spark, d).withColumn("language", X.language_of(F.col("path")))
    nodes, edges = graph.extract(f)
    return graph.bases(edges, nodes)


#: A graph over the catalog: a file's chunks in their order, and contents shared by files.
EDGES = "e AS (SELECT DISTINCT a.file_id AS src, b.file_id AS dst FROM (SELECT DISTINCT file_id, text_hash FROM chunks) a JOIN (SELECT text_hash, min(file_id) AS file_id FROM chunks GROUP BY text_hash) b ON a.text_hash = b.text_hash WHERE a.file_id <> b.file_id)"


def content_edges(spark, d):
    """From each file to the first file that holds a content of it. Hashes map to one first
    file each, so a content that is everywhere makes one edge a file, not one a pair."""
    c = table(spark, d, "chunks").select("file_id", "text_hash").distinct()
    first = c.groupBy("text_hash").agg(F.min("file_id").alias("dst"))
    return c.join(first, "text_hash").filter("file_id <> dst").select(F.col("file_id").alias("src"), "dst").distinct()


@query(f"WITH {EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def degree(spark, d):
    """Degrees of a simple graph."""
    return graph.degrees(content_edges(spark, d))


def _pagerank_sql(rounds: int) -> str:
    ctes = [EDGES, "nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "g AS (SELECT src, count(*) AS deg FROM e GROUP BY src)", "k AS (SELECT count(*) AS n FROM nd)", "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nd, k)"]
    for i in range(rounds):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM g))")
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT nd.node, 0.15 / n + 0.85 * (coalesce(x.got, 0) + lost / n) AS rank FROM nd CROSS JOIN k CROSS JOIN l{i} LEFT JOIN (SELECT e.dst, sum(r.rank / g.deg) AS got FROM e JOIN r{i} r ON r.node = e.src JOIN g ON g.src = e.src GROUP BY e.dst) x ON x.dst = nd.node)")
    return f"WITH {', '.join(ctes)} SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query(_pagerank_sql(20))
def pagerank(spark, d):
    """PageRank after 20 rounds."""
    return graph.pagerank(content_edges(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query()
def communities(spark, d):
    """Communities by label propagation."""
    return graph.communities(content_edges(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query()
def betweenness(spark, d):
    """Betweenness from a stated set of sources (ids divisible by 20)."""
    e = content_edges(spark, d)
    return graph.betweenness(e, e.select(F.col("src").alias("node")).distinct().filter("node % 20 = 0"))


@query(f"""WITH {T.CHUNKS}, n AS (SELECT chunk_id AS node_id, file_id, symbol_name AS name, start_line, end_line FROM c WHERE symbol_kind IN ('class', 'function', 'method'))
    SELECT c.chunk_id, n.node_id FROM c JOIN n ON c.file_id = n.file_id AND c.start_line <= n.end_line AND n.start_line <= c.end_line""")
def range_overlap(spark, d):
    """Chunks and symbols whose lines overlap."""
    c = T.chunks(spark, d, "file_id", "symbol_kind", "symbol_name", "start_line", "end_line")
    n = c.filter("symbol_kind in ('class', 'function', 'method')").select(F.col("chunk_id").alias("node_id"), "file_id", F.col("symbol_name").alias("name"), "start_line", "end_line")
    return graph.overlapping(c, n).select("chunk_id", "node_id")


@query()
def graph_context(spark, d):
    """The relations of each hit, as text."""
    c = T.chunks(spark, d, "file_id", "symbol_kind", "symbol_name", "start_line", "end_line")
    n = c.filter("symbol_kind in ('class', 'function', 'method')").select(F.col("chunk_id").alias("node_id"), "file_id", F.col("symbol_name").alias("name"), "start_line", "end_line")
    after = n.alias("a").join(n.alias("b"), (F.col("a.file_id") == F.col("b.file_id")) & (F.col("b.start_line") == F.col("a.end_line") + 2))
    edges = after.select(F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"), F.lit("next").alias("edge_type"), F.col("a.end_line").alias("line"))
    return graph.render(graph.context(graph.overlapping(c, n), edges))


@query(f"""WITH {T.PENDING}, d AS (SELECT repo, path, id, detected_at FROM p WHERE change_type = 'created'), u AS (SELECT repo, path, id, detected_at FROM p WHERE change_type = 'modified'),
    r AS (SELECT u.id, d.id AS made_by, row_number() OVER (PARTITION BY u.id ORDER BY d.detected_at DESC, d.id DESC) n FROM u JOIN d ON u.repo = d.repo AND u.path = d.path AND d.detected_at <= u.detected_at) SELECT id, made_by FROM r WHERE n = 1""")
def as_of_change(spark, d):
    """The definition before each use (here: the creation before each change).

    Written as a running last value over the merged events, so neither side is paired."""
    from pyspark.sql import Window

    p = T.pending(spark, d).filter("change_type in ('created', 'modified')")
    w = Window.partitionBy("repo", "path").orderBy("detected_at", F.when(F.col("change_type") == "created", 0).otherwise(1), "id").rowsBetween(Window.unboundedPreceding, 0)
    made = F.last(F.when(F.col("change_type") == "created", F.col("id")), ignorenulls=True).over(w)
    return p.select("id", "change_type", made.alias("made_by")).filter("change_type = 'modified' and made_by is not null").select("id", "made_by")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    """Extension: tumbling windows over events, as the stream computes them."""
    e = table(spark, d, "events").withColumn("ts", T.stamp("ts"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
    SELECT user_id, min(ts) AS started_at, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    """Extension: sessions that end after six quiet hours."""
    e = table(spark, d, "events").withColumn("ts", T.stamp("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started_at"), "n")
