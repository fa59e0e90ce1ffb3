"""Code graphs: extraction, resolution, metrics and the context of hits."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chunking import python_symbols, script_symbols

EDGE = "file_id long, source string, target string, edge_type string, line int"
NODE = "file_id long, name string, qualified_name string, node_type string, start_line int, end_line int"


def _call_name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    return node.attr if isinstance(node, ast.Attribute) else None


def python_graph(text: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes and edges (calls, inherits, decorated_by, imports) of a Python text.

    Lines count from 1. A call belongs to the innermost function around it.
    """
    edges = python_edges(text)
    return [(name, path, kind, a, b) for _, a, b, kind, name, path in python_symbols(text)], edges


def python_edges(text: str) -> list[tuple]:
    """The edges alone, without the symbols."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    edges: list[tuple] = []

    def visit(node, owner):
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                here = f"{owner}.{child.name}" if owner else child.name
                for d in child.decorator_list:
                    if name := _call_name(d.func if isinstance(d, ast.Call) else d):
                        edges.append((here, name, "decorated_by", d.lineno))
                if isinstance(child, ast.ClassDef):
                    edges.extend((here, name, "inherits", child.lineno) for b in child.bases if (name := _call_name(b)))
            elif isinstance(child, ast.Call) and owner and (name := _call_name(child.func)):
                edges.append((owner, name, "calls", child.lineno))
            elif isinstance(child, ast.Import):
                edges.extend(("<module>", a.name, "imports", child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                edges.append(("<module>", "." * child.level + (child.module or ""), "imports", child.lineno))
            visit(child, here)

    visit(tree, "")
    return edges


_HERITAGE = re.compile(r"\b(?:class|interface)\s+([\w$]+)[^{]*?\b(extends|implements)\s+([\w$.]+)")
_IMPORT = re.compile(r"^\s*(?:import|export)\b[^;'\"]*?from\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]", re.M)
_CALL = re.compile(r"(?<![\w$.])(?:new\s+)?([A-Za-z_$][\w$]*)\s*\(|\.([A-Za-z_$][\w$]*)\s*\(")


def script_graph(text: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes and edges (calls, extends, implements, imports) of a script."""
    found = script_symbols(text)
    nodes = [(name, path, kind, a, b) for _, a, b, kind, name, path in found]
    edges: list[tuple] = []

    def line(at: int) -> int:
        return text.count("\n", 0, at) + 1

    for m in _HERITAGE.finditer(text):
        edges.append((m[1], m[3], m[2], line(m.start())))
    for m in _IMPORT.finditer(text):
        edges.append(("<module>", m[1] or m[2], "imports", line(m.start())))
    callers = sorted(((a, b, path) for _, a, b, kind, _, path in found if kind in ("function", "method")), key=lambda x: x[1] - x[0])
    known = {name for name, *_ in nodes}
    for m in _CALL.finditer(text):
        name = m[1] or m[2]
        if name in known:
            at = line(m.start())
            owner = next((p for a, b, p in callers if a <= at <= b), None)
            if owner and not (at in {a for a, _, p in callers if p.endswith(name)}):
                edges.append((owner, name, "calls", at))
    return nodes, edges


_SVELTE = (
    ("accepts_prop", re.compile(r"^\s*export\s+let\s+([\w$]+)", re.M)),
    ("subscribes_to", re.compile(r"(?<![\w$.])\$([A-Za-z_][\w$]*)")),
    ("uses_component", re.compile(r"<([A-Z][\w.]*)")),
    ("dispatches_event", re.compile(r"\bdispatch\(\s*['\"]([\w:-]+)['\"]")),
)


def component_graph(text: str) -> tuple[list[tuple], list[tuple]]:
    """Edges of a component file: imports, props, stores, components and events."""
    edges: list[tuple] = []
    for m in _IMPORT.finditer(text):
        edges.append(("<module>", m[1] or m[2], "imports", text.count("\n", 0, m.start()) + 1))
    for kind, pattern in _SVELTE:
        seen = set()
        for m in pattern.finditer(text):
            if m[1] not in seen:
                seen.add(m[1])
                edges.append(("<module>", m[1], kind, text.count("\n", 0, m.start(1)) + 1))
    return [], edges


def data_flow(text: str) -> list[tuple]:
    """(function, variable, line of definition, line of use) within Python functions: each
    use with the first definition of the name in the function that lies before it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    out = []
    for fn in ast.walk(tree):
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        made: dict[str, int] = {a.arg: fn.lineno for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs)}
        names = [n for n in ast.walk(fn) if isinstance(n, ast.Name)]
        for n in sorted((n for n in names if isinstance(n.ctx, ast.Store)), key=lambda n: n.lineno):
            made.setdefault(n.id, n.lineno)
        out += [(fn.name, n.id, made[n.id], n.lineno) for n in names if isinstance(n.ctx, ast.Load) and made.get(n.id, n.lineno) < n.lineno]
    return sorted(set(out))


def stale(commit: Column, current: Column, edge_changes: Column, age_seconds: Column) -> Column:
    """Whether a kept graph is to be rebuilt: another commit, over five changes, over ten minutes."""
    return (commit != current) | (edge_changes > 5) | (age_seconds > 600)


EXTRACTORS = {"python": python_graph, "javascript": script_graph, "typescript": script_graph, "svelte": component_graph}


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``files(file_id, language, text)``; texts that do not parse have none."""

    schema = f"file_id long, node struct<{_fields(NODE)}>, edge struct<{_fields(EDGE)}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    nodes, edges = EXTRACTORS[row.language](row.text)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                out += [(row.file_id, dict(zip(names[0], (row.file_id, *x), strict=True)), None) for x in nodes]
                out += [(row.file_id, None, dict(zip(names[1], (row.file_id, *x), strict=True))) for x in edges]
            yield pd.DataFrame(out, columns=["file_id", "node", "edge"])

    names = [[c.split()[0] for c in kind.split(", ")] for kind in (NODE, EDGE)]
    some = files.select("file_id", "language", "text").filter(F.col("language").isin(*EXTRACTORS) & F.col("text").isNotNull())
    # Each text is parsed once; nodes and edges are read from what was written.
    rows = cut_lineage(some.mapInPandas(run, schema))
    return rows.filter("node is not null").select("node.*"), rows.filter("edge is not null").select("edge.*")


def _fields(schema: str) -> str:
    return ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))


def flows(files: DataFrame) -> DataFrame:
    """Data-flow edges of Python files; texts that do not parse have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    out += [(row.file_id, *x) for x in data_flow(row.text)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["file_id", "function", "variable", "defined", "used"])

    some = files.select("file_id", "language", "text").filter("language = 'python' and text is not null and file_id is not null")
    return some.select("file_id", "text").mapInPandas(run, "file_id long, function string, variable string, defined int, used int")


def import_candidates(module: Column, importer: Column) -> Column:
    """Paths that an import may mean, in order: a module and its package in Python (leading
    dots name the importer's package and those above it), relative paths with the usual
    suffixes in scripts. None for other script imports."""
    folder = F.regexp_replace(importer, r"/?[^/]*$", "")
    named = F.regexp_replace(module, r"^\.+", "")
    up = F.length(module) - F.length(named)
    above = F.filter(F.split(folder, "/"), lambda p: p != "")
    package = F.when(up > 0, F.slice(above, F.lit(1), F.greatest(F.size(above) - up + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    place = F.concat_ws("/", package, F.nullif(F.replace(named, F.lit("."), F.lit("/")), F.lit("")))
    python = F.filter(F.array(F.when(named != "", F.concat(place, F.lit(".py"))), F.concat(place, F.when(place != "", F.lit("/")).otherwise(F.lit("")), F.lit("__init__.py"))), lambda p: p.isNotNull())
    # Steps of a relative path: a part and the ".." after it cancel out.
    joined = F.filter(F.split(F.concat_ws("/", folder, module), "/"), lambda p: (p != ".") & (p != ""))
    folded = F.aggregate(joined, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p)))
    base = F.concat_ws("/", folded)
    script = F.transform(F.array(*(F.lit(x) for x in ("", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx", "/index.js"))), lambda x: F.concat(base, x))
    is_script = importer.rlike(r"\.([cm]?[jt]sx?|svelte)$")
    return F.when(is_script & module.startswith("."), script).when(~is_script, python)


def bases(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows ``file_id, source, edge_type, base_file, base_line``: each class and the first class
    (by file, then line) of its base's name. Bases that are no class here are left out."""
    classes = nodes.filter("node_type in ('class', 'interface') and file_id is not null")
    first = classes.groupBy(F.col("name").alias("base")).agg(F.min(F.struct("file_id", "start_line")).alias("b"))
    held = edges.filter("edge_type in ('inherits', 'extends', 'implements')").withColumn("base", F.regexp_extract("target", r"([^.]*)$", 1))
    return held.join(first, "base").select("file_id", "source", "edge_type", F.col("b.file_id").alias("base_file"), F.col("b.start_line").alias("base_line")).distinct()


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target name is a node: of the same file first, else the newest of all.

    ``edges(file_id, source, target, edge_type, line)``, ``nodes(file_id, name, node_id)``.
    Unresolved edges are left out.
    """
    local = nodes.groupBy("file_id", F.col("name").alias("target")).agg(F.max("node_id").alias("_local"))
    anywhere = nodes.groupBy(F.col("name").alias("target")).agg(F.max("node_id").alias("_any"))
    joined = edges.join(local, ["file_id", "target"], "left").join(anywhere, "target", "left")
    target = F.coalesce("_local", "_any")
    return joined.filter(target.isNotNull()).select("file_id", "source", "edge_type", "line", target.alias("target_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree by node; parallel edges count once."""
    simple = edges.select("src", "dst").distinct()
    sides = simple.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(simple.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return sides.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(edges: DataFrame, iterations: int = 20, alpha: float = 0.85) -> DataFrame:
    """PageRank after a fixed number of iterations; the mass of sinks is spread evenly.

    Parallel edges count once. Every round reads the former ranks twice, so its result is
    written to the shared checkpoint folder; otherwise the plan would double each round.
    """
    simple = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    out = simple.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut_lineage(simple.join(out, "src"))
    nodes = cut_lineage(simple.select(F.col("src").alias("node")).union(simple.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    sinks = nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti")
    for _ in range(iterations):
        given = links.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        lost = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).scalar()
        new = nodes.join(given, "node", "left").select("node", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        rank = cut_lineage(new)
    return rank


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Communities by label propagation on the undirected graph; ties go to the smaller label.

    A node's own label is a vote too, and in each round only one of two halves of the nodes
    (by hash, dealt anew each round) may change, so neighbours do not swap labels for ever.
    Runs until no node would change; ``rounds`` is a bound, and reaching it is an error.
    """
    simple = edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct()
    both = cut_lineage(simple.union(simple.select(F.col("dst"), F.col("src"))).toDF("a", "b").distinct())
    label = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    ballots = cut_lineage(both.unionByName(both.select("a", F.col("a").alias("b")).distinct()))
    for i in range(rounds):
        votes = ballots.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
        wanted = cut_lineage(label.join(best, "node"))
        if wanted.filter("best <> label").isEmpty():
            return label
        turn = F.pmod(F.xxhash64("node", F.lit(i // 2)) + F.lit(i), F.lit(2)) == 0
        label = wanted.select("node", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"))
    raise RuntimeError(f"labels still change after {rounds} rounds")


def betweenness(edges: DataFrame, sources: DataFrame, depth: int = 12) -> DataFrame:
    """Betweenness from a stated set of sources (column ``node``): shortest paths counted level by level,
    dependencies summed back along them. All joins are distributed; no graph is collected."""
    spark = edges.sparkSession
    simple = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    kind = dict(simple.dtypes)["src"]
    front = sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")).distinct()
    levels = [cut_lineage(front)]
    seen = levels[0].select("s", "node")
    for _ in range(depth):
        step = levels[-1].join(simple, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        step = cut_lineage(step.join(seen, ["s", "node"], "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = cut_lineage(seen.unionByName(step.select("s", "node")))
    total = None
    below = None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("delta", F.lit(0.0)) if below is None else levels[k].join(below, ["s", "node"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = cut_lineage(here)
        part = here.select("s", "node", "delta")
        total = part if total is None else total.unionByName(part)
        up = levels[k - 1].select("s", F.col("node").alias("src"), F.col("paths").alias("up_paths"))
        below = here.join(simple, F.col("node") == F.col("dst")).join(up, ["s", "src"]).groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("up_paths") / F.col("paths") * (1 + F.col("delta"))).alias("delta"))
    if total is None:
        return spark.createDataFrame([], f"node {kind}, betweenness double")
    return total.groupBy("node").agg(F.sum("delta").alias("betweenness"))


def overlapping(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of chunks and nodes of one file whose line ranges overlap.

    The equality on the file partitions the join; the ranges are its residual.
    """
    c, n = chunks.alias("c"), nodes.alias("n")
    cond = (F.col("c.file_id") == F.col("n.file_id")) & (F.col("c.start_line") <= F.col("n.end_line")) & (F.col("n.start_line") <= F.col("c.end_line"))
    return c.join(n, cond).select(F.col("c.chunk_id"), F.col("n.node_id"), F.col("n.name"), F.col("n.start_line").alias("node_start"))


def context(pairs: DataFrame, edges: DataFrame, per_hit: int = 10, per_node: int = 5) -> DataFrame:
    """Relations of each hit's nodes: the first nodes, a few edges a node, each once.

    ``pairs(chunk_id, node_id, name, node_start)``, ``edges(src, dst, edge_type, line)``.
    """
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("node_start", "node_id"))
    near = pairs.withColumn("_n", first).filter(F.col("_n") <= per_hit)
    each = F.row_number().over(Window.partitionBy("src").orderBy("edge_type", "line", "dst"))
    some = edges.withColumn("_e", each).filter(F.col("_e") <= per_node)
    found = near.join(some, F.col("node_id") == F.col("src"))
    return found.select("chunk_id", "node_id", "edge_type", F.col("dst").alias("related"), "line").distinct()


def render(relations: DataFrame) -> DataFrame:
    """One text a hit: its relations by type, at most five each."""
    n = F.row_number().over(Window.partitionBy("chunk_id", "edge_type").orderBy("line", "related"))
    few = relations.withColumn("_n", n).filter("_n <= 5")
    lines = few.groupBy("chunk_id", "edge_type").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.col("related").cast("string")))).alias("names"))
    return lines.groupBy("chunk_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(": ", "edge_type", "names")))).alias("context"))


def table_references(statement: Column) -> Column:
    """Distinct lower-case names after FROM and JOIN."""
    found = F.regexp_extract_all(F.lower(statement), F.lit(r"\b(?:from|join)\s+([a-z_][a-z0-9_.]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))
