"""Documents to chunks: token windows, headings, symbols, statements and markup."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "text string, start_line int, end_line int, symbol_kind string, symbol_name string, symbol_path string"


def window_ranges(n: Column, target: int = 400, overlap: int = 40) -> Column:
    """Array of (start, stop) token windows; none for no tokens, one for a short text."""
    if target <= 0:
        raise ValueError("target must be positive")
    step = target - max(0, min(overlap, target - 1))
    last = F.greatest(F.ceil((n - target) / step), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.least(k * step + target, n).alias("stop")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def token_windows(docs: DataFrame, target: int = 400, overlap: int = 40, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Windows of a text's words, cut with the text's own spelling between them.

    Null and empty texts have no windows.
    """
    tokens = F.regexp_extract_all(text_col, F.lit(r"\S+"), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), tokens.alias("_t")).withColumn("_n", F.size("_t")).filter("_n > 0")
    spans = base.select("id", "_t", F.posexplode(window_ranges(F.col("_n"), target, overlap)).alias("ordinal", "w"))
    return spans.select("id", "ordinal", F.col("w.start").alias("start_token"), F.col("w.stop").alias("stop_token"), F.concat_ws(" ", F.slice("_t", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start"))).alias("text"))


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Sections of a markdown text with the headings above them.

    Only ATX headings outside fences count; heading lines are left out. A heading of level
    1..3 sets its level and clears the lower ones; deeper ones split without a name.
    """
    unix = F.regexp_replace(text_col, r"\r\n?", "\n")
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(unix, "\n")).alias("n", "line"))
    up = Window.partitionBy("id").orderBy("n")
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    before = F.sum(fence.cast("int")).over(up) - fence.cast("int")
    level = F.when((before % 2 == 0) & ~fence & F.col("line").rlike(r"^#{1,6}[ \t]+\S"), F.length(F.regexp_extract("line", r"^(#+)", 1)))
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#{1,6}[ \t]+", ""), r"[ \t]+#+[ \t]*$", ""))
    marked = lines.withColumn("level", level).withColumn("title", F.when(level.isNotNull(), title))
    marked = marked.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(up))
    heads = marked.filter("level is not null").select("id", "section", "level", "title")
    by = Window.partitionBy("id").orderBy("section")
    for h in (1, 2, 3):
        # The last title of this level since the last heading above it.
        era = F.sum(F.when(F.col("level") < h, 1).otherwise(0)).over(by)
        heads = heads.withColumn(f"_e{h}", era)
        inner = Window.partitionBy("id", f"_e{h}").orderBy("section")
        heads = heads.withColumn(f"h{h}", F.last(F.when(F.col("level") == h, F.col("title")), ignorenulls=True).over(inner))
    body = marked.filter("level is null").groupBy("id", "section").agg(
        F.min("n").alias("_a"), F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("_l")
    )
    text = F.concat_ws("\n", "_l")
    out = body.join(heads.select("id", "section", "h1", "h2", "h3"), ["id", "section"], "left").withColumn("text", text)
    out = out.filter(F.col("text").rlike(r"\S"))
    return out.select("id", "section", (F.col("_a") + 1).cast("int").alias("start_line"), (F.col("_a") + F.size("_l")).cast("int").alias("end_line"), "h1", "h2", "h3", "text")


# Comments of SQL, and the kinds of its statements by their patterns; the first that matches.
SQL_NOTE = r"(?m)^\s*--[^\n]*$|/\*[\s\S]*?\*/"
SQL_KINDS = (
    ("model", r"(?i)^\s*MODEL\s*\("), ("macro", r"(?i)\{%-?\s*macro\s"), ("template", r"(?i)\{\{\s*(config|ref|source)\s*\("),
    *((kind, rf"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?(TEMP(ORARY)?\s+|MATERIALIZED\s+|UNIQUE\s+)*{kind}\b") for kind in ("table", "view", "function", "procedure", "index", "trigger", "schema")),
    ("cte", r"(?i)^\s*WITH\b"), ("query", r"(?i)^\s*SELECT\b"),
)


def statement_kind(statement: Column) -> Column:
    """Kind of a SQL statement: the first that matches."""
    s = F.regexp_replace(statement, SQL_NOTE, "")
    return F.coalesce(*(F.when(s.rlike(pattern), kind) for kind, pattern in SQL_KINDS), F.lit("statement"))


def sql_parts(text: str, budget: int = 350) -> list[tuple]:
    """Statements of a SQL script by kind; one above 1.5 budgets is cut into lines, its kind with ``_part``."""
    out = []
    for first, last, body in statements(text):
        bare = re.sub(SQL_NOTE, "", body)
        kind = next((kind for kind, pattern in SQL_KINDS if re.search(pattern, bare)), "statement")
        if len(body.split()) <= 1.5 * budget:
            out.append((body, first, last, kind, None, None))
            continue
        lines = body.split("\n")
        for a, b in pack_lines(lines, budget):
            piece = "\n".join(lines[a:b])
            if piece.strip():
                out.append((piece, first + a, first + b - 1, f"{kind}_part", None, None))
    return out


def statements(text: str) -> list[tuple[int, int, str]]:
    """(start line, end line, text) of the statements of a SQL script.

    A statement ends with the line that holds a semicolon outside quotes, dollar quotes and
    template braces.
    """
    out, start, state = [], 0, None
    lines = text.split("\n")
    for n, line in enumerate(lines):
        i, ends = 0, False
        while i < len(line):
            if state:
                j = line.find(state, i)
                if j < 0:
                    break
                i, state = j + len(state), None
                continue
            rest = line[i:]
            if rest.startswith("--"):
                break
            tag = re.match(r"\$\w*\$", rest)
            if rest[0] in "'\"":
                state, i = rest[0], i + 1
            elif tag:
                state, i = tag[0], i + len(tag[0])
            elif rest.startswith("{{") or rest.startswith("{%"):
                state, i = "}}" if rest[1] == "{" else "%}", i + 2
            elif rest.startswith("/*"):
                state, i = "*/", i + 2
            else:
                ends |= rest[0] == ";"
                i += 1
        if ends and not state:
            out.append((start + 1, n + 1, "\n".join(lines[start : n + 1])))
            start = n + 1
    if "\n".join(lines[start:]).strip():
        out.append((start + 1, len(lines), "\n".join(lines[start:])))
    return out


def pack_lines(lines: list[str], budget: int) -> list[tuple[int, int]]:
    """Runs of lines within a budget of words; a longer line stands alone."""
    out, start, used = [], 0, 0
    for n, line in enumerate(lines):
        size = len(line.split())
        if used and used + size > budget:
            out.append((start, n))
            start, used = n, 0
        used += size
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def python_symbols(text: str) -> list[tuple]:
    """Classes, functions and methods (nested ones too), with their lines and paths."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = text.split("\n")
    out = []

    def visit(node, chain, inside):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if inside else "function"
                path = ".".join([*chain, child.name])
                out.append(("\n".join(lines[first - 1 : child.end_lineno]), first, child.end_lineno, kind, child.name, path))
                visit(child, [*chain, child.name], inside or is_class)
            else:
                visit(child, chain, inside)

    visit(tree, [], False)
    return out


_TS = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?P<class>class)|(?P<interface>interface)|(?P<enum>(?:const\s+)?enum)|(?P<type>type)(?=\s+\w+[^=\n]*=)|(?P<function>(?:async\s+)?function\*?)|(?P<arrow>(?:const|let|var))(?=\s+\w+[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>))\s+(?P<name>[\w$]+)",
    re.M,
)
_TSMETHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*(?P<name>[\w$#]+)\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?::[^{;\n]+)?\{", re.M)


# What a script holds besides code: comments, strings, regular expressions (only where a value
# may stand), and the marks that matter outside of them.
_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[`{}]|/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|/")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{|\Z)")
_VALUE_ENDS = re.compile(r"(?:[\w$)\]\"'`}]|\+\+|--)\s*\Z")
_VALUE_FOLLOWS = re.compile(r"\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await)\s*\Z")


def _block_end(text: str, at: int) -> int:
    """Offset after the bracket that closes the first ``{`` at or after ``at``.

    Brackets in comments, strings, template texts and regular expressions do not count;
    those in the holes of templates do.
    """
    i = text.find("{", at)
    open_: list[str] = []
    while 0 <= i < len(text):
        if open_ and open_[-1] == "`":
            m = _TEMPLATE.match(text, i)
            i = m.end()
            if m[1] == "`":
                open_.pop()
            elif m[1]:
                open_.append("${")
            continue
        m = _SKIP.search(text, i)
        if not m:
            break
        i, mark = m.end(), m[0]
        if mark == "{" or mark == "`":
            open_.append(mark)
        elif mark == "}":
            if open_:
                open_.pop()
            if not open_:
                return i
        elif mark[0] == "/" and mark[1:2] not in ("/", "*"):
            before = text[max(0, m.start() - 40) : m.start()]
            if _VALUE_ENDS.search(before) and not _VALUE_FOLLOWS.search(before):
                i = m.start() + 1  # a division
    return len(text)


def script_symbols(text: str) -> list[tuple]:
    """Classes, methods, functions, arrow constants, interfaces, aliases and enums."""
    out = []

    def line(at: int) -> int:
        return text.count("\n", 0, at) + 1

    for m in _TS.finditer(text):
        kind = m.lastgroup if m.lastgroup != "name" else next(k for k in ("class", "interface", "enum", "type", "function", "arrow") if m[k])
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        stop = text.find("\n", m.end())
        stop = len(text) if stop < 0 else stop
        brace = text.find("{", m.end())
        if kind in ("class", "interface", "enum", "function") or 0 <= brace < stop:
            stop = _block_end(text, m.end())
        out.append((text[start:stop], line(start), line(max(start, stop - 1)), {"type": "type_alias", "arrow": "function"}.get(kind, kind), m["name"], m["name"]))
        if kind == "class":
            for k in _TSMETHOD.finditer(text, m.end(), stop):
                if k["name"] in ("if", "for", "while", "switch", "catch", "return"):
                    continue
                a = k.start() + len(k[0]) - len(k[0].lstrip())
                b = _block_end(text, k.end() - 1)
                out.append((text[a:b], line(a), line(b - 1), "method", k["name"], f"{m['name']}.{k['name']}"))
    return out


_ELEMENT = re.compile(r"<(script|style)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>([\s\S]*?)(?:</\1\s*>|\Z)", re.I)
_MODULE = re.compile(r"(?:^|\s)(?:module(?=\s|$)|context\s*=\s*[\"']?module\b)")


def markup_parts(text: str, budget: int = 350) -> list[tuple]:
    """Scripts (by symbol), styles and the packed template of a component file."""
    out = []
    for m in _ELEMENT.finditer(text):
        kind, data = m[1].lower(), m[3]
        first = text.count("\n", 0, m.start(3)) + 1
        if kind == "script" and _MODULE.search(m[2]):
            kind = "module"
        if kind == "style":
            out.append((data, first, first + data.count("\n"), "style", None, None))
            continue
        prefix = "module_" if kind == "module" else "script_"
        for body, a, b, k, name, path in script_symbols(data):
            out.append((body, first + a - 1, first + b - 1, prefix + k, name, path))
    rest = _ELEMENT.sub(lambda m: "\n" * m[0].count("\n"), text).split("\n")
    for a, b in pack_lines(rest, budget):
        body = "\n".join(rest[a:b])
        if body.strip():
            out.append((body, a + 1, b, "template", None, None))
    return out


CHUNKERS = {
    "python": python_symbols,
    "javascript": script_symbols,
    "typescript": script_symbols,
    "sql": sql_parts,
    "svelte": markup_parts,
}


def _plain(text: str, budget: int) -> list[tuple]:
    lines = text.split("\n")
    return [("\n".join(lines[a:b]), a + 1, b, None, None, None) for a, b in pack_lines(lines, budget) if "\n".join(lines[a:b]).strip()]


def chunk(files: DataFrame, budget: int = 350) -> DataFrame:
    """Chunks of every file by its language; a file that its chunker rejects, or without
    symbols, is cut into lines within the budget.

    ``files(file_id, path, language, text)``. ``symbol_path`` starts with the file's path.
    Null and empty texts have no chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    chunker = CHUNKERS.get(row.language)
                    if chunker in (sql_parts, markup_parts):
                        found = chunker(row.text, budget)
                    else:
                        found = chunker(row.text) if chunker else []
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                for n, (body, a, b, kind, name, path) in enumerate(found or _plain(row.text, budget)):
                    out.append((row.file_id, n, body, a, b, kind, name, f"{row.path}::{path}" if path else None))
            yield pd.DataFrame(out, columns=["file_id", "ordinal", "text", "start_line", "end_line", "symbol_kind", "symbol_name", "symbol_path"])

    return files.select("file_id", "path", "language", "text").filter("text is not null and text <> ''").mapInPandas(run, f"file_id long, ordinal int, {CHUNK}")
