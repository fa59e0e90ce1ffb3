"""Text, path and identifier expressions. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that ends a line (line feeds aside), as a character class body.
BLANKS = r"\t\x0B-\x0D\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: the line that parts a chunk's text from the search terms appended to it.
SENTINEL = "\n--search-terms--\n"
# Language by extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "typescript", "md": "markdown", "mdx": "markdown", "markdown": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sql": "sql",
    "sh": "shell", "bash": "shell", "zsh": "shell", "html": "html", "css": "css", "svelte": "svelte", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "php": "php",
}
# Language of files that are known by name.
NAMED = {"readme": "markdown", "makefile": "make", "dockerfile": "docker", "license": "text"}
# Words that mark a query about identifiers, and one that asks for examples.
IDENTIFIER_MARKS = ("function", "class ", "method", "variable", "()", "_", "::", "->")
EXAMPLE_MARKS = ("example", "how to", "how do", "usage", "sample")


def canonical(text: Column) -> Column:
    """LF line ends, no trailing blanks, no blank lines at the edges, one final LF.

    Null stays null; an empty or blank text becomes a single LF.
    """
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    bare = F.regexp_replace(unix, rf"[{BLANKS}]+(?=\n|\z)", "")
    return F.concat(F.regexp_replace(bare, r"\A\n+|\n+\z", ""), F.lit("\n"))


def text_hash(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(text), 256)


def verify_hash(text: Column, expected: Column) -> Column:
    return text_hash(text) == F.lower(expected)


def content_id(repo: Column, file: Column, hash_: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the three parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", repo.cast("string"), file.cast("string"), hash_), 256), 1, 32)


def row_id(repo: Column, file: Column, model: Column, hash_: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", *(c.cast("string") for c in (repo, file, model, hash_, start, end)))


def parse_row_id(id_: Column) -> Column:
    """Struct of the six parts; null for an id of fewer parts (a content id)."""
    parts = F.split(id_, ":")
    return F.when(
        F.size(parts) >= 6,
        F.struct(
            parts[0].alias("repo"), parts[1].alias("file"), parts[2].alias("model"), parts[3].alias("text_hash"),
            parts[4].try_cast("int").alias("start_line"), parts[5].try_cast("int").alias("end_line"),
        ),
    )


def camel_parts(name: Column) -> Column:
    """Lower-case words of a camel-case name; an empty name has none."""
    marked = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(marked), " "), lambda w: w != "")


def path_parts(path: Column) -> Column:
    """Lower-case parts of a path without the last part's extensions."""
    return F.filter(F.split(F.lower(F.regexp_replace(path, r"\.[^/\\]+$", "")), r"[/\\]"), lambda w: w != "")


def enrich(text: Column, path: Column, name: Column, qualified: Column) -> Column:
    """The text with the distinct words of its path and symbol appended below a sentinel."""
    none = F.array().cast("array<string>")
    symbol = F.coalesce(camel_parts(name), none)
    inner = F.flatten(F.transform(F.split(F.coalesce(qualified, F.lit("")), r"[./]"), camel_parts))
    words = F.array_distinct(F.concat(F.coalesce(path_parts(path), none), symbol, inner))
    return F.when(F.size(words) == 0, text).otherwise(F.concat(text, F.lit(SENTINEL), F.concat_ws(" ", words)))


def strip_enrichment(text: Column) -> Column:
    return F.substring_index(text, SENTINEL, 1)


def extension_of(path: Column) -> Column:
    """Lower-case extension without its dot, of the last part; empty without one."""
    return F.regexp_extract(F.lower(path), r"[^/]\.([^./]+)$", 1)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def language_of(path: Column) -> Column:
    """Language by name, then by extension, else text."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    stem = F.regexp_extract(base, r"^([^.]*)", 1)
    return F.coalesce(_lookup(stem, NAMED), _lookup(extension_of(path), LANGUAGES), F.lit("text"))


def language_token(value: Column) -> Column:
    """A language as users write it, brought to the names used here."""
    low = F.lower(F.trim(value))
    return F.coalesce(_lookup(low, LANGUAGES), low)


def query_type(query: Column) -> Column:
    """identifier, example or concept: the first whose marks the query holds."""
    low = F.lower(query)
    has = lambda marks: F.greatest(*(F.contains(low, F.lit(m)).cast("int") for m in marks)) == 1
    return F.when(has(IDENTIFIER_MARKS), "identifier").when(has(EXAMPLE_MARKS), "example").otherwise("concept")


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def edge_feeds(text: Column) -> Column:
    """Line feeds at the start and the end of a text, and the text without them."""
    lead = F.length(F.regexp_extract(text, r"\A(\n*)", 1))
    bare = F.regexp_replace(text, r"\A\n+|\n+\z", "")
    return F.struct(lead.alias("leading"), (F.length(text) - lead - F.length(bare)).alias("trailing"), bare.alias("text"))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive, cut at the end of the text)."""
    return F.concat_ws("\n", F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def link(repo: Column, path: Column, start: Column, end: Column) -> Column:
    return F.format_string("kb://%s/%s#L%d-L%d", repo, path, start, end)


def snippet(text: Column, start: Column, end: Column, before: int = 2, after: int = 2, max_tokens: int = 400) -> Column:
    """Lines around a match within a budget of four characters a token.

    The match comes first and is cut if it alone is too long; what is left is halved: the
    lines before keep their tail, the lines after their head.
    """
    lines = F.split(text, "\n")
    piece = lambda a, b: F.concat_ws("\n", F.slice(lines, F.greatest(a, F.lit(1)), F.greatest(b - F.greatest(a, F.lit(1)) + 1, F.lit(0))))
    head, body, tail = piece(start - before, start - 1), piece(start, end), piece(end + 1, end + after)
    room = max_tokens * 4
    half = F.greatest(F.floor((room - F.length(body)) / 2), F.lit(0)).cast("int")
    whole = F.length(head) + F.length(body) + F.length(tail) <= room
    return F.struct(
        F.when(whole, head).otherwise(F.when(half > 0, F.substring(head, F.greatest(F.length(head) - half + 1, F.lit(1)), half)).otherwise("")).alias("before"),
        F.substring(body, F.lit(1), F.lit(room)).alias("match"),
        F.when(whole, tail).otherwise(F.substring(tail, F.lit(1), half)).alias("after"),
    )


# Media types by language.
MEDIA = {"python": "text/x-python", "javascript": "text/javascript", "typescript": "text/typescript", "markdown": "text/markdown", "json": "application/json", "yaml": "application/yaml", "html": "text/html", "css": "text/css", "toml": "application/toml", "shell": "application/x-sh", "sql": "application/sql"}


def fence_language(path: Column) -> Column:
    """The name after the back-ticks of a code fence; empty for plain text."""
    lang = language_of(path)
    return F.when(lang == "text", "").when(lang == "shell", "bash").otherwise(lang)


def media_type(path: Column) -> Column:
    return F.coalesce(_lookup(language_of(path), MEDIA), F.lit("text/plain"))


def normal_path(path: Column) -> Column:
    """A path without leading ``./`` or ``/`` and without trailing ``/``; dot files keep their dot."""
    return F.rtrim(F.regexp_replace(path, r"^(?:\./+|/+)+", ""), F.lit("/"))


def masked(value: Column) -> Column:
    """A log value with secrets masked and cut to 200 characters."""
    hidden = F.regexp_replace(value, r"(?i)((?:password|secret|token|api[_-]?key)\s*[=:]\s*)\S+", "$1***")
    return F.when(F.length(hidden) > 200, F.concat(F.substring(hidden, 1, 200), F.lit("..."))).otherwise(hidden)


def cache_key(query: Column, params: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", query, params), 256), 1, 16)


def encode_cursor(query: Column, score: Column, id_: Column) -> Column:
    """URL-safe base64 of the query's fingerprint, the last score and the last id."""
    body = F.to_json(F.struct(F.substring(F.sha2(query, 256), 1, 8).alias("q"), score.alias("s"), id_.alias("i")))
    return F.translate(F.base64(body.cast("binary")), "+/", "-_")


def decode_cursor(cursor: Column, query: Column) -> Column:
    """The cursor's struct, or null when it is malformed or of another query."""
    raw = F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64"))
    got = F.from_json(raw.cast("string"), "q string, s double, i string")
    return F.when(got["q"] == F.substring(F.sha2(query, 256), 1, 8), got)
