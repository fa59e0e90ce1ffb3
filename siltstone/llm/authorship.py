"""Telling files that no contributor wrote by hand from hand-written sources.

Four kinds are told apart: ``generated`` (code, lock files, snapshots, source maps),
``minified``, ``vendored`` and ``data``. Phrases are matched with a multi-pattern automaton,
and only in the comments that open a file: a hand-written program that prints such a notice
holds it in a string further down. Path rules name vendored directories, lock files and
minified suffixes. A place or a phrase alone decides nothing where the contents can speak:
they are measured over the whole text.

Vendored copies often lose their banner. The longer lines of files that have one form a set
of known third-party lines; a file most of whose own longer lines are in that set is a copy
or a part of one, patched or not, wherever it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of generators' notices (lower case). Some say by themselves that the
# file is made by a tool.
NOTICES = (
    "@generated", "<auto-generated", "auto-generated", "autogenerated", "code generated", "automatically generated", "machine generated", "machine-generated",
    "machine written", "machine-written", "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "généré automatiquement", "generado automáticamente",
)
# Others only where what is made, or must not be touched, is this file (see ABOUT).
HINTS = (
    "generated file", "generated code", "fichier généré", "archivo generado", "generated by", "generated from", "generated with", "produced automatically", "produced by", "do not edit", "don't edit", "do not modify", "do not change", "edits", "changes", "modifications", "overwritten",
    "regenerate", "refresh this", "rebuild this", "nicht bearbeite", "nicht ändern", "ne pas modifier", "no editar", "no modificar",
)
#: What makes a hint a notice: the sentence is about the file at hand.
ABOUT = re.compile(
    r"^(?:generated|produced)\s+(?:by|from|with|automatically)\b"
    r"|^(?:this is |ceci est |este es )?(?:an? |un )?(?:generated (?:file|code)|fichier généré|archivo generado)\b"
    r"|\b(?:this|the) (?:file|module|code|source|class|document) (?:is|was|has been|has to be|must be)\b.*\b(?:generated|produced|created|built)\b"
    r"|\b(?:do not|don't|never) (?:edit|modify|change|touch)(?:\s+(?:(?:this|the) (?:file|module|code)|it|manually|directly|by hand|here|below))*\s*(?:[.;:,!]|$|\bmanually|\bby hand|\bdirectly)"
    r"|\b(?:edits|changes|modifications)\b[^.;]*\b(?:lost|overwritten|discarded|reverted)\b"
    r"|\bto (?:refresh|regenerate|rebuild|update) this (?:file|module|code)\b"
    r"|\bnicht (?:bearbeite|ändern)|\bne pas modifier\b|\bno (?:editar|modificar)\b"
)
# Phrases of hand-written comments about generated files.
DENIALS = ("unlike the", "not generated", "maintained by us", "maintained by hand", "written by hand", "hand-written", "handwritten", "hand written")
# Directories that hold third-party sources.
VENDORED = ("vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "extern", "external", "externals", "deps", "node_modules", "bower_components", "site-packages")
# Lock files.
LOCKS = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "pdm.lock", "cargo.lock", "gemfile.lock", "composer.lock", "go.sum", "flake.lock", "pipfile.lock", "bun.lock", "mix.lock", "podfile.lock")

CODE = re.compile(r"\.(py|pyi|pyw|js|mjs|cjs|jsx|ts|mts|cts|tsx|css|scss|java|go|rb|rs|c|h|cc|cpp|hpp|cs|php|swift|kt|lua|pl|r|scala|sh|bash|zsh)$")
BLOB_CODE = re.compile(r"\.(py|pyi|pyw|js|mjs|cjs|jsx|ts|mts|cts|tsx|java|go|rb|rs|c|h|cc|cpp|hpp|cs|php|swift|kt|lua|pl|r|scala)$")
WEB = re.compile(r"\.(js|mjs|cjs|jsx|css|scss|ts|mts|cts)$")
MIN_NAME = re.compile(r"[.-](min|bundle|chunk|prod|packed)\.(js|mjs|cjs|css)$")
GEN_NAME = re.compile(r"(^|/)(_generated|__generated__|generated|gen|proto|autogen)/|[._-](gen|generated|pb|pb2|pb2_grpc|g|designer)\.\w+$|_pb2?\.\w+$")
VENDOR_DIR = re.compile("(^|/)(" + "|".join(re.escape(v) for v in VENDORED) + ")/")
COMMENT = re.compile(r"\s*(#|//|/\*|\*|<!--|--|;|%)")
BANNER = re.compile(
    r"^\s*(/\*!?|//|#|\*|--|<!--)+\s*!?\s*@?(?P<name>[\w.@/-]+)\s+v?\d+\.\d+(\.\d+)?\b.*?(\(c\)|copyright|https?://|license|permission is granted|\bmit\b)", re.I
)
OTHERS = re.compile(r"(\(c\)|copyright)\s+(?:\d{4}\s+)?(the\s+)?[\w-]+\s+(project|authors|foundation|team)\b|permission is (hereby )?granted", re.I)
OWN = re.compile(r"license file of this repository", re.I)
SHAPE = re.compile(r"[A-Za-z_$][\w$]*|[0-9]+(?:\.[0-9]+)?|\"[^\"\n]*\"|'[^'\n]*'")
COUNTER = re.compile(r"(?<=[A-Za-z_])0*(\d+)\b")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
NUMBER = re.compile(r"\b0x[0-9a-fA-F]+\b|\b\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?")
WORDS = re.compile(r"[A-Za-z_$][\w$]*")

#: Characters of a line that counts when copies are looked for.
LONG_LINE = 24
#: Members numbered from 0 that are a mark by themselves.
MANY = 24


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sort, phrases in enumerate((NOTICES, HINTS, DENIALS)):
        for p in phrases:
            found.add_word(p, (sort, p))
    found.make_automaton()
    return found


DOCSTRING = re.compile(r"[rRuU]?(\"{3}|'{3})")
FIRST_STATEMENT = re.compile(r"(?:package|namespace)\s+[\w.]+;?\s*$|[\"']use strict[\"'];?\s*$|<\?php\s*$")


def header(text: str) -> str:
    """The comments that open a file, a docstring among them, on both sides of a package line.

    Shebangs are skipped.
    """
    out = []
    close = ""
    for line in text.lstrip("\ufeff").split("\n"):
        bare = line.strip()
        if close:
            out.append(line)
            close = "" if close in line else close
        elif not bare or line.startswith("#!") or FIRST_STATEMENT.match(bare):
            continue
        elif COMMENT.match(line):
            out.append(line)
            close = "*/" if bare.startswith("/*") and "*/" not in bare else ""
        elif m := DOCSTRING.match(bare):
            out.append(line)
            close = "" if m[1] in bare[m.end() :] else m[1]
        else:
            break
    return "\n".join(out)


_SIGNS = re.compile(r"^[\s/*#;%<!\-\"']+|[\s/*#;%>\-\"']+$")


def notice(automaton, opening: str) -> bool:
    """Whether the opening comments say that a tool wrote this file."""
    low = opening.lower()
    sorts = {sort for _, (sort, _p) in automaton.iter(low)}
    if 2 in sorts or not sorts:
        return False
    if 0 in sorts:
        return True
    # Sentences may run over several lines.
    plain = " ".join(_SIGNS.sub("", line) for line in low.split("\n"))
    return any(ABOUT.search(part.strip()) for part in [*re.split(r"(?<=[.!?])\s+", plain), *(_SIGNS.sub("", line) for line in low.split("\n"))])


def serial(text: str, placed: bool = False) -> bool:
    """Whether the body is a run of members numbered in sequence, of few shapes.

    The mark of generators: most lines repeat a handful of shapes (names and numbers
    masked), and the numbers within names count up without a gap. People number a few
    members too: without filled-up numbers (007) or a place for generated files
    (``placed``), only many members that begin with 0 are a mark.
    """
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x and not COMMENT.match(x)]
    if len(lines) < 6:
        return False
    found = [m for x in lines if (m := COUNTER.search(x))]
    numbers = [int(m.group(1)) for m in found]
    if len(numbers) < 5:
        return False
    if not placed and not any(m.group(0) != m.group(1) for m in found) and (numbers[0] != 0 or len(numbers) < MANY):
        return False
    steps = sum(b == a + 1 for a, b in zip(numbers, numbers[1:], strict=False))
    if steps < 0.8 * (len(numbers) - 1):
        return False
    shapes: dict[str, int] = {}
    for x in lines:
        s = SHAPE.sub("a", x)
        shapes[s] = shapes.get(s, 0) + 1
    often = sum(n for n in shapes.values() if n >= 3)
    return often >= 0.6 * len(lines)


FIRST_MEMBER = re.compile(r"[A-Za-z_]00+\b")


def cut_off(path: str, text: str) -> bool:
    """A generated file that ends early: its place says so, and its members begin at 000."""
    return len(text) < 1000 and bool(GEN_NAME.search(path)) and bool(FIRST_MEMBER.search(text))


def tool_written(path: str, text: str) -> bool:
    """Lock files, snapshots and source maps: by name and contents."""
    name = path.rsplit("/", 1)[-1].lower()
    if name.endswith(".map"):
        return '"mappings"' in text and '"version"' in text
    if name.endswith(".snap") or "/__snapshots__/" in path.lower():
        return "exports[`" in text or text.startswith("// Jest Snapshot")
    if name in LOCKS or name.endswith((".lock", "-lock.json", ".lock.json", "-lock.yaml")):
        pins = text.count("checksum") + text.count("integrity") + text.count("resolved") + text.count("sha256") + text.count("h1:")
        return "lockfileVersion" in text or "[[package]]" in text or pins >= 2
    return False


def minified(path: str, text: str) -> bool:
    """Scripts and styles without room between their words."""
    n = len(text)
    if n < 200 or not WEB.search(path):
        return False
    lines = text.count("\n") + 1
    blank = text.count(" ") + text.count("\t") + lines
    longest = max(map(len, text.split("\n")))
    body = STRING.sub('""', text)
    if len(body) < 0.25 * n:
        return False  # one large literal: data, not a script
    m = len(body)
    gaps = body.count(" ") + body.count("\n") + body.count("\t")
    dense = gaps < (0.09 if not path.endswith("css") else 0.06) * m
    return longest > 300 and blank < 0.12 * n and dense


def literal(path: str, text: str) -> bool:
    """Code that is nearly nothing but one literal."""
    if len(text) < 400 or not BLOB_CODE.search(path):
        return False
    lines = [x for x in text.split("\n") if x.strip() and not COMMENT.match(x)]
    body = "\n".join(lines)
    if len(body) < 400:
        return False
    rest = NUMBER.sub("", STRING.sub("", body))
    names = sum(map(len, WORDS.findall(rest)))
    return names <= 0.04 * len(body) + 60 and names < 0.25 * len(body) and len(WORDS.findall(rest)) <= 16


def line_hashes(text: str) -> list[int]:
    """Hashes of the distinct longer lines, comments left out."""
    lines = {x for line in text.split("\n") if len(x := line.strip()) >= LONG_LINE and not COMMENT.match(x)}
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - 2**63 for x in lines]


FEATURES = "file_id long, repo string, path string, kind string, banner boolean, third_party_dir boolean, lines array<long>"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = _automaton()
    for frame in batches:
        out = []
        for row in frame.itertuples(index=False):
            path, text = row.path or "", row.text
            low = path.lower()
            top = header(text)
            kind = None
            banner = bool(top) and bool(BANNER.search(top) or OTHERS.search(top)) and not OWN.search(top)
            if tool_written(path, text) or (CODE.search(low) and not low.endswith("css") and notice(automaton, top)):
                kind = "generated"
            elif minified(low, text):
                kind = "minified"
            elif literal(low, text):
                kind = "data"
            elif CODE.search(low) and (serial(text, bool(GEN_NAME.search(low))) or cut_off(low, text)):
                kind = "generated"
            is_code = bool(CODE.search(low))
            out.append((row.file_id, row.repo, path, kind, banner and is_code, bool(VENDOR_DIR.search(low)), line_hashes(text) if is_code and kind is None else []))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])


def not_hand_written(files: DataFrame, share: float = 0.6) -> DataFrame:
    """Rows ``file_id, repo, path, kind`` of the files that no contributor wrote by hand.

    ``kind`` is generated, minified, data or vendored, the first that holds. ``share`` is
    the part of a file's longer lines that must be known third-party lines for a copy.
    Null, empty and binary texts and null ids are never cases; repeated deliveries count once (any of
    them decides, as their contents agree); a null path counts as an empty one; ``ext`` and
    ``size_bytes`` may be wrong or null, so the path and the text themselves are used.
    """
    picked = files.select("file_id", "repo", "path", "text").filter("file_id is not null and text is not null and text <> ''")
    measured = picked.mapInPandas(_measure, FEATURES)
    return classify(measured, share)


def classify(measured: DataFrame, share: float) -> DataFrame:
    from ..session import cut_lineage

    # Three readers follow; the texts are measured once.
    seen = cut_lineage(measured)
    lines = seen.filter("kind is null and size(lines) >= 2").select("file_id", "repo", "banner", "third_party_dir", F.explode("lines").alias("line"))
    known = (
        lines.filter("banner or third_party_dir")
        .groupBy("line")
        .agg(F.max("banner").alias("banner"), F.min("repo").alias("r0"), F.max("repo").alias("r1"))
        .filter("banner or r0 <> r1")
        .select("line")
    )
    hits = lines.select("file_id", "line").distinct().join(known, "line", "left_semi").groupBy("file_id").agg(F.count("*").alias("n"))
    total = seen.filter("kind is null").select("file_id", "repo", "path", F.size("lines").alias("size"), "banner", "third_party_dir")
    # A few lines prove nothing by themselves, but in a vendored place all of them known do.
    short = F.col("third_party_dir") & (F.col("size") >= 2) & (F.col("n") == F.col("size"))
    copies = total.join(hits, "file_id", "left").filter(F.col("banner") | short | (F.col("n") >= F.greatest(F.lit(3), F.col("size") * share)))
    found = seen.filter("kind is not null").select("file_id", "repo", "path", "kind").unionByName(copies.select("file_id", "repo", "path", F.lit("vendored").alias("kind")))
    return found.groupBy("file_id").agg(F.min(F.struct("repo", "path", "kind")).alias("r")).select("file_id", "r.*")
