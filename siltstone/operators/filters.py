"""Filters on ranked hits and on vector rows, built as expressions, never as strings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_path


def under(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether a path is one of the prefixes or lies below one; an empty prefix holds all."""
    out = F.lit(False)
    for p in prefixes:
        p = re.sub(r"^(?:\./+|/+)+", "", p).rstrip("/")
        out = out | (F.lit(True) if not p else (normal_path(path) == p) | normal_path(path).startswith(p + "/"))
    return out


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; ``*`` also crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


def matches(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the whole path or its last part matches one of the shell patterns."""
    out = F.lit(False)
    for p in patterns:
        rx = glob_regex(p)
        out = out | path.rlike(rx) | F.regexp_extract(path, r"([^/]*)$", 1).rlike(rx)
    return out


# What an index leaves out by default, and what it must never hold.
IGNORED = ("node_modules", ".git", "__pycache__", "dist", "build", ".venv", "*.min.js", "*.lock", "*.map")
SECURITY = (".env", ".env.*", "*.pem", "id_rsa", "*.key", ".netrc", ".npmrc")


def ignored(path: Column, patterns: Sequence[str] = IGNORED, exceptions: Sequence[str] = (), security: Sequence[str] = SECURITY) -> Column:
    """Whether a path is left out: a pattern without a slash matches any part of the path.

    Exceptions remove patterns; security patterns always hold.
    """
    parts = []
    for p in [*[p for p in patterns if p not in exceptions], *security]:
        body = glob_regex(p.strip("/"))[5:-2].replace(".*", "[^/]*") if "/" not in p.strip("/") else glob_regex(p.strip("/"))[5:-2]
        parts.append(f"(?:^|/){body}(?:/|$)" if "/" not in p.strip("/") else f"^{body}(?:/|$)")
    return F.coalesce(path.rlike("|".join(parts)), F.lit(False)) if parts else F.lit(False)


@dataclass
class Criteria:
    """What vector rows to search; empty lists and nulls do not restrict."""

    repos: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    min_tokens: int | None = None
    max_tokens: int | None = None
    exclude_paths: list[str] = field(default_factory=list)
    include_globs: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)

    def column(self) -> Column | None:
        parts: list[Column] = []
        for name, values in (("repo", self.repos), ("language", self.languages), ("symbol_kind", self.kinds)):
            if values:
                parts.append(F.col(name).isin(*values))
        if self.min_tokens:
            parts.append(F.col("token_count") >= self.min_tokens)
        if self.max_tokens:
            parts.append(F.col("token_count") <= self.max_tokens)
        parts += [~F.col("path").startswith(p) for p in self.exclude_paths]
        parts += [~F.col("path").rlike(glob_regex(g)) for g in self.exclude_globs]
        if self.include_globs:
            parts.append(F.greatest(*(F.col("path").rlike(glob_regex(g)) for g in (self.include_globs * 2)[: max(2, len(self.include_globs))])))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        cond = self.column()
        return df if cond is None else df.filter(cond)


def combine(*criteria: Criteria) -> Criteria:
    """Lists are united (sorted), the token range is the overlap of the ranges."""
    out = Criteria()
    for f in fields(Criteria):
        if f.name not in ("min_tokens", "max_tokens"):
            setattr(out, f.name, sorted({v for c in criteria for v in getattr(c, f.name)}))
    lows = [c.min_tokens for c in criteria if c.min_tokens]
    highs = [c.max_tokens for c in criteria if c.max_tokens]
    out.min_tokens, out.max_tokens = (min(lows) if lows else None), (max(highs) if highs else None)
    return out


def hits(df: DataFrame, repos: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), exclude_globs: Sequence[str] = ()) -> DataFrame:
    """Ranked hits after the repository, path and pattern filters; scores are untouched."""
    if repos:
        df = df.filter(F.col("repo").isin(*repos))
    if include:
        df = df.filter(under(F.col("path"), include))
    if exclude:
        df = df.filter(~under(F.col("path"), exclude))
    if exclude_globs:
        df = df.filter(~matches(F.col("path"), exclude_globs))
    return df


def after_cursor(score: Column, id_: Column, last_score: float, last_id: str) -> Column:
    """Hits behind the last one of the previous page (score falling, id rising)."""
    return (score < last_score) | ((F.abs(score - last_score) < 1e-9) & (id_ > last_id))


def contained(path: Column) -> Column:
    """Whether a relative path stays below its base: no absolute path, no step above it."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            F.when(p == "..", s["d"] - 1).when((p == "") | (p == "."), s["d"]).otherwise(s["d"] + 1).alias("d"),
            F.least(s["low"], F.when(p == "..", s["d"] - 1).otherwise(s["d"])).alias("low"),
        ),
    )
    return ~path.startswith("/") & ~F.contains(path, F.lit("\x00")) & (depth["low"] >= 0)
