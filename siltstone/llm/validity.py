"""Source files that do not parse in their language.

Texts are cut into tokens, brackets and blocks are folded, and the sequences are parsed by
generalised LL (see :mod:`gll`). A file is flagged when every dialect of its language
rejects it.
"""

from __future__ import annotations

import json
import sys
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_language
from .gll import Recogniser
from .grammars import CUTS, LANGUAGES, Invalid

CHECKED = tuple(LANGUAGES)


def _constant(name: str) -> None:
    raise ValueError(name)


def _exact(language: str, text: str) -> bool | None:
    """The verdict of a reference parser that the interpreter ships, where there is one."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "<text>", "exec", flags=1024, dont_inherit=True)  # to a syntax tree only
        elif language == "json":
            json.loads(text, parse_constant=_constant)
        elif language == "toml":
            tomllib.loads(text.replace("\r\n", "\n"))
        else:
            return None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


class Parser:
    """Recognisers by language; what they have learnt serves the texts that follow."""

    def __init__(self):
        self.of = {name: Recogniser(grammar) for name, (grammar, _, _) in LANGUAGES.items()}
        for name, (rules, cut) in CUTS.items():
            grammar = LANGUAGES[name][0]
            self.of[name].cuts = {grammar.names[r]: cut for r in rules}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

    def accepts(self, language: str, text: str) -> bool:
        grammar, lexer, starts = LANGUAGES[language]
        rec = self.of[language]
        rec.trim()
        try:
            return rec.derives(tuple(grammar.names[s] for s in starts), tuple(lexer(text, rec)))
        except (Invalid, RecursionError):
            return False

    def valid(self, language: str, text: str) -> bool:
        """Accepted by the grammar, or by the exact parser that reviews a rejection."""
        return self.accepts(language, text) or bool(_exact(language, text))


VERDICTS = "file_id long, repo string, path string, language string, valid boolean"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parser = Parser()
    for frame in batches:
        frame["valid"] = [parser.valid(lang, text) for lang, text in zip(frame["language"], frame["text"], strict=True)]
        yield frame[["file_id", "repo", "path", "language", "valid"]]


def check_files(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows ``file_id, repo, path, language, valid`` for files of the checked languages.

    The language follows from the path's extension. Null texts (binary files) and null ids are left out;
    an empty Python, JavaScript, TypeScript, TOML or shell file is valid, empty JSON is not.
    Repeated deliveries of a file count once: their contents agree, so the smallest verdict
    stands for all. Other columns are ignored.
    """
    picked = with_language(files.select("file_id", "repo", "path", "text").filter("file_id is not null and text is not null"), limits)
    some = picked.filter(F.col("language").isin(*CHECKED)).select("file_id", "repo", "path", "language", "text")
    judged = some.mapInPandas(_judge, VERDICTS)
    return judged.groupBy("file_id").agg(F.min(F.struct("valid", "repo", "path", "language")).alias("r")).select("file_id", "r.repo", "r.path", "r.language", "r.valid")


def rates(verdicts: DataFrame) -> DataFrame:
    """Files, invalid files and their share by repository and language."""
    return verdicts.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"),
        F.sum((~F.col("valid")).cast("long")).alias("n_invalid"),
        F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_rate"),
    )
