"""Credentials embedded in source code: finding and redacting them.

Literals in assignment contexts (a telling name before ``=`` or ``:``, an authorization
header, the user part of a URL, a prose mention) are segmented into dictionary words by
Viterbi over a public tokenizer's vocabulary. What the words cannot explain is the
residual: a value with a residual is a secret, a value that words explain wholly is a name,
a placeholder or a reference. Hashes, checksums, commit ids, UUIDs and public keys are
known formats and no secrets, unless the name before them says that they are used as one.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, solid

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# What a name must hold for its value to be a credential.
TELLING = (
    r"(?<![a-z])pw(?![a-z])|pass(?:(?:word|wd|phrase|code)s?)?(?![a-z])|pwds?(?![a-z])|secret|token(?!iz|_?count)|"
    r"(?:api|access|private|signing|encryption|auth|account|service|master|shared)[ _-]?key|credential|authorization"
)
# Prefixes that issuers give their keys.
ISSUED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}\b|AIza[0-9A-Za-z_-]{20,}|gh[pousr]_[0-9A-Za-z]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}|"
    r"sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{16,}|npm_[0-9A-Za-z]{20,}|pypi-[\w-]{16,}|hf_[0-9A-Za-z]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_[0-9a-f]{32,}|"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"
)
# Values that stand for a credential without being one.
PLACEHOLDER = re.compile(
    r"^$|change[_-]?me|replace[_-]|your[_-]|_here\b|-here\b|example|placeholder|dummy|redacted|todo|tbd|^none$|^null$|^nil$|^true$|^false$|^undefined$|"
    r"^<.*>$|^\[.*\]$|^(.)\1*$|x{6,}|\*{3,}|\.{3}|^\$|\$\{|\{\{|^%\(|%[sd]|^\{|^vault[:/]|/secret|^env[.:(]|secretsmanager|^ref\+|^op://|^arn:|^!|^process\.|^os\.|^file:",
    re.I,
)
# Names of digests, as whole parts of a name; and their formats.
DIGEST_NAME = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?=[A-Z][a-z])|(?i:(?<=password)|(?<=passwd)|(?<=secret)|(?<=token)|(?<=key)|(?<=commit)|(?<=git)))"
    r"(?i:hash(?:e[sd])?|sha\d*(?:sum)?|digests?|checksums?|integrity|commits?|etags?|fingerprints?|md5(?:sum)?|crc\d*|revisions?|public)(?![a-z])(?!(?<=[A-Z])[A-Z])"
)
DIGEST = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|sha\d+[-:=].+|\$2[aby]\$.+|\$(?:argon2|pbkdf2|scrypt|5|6)\S+|\{?ssha\}?.+)$", re.I)
UUID = re.compile(r"^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$", re.I)

TELL = re.compile(TELLING, re.I)
BEFORE = re.compile(r"[\w.$/:@-]*$")
KEYED = re.compile(r"[\w.-]*[\"'`]?\]?\s*(?::\s*[\w\[\]| .<>]{1,40}?=|=>|:=|\?=|\|\|=|[:=]|,(?=\s*[\"'`]))", re.I)
#: A value on the line after the name's.
CONTINUED = re.compile(r"\n[ \t]+[\"'][^\n]*")
PROSE = re.compile(r"(?:\s+key)?s?\s+(?:is|was|of|to|=|:)?\s*[`\"'](?P<value>[^`\"'\s]{6,})[`\"']", re.I)
PLAIN = re.compile(r"(?:\s+key)?\s*(?::|=|\bis\b|\bwas\b)\s*(?P<value>[^\s`\"',;]{6,})", re.I)
PAIR = re.compile(r"[\w.-]*[\"']?\s*,?\s*[\"']?value[\"']?\s*[:=]\s*[\"']?(?P<value>[^\s\"',}]{6,})", re.I)
NETRC = re.compile(r"\b(?:login|user(?:name)?)\s+\S+\s+password\s+(?P<value>\S{4,})", re.I)
FLAG = re.compile(r"(?:--?(?:password|passwd|pass|token|api-key|secret)(?:=|\s+))[\"']?(?P<value>[^\s\"'$]{6,})|\s-u\s*[\"']?[\w.-]+:(?P<user>[^\s\"'$@]{4,})")
HEADER = re.compile(r"\b(?P<scheme>Bearer|Basic|Token)\s+(?P<value>[\w.~+/=-]{8,})")
URL = re.compile(r"://(?P<user>[^\s/:@\"'`]*):(?P<value>[^\s/@\"'`]{3,})@[\w.-]+", re.I)
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KNOWN = re.compile(rf"(?<![\w/+-])(?:{ISSUED})")
QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
#: What stands between a telling name's separator and the list or mapping that it holds.
OPENING = re.compile(
    r"[ \t]*(?:[^\n=\"'`({]{1,60}=(?![=>])\s*)?(?:(?:new\s+)?(?:frozenset|set|list|tuple|dict|Set|Map|Array(?:\.of|\.from)?|List\.of|Set\.of|Object\.freeze|Arrays\.asList|vec!|\[\d*\]\w+|map\[\w+\]\w+|\w+\[\])\s*(?:\(\s*)?)?(?=[\[({])"
)
#: Parts of a list or mapping: quoted values, separators and brackets, bare values.
PART = re.compile(rf"(?P<quoted>{QUOTED.pattern})|(?P<open>[\[({{])|(?P<close>[\])}}])|(?P<note>(?<![^\s,])(?:#|//)[^\n]*)|(?P<next>[,;])|(?P<bare>[^\s\"'`,;(){{}}\[\]]+)")
ENDED = re.compile(r"\s*(?:[,\])}]|#|//|\Z)")
#: A version number, as lock files list them.
VERSION = re.compile(r"[v^~<>= ]*\d+(?:\.\d+)+(?:[-+.]\w+)*")
IS_KEY = re.compile(r"\s*(?:=>|[:=](?![:=]))")
#: A line of a block list or mapping of YAML.
BLOCK = re.compile(r"(?P<indent>[ \t]*)(?P<dash>(?:-[ \t]+)*)(?:(?P<key>[\w.$/-]+|\"[^\"\n]*\"|'[^'\n]*'):(?:[ \t]+|$))?(?P<value>\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'\[{#&*|>][^\n]*?)?[ \t]*(?:[ \t]#.*)?$")
BARE = re.compile(r"\s*(?P<v>[^\s\"'`,;#(){}\[\]]+)")
#: What a text must hold to be looked at; implied by every pattern above.
TRIGGER = (
    rf"(?i)pass|pwd|\bpw|secret|token(?:[\w.-]*[\"'`]?\]?\s*[:=,|?]|s?\s+(?:is|was|of|to|[`\"'])|[\w.-]*[\"']?,?\s+[\"']?value)|[a-z][ _-]?key|credential|authorization|"
    rf"://[^\s/@]*:[^\s/@]*@|-----BEGIN|\b(?:bearer|basic|token)\s|\s-u\s|--token|{ISSUED}"
)


def vocabulary(path: str = VOCABULARY, least: int = 3) -> dict[str, float]:
    """Words of a public tokenizer with their cost: the logarithm of their rank."""
    words: dict[str, float] = {}
    with open(path, "rb") as lines:
        for line in lines:
            raw, _, rank = line.rstrip().partition(b" ")
            word = base64.b64decode(raw).decode("utf-8", "ignore").strip().lower()
            if len(word) >= least and word.isascii() and word.isalpha():
                cost = 2.0 + math.log(int(rank) + 2)
                words[word] = min(cost, words.get(word, cost))
    return words


def segment(value: str, words: dict[str, float], unknown: float = 6.0) -> list[tuple[str, bool]]:
    """The cheapest split of a value into dictionary words and unexplained characters.

    A word must be written in one case (lower, Capitalised or UPPER) to count; a character
    outside words costs ``unknown``.
    """
    n = len(value)
    low = value.lower()
    best = [0.0] * (n + 1)
    back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
    for i in range(1, n + 1):
        best[i], back[i] = best[i - 1] + (unknown if value[i - 1].isalnum() else 0.5), (i - 1, False)
        for j in range(max(0, i - 18), i - 2):
            cost = words.get(low[j:i])
            if cost is not None and best[j] + cost < best[i]:
                w = value[j:i]
                if w.islower() or w.isupper() or (w[0].isupper() and w[1:].islower()):
                    best[i], back[i] = best[j] + cost, (j, True)
    out = []
    i = n
    while i:
        j, known = back[i]
        out.append((value[j:i], known))
        i = j
    return out[::-1]


def residual(value: str, words: dict[str, float]) -> int:
    """Letters and digits that no dictionary word explains.

    Words of three letters explain a value only beside longer ones: in random text they
    turn up by chance.
    """
    parts = segment(value, words)
    long_ = sum(len(p) for p, known in parts if known and len(p) >= 4)
    short = sum(len(p) for p, known in parts if known and len(p) == 3)
    left = sum(c.isalnum() for p, known in parts if not known for c in p)
    return left + (short if short > long_ else 0)


def _like_digest(value: str) -> bool:
    """Whether a value has the form of a digest: hexadecimal, or base64 of a digest's size."""
    if re.fullmatch(r"(?:0x)?[0-9a-fA-F]{7,}", value) or re.match(r"\w+:\w+[:$]", value):
        return True
    if not re.fullmatch(r"[\w+/-]{22,}={0,2}", value):
        return False
    return len(value.rstrip("=")) * 3 // 4 in (16, 20, 28, 32, 48, 64)


def is_secret(name: str, value: str, words: dict[str, float]) -> bool:
    """Whether a value in the context of a telling name is a usable credential."""
    value = value.strip()
    if len(value) < 6 or PLACEHOLDER.search(value) or UUID.match(value):
        return False
    if re.search(r"\{[^{}]*\}", value):
        return False
    if re.search(r"\s", value) and not re.fullmatch(ISSUED, value):
        return False
    if DIGEST.match(value) and not re.fullmatch(r"[0-9a-fA-F]+", value):
        return False
    if DIGEST_NAME.search(name) and (not TELL.search(name) or _like_digest(value)):
        return False
    if value.startswith(("ssh-", "AAAA", "http://", "https://", "./", "../", "/", "data:")):
        return False
    if len(value) < 20 and not any(c.isdigit() for c in value) and (value.islower() or value.isupper()):
        return False  # a name that the vocabulary happens not to hold
    return residual(value, words) >= 2


def _keyed(name: str, text: str, at: int, end: int, words: dict[str, float], seen: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the secret values after a telling name, and how far quoted values were judged.

    ``at`` to ``end`` is what follows the separator. Values up to ``seen`` were judged for a
    name before; of them only the one right behind this name is judged again.
    """
    out: list[tuple[int, int]] = []
    quotes = QUOTED.finditer(text, at, end)
    first = next(quotes, None)
    bare = BARE.match(text, at, end)
    if bare and (first is None or bare.start("v") < first.start()):
        v = bare["v"]
        after = text[bare.end() : min(end, bare.end() + 1)]
        if v and not _is_code(v, after) and re.search(r"[A-Za-z]", v) and is_secret(name, v, words):
            return [bare.span("v")], seen
        head = text[at : min(end, at + 200)]
        if re.match(r"^[\"'`]", head.lstrip()) is None and not re.match(r"\s*(?:process\.env|os\.|env|\w+\(|\w+\.\w+|\(|await|new|f?[\"']|\{)", head):
            return [], seen
    q, last, n = first, at, 0
    while q is not None and not (n and q.start() < seen):
        g = next(i for i in (1, 2, 3) if q[i] is not None)
        between = text[max(last, q.start() - 200) : q.start()] if n else ""
        ahead = text[max(at, q.start() - 200) : q.start()].rstrip()
        behind = text[q.end() : min(end, q.end() + 40)].lstrip()
        # Behind a value, only further values of the same list; behind others, no value of another name.
        if (out and not re.fullmatch(r"\s*(?:,|or|\|\||\?\?|:)\s*", between)) or (n > 2 and re.search(r"[\w\])\"'`]\s*[:=]\s*$|;", between)):
            break
        # A further name and its own value: not this name's.
        if n and ahead.endswith((",", ";")) and behind.startswith((":", "=")):
            break
        if HEADER.match(q[g]) or (not n and behind.startswith((":", "=>"))):
            break
        if not ahead.endswith(("[", "environ[")) and is_secret(name, q[g], words):
            out.append(q.span(g))
        last, n, q = q.end(), n + 1, next(quotes, None)
    return out, max(seen, last) if not DIGEST_NAME.search(name) else seen


def _is_code(v: str, after: str) -> bool:
    """Whether a bare value is a name, a member or a call, no literal."""
    return after in ("(", "[", "{") or bool(re.match(r"^[A-Za-z_$][\w$]*(?:[.?!]+[A-Za-z_$][\w$]*)*!?$", v) and not re.search(r"\d", v))


def _held(text: str, at: int) -> Iterator[tuple[str, int, int, bool]]:
    """Elements (own name, start, end, quoted) of the list or mapping that opens at a bracket.

    The names of a mapping are no elements; a list without its end runs to the end of the text.
    """
    names: list[str] = []
    indexes: list[int] = []  # depths of x[...], whose contents are no elements
    for m in PART.finditer(text, at):
        if m["open"]:
            if names and m["open"] == "[" and re.match(r"[\w\])]", text[m.start() - 1]):
                indexes.append(len(names))
            names.append("")
        elif m["close"]:
            names.pop()
            if not names:
                return
            if indexes and indexes[-1] == len(names):
                indexes.pop()
        elif indexes:
            continue
        elif m["next"]:
            names[-1] = ""
        elif m["quoted"] is not None:
            g = next(i for i in (2, 3, 4) if m[i] is not None)
            if IS_KEY.match(text, m.end()):
                names[-1] = m[g]
            else:
                yield next((n for n in reversed(names) if n), ""), m.start(g), m.end(g), True
        elif m["bare"]:
            v = m["bare"]
            key = re.match(r"([A-Za-z_$][\w.$-]*)(?::|=>|=(?=$|[^=]))", v)
            if key or (re.fullmatch(r"[A-Za-z_$][\w.$-]*", v) and IS_KEY.match(text, m.end())):
                names[-1] = key[1] if key else v
                skip = key.end() if key else len(v)
            else:
                skip = re.match(r"(?:=>|[:=])?", v).end()
            alone = (key or text[max(at, m.start() - 200) : m.start()].rstrip()[-1:] in tuple("[({,:=>")) and ENDED.match(text, m.end())
            if len(v) > skip and alone and not _is_code(v[skip:], ""):
                yield next((n for n in reversed(names) if n), ""), m.start() + skip, m.end(), False


def _block(text: str, name_at: int, at: int) -> Iterator[tuple[str, int, int, bool]]:
    """Elements of the YAML list or mapping on the deeper lines that follow."""
    first = text.rfind("\n", 0, name_at) + 1
    outer = len(re.match(r"[ \t]*(?:-[ \t]+)*", text[first:name_at])[0])
    while at < len(text):
        stop = text.find("\n", at + 1)
        stop = len(text) if stop < 0 else stop
        line = text[at + 1 : stop].rstrip("\r")
        if line.strip() and not line.lstrip().startswith("#"):
            m = BLOCK.match(line)
            depth = len(line) - len(line.lstrip())
            if depth < outer or (depth == outer and not line.lstrip().startswith("- ")) or not m:
                return
            if m["value"] and (m["dash"] or m["key"]):
                quoted = m["value"][0] in "\"'"
                a, b = m.start("value") + quoted, m.end("value") - quoted
                if quoted or not _is_code(m["value"], ""):
                    yield (m["key"] or "").strip("\"'"), at + 1 + a, at + 1 + b, quoted
        at = stop


def _collected(name: str, text: str, name_at: int, hit: re.Match, words: dict[str, float]) -> list[tuple[int, int]]:
    """Spans of the secret values in the list or mapping after a telling name, over all its lines."""
    at = hit.end()
    separator = text[hit.start() : at]
    if re.match(r"[ \t]*(?:#[^\n]*)?\r?\n", text[at : at + 200]) and separator.rstrip().endswith(":"):
        found = _block(text, name_at, text.index("\n", at))
    elif opening := OPENING.match(text, at):
        # The body of a function of a parameter with a telling name is no mapping.
        if "=>" in separator and not re.search(r"[\"'`]", separator):
            return []
        found = _held(text, opening.end())
    else:
        return []
    out = []
    for own, a, b, quoted in found:
        v = text[a:b]
        if (quoted or re.search(r"[A-Za-z]", v)) and not HEADER.match(v) and not VERSION.fullmatch(v) and is_secret(f"{name}.{own}" if own else name, v, words):
            out.append((a, b))
    return out


#: A line of a private key: its base64 text or a header, in quotes and comment signs or not.
KEY_LINE = re.compile(r"[\s\"'`+,;>|#*()]*(?:[\w-]+:[^\n]*|(?:[A-Za-z0-9+/]{4,}={0,2}(?:\\[nr])*[\"'`+,;\s]*)+)?(?:\\)?$")


def _key_end(text: str, at: int) -> int | None:
    """Where the private key ends whose BEGIN line ends at ``at``; None where no key follows."""
    body = re.match(r"(?:\\[nr]|[\s\"'`+,;>|#*\\]|[\w-]+:[^\n]*\n)*(?=[A-Za-z0-9+/]{16}|[A-Za-z0-9+/]{4,}={0,2}[\s\"'`+,;\\]{0,6}-----END)", text[at : at + 1000])
    if not body:
        return None
    end = END.search(text, at)
    if end and not BEGIN.search(text, at, end.start()):
        return end.end()
    # Cut off: as far as lines look like a key's.
    stop = at
    while stop < len(text):
        nxt = text.find("\n", stop + 1)
        nxt = len(text) if nxt < 0 else nxt
        if not KEY_LINE.match(text[stop:nxt]):
            break
        stop = nxt
    return max(stop, min(len(text), at + body.end() + 16))


def find(text: str, words: dict[str, float]) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the credentials in a text, in order, without overlaps."""
    spans: list[tuple[int, int, str]] = []
    for m in BEGIN.finditer(text):
        if spans and m.start() < spans[-1][1]:
            continue
        if stop := _key_end(text, m.end()):
            spans.append((m.start(), stop, "private_key"))
    keys = list(spans)

    def inside(at: int) -> bool:
        return any(a <= at < b for a, b, _ in keys)

    def mentioned(name: str, v: str, plain: bool) -> bool:
        if re.match(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*[();:,]*$", v) and not re.search(r"\d", v):
            return False
        if plain and not (re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and residual(v, words) >= 6 and not re.search(r"[()\[\]{}]", v)):
            return False
        return is_secret(name, v, words)

    for m in URL.finditer(text):
        v = m["value"]
        if not PLACEHOLDER.search(v) and not inside(m.start()) and not v.startswith(("$", "{", "<")) and (residual(v, words) >= 1 or len(v) >= 20) and not re.fullmatch(r"\d{1,5}", v):
            spans.append((m.start("value"), m.end("value"), "url_password"))
    for m in HEADER.finditer(text):
        v = m["value"]
        if PLACEHOLDER.search(v) or inside(m.start()):
            continue
        if m["scheme"] == "Basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4)).decode("utf-8")
            except ValueError:
                continue
            if ":" not in plain or PLACEHOLDER.search(plain.partition(":")[2]):
                continue
            spans.append((m.start("value"), m.end("value"), "authorization"))
        elif residual(v, words) >= 6:
            spans.append((m.start("value"), m.end("value"), "authorization"))
    for m in KNOWN.finditer(text):
        if not inside(m.start()) and residual(m[0], words) >= 6 and not PLACEHOLDER.search(m[0]):
            spans.append((m.start(), m.end(), "issued_key"))
    line, seen = -1, 0  # end of the line at hand, and how far its quoted values were judged
    for m in TELL.finditer(text):
        if inside(m.start()):
            continue
        name = BEFORE.search(text, max(0, m.start() - 60), m.start())[0] + m[0]
        if hit := KEYED.match(text, m.end()):
            name += re.match(r"[\w.-]*", text[m.end() : m.end() + 60])[0]
            if hit.end() > line:
                line = text.find("\n", hit.end())
                line = len(text) if line < 0 else line
                if more := CONTINUED.match(text, line):
                    line = more.end()
            if "BEGIN" not in text[hit.end() : min(line, hit.end() + 40)]:
                values, seen = _keyed(name, text, hit.end(), line, words, seen)
                spans += [(a, b, "assigned") for a, b in values]
                spans += [(a, b, "assigned") for a, b in _collected(name, text, m.start(), hit, words)]
        for pattern in (PROSE, PLAIN, PAIR):
            if (hit := pattern.match(text, m.end())) and mentioned(name, hit["value"], pattern is PLAIN):
                spans.append((hit.start("value"), hit.end("value"), "mentioned"))
    low = text.lower() if "assword" in text or "-u " in text or "--" in text else ""
    for pattern, kind, mark in ((NETRC, "assigned", "password"), (FLAG, "argument", "-")):
        for m in pattern.finditer(text) if mark in low else ():
            group = "user" if pattern is FLAG and m["value"] is None else "value"
            if not inside(m.start()) and mentioned("", m[group], False):
                spans.append((m.start(group), m.end(group), kind))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; quotes, line feeds and END lines stay."""
    out, at = [], 0
    for a, b, kind in spans:
        old = text[a:b]
        if kind == "private_key":
            breaks = re.findall(r"\r?\n|\\n", old)
            new = "REDACTED_PRIVATE_KEY" + "".join(breaks)
        else:
            new = "REDACTED_" + kind.upper()
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


FOUND = "chunk_id long, line_no long, kind string, start long, end long"
REDACTED = "chunk_id long, text string, n_secrets int"


def _candidates(chunks: DataFrame) -> DataFrame:
    return chunks.select(solid("chunk_id"), "text").filter(F.col("text").rlike(TRIGGER))


def find_secrets(chunks: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Rows ``chunk_id, line_no, kind, start, end``, one per credential.

    ``line_no`` counts from 1 within the chunk's text, ``start`` and ``end`` are character
    offsets. Null and empty texts and null ids give no rows; repeated rows of a chunk count once. Other
    columns are ignored. The vocabulary (a fixed public file) is read on the driver and
    broadcast; a text without any trigger never leaves the JVM.
    """
    words = chunks.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for chunk, text in zip(frame["chunk_id"], frame["text"], strict=True):
                line, at = 1, 0
                for a, b, kind in find(text, words.value):
                    line, at = line + text.count("\n", at, a), a
                    out.append((chunk, line, kind, a, b))
            yield pd.DataFrame(out, columns=["chunk_id", "line_no", "kind", "start", "end"])

    return _candidates(chunks.filter("chunk_id is not null")).mapInPandas(run, FOUND).distinct()


def redact(chunks: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Rows ``chunk_id, text, n_secrets``: every row with its credentials replaced.

    Texts without a trigger pass unchanged; nulls stay null.
    """
    words = chunks.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            spans = [find(t, words.value) if hit else [] for t, hit in zip(frame["text"], frame["hit"], strict=True)]
            frame["text"] = [redact_text(t, s) if s else t for t, s in zip(frame["text"], spans, strict=True)]
            frame["n_secrets"] = [len(s) for s in spans]
            yield frame[["chunk_id", "text", "n_secrets"]]

    read = chunks.select(solid("chunk_id"), "text", F.coalesce(F.col("text").rlike(TRIGGER), F.lit(False)).alias("hit"))
    return read.mapInPandas(run, REDACTED).select(restored("chunk_id"), "text", "n_secrets")
