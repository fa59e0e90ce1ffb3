"""A generalised LL recogniser with a graph-structured stack, and its grammar notation.

Brackets (and indented blocks) are folded by the lexers: a matched pair is one token whose
contents are a sequence of their own. A terminal such as ``PAREN<args>`` matches a folded
pair whose contents derive from ``args``. Folded sequences are interned, so each distinct
shape is parsed once however often it occurs.
"""

from __future__ import annotations

import re

LOOP = 1 << 16
NOTATION = re.compile(r"\s*(?:(?P<lit>\"[^\"]+\")|(?P<fold>[A-Z]+<\w+>)|(?P<term>[A-Z][A-Z_0-9]*)|(?P<rule>[a-z]\w*)|(?P<op>[()|*+?]))")


class Grammar:
    """Rules compiled to alternatives of symbols.

    A symbol is a nonterminal (negative number) or a terminal (index into ``terminals``).
    ``kinds`` maps what the lexer names (``"if"``, ``NAME``) to token kinds; ``classes``
    names sets of kinds that one terminal accepts.
    """

    def __init__(self, text: str, classes: dict[str, list[str]] | None = None):
        self.classes = classes or {}
        self.kinds: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.rules: list[list[tuple[int, ...]]] = [[]]
        self.terminals: list[tuple[frozenset[int], int, bool]] = []  # kinds, folded rule, zero-width end
        self._terms: dict[str, int] = {}
        self.loops: list[int] = []  # repeated symbols; a loop is LOOP + index in an alternative
        for line in re.split(r"\n(?=\w+\s*=)", text.strip()):
            name, _, body = line.partition("=")
            rule = self._rule(name.strip())
            parts = self._scan(body)
            alts, rest = self._alternatives(parts, 0)
            if rest != len(parts):
                raise ValueError(f"grammar: {line}")
            self.rules[rule] = alts
        missing = [n for n, r in self.names.items() if not self.rules[r]]
        if missing:
            raise ValueError(f"grammar: no rule for {missing}")
        self._predict()

    def kind(self, name: str) -> int:
        return self.kinds.setdefault(name, len(self.kinds) + 1)

    def _rule(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.rules)
            self.rules.append([])
        return self.names[name]

    def _scan(self, body: str) -> list[tuple[str, str]]:
        out, at = [], 0
        body = body.rstrip()
        while at < len(body):
            m = NOTATION.match(body, at)
            if not m:
                raise ValueError(f"grammar at {body[at:at+30]!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return out

    def _terminal(self, name: str) -> int:
        if name not in self._terms:
            if name == "EOS":
                spec = (frozenset([self.kind(";")]), 0, True)
            elif re.fullmatch(r"[A-Z]+<\w+>", name):
                bracket, _, inner = name[:-1].partition("<")
                spec = (frozenset([self.kind(bracket)]), self._rule(inner), False)
            else:
                spec = (frozenset(self.kind(k) for k in self.classes.get(name, [name])), 0, False)
            self._terms[name] = len(self.terminals)
            self.terminals.append(spec)
        return self._terms[name]

    def _alternatives(self, parts, at):
        alts, seq = [], []
        while at < len(parts):
            kind, value = parts[at]
            if value == ")" and kind == "op":
                break
            if value == "|" and kind == "op":
                alts.append(tuple(seq))
                seq = []
                at += 1
                continue
            if kind == "op" and value == "(":
                inner, at = self._alternatives(parts, at + 1)
                symbol = self._fresh(inner)
            elif kind == "rule":
                symbol = -self._rule(value)
            else:
                symbol = self._terminal(value.strip('"'))
            at += 1
            while at < len(parts) and parts[at][0] == "op" and parts[at][1] in "*+?":
                op = parts[at][1]
                at += 1
                if op == "?":
                    symbol = self._fresh([(symbol,), ()])
                else:
                    if op == "+":
                        seq.append(symbol)
                    self.loops.append(symbol)
                    symbol = LOOP + len(self.loops) - 1
            seq.append(symbol)
        alts.append(tuple(seq))
        return alts, at

    def _fresh(self, alts) -> int:
        self.rules.append(alts)
        return -(len(self.rules) - 1)

    def _predict(self) -> None:
        """For each rule, the alternatives that may start with a kind, and whether it may be empty."""
        n = len(self.rules)
        nullable = [False] * n
        first: list[set[int]] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for r in range(1, n):
                for alt in self.rules[r]:
                    empty = True
                    for s in alt:
                        before = len(first[r])
                        if s >= LOOP:
                            x = self.loops[s - LOOP]
                            first[r] |= first[-x] if x < 0 else self.terminals[x][0]
                            step = True
                        elif s < 0:
                            first[r] |= first[-s]
                            step = nullable[-s]
                        else:
                            first[r] |= self.terminals[s][0]
                            step = self.terminals[s][2]
                        changed |= len(first[r]) != before
                        if not step:
                            empty = False
                            break
                    if empty and not nullable[r]:
                        nullable[r] = changed = True
        self.choices: list[dict[int, list[tuple[int, ...]]]] = [{} for _ in range(n)]
        self.empty: list[list[tuple[int, ...]]] = [[] for _ in range(n)]
        for r in range(1, n):
            for alt in self.rules[r]:
                may, empty = set(), True
                for s in alt:
                    x = self.loops[s - LOOP] if s >= LOOP else s
                    may |= first[-x] if x < 0 else self.terminals[x][0]
                    if s < LOOP and not (nullable[-s] if s < 0 else self.terminals[s][2]):
                        empty = False
                        break
                for k in may:
                    self.choices[r].setdefault(k, []).append(alt)
                if empty:
                    self.empty[r].append(alt)
            # An alternative that may be empty is open whatever follows.
            for k, alts in self.choices[r].items():
                self.choices[r][k] = alts + [a for a in self.empty[r] if a not in alts]


class Recogniser:
    """Parses interned token sequences. A token is ``kind << 1 | newline_before``, or a
    folded pair numbered from ``FOLD`` (also shifted by one for its newline flag)."""

    FOLD = 1 << 20

    def __init__(self, grammar: Grammar, limit: int = 300_000):
        self.g = grammar
        self.limit = limit
        #: By rule whose sentences may be joined: how to cut a sequence into likely sentences.
        self.cuts: dict[int, object] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple[int, tuple[int, ...]], int] = {}
        self.folded: list[tuple[int, tuple[int, ...]]] = []
        self.known: dict[tuple[int, tuple[int, ...]], bool] = {}

    def fold(self, kind: int, inner: list[int]) -> int:
        key = (kind, tuple(inner))
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.folded)
            self.folded.append(key)
        return self.FOLD + at

    def trim(self) -> None:
        """Forget the memory between texts once it has grown."""
        if len(self.ids) > self.limit or len(self.known) > self.limit:
            self.reset()

    def derives(self, rules: tuple[int, ...], tokens: tuple[int, ...]) -> bool:
        """Whether any of the rules derives the tokens; all are run on one stack."""
        key = (rules if len(rules) > 1 else rules[0], tokens)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = self._joined(rules, tokens) or self._run(rules, tokens)
        return got

    def _joined(self, rules: tuple[int, ...], tokens: tuple[int, ...]) -> bool:
        """Whether the tokens are sentences one after the other, by cutting them first.

        Only a yes counts: a sequence of which some part is rejected is parsed whole.
        """
        cut = self.cuts.get(rules[0]) if len(rules) == 1 else None
        if cut is None or len(tokens) < 2:
            return False
        parts = cut(tokens, self)
        if len(parts) < 2:
            return False
        for part in parts:
            key = (rules[0], part)
            got = self.known.get(key)
            if got is None:
                got = self.known[key] = self._run(rules, part)
            if not got:
                return False
        return True

    def _run(self, rules: tuple[int, ...], tokens: tuple[int, ...]) -> bool:
        g, FOLD = self.g, self.FOLD
        n = len(tokens)
        kinds = [self.folded[(t >> 1) - FOLD][0] if t >> 1 >= FOLD else t >> 1 for t in tokens]
        kinds.append(0)
        terminals, choices, empties, loops = g.terminals, g.choices, g.empty, g.loops
        # A stack node is (rule, position): who waits for it, and where it has ended.
        waiting: dict[tuple[int, int], list] = {}
        ended: dict[tuple[int, int], dict[int, None]] = {}
        done: set = set()
        todo: list = []

        def call(rule: int, i: int, back) -> None:
            node = (rule, i)
            if node in waiting:
                waiting[node].append(back)
                for j in list(ended[node]):
                    resume(back, j)
                return
            waiting[node], ended[node] = [back], {}
            for alt in choices[rule].get(kinds[i], empties[rule]):
                todo.append((node, alt, 0, i))

        def resume(back, j: int) -> None:
            if back is None:
                if j == n:
                    done.add("accepted")
                return
            node, alt, dot = back
            todo.append((node, alt, dot, j))

        for r in rules:
            call(r, 0, None)
        seen: set = set()
        while todo and "accepted" not in done:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            node, alt, dot, i = state
            size = len(alt)
            while dot < size:
                s = alt[dot]
                if s >= LOOP:
                    # Stay on the loop after each match, or go on behind it.
                    x = loops[s - LOOP]
                    if x < 0:
                        if kinds[i] in choices[-x]:
                            call(-x, i, (node, alt, dot))
                    else:
                        accepted, inner, _ = terminals[x]
                        if i < n and kinds[i] in accepted and (not inner or self.derives((inner,), self.folded[(tokens[i] >> 1) - FOLD][1])):
                            todo.append((node, alt, dot, i + 1))
                    dot += 1
                    continue
                if s < 0:
                    call(-s, i, (node, alt, dot + 1))
                    break
                accepted, inner, end = terminals[s]
                if i < n and kinds[i] in accepted and (not inner or self.derives((inner,), self.folded[(tokens[i] >> 1) - FOLD][1])):
                    i += 1
                elif end and (i == n or tokens[i] & 1):
                    pass
                else:
                    break
                dot += 1
            else:
                if i not in ended[node]:
                    ended[node][i] = None
                    for back in waiting[node]:
                        resume(back, i)
        return "accepted" in done
