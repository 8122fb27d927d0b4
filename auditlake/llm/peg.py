"""Packrat parsing-expression grammars over tokens.

A grammar is text, one rule a line: `Name = expression`, with 'literal' tokens, token classes in capitals, rules,
`a b` sequence, `a / b` ordered choice, `a* a+ a?`, `&a !a` lookahead and parentheses. NL and NONL ask whether a line
end precedes the next token, EOF whether none is left. Rules are compiled to functions that remember their result by
position. A rule marked @ begins with a bracket and ends with its match: its result depends on the kinds of the tokens
between alone, so it is remembered by these kinds for other places and texts as well.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

_ITEM = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_]*)|([()/*+?&!]))")
#: Results kept by the kinds of tokens, and the most tokens of one that is worth keeping.
_KEPT, _LONGEST = 100_000, 600


@dataclass
class Tokens:
    """Kinds of tokens (0 ends them), whether a line end precedes each, where each starts, and matching brackets."""

    kinds: bytes
    breaks: bytes
    starts: list[int]
    matches: dict[int, int]
    error: tuple[int, str] | None = None


@dataclass
class Grammar:
    """A compiled grammar; kind_of gives the number of a literal or class."""

    text: str
    classes: tuple[str, ...]
    kind_of: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 40_000))
        self.rules: dict[str, tuple] = {}
        self.bracketed: set[str] = set()
        logical = re.sub(r"\n[ \t]+(?=\S)", " ", re.sub(r"(?m)^\s*--.*$", "", self.text))
        for name in self.classes:
            self.kind_of[name] = len(self.kind_of) + 1
        for line in filter(str.strip, logical.split("\n")):
            name, _, body = line.partition(" = ")
            name = name.strip()
            if name.startswith("@"):
                name = name[1:]
                self.bracketed.add(name)
            items = [m.groups() for m in _ITEM.finditer(body)]
            tree, at = self._choice(items, 0)
            if at != len(items):
                raise ValueError(f"rule {name} ends at {items[at]}")
            self.rules[name] = tree
        if len(self.kind_of) > 250:
            raise ValueError("too many kinds of tokens")
        self.literals = {word: kind for word, kind in self.kind_of.items() if word not in self.classes}
        self.number = {name: i for i, name in enumerate(self.rules)}
        self._first()
        self.fast, self.slow = self._compile(False), self._compile(True)

    def _choice(self, items: list, at: int) -> tuple[tuple, int]:
        options = []
        while True:
            parts = []
            while at < len(items) and items[at][2] not in (")", "/"):
                part, at = self._part(items, at)
                parts.append(part)
            options.append(parts[0] if len(parts) == 1 else ("seq", parts))
            if at < len(items) and items[at][2] == "/":
                at += 1
                continue
            return (options[0] if len(options) == 1 else ("alt", options)), at

    def _part(self, items: list, at: int) -> tuple[tuple, int]:
        literal, name, sign = items[at]
        if sign in ("&", "!"):
            inner, at = self._part(items, at + 1)
            return (("and" if sign == "&" else "not"), inner), at
        if sign == "(":
            tree, at = self._choice(items, at + 1)
            at += 1
        elif literal:
            tree, at = ("tok", self.kind_of.setdefault(literal, len(self.kind_of) + 1)), at + 1
        elif name in ("NL", "NONL", "EOF"):
            tree, at = (name.lower(),), at + 1
        elif name in self.kind_of:
            tree, at = ("tok", self.kind_of[name]), at + 1
        else:
            tree, at = ("rule", name), at + 1
        while at < len(items) and items[at][2] in ("*", "+", "?"):
            tree, at = ({"*": "star", "+": "plus", "?": "opt"}[items[at][2]], tree), at + 1
        return tree, at

    def _first(self) -> None:
        """Per rule: the kinds it can begin with, and whether it can be empty; by repetition until nothing changes."""
        self.begins = {name: (frozenset(), False) for name in self.rules}
        changed = True
        while changed:
            changed = False
            for name, tree in self.rules.items():
                found = self._begin(tree)
                if found != self.begins[name]:
                    self.begins[name], changed = found, True

    def _begin(self, tree: tuple) -> tuple[frozenset, bool]:
        kind = tree[0]
        if kind == "tok":
            return frozenset((tree[1],)), False
        if kind == "rule":
            return self.begins[tree[1]]
        if kind == "eof":
            return frozenset((0,)), True
        if kind in ("nl", "nonl", "and", "not"):
            return frozenset(), True
        if kind in ("star", "opt"):
            return self._begin(tree[1])[0], True
        if kind == "plus":
            return self._begin(tree[1])
        found = [self._begin(t) for t in tree[1]]
        if kind == "alt":
            return frozenset().union(*(f for f, _ in found)), any(e for _, e in found)
        begin: frozenset = frozenset()
        for kinds, empty in found:
            begin |= kinds
            if not empty:
                return begin, False
        return begin, True

    def _compile(self, tracked: bool) -> dict:
        """The rules as functions; tracked ones note the furthest position at which a token did not fit."""
        out: list[str] = []
        self._names = 0
        space: dict = {"K": b"", "N": b"", "B": {}, "FAR": [0], "CACHE": {}, "MEMOS": []}

        def new() -> str:
            self._names += 1
            return f"v{self._names}"

        def emit(depth: int, line: str) -> None:
            out.append(" " * depth + line)

        def guard(tree: tuple) -> str | None:
            kinds, empty = self._begin(tree)
            if empty or not kinds:
                return None
            name = f"F{len(space)}"
            space[name] = kinds
            return name

        def missed(depth: int, start: str) -> None:
            if tracked:
                emit(depth, f"elif {start} > FAR[0]: FAR[0] = {start}")

        def gen(tree: tuple, start: str, depth: int) -> str:
            kind, r = tree[0], new()
            if kind == "tok":
                emit(depth, f"{r} = -1")
                emit(depth, f"if K[{start}] == {tree[1]}: {r} = {start} + 1")
                missed(depth, start)
            elif kind == "eof":
                emit(depth, f"{r} = -1")
                emit(depth, f"if not K[{start}]: {r} = {start}")
                missed(depth, start)
            elif kind in ("nl", "nonl"):
                emit(depth, f"{r} = {start} if {'' if kind == 'nl' else 'not '}N[{start}] else -1")
            elif kind == "rule":
                first = guard(tree)
                emit(depth, f"{r} = -1")
                emit(depth, f"if {f'K[{start}] in {first}' if first else 'True'}: {r} = R{self.number[tree[1]]}({start})")
                if first:
                    missed(depth, start)
            elif kind == "seq":
                emit(depth, f"{r} = -1")
                at = start
                for part in tree[1]:
                    at = gen(part, at, depth)
                    emit(depth, f"if {at} >= 0:")
                    depth += 1
                emit(depth, f"{r} = {at}")
            elif kind == "alt":
                emit(depth, f"{r} = -1")
                for n, part in enumerate(tree[1]):
                    first = guard(part)
                    tests = (["%s < 0" % r] if n else []) + ([f"K[{start}] in {first}"] if first and part[0] not in ("tok", "rule") else [])
                    emit(depth, f"if {' and '.join(tests) or 'True'}:")
                    x = gen(part, start, depth + 1)
                    emit(depth + 1, f"{r} = {x}")
                    if tracked and len(tests) > (n > 0):
                        emit(depth, f"elif {start} > FAR[0]: FAR[0] = {start}")
            elif kind in ("star", "plus"):
                emit(depth, f"{r} = {start}")
                emit(depth, "while True:")
                x = gen(tree[1], r, depth + 1)
                emit(depth + 1, f"if {x} < 0 or {x} == {r}: break")
                emit(depth + 1, f"{r} = {x}")
                if kind == "plus":
                    emit(depth, f"if {r} == {start}: {r} = -1")
            elif kind == "opt":
                x = gen(tree[1], start, depth)
                emit(depth, f"{r} = {x} if {x} >= 0 else {start}")
            else:
                x = gen(tree[1], start, depth)
                emit(depth, f"{r} = {start} if {x} {'>=' if kind == 'and' else '<'} 0 else -1")
            return r

        for name, tree in self.rules.items():
            n = self.number[name]
            plain = tree[0] == "alt" and all(t[0] == "tok" for t in tree[1])
            emit(0, f"def R{n}(p):")
            if plain:
                emit(1, f"return p + 1 if K[p] in S{n} else -1")
                space[f"S{n}"] = frozenset(t[1] for t in tree[1])
                continue
            space[f"M{n}"] = {}
            space["MEMOS"].append(space[f"M{n}"])
            emit(1, f"m = M{n}.get(p)")
            emit(1, "if m is not None: return m")
            if name in self.bracketed:
                emit(1, "j = B.get(p)")
                emit(1, f"if j is not None and j - p > {_LONGEST}: j = None")
                emit(1, "if j is not None:")
                emit(2, f"key = ({n}, K[p:j + 1], N[p:j + 1])")
                emit(2, "m = CACHE.get(key)")
                emit(2, "if m is not None and (m or %s): return j + 1 if m else -1" % (not tracked))
            r = gen(tree, "p", 1)
            emit(1, f"M{n}[p] = {r}")
            if name in self.bracketed:
                emit(1, f"if j is not None and ({r} < 0 or {r} == j + 1):")
                emit(2, f"if len(CACHE) > {_KEPT}: CACHE.clear()")
                emit(2, f"CACHE[key] = {r} >= 0")
            emit(1, f"return {r}")
        exec(compile("\n".join(out), "<grammar>", "exec"), space)  # the functions of this module's own grammars
        return space

    def _run(self, space: dict, tokens: Tokens) -> int:
        space["K"], space["N"], space["B"] = tokens.kinds, tokens.breaks, tokens.matches
        for memo in space["MEMOS"]:
            memo.clear()
        space["FAR"][0] = 0
        return space["R0"](0)

    def takes(self, tokens: Tokens) -> bool:
        """Whether the first rule takes all tokens, however deep they nest."""
        try:
            return self._run(self.fast, tokens) >= 0
        except RecursionError:
            return self._stacked(tokens) is None

    def failure(self, tokens: Tokens) -> int | None:
        """None if the first rule takes all tokens, else the furthest token at which nothing fitted, however deep they nest."""
        try:
            if self._run(self.fast, tokens) >= 0:
                return None
            self._run(self.slow, tokens)
            return self.slow["FAR"][0]
        except RecursionError:
            return self._stacked(tokens)

    def _stacked(self, tokens: Tokens) -> int | None:
        """The same verdict with a stack of its own, for texts nested deeper than calls may be.

        Results are remembered with the furthest failure inside them. Brackets are parsed from the innermost outwards,
        so the stack holds one level of brackets at a time; only nesting without brackets makes it grow.
        """
        kinds, breaks, memo = tokens.kinds, tokens.breaks, {}

        def steps(tree: tuple, p: int):
            kind = tree[0]
            if kind == "tok":
                return (p + 1, -1) if kinds[p] == tree[1] else (-1, p)
            if kind == "eof":
                return (-1, p) if kinds[p] else (p, -1)
            if kind in ("nl", "nonl"):
                return (p if bool(breaks[p]) == (kind == "nl") else -1), -1
            if kind == "rule":
                key = (tree[1], p)
                if key not in memo:
                    memo[key] = yield self.rules[tree[1]], p
                return memo[key]
            far = -1
            if kind == "seq":
                for part in tree[1]:
                    p, f = yield part, p
                    far = max(far, f)
                    if p < 0:
                        break
                return p, far
            if kind == "alt":
                for part in tree[1]:
                    r, f = yield part, p
                    far = max(far, f)
                    if r >= 0:
                        return r, far
                return -1, far
            if kind in ("star", "plus"):
                at = p
                while True:
                    r, f = yield tree[1], at
                    far = max(far, f)
                    if r < 0 or r == at:
                        return (-1 if kind == "plus" and at == p else at), far
                    at = r
            r, far = yield tree[1], p
            if kind == "opt":
                return (r if r >= 0 else p), far
            return (p if (r >= 0) == (kind == "and") else -1), far

        def run(tree: tuple, p: int) -> tuple[int, int]:
            stack, value = [steps(tree, p)], None
            while stack:
                try:
                    stack.append(steps(*stack[-1].send(value)))
                    value = None
                except StopIteration as end:
                    stack.pop()
                    value = end.value
            return value

        for p in sorted(tokens.matches, reverse=True):
            for name in self.bracketed:
                if kinds[p] in self.begins[name][0]:
                    run(("rule", name), p)
        end, far = run(("rule", next(iter(self.rules))), 0)
        return None if end >= 0 else max(far, 0)
