"""Tokens of whole texts by one pass of a regular expression, for texts whose literals are simple.

The lexers of auditlake.llm.lexers walk from token to token, and know where each starts and what is wrong. Most texts parse,
and of those the kinds of tokens alone matter: here findall cuts a text, a table gives the kinds, and only brackets and the
lines of Python are walked. The tokens are the same; texts with anything else in them are left to those lexers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from auditlake.llm import lexers
from auditlake.llm.grammars import grammar
from auditlake.llm.peg import Grammar, Tokens

#: Kinds of what is no token: what nothing begins with, templates with code, and gaps without and with a line end.
_BAD, _HOLES, _GAP, _LINE = 0, 253, 254, 255
_LINE_ENDS = bytes(255 if k == _LINE else 0 for k in range(256))
#: Tokens whose kinds are remembered, of so many characters at most.
_KEPT, _LONGEST = 50_000, 60
#: Characters of texts beyond which the lexers, who hold no list of tokens, are asked.
_MOST = 4_000_000

_SPACES = " \t\f\v\r\n\u00a0\ufeff"
_BETWEEN = rf"(?:[{_SPACES}]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)++"
_ASCII_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?![^\x00-\x7f])"
#: Templates of scripts, with code that holds no braces, comments, regular expressions or templates.
_TEXT, _CODE = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+", r"(?:[^{}`'\"/\\]|'[^'\\\n\r]*'|\"[^\"\\\n\r]*\")*+"
_TEMPLATE = rf"`{_TEXT}(?:\$\{{{_CODE}\}}{_TEXT})*+`"
_PIECE = re.compile(rf"{_TEXT}(?:\$\{{({_CODE})\}}|`)")
#: Regular expressions behind signs that end no operand; a slash there that begins none takes the rest, so none is tried again.
_REGEX = rf"(?:(?<=[=(,:;!&|?\[{{+\-*%<>~^])|(?<=[=(,:;!&|?\[{{+\-*%<>~^] )|(?<=[^\w$#.]return ))(?:{lexers._REGEX.pattern}|/[\s\S]*)"
#: Strings of Kotlin with code that holds no braces, literals or comments.
_KOTLIN_STRING = r'"(?!"")(?:[^"\\\n\r$]++|\\[tbnr\'"\\$]|\\u[0-9a-fA-F]{4}|\$(?!\{)|\$\{[^{}"\'`/\\\n\r]*\})*+"'
_KOTLIN_HOLE = re.compile(r"\\[\s\S]|\$\{([^{}]*)\}")
#: f-strings with names, their attributes, numbered items and calls without arguments, and the rest of what begins one.
_PATH, _SPEC = r"[^\W\d]\w*(?:\.[^\W\d]\w*|\[\d+\]|\(\))*+", r"(?::[\w.<>^,+%\-]*)?"
_F_STRING = "[fF](?:{}|{})".format(*(rf"{q}(?!{q}{q})(?:[^{q}\\\n\r{{}}]++|\{{\{{|\}}\}}|\\[^N{{}}\n\r]|\{{{_PATH}{_SPEC}\}})*+{q}" for q in "\"'"))
_F_STRING_HOLE = re.compile(rf"\{{\{{|\}}\}}|\\[\s\S]|\{{({_PATH}){_SPEC}\}}")
_PYTHON_LINE = r"(?:#[^\n]*+)?+\r?\n(?:[ \t]*+(?:#[^\n]*+)?+\r?\n)*+[ \t]*+"
_BEGINS_CONTINUED = re.compile(r"\n[ \t]*\\\r?\n")


class Kinds(dict):
    """The kind of each token of a language; those not known yet are judged, and remembered where they are short."""

    def __init__(self, rules: Grammar, pattern: str, judge: Callable[[str], int]) -> None:
        super().__init__(rules.literals)
        self.literals, self.judge = rules.literals, judge
        self.find, self.find_ascii = re.compile(pattern).findall, re.compile(pattern, re.ASCII).findall

    def __missing__(self, token: str) -> int:
        kind = self.judge(token)
        if len(token) <= _LONGEST:
            if len(self) >= _KEPT:
                self.clear()
                self.update(self.literals)
            self[token] = kind
        return kind

    def cut(self, text: str) -> list[str]:
        return (self.find_ascii if text.isascii() else self.find)(text)

    def of(self, tokens: list[str]) -> bytes:
        return bytes(map(self.__getitem__, tokens))


@cache
def _bracket_kinds(lang: str, parses: Callable[[str], bool] | None) -> Kinds:
    rules = grammar(lang)
    strings, number, name, operators = {"java": lexers.JAVA_PARTS, "kotlin": lexers.KOTLIN_PARTS}.get(lang, lexers.SCRIPT_PARTS)
    script, names, numbers = lang not in ("java", "kotlin"), re.compile(name), re.compile(number)
    kind_of = rules.kind_of

    def judge(token: str) -> int:
        first = token[0]
        if first in _SPACES or token.startswith(("//", "/*")):
            return _LINE if "\n" in token else _GAP
        if first in "\"'":
            code = _KOTLIN_HOLE.finditer(token) if lang == "kotlin" and "${" in token else ()
            return kind_of["STRING"] if len(token) > 1 and all(m[1] is None or parses(m[1]) for m in code) else _BAD
        if script and first == "/":
            return kind_of["REGEX"] if lexers._REGEX.fullmatch(token) else _BAD
        if script and first == "`" and len(token) > 1:
            return _HOLES if "${" in token else kind_of["TEMPLATE"]
        if names.fullmatch(token):
            return kind_of["PRIVATE" if first == "#" else "NAME"]
        return kind_of["NUMBER"] if numbers.fullmatch(token) else _BAD

    signs = "|".join(re.escape(o) for o in sorted(operators, key=len, reverse=True))
    if lang == "kotlin":
        name, strings = rf"as\?|{name}", f"{strings}|{_KOTLIN_STRING}"
        signs = rf"!i[ns](?:[^\x00-\x7f]|(?![A-Za-z_]))|" + "|".join(s for s in signs.split("|") if s not in ("!in", "!is"))
    if script:
        strings, signs = f"{strings}|{_TEMPLATE}", f"{_REGEX}|{signs}"
    ascii_name = rf"(?!as\?){_ASCII_NAME}" if lang == "kotlin" else _ASCII_NAME
    return Kinds(rules, rf"[ \t]*+({ascii_name}|[()\[\]{{}};,]|\.(?![\d.])|=(?![=>])|{_BETWEEN}|{name}|{strings}|(?:{number})(?![\w$])|{signs}|\d[\w$]+|[\s\S])", judge)


@cache
def _python_kinds(parses: Callable[[str], bool]) -> Kinds:
    rules = grammar("python")
    kind_of, numbers, f_string = rules.kind_of, re.compile(lexers.PYTHON_NUMBER), re.compile(_F_STRING)

    def judge(token: str) -> int:
        if token[-1] in "\"'":
            if lexers._TEMPLATE_HEAD.match(token):
                return kind_of["STRING"] if f_string.fullmatch(token) and all(m[1] is None or parses(m[1]) for m in _F_STRING_HOLE.finditer(token)) else _BAD
            return kind_of["STRING"] if len(token) > 1 else _BAD
        if "\n" in token:
            return _GAP if token[0] == "\\" else _LINE
        if re.fullmatch(r"[^\W\d]\w*", token):
            return kind_of["NAME"]
        return kind_of["NUMBER"] if numbers.fullmatch(token) else _BAD

    return Kinds(
        rules,
        rf"[ \t]*+([A-Za-z_][A-Za-z0-9_]*+(?![\"'\x80-\U0010ffff])|[()\[\]{{}},]|\.(?![\d.])|=(?!=)|{_PYTHON_LINE}|{lexers._PYTHON_STRING}|{_F_STRING}|{lexers._PYTHON_TEMPLATE}"
        rf"|(?:{lexers.PYTHON_NUMBER})(?!\w)|[^\W\d]\w*|{lexers.PYTHON_SIGN}|\\\r?\n|\d\w+|[\s\S])",
        judge,
    )


@dataclass(frozen=True)
class _Walk:
    """What of a language's kinds is walked: brackets, templates and lines; the closing kind of each opening one, those that
    join lines of Kotlin, and in scripts the kinds that end operands and what finds slashes."""

    find: Callable
    closing: dict[int, int]
    joining: frozenset
    operands: frozenset
    slashes: Callable | None


@cache
def _walk(lang: str) -> _Walk:
    words, kind_of = grammar(lang).literals, grammar(lang).kind_of
    closing = {words[a]: words[b] for a, b in lexers._OPEN.items()}
    joining = frozenset((words["("], words["["])) if lang == "kotlin" else frozenset()
    walked, operands, slashes = {*closing, *closing.values()}, frozenset(), None
    if lang == "python":
        walked.add(_LINE)
    if "HEAD" in kind_of:
        closing[kind_of["HEAD"]] = kind_of["TAIL"]
        walked |= {kind_of[k] for k in ("HEAD", "MIDDLE", "TAIL")}
        operands = frozenset(words[w] for w in ("this", "super", "null", "true", "false", ")", "]", "}")) | {kind_of[k] for k in ("NAME", "PRIVATE", "NUMBER", "STRING", "TEMPLATE", "TAIL", "REGEX")}
        slashes = _finder({words["/"], words["/="]})
    return _Walk(_finder(walked), closing, joining, operands, slashes)


def _finder(kinds: set[int]) -> Callable:
    return re.compile(b"[" + re.escape(bytes(sorted(kinds))) + b"]").finditer


def _filled(kinds: Kinds, template: str, kind_of: dict[str, int]) -> bytes:
    """The kinds of the pieces of a template and the code between."""
    out = bytearray()
    for m in _PIECE.finditer(template, 1):
        if m[1] is None:
            out.append(kind_of["TAIL" if out else "TEMPLATE"])
        else:
            out.append(kind_of["MIDDLE" if out else "HEAD"])
            out += kinds.of(kinds.cut(m[1].rstrip(" \t")))
    return bytes(out)


def _brackets(text: str, lang: str, parses: Callable[[str], bool] | None) -> Tokens | None:
    kinds, walk, kind_of = _bracket_kinds(lang, parses), _walk(lang), grammar(lang).kind_of
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    if text.rfind("/*") > text.rfind("*/"):
        return None
    tokens = kinds.cut(text.rstrip(" \t"))
    found = kinds.of(tokens)
    if _HOLES in found:
        filled = [_filled(kinds, t, kind_of) for t, k in zip(tokens, found) if k == _HOLES]
        first, *rest = found.split(bytes((_HOLES,)))
        found = first + b"".join(a + b for a, b in zip(filled, rest))
    if _BAD in found or _HOLES in found:
        return None
    found = found.translate(None, bytes((_GAP,)))
    breaks = bytearray(found.translate(_LINE_ENDS).replace(b"\xff\x00", b"\x01").rstrip(b"\xff"))
    found = found.replace(b"\xff", b"")
    if walk.slashes and any(not m.start() or found[m.start() - 1] not in walk.operands for m in walk.slashes(found)):
        return None
    closing, joining, middle, tail = walk.closing, walk.joining, kind_of.get("MIDDLE"), kind_of.get("TAIL")
    matches, opened, wanted, last = {}, [], [], 0
    for m in walk.find(found):
        i = m.start()
        kind = found[i]
        end = closing.get(kind)
        if joining:  # a line that begins right in these brackets does not count
            until = i if end is None else i + 1
            if opened and found[opened[-1]] in joining and breaks.find(1, last, until) >= 0:
                breaks[last:until] = bytes(until - last)
            last = until
        if end is not None:
            opened.append(i)
            wanted.append(end)
        elif kind == middle:
            if not wanted or wanted[-1] != tail:
                return None
        elif not wanted or wanted.pop() != kind:
            return None
        else:
            where = opened.pop()
            if kind != tail:
                matches[where] = i
    return None if wanted else Tokens(found + b"\0", bytes(breaks) + b"\1", [], matches)


def _indented(text: str, parses: Callable[[str], bool]) -> Tokens | None:
    kinds, walk, kind_of = _python_kinds(parses), _walk("python"), grammar("python").kind_of
    if "\f" in text or "\ufeff" in text or text.count("\r") != text.count("\r\n"):
        return None
    text = "\n" + text.rstrip(" \t") + "\n"
    if "\\" in text and (text.endswith("\\\n") or _BEGINS_CONTINUED.search(text)):
        return None
    tokens = kinds.cut(text)
    found = kinds.of(tokens)
    if _BAD in found:
        return None
    if _GAP in found:
        tokens = [t for t, k in zip(tokens, found) if k != _GAP]
        found = found.translate(None, bytes((_GAP,)))
    closing, new_line, indent, dedent = walk.closing, kind_of["NEWLINE"], kind_of["INDENT"], kind_of["DEDENT"]
    out, matches, opened, wanted = bytearray(), {}, [], []
    levels: list[tuple[int, int, int]] = [(0, 0, -1)]
    current, last, shift = "", 0, 0  # shift: how much further a token stands in out than in found
    for m in walk.find(found):
        i = m.start()
        kind = found[i]
        if kind == _LINE:
            out += found[last:i]
            last = i + 1
            if not wanted:
                if i:
                    out.append(new_line)
                margin = tokens[i].rpartition("\n")[2]
                if margin != current and last < len(found):
                    current, wide, narrow = margin, len(margin.expandtabs(8)), len(margin.expandtabs(1))
                    if wide > levels[-1][0]:
                        if narrow <= levels[-1][1]:
                            return None
                        levels.append((wide, narrow, len(out)))
                        out.append(indent)
                    while wide < levels[-1][0]:
                        matches[levels.pop()[2]] = len(out)
                        out.append(dedent)
                    if wide != levels[-1][0] or narrow != levels[-1][1]:
                        return None
            shift = len(out) - last
            continue
        end = closing.get(kind)
        if end is not None:
            opened.append(i + shift)
            wanted.append(end)
        elif not wanted or wanted.pop() != kind:
            return None
        else:
            matches[opened.pop()] = i + shift
    if wanted:
        return None
    while len(levels) > 1:
        matches[levels.pop()[2]] = len(out)
        out.append(dedent)
    return Tokens(bytes(out) + b"\0", bytes(len(out) + 1), [], matches)


def tokens(text: str, lang: str, parses: Callable[[str], bool] | None = None) -> Tokens | None:
    """The tokens of a text, without where they start, or None where the lexers have to say; parses as for these."""
    if len(text) > _MOST:
        return None
    return _indented(text, parses) if lang == "python" else _brackets(text, lang, parses if lang == "kotlin" else None)
