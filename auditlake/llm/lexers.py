"""Tokens of Java, Kotlin, JavaScript, TypeScript and Python for the grammars."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from auditlake.llm.peg import Grammar, Tokens

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

_NAME = r"[A-Za-z_$][\w$]*|[^\W\d][\w$]*"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_DIGITS = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"


def _pattern(strings: str, number: str, name: str, operators: list[str]) -> re.Pattern:
    signs = "|".join(re.escape(o) for o in sorted(operators, key=len, reverse=True))
    return re.compile(rf"[ \t]*(?:([ \t\f\v\r\n\u00a0\ufeff]+|{_COMMENT})|({name})|({strings})|({number})(?![\w$])|({signs}))")


#: The groups of a lexer's pattern.
_SPACE, _WORD, _STRING, _NUMBER, _SIGN = 1, 2, 3, 4, 5


def _signs(*words: str) -> list[str]:
    return " ".join(words).split()


JAVA_PARTS = (
    r'"""[ \t\f]*\r?\n(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|"(?!"")(?:[^"\\\n\r]++|\\[btnfrs"\'\\0-7]|\\u+[0-9a-fA-F]{4})*+"|""(?!")|\'(?:[^\'\\\n\r]|\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))\'',
    rf"{_DIGITS}[lLfFdD]?|\d[\d_]*\.(?![.\w])[fFdD]?", _NAME,
    _signs("( ) [ ] { } ; , . ... @ :: -> = == != < > <= >= >>= >>>= <<= << + - * / % & | ^ ! ~ ? : && || ++ -- += -= *= /= %= &= |= ^="),
)
JAVA = _pattern(*JAVA_PARTS)
KOTLIN_PARTS = (
    r'"""(?:[^"$]++|\$(?!\{)|"(?!""))*+"""+|"(?!"")(?:[^"\\\n\r$]++|\\[tbnr\'"\\$]|\\u[0-9a-fA-F]{4}|\$(?!\{))*+"|""(?!")|\'(?:[^\'\\\n\r]|\\[tbnr\'"\\$]|\\u[0-9a-fA-F]{4})\'',
    rf"(?:{_DIGITS})[uU]?[lLfF]?", rf"{_NAME}|`[^`\n]+`",
    _signs("( ) [ ] { } ; , . .. ..< @ :: -> = == != === !== < > <= >= + - * / % & | ! ? : && || ++ -- += -= *= /= %= ?. ?: !! !in !is as?"),
)
KOTLIN = _pattern(*KOTLIN_PARTS)
_ESCAPED = r"\\(?:[^\n\r]|\r?\n)"
SCRIPT_PARTS = (
    rf'"(?:[^"\\\n\r]++|{_ESCAPED})*+"|\'(?:[^\'\\\n\r]++|{_ESCAPED})*+\'', rf"(?:{_DIGITS}|0[oO][0-7_]+|\d[\d_]*\.(?![.\w]))n?", rf"#?(?:{_NAME})",
    _signs("( ) [ ] { } ; , . ... @ => = == != === !== < > <= >= << <<= >>= >>>= + - * ** / % & | ^ ! ~ ? : && || ?? ++ -- += -= *= **= /= %= &= |= ^= &&= ||= ??= ?. `"),
)
SCRIPT = _pattern(*SCRIPT_PARTS)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)")


#: The plain text of a Kotlin string by its quotes, and what of code in its templates holds no quote or brace.
_KOTLIN_PLAIN = {'"': re.compile(r'(?:[^"\\\n\r$]|\\[tbnr\'"\\$]|\\u[0-9a-fA-F]{4}|\$(?!\{))*'), '"""': re.compile(r'(?:[^"$]|\$(?!\{)|"(?!""))*')}
_KOTLIN_CODE = re.compile(r"(?:[^\"'`{}/]|/(?![/*])|//[^\n]*|/\*[\s\S]*?\*/|`[^`\n]+`|'(?:[^'\\\n\r]|\\[^\n])+')*")

Spans = list[tuple[int, int]]

#: JSX: what may stand between the parts of a tag, names, and texts between tags, which hold no other signs of tags or braces.
_TAG_SPACE = re.compile(rf"(?:\s|{_COMMENT})*")
_TAG_WORD = r"(?:[^\W\d]|\$)[\w$\-]*"
_TAG_NAME = re.compile(rf"{_TAG_WORD}(?:\s*:\s*{_TAG_WORD}|(?:\s*\.\s*{_TAG_WORD})+)?")
_ATTRIBUTE = re.compile(rf"{_TAG_WORD}(?:\s*:\s*{_TAG_WORD})?")
_ATTRIBUTE_TEXT = re.compile(r"\"[^\"]*\"|'[^']*'")
_TAG_TEXT = re.compile(r"[^<>{}]*")
_SPREAD = re.compile(rf"(?:\s|{_COMMENT})*\.\.\.")
#: Words that an expression may follow; and angle brackets that are type parameters wherever they stand, or where no such tag is closed.
_LAST = re.compile(r"[\w$]+|[\s\S]")
_BEFORE_TAG = frozenset("return default case else do typeof void delete in of instanceof throw yield await".split())
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|\bextends\b(?!\s*[=/>]))")
_GENERIC = re.compile(r"<\s*([\w$]+)(?:\s*=[^<>()]*)?\s*>\s*\(")


def _type_arguments(text: str, at: int) -> int | None:
    """The end of the angle brackets that open at `at`."""
    depth = 0
    for m in re.compile(r"=>|[<>]|\"[^\"\n]*\"|'[^'\n]*'").finditer(text, at):
        depth += {"<": 1, ">": -1}.get(m.group(), 0)
        if not depth:
            return m.end()
    return None


def begins_tag(text: str, at: int, typed: bool) -> bool:
    """Whether the sign < at `at`, where an operand may stand, begins an element and not type parameters."""
    if typed:
        generic = _GENERIC.match(text, at)
        if _TYPE_PARAMETERS.match(text, at) or generic and not re.compile(rf"</\s*{re.escape(generic[1])}\s*>").search(text, at):
            return False
    after = _TAG_SPACE.match(text, at + 1).end()
    return text.startswith(">", after) or _TAG_NAME.match(text, after) is not None


def markup(text: str, at: int, open_: list, types: Callable[[str], bool] | None) -> tuple[int, str | None] | None:
    """Reads an element's text from `at` on: the place behind it and None, or behind a brace and its kind; None if it is wrong.

    open_ holds the elements that are open, and goes on with the same list behind the brace's match: [name, where we are
    in it], which is "tag", "attributes", "value" or "children". types judges type arguments of tags, where there are any.
    """
    while True:
        where = open_[-1][1]
        if where == "children":
            at = _TAG_TEXT.match(text, at).end()
            if text.startswith("{", at):
                return at + 1, "JCHILD"
            if not text.startswith("<", at):
                return None
            after = _TAG_SPACE.match(text, at + 1).end()
            if not text.startswith("/", after):
                open_.append(["", "tag"])
                at += 1
                continue
            at = _TAG_SPACE.match(text, after + 1).end()
            m = _TAG_NAME.match(text, at)
            name = re.sub(r"\s", "", m.group()) if m else ""
            at = _TAG_SPACE.match(text, m.end() if m else at).end()
            if name != open_.pop()[0] or not text.startswith(">", at):
                return None
        else:
            at = _TAG_SPACE.match(text, at).end()
            sign = text[at : at + 1]
            if where == "tag":
                open_[-1][1] = "attributes"
                if sign == ">":
                    open_[-1][1] = "children"
                    at += 1
                    continue
                m = _TAG_NAME.match(text, at)
                if m is None:
                    return None
                open_[-1][0] = re.sub(r"\s", "", m.group())
                at = m.end()
                after = _TAG_SPACE.match(text, at).end()
                if types and text.startswith("<", after):
                    at = _type_arguments(text, after)
                    if at is None or not types(text[after:at]):
                        return None
                continue
            if where == "value":
                open_[-1][1] = "attributes"
                if sign == "{":
                    return at + 1, "JVALUE"
                if sign == "<":
                    open_.append(["", "tag"])
                    at += 1
                    continue
                m = _ATTRIBUTE_TEXT.match(text, at)
                if m is None:
                    return None
                at = m.end()
                continue
            if sign == "{":
                m = _SPREAD.match(text, at + 1)
                return (m.end(), "JSPREAD") if m else None
            if sign == ">":
                open_[-1][1] = "children"
                at += 1
                continue
            if sign != "/":
                m = _ATTRIBUTE.match(text, at)
                if m is None:
                    return None
                after = _TAG_SPACE.match(text, m.end()).end()
                at = m.end()
                if text.startswith("=", after):
                    open_[-1][1], at = "value", after + 1
                continue
            at = _TAG_SPACE.match(text, at + 1).end()
            if not text.startswith(">", at):
                return None
            open_.pop()
        at += 1
        if not open_:
            return at, None


def kotlin_string(text: str, at: int) -> tuple[int, Spans] | None:
    """The end of the string that starts at `at`, and where the expressions in its templates stand; None if it has no end."""
    holes: Spans = []
    stack: list[tuple[str, int]] = []  # open quotes, and braces with the place after those of a template

    def opened(at: int) -> int:
        quote = '"""' if text.startswith('"""', at) else '"'
        stack.append((quote, 0))
        return at + len(quote)

    at = opened(at)
    while stack:
        kind, first = stack[-1]
        if kind == "{":
            at = _KOTLIN_CODE.match(text, at).end()
            sign = text[at : at + 1]
            if sign == '"':
                at = opened(at)
            elif sign == "{":
                stack.append(("{", 0))
                at += 1
            elif sign == "}":
                stack.pop()
                if first:
                    holes.append((first, at))
                at += 1
            else:
                return None
            continue
        at = _KOTLIN_PLAIN[kind].match(text, at).end()
        if text.startswith(kind, at):
            at += len(kind)
            while kind == '"""' and text.startswith('"', at):
                at += 1
            stack.pop()
        elif text.startswith("${", at):
            at += 2
            stack.append(("{", at))
        else:
            return None
    return at, holes


def _template_error(text: str, holes: Spans, parses: Callable[[str], bool]) -> tuple[int, str] | None:
    wrong = [a for a, b in holes if not parses(text[a:b])]
    return (min(wrong), "template that does not parse") if wrong else None


@dataclass(frozen=True)
class Tags:
    """How elements are read: what judges type arguments (none in JavaScript), and whether one may follow a closing bracket."""

    types: Callable[[str], bool] | None = None
    after_brackets: bool = False


def brackets(text: str, pattern: re.Pattern, grammar: Grammar, script: bool = False, lines_in_parens: bool = True, parses: Callable[[str], bool] | None = None, tags: Tags | None = None) -> Tokens:
    """Tokens of a language with brackets; in scripts, slashes and backquotes are told apart by what precedes them.

    Where strings may hold templates with code, parses judges their expressions. With tags, elements of JSX are read: a
    JSX token for one without braces, else JOPEN, for each brace the token of its kind, and JCLOSE.
    """
    kind_of, words = grammar.kind_of, grammar.literals
    name_kind, number, string = kind_of["NAME"], kind_of["NUMBER"], kind_of["STRING"]
    kinds, breaks, starts, matches, stack = bytearray(), bytearray(), [], {}, []
    add_kind, add_break, add_start = kinds.append, breaks.append, starts.append
    at, size, line, error, operand = 0, len(text), 0, None, False
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
    found = pattern.finditer(text, at)
    while at < size:
        m = next(found, None)
        if m is None or m.start() != at:
            while text[at] in " \t":
                at += 1
            whole = kotlin_string(text, at) if parses and text[at] == '"' else None
            if whole is None:
                error = (at, "unterminated literal" if text[at] in "\"'`/" else "unknown character")
                break
            error = _template_error(text, whole[1], parses)
            if error:
                break
            end, group, begun = whole[0], _STRING, at
            found = pattern.finditer(text, end)
        else:
            group, end = m.lastindex, m.end()
            begun = m.start(group)
        if group == _SPACE:
            if "\n" in m[1]:
                line = 1
            at = end
            continue
        if group == _WORD:
            token = m[2]
            if token == "as" and text.startswith("?", end) and "as?" in words:
                token, end = "as?", end + 1
                found = pattern.finditer(text, end)
            if script:
                kind = kind_of["PRIVATE"] if token[0] == "#" else words.get(token, name_kind)
                operand = kind == name_kind or token[0] == "#" or token in ("this", "super", "null", "true", "false")
            else:
                kind = words.get(token, name_kind)
        elif group == _SIGN:
            token = m[5]
            tag = False
            if tags and token == "<" and begins_tag(text, begun, tags.types is not None):
                before = _LAST.match(text, starts[-1]).group() if starts else ""
                word = before[:1].isalpha() and (before in _BEFORE_TAG and not (len(starts) > 1 and text[starts[-2] : starts[-1]].strip() in (".", "?.")))
                tag = word or not operand and not before[:1].isalpha() or tags.after_brackets and before[:1] in (")", "}")
            if tag:
                open_: list = [["", "tag"]]
                step = markup(text, begun + 1, open_, tags.types)
                if step is None:
                    error = (begun, "tag that does not parse")
                    break
                end, hole = step
                operand = hole is None
                kind = kind_of["JSX" if operand else "JOPEN"]
                found = pattern.finditer(text, end)
                if not operand:
                    add_kind(kind)
                    add_break(line)
                    add_start(begun)
                    kind, line, begun = kind_of[hole], 0, end - 1
                    stack.append(("<{", len(kinds), open_))
            elif script and (token == "`" or token[0] == "/" and not operand):
                m = (_TEMPLATE if token == "`" else _REGEX).match(text, begun + (token == "`"))
                if m is None:
                    error = (begun, "unterminated literal")
                    break
                operand = token != "`" or m.group().endswith("`")
                kind = kind_of["REGEX" if token != "`" else "TEMPLATE" if operand else "HEAD"]
                end = m.end()
                found = pattern.finditer(text, end)
                if not operand:
                    stack.append(("${", len(kinds)))
            else:
                if token[0] == "!" and token in ("!in", "!is") and text[end : end + 1].isidentifier():
                    token, end = "!", begun + 1
                    found = pattern.finditer(text, end)
                kind = words.get(token)
                if kind is None:
                    error = (begun, "unknown character")
                    break
                operand = False
                if token in _OPEN:
                    stack.append((token, len(kinds)))
                elif token in _CLOSE:
                    operand = True
                    opened, where = stack[-1][:2] if stack else ("", 0)
                    if _OPEN.get(opened) == token:
                        stack.pop()
                        matches[where] = len(kinds)
                    elif opened == "<{" and token == "}":
                        open_ = stack.pop()[2]
                        step = markup(text, begun + 1, open_, tags.types)
                        if step is None:
                            error = (begun, "tag that does not parse")
                            break
                        add_kind(kind)
                        add_break(line)
                        add_start(begun)
                        end, hole = step
                        operand, line, begun = hole is None, 0, end - 1
                        kind = kind_of[hole or "JCLOSE"]
                        if hole:
                            stack.append(("<{", len(kinds), open_))
                        found = pattern.finditer(text, end)
                    elif opened == "${" and token == "}":
                        m = _TEMPLATE.match(text, begun + 1)
                        if m is None:
                            error = (begun, "unterminated literal")
                            break
                        operand = m.group().endswith("`")
                        stack.pop()
                        if not operand:
                            stack.append(("${", len(kinds)))
                        kind, end = kind_of["TAIL" if operand else "MIDDLE"], m.end()
                        found = pattern.finditer(text, end)
        else:
            kind, operand = (number if group == _NUMBER else string), True
        add_kind(kind)
        if line and not lines_in_parens:
            inside = len(stack) - 1 if stack and stack[-1][1] == len(kinds) - 1 else len(stack)
            line = not inside or stack[inside - 1][0] not in ("(", "[")
        add_break(line)
        add_start(begun)
        line, at = 0, end
    if error is None and starts and "/*" in text[starts[-1] :] and "*/" not in text[starts[-1] :]:
        error = (text.rfind("/*"), "unterminated comment")
    return Tokens(bytes(kinds) + b"\0", bytes(breaks) + b"\1", [*starts, size], matches, error)


_PREFIX = r"(?i:[rbu]|br|rb)?"
_PYTHON_STRING = rf'{_PREFIX}(?:"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]++|\\[\s\S]|\'(?!\'\'))*+\'\'\'|"(?!"")(?:[^"\\\n]++|\\[\s\S])*+"|""(?!")|\'(?!\'\')(?:[^\'\\\n]++|\\[\s\S])*+\'|\'\'(?!\'))'
_PYTHON_TEMPLATE = r"(?i:f|fr|rf)(?:\"\"\"|'''|\"|')"
PYTHON_NUMBER = (
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
    r"|(?:0(?:_?0)*|[1-9](?:_?\d)*)(?![\d_])\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
)
PYTHON_SIGN = r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=()\[\]{},:.;]"
PYTHON = re.compile(
    rf"[ \t]*(?:([ \t\f\ufeff]+|#[^\n]*|\\\r?\n)|(?P<line>\r?\n|\r)|(?P<string>{_PYTHON_STRING})"
    rf"|(?P<number>(?:{PYTHON_NUMBER}))(?![\w])|(?!{_PYTHON_TEMPLATE})(?P<name>[^\W\d]\w*)|(?P<sign>{PYTHON_SIGN}))"
)
_TEMPLATE_HEAD, _WHOLE_STRING = re.compile(_PYTHON_TEMPLATE), re.compile(_PYTHON_STRING)
#: What of an expression in a template ends nothing; the sign that its text is wanted too, and how it is to be written.
_PYTHON_CODE = re.compile(r"(?:#[^\n]*|[^\W\d]\w*|[^\w\"'#()\[\]{}!:=]|\d\w*|[=!<>]=)+")
_WRITTEN = re.compile(r"(?:=(?!=)\s*)?(?:!\s*[rsa]\s*)?(?=[:}])")
#: Templates within templates that the language allows.
_MOST_NESTED = 150


def python_template(text: str, at: int) -> tuple[int, Spans] | None:
    """The end of the f-string that starts at `at`, and where its expressions stand; None if it is none of the language's."""
    holes: Spans = []
    stack: list[list] = []  # ["text", quotes, raw], ["hole", first place, brackets open], ["spec", quotes]

    def opened(m: re.Match) -> int:
        prefix = m.group().rstrip("\"'")
        stack.append(["text", m.group()[len(prefix) :], "r" in prefix.lower()])
        return m.end()

    at = opened(_TEMPLATE_HEAD.match(text, at))
    while stack:
        if at >= len(text) or len(stack) > 2 * _MOST_NESTED:
            return None
        frame, c = stack[-1], text[at]
        if frame[0] == "hole":
            if m := _TEMPLATE_HEAD.match(text, at):
                at = opened(m)
            elif m := _WHOLE_STRING.match(text, at):
                at = m.end()
            elif not frame[2] and (m := _WRITTEN.match(text, at)) and (m.group() or c in ":}"):
                holes.append((frame[1], at))
                stack.pop()
                at = m.end() + 1
                if text[at - 1] == ":":
                    stack.append(["spec", next(f[1] for f in reversed(stack) if f[0] != "hole")])
            elif c in "([{":
                frame[2].append(c)
                at += 1
            elif c in ")]}":
                if not frame[2] or _OPEN[frame[2].pop()] != c:
                    return None
                at += 1
            elif m := _PYTHON_CODE.match(text, at):
                at = m.end()
            elif c in "=:" or c == "!" and frame[2]:
                at += 1
            else:
                return None
        elif text.startswith(frame[1], at) and frame[0] == "text":
            stack.pop()
            at += len(frame[1])
        elif c == "{" and (frame[0] == "spec" or text[at + 1 : at + 2] != "{"):
            stack.append(["hole", at + 1, []])
            at += 1
        elif c == "}" and frame[0] == "spec":
            stack.pop()
            at += 1
        elif c == "}" and text[at + 1 : at + 2] != "}":
            return None
        elif c in "{}":
            at += 2
        elif c == "\\" and frame[0] == "text":
            named = not frame[2] and text.startswith("\\N{", at) and text.find("}", at)
            at = named + 1 if named and named > 0 else at + (1 if text[at + 1 : at + 2] in ("{", "}") else 2)
        elif c == "\n" and len(frame[1]) == 1 or frame[0] == "spec" and text.startswith(frame[1], at):
            return None
        else:
            at += 1
    return at, holes


def indented(text: str, grammar: Grammar, parses: Callable[[str], bool]) -> Tokens:
    """Tokens of Python, with NEWLINE, INDENT and DEDENT; parses judges the expressions in f-strings."""
    kind_of, words = grammar.kind_of, grammar.literals
    name_kind, number, string, new_line = kind_of["NAME"], kind_of["NUMBER"], kind_of["STRING"], kind_of["NEWLINE"]
    kinds, starts, matches, stack = bytearray(), [], {}, []
    levels: list[tuple[int, int, int]] = [(0, 0, -1)]
    at, size, error, fresh, found = 0, len(text), None, True, iter(())

    def put(kind: str, where: int) -> None:
        kinds.append(kind_of[kind])
        starts.append(where)

    while at < size:
        if fresh and not stack:
            begun = at
            while at < size and text[at] in " \t\f\ufeff":
                at += 1
            rest = text[at : at + 1]
            if rest == "\\" and text[at + 1 : at + 2] in ("\n", "\r"):
                pass
            elif rest in ("", "#", "\n", "\r"):
                end = text.find("\n", at)
                at = size if end < 0 else end + 1
                continue
            else:
                width = text[begun:at].replace("\ufeff", "").rsplit("\f", 1)[-1]
                wide, narrow = len(width.expandtabs(8)), len(width.expandtabs(1))
                if wide > levels[-1][0]:
                    if narrow <= levels[-1][1]:
                        error = (at, "inconsistent tabs")
                        break
                    levels.append((wide, narrow, len(kinds)))
                    put("INDENT", at)
                while wide < levels[-1][0]:
                    matches[levels.pop()[2]] = len(kinds)
                    put("DEDENT", at)
                if wide != levels[-1][0] or narrow != levels[-1][1]:
                    error = (at, "inconsistent indentation")
                    break
            fresh = False
            found = PYTHON.finditer(text, at)
        m = next(found, None)
        if m is None or m.start() != at:
            while text[at] in " \t":
                at += 1
            whole = python_template(text, at) if _TEMPLATE_HEAD.match(text, at) else None
            if whole is None:
                error = (at, "unterminated literal" if text[at] in "\"'" or _TEMPLATE_HEAD.match(text, at) else "unknown character")
                break
            error = _template_error(text, whole[1], parses)
            if error:
                break
            kinds.append(string)
            starts.append(at)
            at = whole[0]
            found = PYTHON.finditer(text, at)
            continue
        group, at = m.lastindex, m.end()
        if group == 1:
            continue
        if group == 5:
            kind = words.get(m[5], name_kind)
        elif group == 6:
            token = m[6]
            if token in _OPEN:
                stack.append((token, len(kinds)))
            elif token in _CLOSE and stack and _OPEN[stack[-1][0]] == token:
                matches[stack.pop()[1]] = len(kinds)
            kind = words.get(token, 0)
            if not kind:
                error = (m.start(6), "unknown character")
                break
        elif group == 2:
            if stack:
                continue
            kind, fresh = new_line, True
        else:
            kind = string if group == 3 else number
        kinds.append(kind)
        starts.append(m.start(group))
    if error is None and not stack:
        if not fresh:
            put("NEWLINE", size)
        while len(levels) > 1:
            matches[levels.pop()[2]] = len(kinds)
            put("DEDENT", size)
    return Tokens(bytes(kinds) + b"\0", bytes(len(kinds) + 1), [*starts, size], matches, error)
