"""Problem 3: source files that do not parse in the language of their extension.

Each text is cut into tokens and parsed by a packrat grammar that must take all of them. A text that parses is mostly cut
in one pass of a regular expression; where it does not, or holds more than that pass knows, it is cut token by token. A failure is reported with
the line and column of the furthest token at which nothing fitted, and a cause: markers of a merge conflict, a text cut
off, the syntax of another of the languages, a literal or character that is no token, or an unexpected token. Bodies in
brackets are remembered by the kinds of their tokens, so that a task parses a common shape once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import lexers, quick
from auditlake.llm.grammars import grammar
from auditlake.llm.handwritten import extension, language
from auditlake.llm.peg import Tokens
from auditlake.storage import spread

LANGUAGES = ("java", "python", "javascript", "typescript", "kotlin")
MARKERS = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M)


#: How the expression in a template of a string is written as a text of its own, and templates whose verdict a task remembers, of
#: so many characters at most.
WRAPPED = {"python": "({}\n)", "kotlin": "val it = ({}\n)"}
KEPT, LONGEST = 50_000, 500
_verdicts: dict[tuple[str, str], bool] = {}


def tokens_of(text: str, lang: str, parses: Callable[[str], bool] | None = None, tags: lexers.Tags | None = None) -> Tokens:
    """The tokens of a text; parses judges the expressions in templates of strings, by default by the grammar.

    Elements are read with tags, in the languages jsx and tsx.
    """
    rules, parses = grammar(lang), parses or partial(expression, lang)
    if lang == "python":
        return lexers.indented(text, rules, parses)
    if lang == "java":
        return lexers.brackets(text, lexers.JAVA, rules)
    if lang == "kotlin":
        return lexers.brackets(text, lexers.KOTLIN, rules, lines_in_parens=False, parses=parses)
    return lexers.brackets(text, lexers.SCRIPT, rules, script=True, tags=tags)


def expression(lang: str, text: str) -> bool:
    """Whether the text in a template is an expression. Templates inside it are judged by themselves."""
    known = _verdicts.get((lang, text))
    if known is None:
        found = tokens_of(WRAPPED[lang].format(text), lang, lambda _: True)
        known = bool(text.strip()) and found.error is None and grammar(lang).failure(found) is None
        if len(text) <= LONGEST:
            if len(_verdicts) >= KEPT:
                _verdicts.clear()
            _verdicts[lang, text] = known
    return known


#: What judges the templates of a language's strings.
_expressions = {lang: partial(expression, lang) for lang in WRAPPED}


def type_arguments(text: str) -> bool:
    return failure(f"type It = It{text};", "typescript") is None


def failure_with_elements(text: str, lang: str) -> tuple[int, str] | None:
    """failure of a text of JavaScript or TypeScript that may hold elements of JSX.

    An element that follows a closing bracket, as the body of a loop or condition, is only looked for where the text
    does not parse otherwise: there the sign < mostly compares.
    """
    mixed, types = ("tsx", type_arguments) if lang == "typescript" else ("jsx", None)
    found = failure(text, mixed, lexers.Tags(types))
    return found and failure(text, mixed, lexers.Tags(types, True)) and found


def parses(text: str, lang: str) -> bool:
    """Whether a text, that is probably no program of the language, is one; its lexer ends at the first error."""
    found = tokens_of(text, lang)
    return found.error is None and grammar(lang).takes(found)


def failure(text: str, lang: str, tags: lexers.Tags | None = None) -> tuple[int, str] | None:
    """None if a text is a program of the language, else the offset of the failure and what is there."""
    found = quick.tokens(text, lang, _expressions.get(lang)) if tags is None else None
    if found is not None and grammar(lang).takes(found):
        return None
    found = tokens_of(text, lang, tags=tags)
    at = grammar(lang).failure(found)
    if found.error is not None:
        where = found.starts[at] if at is not None and at < len(found.starts) - 1 else found.error[0]
        return min(where, found.error[0]), found.error[1]
    if at is None:
        return None
    return found.starts[min(at, len(found.starts) - 1)], "end of text" if at >= len(found.starts) - 1 else "unexpected token"


def cause(text: str, lang: str, at: int, what: str) -> str:
    """Why a text that fails at offset `at` with `what` probably does."""
    if len(MARKERS.findall(text)) >= 2 or MARKERS.match(text, text.rfind("\n", 0, at) + 1):
        return "merge conflict"
    if what == "end of text":
        return "cut off"
    if any(parses(text, other) for other in LANGUAGES if other != lang and not {other, lang} == {"javascript", "typescript"}):
        return "another language"
    return what


#: Where elements of JSX seem to begin.
ELEMENT = re.compile(r"(?:[(=?:,>]|&&|\|\||\breturn)\s*<(?:>|[A-Za-z][\w.]*(?:\s[^<>]*|\s*/)?>)")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    names = ["parses", "line_no", "column_no", "cause"]
    for batch in batches:
        rows = []
        for lang, mixed, text in zip(*(c.to_pylist() for c in batch.columns[-3:])):
            found = failure(text, lang)
            elements = found is not None and mixed and "<" in text
            other = failure_with_elements(text, lang) if elements else None
            if found is None:
                rows.append((True, None, None, None))
            elif elements and other is None:
                rows.append((None, None, None, "JSX"))
            else:
                at, what = other if elements and ELEMENT.search(text) else found
                rows.append((False, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), cause(text, lang, at, what)))
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays(batch.columns[:-2] + [pa.array(c, k) for c, k in zip(columns, kinds)], batch.schema.names[:-2] + names)


def checked(sources: DataFrame) -> DataFrame:
    """(source_id, repository_id, language, parses, line_no, column_no, cause) of every file of a known extension.

    Null texts and paths of other extensions give no row; empty texts parse. Positions are null where a text parses.
    Texts may nest as deeply as they like. Files of JSX (.jsx, .tsx) are judged with their elements. One that parses with
    them alone, and not as plain JavaScript or TypeScript, is valid: parses is null there, and the cause JSX.
    """
    mixed = extension(F.col("file_path")).isin("jsx", "tsx")
    rows = sources.where("raw_source is not null").select("source_id", "repository_id", language(F.col("file_path")).alias("language"), mixed.alias("mixed"), "raw_source").where("language is not null")
    kind = f"source_id {sources.schema['source_id'].dataType.simpleString()}, repository_id string, language string"
    return spread(rows).mapInArrow(_check, f"{kind}, parses boolean, line_no int, column_no int, cause string")


def invalid(sources: DataFrame) -> DataFrame:
    """(source_id): the files that do not parse."""
    return checked(sources).where("not parses").select("source_id")


def rates(sources: DataFrame, elements: bool = False) -> DataFrame:
    """(repository_id, language, cause, files, failed, rate): failures by repository, language and cause.

    cause is null in the row of all causes; files counts all files of the repository and language, and with elements
    those as well that parse with elements of JSX alone.
    """
    found = checked(sources).where(F.lit(elements) | F.col("parses").isNotNull()).groupBy("repository_id", "language", "cause").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("parses")).alias("failed"))
    whole = found.groupBy("repository_id", "language").agg(F.sum("n").alias("files"), F.sum("failed").alias("failed"))
    by_cause = found.where("failed > 0").select("repository_id", "language", "cause", "failed").join(whole.drop("failed"), ["repository_id", "language"])
    every = by_cause.unionByName(whole.withColumn("cause", F.lit(None).cast("string")))
    return every.select("repository_id", "language", "cause", "files", "failed", (F.col("failed") / F.col("files")).alias("rate"))
