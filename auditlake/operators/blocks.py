"""Line rules whose condition needs more than the line: the body of a catch, a method's finally, a file's volatile fields.

Comments and the insides of literals are blanked, so that brackets pair; positions stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.storage import spread

#: Files without any of these words hold no case.
WORDS = r"catch|except|volatile|new\s|fs\.|verify"
STREAMS = "FileInputStream|FileOutputStream|InputStream|OutputStream|FileReader|FileWriter|BufferedReader|BufferedWriter|BufferedInputStream|BufferedOutputStream|DataInputStream|DataOutputStream"

LITERAL = re.compile(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)')
PY_LITERAL = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*')
CATCH = re.compile(r"\bcatch\s*\(([^()]*)\)\s*\{")
METHOD = re.compile(r"([\w.>\]?]+)\s+(\w+)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws[\w.,\s]+)?\{")
NO_TYPE, NO_NAME = {"new", "return", "else", "throw", "do"}, {"if", "for", "while", "switch", "catch", "synchronized", "try"}
TARGETS = re.compile(r"Exception|Throwable")
SECURE = re.compile(r"auth|security|permission|access|check|verify|validate|can")
GRANTED = re.compile(r"return true|grantAccess|authorized = true")
CREATION = re.compile(rf"\bnew\s+(?:{STREAMS})\s*(?:<[^<>]*>)?\s*\(")
ASSIGNED = re.compile(r"(?<![.\w])(\w+)\s*=(?!=)")
EXCEPT = re.compile(r"^([ \t]*)except\b[^\n]*?:[ \t]*([^\n]*)$", re.M)
BROAD = re.compile(r"except(?:\s+\w+(?:\s+as\s+\w+)?)?\s*:")
OUTBOUND = re.compile(r"\b(?:requests|httpx|session|client|urllib\.request|urllib|aiohttp)\.(?:get|post|put|delete|patch|head|options|request|urlopen)\s*\(")
SCOPE = re.compile(r"^\s*(?:(?:async\s+)?(?:def|function)|(?:export\s+)?(?:async\s+)?function)\s+[a-zA-Z0-9_]+")


def _blanked(text: str, lang: str) -> str:
    pattern = PY_LITERAL if lang == "PYTHON" else LITERAL
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _pairs(code: str) -> dict[int, int]:
    """The end of each bracket by its begin; brackets left open end with the text."""
    out, held = {}, {"}": [], ")": []}
    for m in re.finditer(r"[{}()]", code):
        c = m[0]
        if c in "{(":
            held["}" if c == "{" else ")"].append(m.start())
        elif held[c]:
            out[held[c].pop()] = m.start()
    return out | {at: len(code) for left in held.values() for at in left}


def _java(code: str) -> Iterator[tuple[int, str, float]]:
    ends = _pairs(code)
    methods = [(m.end() - 1, ends[m.end() - 1], m[1], m[2]) for m in METHOD.finditer(code) if m[1] not in NO_TYPE and m[2] not in NO_NAME]

    def method(at: int) -> tuple[int, int, str, str] | None:
        return max((x for x in methods if x[0] < at <= x[1]), default=None)

    for m in CATCH.finditer(code):
        kinds = m[1].strip().rpartition(" ")[0]
        body, inside = code[m.end() : ends[m.end() - 1]], method(m.start())
        if TARGETS.search(kinds):
            secure = inside is not None and (inside[2].lower() == "boolean" or SECURE.search(inside[3].lower()))
            if re.search(r"\breturn\s+true\s*;", body) or secure and GRANTED.search(re.sub(r"\s+", " ", body)):
                yield m.start(), "SEC-001", 0.98
    creations = [(m.start(), m.end() - 1, ends[m.end() - 1]) for m in CREATION.finditer(code)]
    resources = [(m.end() - 1, ends[m.end() - 1]) for m in re.finditer(r"\btry\s*\(", code)]
    for at, begin, _ in creations:
        if any(b < at < e for _, b, e in creations if b != begin) or any(b < at < e for b, e in resources):
            continue
        names = ASSIGNED.findall(re.split(r"[;{}]", code[max(0, at - 2000) : at])[-1])
        inside = method(at)
        if names and inside:
            finals = (code[f.end() : ends[f.end() - 1]] for f in re.finditer(r"\bfinally\s*\{", code) if inside[0] < f.start() < inside[1])
            if any(re.search(rf"(?<![.\w]){names[-1]}\s*\.\s*close\s*\(", body) for body in finals):
                continue
        yield at, "SEC-002", 0.95
    fields = set()
    for m in re.finditer(r"\bvolatile\b([^;(){}]*?(?:=[^;]*)?);", code):
        declared = re.sub(r"<[^;=]*>|\([^;]*\)|\{[^;]*\}", " ", m[1])
        fields |= {n[1] for part in declared.split(",") if (n := re.search(r"(\w+)\s*(?:\[\s*\])*\s*$", part.partition("=")[0]))}
    if fields:
        for m in re.finditer(r"(?:\+\+|--)\s*(\w+)\b(?!\s*[.(\[])|(?<![.\w])(\w+)\s*(?:\+\+|--|(?:<<|>>>?|[-+*/%&|^])=)", code):
            if (m[1] or m[2]) in fields:
                yield m.start(), "SEC-003", 0.97


def _kotlin(code: str) -> Iterator[tuple[int, str, float]]:
    for m in re.finditer(r"\bcatch\s*\([^()]*\)\s*\{\s*return\s+true\s*;?\s*\}", code):
        yield m.start(), "SEC-001", 0.98


def _python(code: str) -> Iterator[tuple[int, str, float]]:
    ends = _pairs(code)
    for m in OUTBOUND.finditer(code):
        if re.search(r"\bverify\s*=\s*False\b", code[m.end() : ends[m.end() - 1]]):
            yield m.start(), "SEC-001", 0.99
    for m in EXCEPT.finditer(code):
        if not BROAD.match(code, m.end(1)):
            continue
        body = [m[2]]
        for line in code[m.end() + 1 :].split("\n"):
            if line.strip() and len(line) - len(line.lstrip()) <= len(m[1]):
                break
            body.append(line)
        if any(re.search(r"(?:^|[;:])\s*return\s+True\s*(?:;|$)", x) for x in body):
            yield m.end(1), "SEC-001", 0.94


def _script(text: str) -> Iterator[tuple[int, str, float]]:
    lines, at = text.split("\n"), 0
    for i, line in enumerate(lines):
        if re.search(r"fs\.(?:readFileSync|readFile|createReadStream)\(", line) and ("${" in line or "+" in line):
            start = next((k for k in range(i, -1, -1) if SCOPE.match(lines[k])), 0)
            end, head = len(lines), len(lines[start]) - len(lines[start].lstrip())
            for k in range(start + 1, len(lines)) if start < i else ():
                bare = lines[k].strip()
                if bare.startswith(("def ", "async def ", "class ")) and len(lines[k]) - len(lines[k].lstrip()) <= head:
                    end = k
                    break
            scope = (x.partition("#")[0].partition("//")[0] for x in lines[start:end])
            if not any(re.search(r"path\.(?:normalize|resolve|join)", x) and re.search(r"startsWith|indexOf|includes", x) for x in scope):
                yield at, "SEC-006", 0.95
        at += len(line) + 1


def cases(text: str, lang: str) -> set[tuple[int, str, float]]:
    """(line_no, rule_key, confidence) of the rules that a text breaks."""
    if lang in ("JAVASCRIPT", "TYPESCRIPT"):
        found = _script(text)
    else:
        found = {"JAVA": _java, "KOTLIN": _kotlin, "PYTHON": _python}[lang](_blanked(text, lang))
    return {(text.count("\n", 0, at) + 1, key, confidence) for at, key, confidence in found}


def block_findings(known: DataFrame, *keep: str) -> DataFrame:
    """keep, (source_id, line_no, rule_key, confidence) of known: (source_id, keep, raw_source, language)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *c) for i, (text, lang) in enumerate(zip(*(c.to_pylist() for c in batch.columns[-2:]))) for c in sorted(cases(text, lang))]
            at, *columns = zip(*found) if found else [[]] * 4
            kinds = [pa.int32(), pa.string(), pa.float64()]
            held = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays(held + [pa.array(c, k) for c, k in zip(columns, kinds)], [*batch.schema.names[:-2], "line_no", "rule_key", "confidence"])

    rows = known.where("language in ('JAVA', 'KOTLIN', 'PYTHON', 'JAVASCRIPT', 'TYPESCRIPT')").where(F.col("raw_source").rlike(WORDS)).select("source_id", *keep, "raw_source", "language")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return spread(rows).mapInArrow(check, f"{kinds}, line_no int, rule_key string, confidence double")
