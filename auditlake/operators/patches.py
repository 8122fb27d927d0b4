"""Fixes of findings by rule: a registry of pattern replacements, checked by running the rule again, for snippets and whole files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C

#: By rule key: the pattern whose match is the finding, what to replace, and by what ($1.. are groups).
FIXES = (
    ("SEC-001", r"(?:catch \([^)]*\) \{|except \w+:)\s*return (?:true|True)", r"((?:catch \([^)]*\) \{|except \w+:)\s*return )(?:true|True)", "$1False"),
    ("SEC-003", r"volatile (?:long|int) ", r"volatile (?:long|int) (\w+);", "final AtomicLong $1 = new AtomicLong();"),
    ("SEC-004", r"shell=True", r"shell=True", "shell=False"),
    ("SEC-005", r"execute\(\"[^\"]*'%s'[^\"]*\" % \w+\)", r"execute\((\"[^\"]*)'%s'([^\"]*\") % (\w+)\)", "execute($1%s$2, ($3,))"),
    ("SEC-006", r"os\.path\.join\(\w+, \w+ \+", r"os\.path\.join\((\w+), (\w+) \+", "safe_join($1, $2 +"),
    ("SEC-007", r"pickle\.loads\(", r"pickle\.loads\(", "json.loads("),
    ("SEC-009", r"csrf\(c -> c\.disable\(\)\)|@csrf_exempt", r"csrf\(c -> c\.disable\(\)\)|@csrf_exempt\s*", ""),
    ("SEC-010", r"\"origins\": \"\*\"|origins = \"\*\"", r"(\"origins\": |origins = )\"\*\"", '$1"https://trusted.invalid"'),
    ("ARCH-003", r"System\.currentTimeMillis\(\)", r"System\.currentTimeMillis\(\)", "clock.millis()"),
)


def _by_rule(at: int, otherwise: Column, of) -> Column:
    found = otherwise
    for fix in reversed(FIXES):
        found = F.when(F.col("rule_key") == fix[0], of(*fix[1:])).otherwise(found)
    return found


def patched(entries: DataFrame, snippet: str = "snippet") -> DataFrame:
    """entries with rule_key, fires, patched, fires_after: each snippet with its rule's fix applied.

    Rules without a fix leave the snippet as it is and do not fire. Null snippets stay null and do not fire.
    """
    text = F.coalesce(F.col(snippet), F.lit(""))
    rows = entries.withColumn("rule_key", C.rule_key(F.col("rule_id")))
    rows = rows.withColumn("fires", _by_rule(0, F.lit(False), lambda p, w, r: text.rlike(p)))
    rows = rows.withColumn("patched", F.when(F.col(snippet).isNotNull(), _by_rule(1, text, lambda p, w, r: F.regexp_replace(text, w, r))))
    after = F.coalesce(F.col("patched"), F.lit(""))
    return rows.withColumn("fires_after", _by_rule(0, F.lit(False), lambda p, w, r: after.rlike(p)))


def stage(snippet: str = "snippet") -> Column:
    """The first stage of remediation that fails: no snippet, no fix known, not detected, unchanged, still firing, or fixed."""
    known = F.col("rule_key").isin([f[0] for f in FIXES])
    return (
        F.when(F.col(snippet).isNull(), "NO_SNIPPET").when(~known, "NO_FIX").when(~F.col("fires"), "NOT_DETECTED").when(F.col("patched") == F.col(snippet), "UNCHANGED")
        .when(F.col("fires_after"), "STILL_FIRES").otherwise("FIXED")
    )


#: Languages whose files are patched; findings in others are left to people. Rules whose fix spans several files.
PATCHED, DEFERRED = ("JAVA",), "ARCH-"
STATUS = ("SUCCESS", "PARTIAL", "DEFERRED_TO_MULTI_FILE_PLAN", "FAILED", "MANUAL_REMEDIATION_REQUIRED")


def nearest(lines: list[str], snippet: str, expected: int) -> tuple[int, int] | None:
    """The first and last line (from 1) of a snippet's occurrence nearest to the expected line, the earlier one of two; none if it does not occur.

    A snippet of one line occurs where a line holds it; one of several where the text does.
    """
    wanted = snippet.strip()
    if not wanted:
        return None
    span = wanted.count("\n")
    if span:
        text, at, found = "\n".join(lines), -1, []
        while (at := text.find(wanted, at + 1)) >= 0:
            found.append(text.count("\n", 0, at) + 1)
    else:
        found = [i for i, line in enumerate(lines, 1) if wanted in line]
    best = min(found, key=lambda i: (abs(i - expected), i), default=None)
    return (best, best + span) if best else None


def compose(text: str, found: list[tuple[str, int, str]]) -> tuple[str, str, int, int]:
    """(status, patched text, fixes applied, findings skipped) for the findings (rule key, line, snippet) of a file, in their order.

    Each is looked for again in the text as patched so far, near its line moved by what was added before. One that meets
    lines already changed is skipped unless its snippet is still there. A fix that changes the balance of brackets is
    taken back. SUCCESS if no rule fires any more on the lines changed, PARTIAL if one does.
    """
    fixes = {f[0]: (re.compile(f[1]), re.compile(f[2]), re.sub(r"\$(\d)", r"\\\1", f[3])) for f in FIXES}
    lines, moved, changed, applied, skipped = text.split("\n"), 0, [], 0, 0
    firing: list[tuple[re.Pattern, int, int]] = []
    for key, line_no, snippet in found:
        place = nearest(lines, snippet or "", line_no + moved)
        low, high = place or (max(1, line_no + moved), max(1, line_no + moved))
        if any(a <= high and low <= b for a, b in changed) and place is None or key not in fixes or high > len(lines):
            skipped += 1
            continue
        fires, what, by = fixes[key]
        old = "\n".join(lines[low - 1 : high])
        new = what.sub(by, old)
        if new == old or any(new.count(c) - new.count(d) != old.count(c) - old.count(d) for c, d in ("()", "[]", "{}")):
            skipped += 1
            continue
        block = new.split("\n")
        lines[low - 1 : high] = block
        moved += len(block) - (high - low + 1)
        changed.append((low, low + len(block) - 1))
        firing.append((fires, low, low + len(block) - 1))
        applied += 1
    if applied:
        status = "PARTIAL" if any(f.search("\n".join(lines[a - 1 : b])) for f, a, b in firing) else "SUCCESS"
    else:
        status = "DEFERRED_TO_MULTI_FILE_PLAN" if any(key.startswith(DEFERRED) for key, _, _ in found) else "FAILED"
    return status, "\n".join(lines), applied, skipped


def composed(sources: DataFrame, found: DataFrame, languages: tuple[str, ...] = PATCHED) -> DataFrame:
    """(source_id, status, applied, skipped, patched): the fixes of each file's findings, one after the other.

    found has (source_id, rule_key, line_no, snippet, priority); a file's are at most one for each of its lines and rules,
    and go by priority, line and rule. Files without findings and null texts give no row; files of other languages keep
    their text. Equal findings count once.
    """
    each = found.groupBy("source_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("priority", F.lit(99)).alias("priority"), "line_no", "rule_key", "snippet"))).alias("found"))
    rows = sources.where("raw_source is not null").select("source_id", C.language_of(F.col("file_path")).alias("language"), F.regexp_replace("raw_source", "\r\n", "\n").alias("raw_source")).join(each, "source_id")
    kind = rows.schema["source_id"].dataType.simpleString()

    def patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for language, text, items in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if language in languages:
                    out.append(compose(text, [(x["rule_key"], x["line_no"], x["snippet"]) for x in items]))
                else:
                    out.append((STATUS[-1], text, 0, len(items)))
            status, texts, applied, skipped = zip(*out) if out else [[]] * 4
            columns = [pa.array(status, pa.string()), pa.array(applied, pa.int32()), pa.array(skipped, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["source_id", "status", "applied", "skipped", "patched"])

    return rows.select("source_id", "language", "raw_source", "found").mapInArrow(patch, f"source_id {kind}, status string, applied int, skipped int, patched string")
