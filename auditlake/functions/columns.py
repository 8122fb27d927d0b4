"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.catalog import EXTENSIONS, SEVERITIES
from auditlake.storage import spread


def normal_path(path: Column) -> Column:
    """A path with forward slashes, trimmed, without leading ./ and /."""
    return F.regexp_replace(F.trim(F.translate(path, "\\", "/")), r"^(\./|/)+", "")


def file_of(path: Column) -> Column:
    return F.regexp_extract(normal_path(path), r"([^/]*)$", 1)


def language_of(path: Column, otherwise: str | None = None) -> Column:
    """The language of a path's extension; `otherwise` for unknown ones."""
    found = F.lit(otherwise).cast("string")
    for ext, lang in reversed(EXTENSIONS):
        found = F.when(F.lower(path).endswith(f".{ext}"), lang).otherwise(found)
    return found


def rule_key(rule: Column) -> Column:
    """The first two segments of a rule id in capitals: its key in the catalogue."""
    return F.regexp_extract(F.upper(rule), r"^\s*([A-Z]+-[0-9]+)", 1)


def severity_rank(severity: Column) -> Column:
    """0 for the most severe; unknown and null severities after the least."""
    found = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES):
        found = F.when(severity == name, i).otherwise(found)
    return found


def collapsed(text: Column) -> Column:
    """White space collapsed to single blanks, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+", " "))


def finding_fingerprint(path: Column, rule: Column, method: Column, snippet: Column) -> Column:
    """The first 32 hex digits of SHA-256 over path, rule, method and collapsed snippet, joined by bars."""
    empty = F.lit("")
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(normal_path(path), empty), F.coalesce(rule, empty), F.coalesce(method, empty), collapsed(snippet)), 256), 1, 32)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for empty texts, null for null."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    total = F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n == 0, 0.0).otherwise(total)


def masked(text: Column) -> Column:
    """Quoted values of eight or more word characters, cut after four."""
    return F.regexp_replace(text, r"([\"'])([A-Za-z0-9_\-]{4})[A-Za-z0-9_\-]{4,}([\"'])", "$1$2****$3")


def lines(sources: DataFrame, *keep: str, text: str = "raw_source") -> DataFrame:
    """keep, line_no, line: a row for each line, counted from 1; null texts give none, empty ones a single empty line."""
    rows = spread(sources.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text")))
    return rows.select(*keep, F.posexplode(F.split("_text", r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def half_up(value: Column) -> Column:
    """Rounded to two decimals, halves up, by the same arithmetic in every engine."""
    return F.floor(value * 100 + 0.5) / 100
