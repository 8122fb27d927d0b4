"""Scores, buckets, counts and rates of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C

#: Weights of the factors taint, precision, sanitizer and reach, and the least score that is kept.
WEIGHTS = (0.35, 0.30, 0.20, 0.15)
KEPT = 0.70
#: Rules about tainted input, whose findings without known method start lower.
TAINTED = ("SEC-004", "SEC-005", "SEC-006", "SEC-007")


def factors(rule: Column, snippet: Column, method: Column, line: Column) -> tuple[Column, Column, Column, Column]:
    """The four factor scores from a finding's own fields."""
    has = F.length(F.trim(F.coalesce(snippet, F.lit("")))) > 0
    taint = F.when(C.rule_key(rule).isin(*TAINTED), 0.45).when(has, 0.95).otherwise(0.70)
    precision = F.when(method.isNull(), 0.50).when(has & (line > 0), 1.0).otherwise(0.75)
    sanitizer = F.when(F.coalesce(snippet, F.lit("")).rlike(r"\.replaceAll|\.replace|requireNonNull|isValid|sanitize|escape"), 0.20).otherwise(1.0)
    reach = F.when(F.lower(F.coalesce(method, F.lit(""))).rlike("private|internal"), 0.15).otherwise(0.65)
    return taint, precision, sanitizer, reach


def calibrated(scores: tuple[Column, Column, Column, Column]) -> Column:
    """The weighted sum of the factors in [0, 1], two decimals, halves up."""
    total = sum((F.lit(w) * s for w, s in zip(WEIGHTS[1:], scores[1:])), F.lit(WEIGHTS[0]) * scores[0])
    return C.half_up(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def bucket(score: Column, severity: Column) -> Column:
    """How easily a finding is exploited, by score and severity."""
    return (
        F.when((score >= 0.88) | ((severity == "CRITICAL") & (score >= 0.80)), "CRITICAL").when((score >= 0.75) | ((severity == "HIGH") & (score >= 0.70)), "HIGH")
        .when(score >= 0.60, "MEDIUM").when(score >= 0.40, "LOW").otherwise("VERY_LOW")
    )


def matrix(rows: DataFrame, *by: str, of: str = "classification") -> DataFrame:
    """by, tp, fp, tn, fn: a confusion matrix by group; other classes count nowhere."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(of) == x.upper()).alias(x) for x in ("tp", "fp", "tn", "fn")])


def with_rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1, fpr and fnr; empty denominators give 1 for recall, 0 for fpr, fnr and f1.

    Precision without any positive call is 1 if nothing was missed, else 0.
    """
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    rated = counts.withColumns({"precision": precision, "recall": recall, "fpr": F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0), "fnr": F.when(fn + tp > 0, fn / (fn + tp)).otherwise(0.0)})
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def severity_map(rows: DataFrame, *by: str, of: str = "severity") -> DataFrame:
    """by, severities: a map of the counts of the four severities, 0 where none."""
    names = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    return rows.groupBy(*by).agg(*[F.count_if(F.col(of) == n).alias(n) for n in names]).select(*by, F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("severities"))
