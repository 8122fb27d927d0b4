"""The rule catalogue and the word lists of the rules: fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rule key, priority, default severity and weakness number of each rule.
RULES = (
    ("SEC-001", 3, "CRITICAL", 393), ("SEC-002", 2, "HIGH", 404), ("SEC-003", 1, "HIGH", 362), ("SEC-004", 4, "CRITICAL", 78),
    ("SEC-005", 5, "CRITICAL", 89), ("SEC-006", 6, "CRITICAL", 22), ("SEC-007", 7, "CRITICAL", 502), ("SEC-008", 8, "HIGH", 798),
    ("SEC-009", 9, "HIGH", 352), ("SEC-010", 10, "MEDIUM", 942), ("SEC-011", 11, "CRITICAL", 611), ("SEC-012", 12, "CRITICAL", 918),
    ("SEC-013", 13, "CRITICAL", 347), ("SEC-014", 14, "HIGH", 117), ("SEC-015", 15, "CRITICAL", 90), ("SEC-016", 16, "CRITICAL", 643),
    ("SEC-017", 17, "HIGH", 601), ("SEC-018", 18, "HIGH", 327), ("SEC-019", 19, "HIGH", 338), ("SEC-020", 20, "HIGH", 79),
    ("ARCH-001", 21, "MEDIUM", 1047), ("ARCH-002", 22, "HIGH", 497), ("ARCH-003", 23, "MEDIUM", None),
)

#: Severities from the most to the least severe.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

#: Extensions and their languages.
EXTENSIONS = (("java", "JAVA"), ("kt", "KOTLIN"), ("kts", "KOTLIN"), ("py", "PYTHON"), ("js", "JAVASCRIPT"), ("jsx", "JAVASCRIPT"), ("ts", "TYPESCRIPT"), ("tsx", "TYPESCRIPT"))

#: Path segments whose files are not scanned.
IGNORED = (".git", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache", "target", "dist", "build")


def rules(spark: SparkSession) -> DataFrame:
    """(rule_key, priority, severity, cwe): the catalogue, a table of fixed size."""
    return spark.createDataFrame(RULES, "rule_key string, priority int, severity string, cwe int")


def rules_sql() -> str:
    """The catalogue as a SQL relation."""
    rows = ", ".join(f"('{k}', {p}, '{s}', {'NULL' if c is None else c})" for k, p, s, c in RULES)
    return f"(values {rows}) as r(rule_key, priority, severity, cwe)"
