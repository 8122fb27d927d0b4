"""Writing reports, baselines, ledgers and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_ledger(runs: DataFrame, path: str) -> None:
    """Adds runs to a ledger of JSON lines."""
    runs.write.mode("append").json(path)


def write_texts(rows: DataFrame, text: str, path: str) -> None:
    """One text a line group: SARIF or patches; null and empty texts are left out."""
    rows.where(F.length(text) > 0).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_baseline(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, partitioned by repository, so that a repository's baseline is read alone."""
    entries.write.mode("overwrite").partitionBy("repository_id").json(path)
