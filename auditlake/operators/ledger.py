"""Audit ledgers: signatures, checks, first deliveries and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signed fields in their order.
SIGNED = ("run_id", "repository_id", "target_path", "commit_id", "branch_name", "input_fingerprint", "policy_status", "total_findings", "active_findings", "suppressed_findings", "blocked_findings")


def signature(*fields: str) -> Column:
    """SHA-256 over the fields joined by bars; nulls are empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields or SIGNED]
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_deliveries(ledger: DataFrame) -> DataFrame:
    """One row of each run: the one received first; runs appended twice are equal otherwise."""
    first = Window.partitionBy("run_id").orderBy("received_at", "batch_no")
    return ledger.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def logged_at(text: Column) -> Column:
    """The time of an ISO-8601 text or of epoch seconds with a fraction, in microseconds; null for anything else."""
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT"), F.try_to_timestamp(text))
    seconds = F.when(text.rlike(r"^\d+(\.\d+)?$"), text).try_cast("decimal(20,9)")
    epoch = F.timestamp_micros(F.floor(seconds * 1000000).cast("long"))
    return F.coalesce(iso, epoch)


def verified(ledger: DataFrame, signed: DataFrame) -> DataFrame:
    """(run_id, ok): whether a run's fields still give the signature kept for it, whatever its letter case."""
    kept = signed.select("run_id", F.lower("signature").alias("kept"))
    return ledger.select("run_id", signature().alias("now")).join(kept, "run_id").select("run_id", (F.col("kept") == F.col("now")).alias("ok"))
