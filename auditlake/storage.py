"""Reading the input tables, shared staging and task spreading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets an own temporary one; on a cluster that is an error, as
    no folder of one machine is shared.
    """
    context = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if conf or held.isDefined():
        return (conf or held.get()).rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir (or SparkContext.setCheckpointDir) to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-auditlake-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spreads rows over the cores where the scan has fewer partitions than cores; large scans stay unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)


def column_or_null(df: DataFrame, name: str, kind: str):
    """df[name], or a null of that type where the column is missing."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
