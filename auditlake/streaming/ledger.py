"""Ledgers and inspections as streams: first deliveries, sessions and skipping of known content."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.storage import shared_dir


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, be it a folder of files or one file."""
    place = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(place).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(place)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def first_of(stream: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Rows whose keys were not seen before; state older than the lateness is dropped, later copies are then kept out too."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicates(keys).drop("_at")


def sessions(rows: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """keys, started, ended, rows: runs of rows of which each follows the last within the gap. For streams and tables.

    The end is the last row's time plus the gap, as for session windows.
    """
    window = F.session_window(F.col(at).cast("timestamp"), gap)
    return rows.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "rows")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, into a table of the shared folder, and reads that table."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
