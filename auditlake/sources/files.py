"""Files as tables: source trees, diffs, baselines, policies and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import catalog
from auditlake.functions import columns as C

BASELINE = (
    "version string, createdAt string, targetPath string, totalEntries int, entries array<struct<fingerprint:string,filePath:string,ruleId:string,"
    "startLine:int,endLine:int,className:string,methodName:string,snippet:string,capturedAt:string>>"
)
POLICY = (
    "policyName string, version string, maxAllowedCritical int, maxAllowedHigh int, maxAllowedMedium int, maxAllowedLow int, failOnUnverifiedPatch boolean, "
    "blockedRules array<string>, requiredTags array<string>"
)
LEDGER = (
    "runId string, timestamp string, targetPath string, commitId string, branch string, operator string, inputFingerprint string, reportSignature string, rulesActive int, "
    "policyStatus string, totalFindings int, totalPatches int, activeFindings int, suppressedFindings int, blockedFindings int, "
    "executionTimings struct<parseMs:bigint,analysisMs:bigint,patchMs:bigint,totalMs:bigint>"
)


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, raw_source): all files of known languages under root, outside ignored folders."""
    texts = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("raw_source"))
    ignored = F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, catalog.IGNORED)))
    return texts.withColumn("language", C.language_of(F.col("file_path"))).where("language is not null").where(~ignored).select("file_path", "language", "raw_source")


def one_source(spark: SparkSession, code: str, path: str = "InMemory.java") -> DataFrame:
    """(file_path, language, raw_source) of one text; unknown extensions count as Java."""
    return spark.createDataFrame([(path, code)], "file_path string, raw_source string").select("file_path", C.language_of(F.col("file_path"), "JAVA").alias("language"), "raw_source")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of a baseline's JSON, with its position."""
    return spark.read.schema(BASELINE).json(path, multiLine=True).select(F.posexplode("entries").alias("pos", "e")).select("pos", "e.*")


def policy(spark: SparkSession, path: str) -> DataFrame:
    """A policy's row; missing limits are 0 for critical and high, -1 (no limit) for the others."""
    rows = spark.read.schema(POLICY).json(path, multiLine=True)
    return rows.fillna({"maxAllowedCritical": 0, "maxAllowedHigh": 0, "maxAllowedMedium": -1, "maxAllowedLow": -1, "failOnUnverifiedPatch": True})


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a ledger of JSON lines, the first of each run id; lines that are no JSON object are left out."""
    return spark.read.schema(LEDGER).json(path).where("runId is not null").dropDuplicates(["runId"])


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_path, diff): unified diff files as whole texts."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_path"), F.col("value").alias("diff"))


def ignore_rules(spark: SparkSession, path: str) -> DataFrame:
    """(pos, path, rule): the lines of an ignore file: path:RULE, a path, or a rule; # begins a comment."""
    text = F.trim(F.regexp_replace("line", r"#.*$", ""))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).select("pos", text.alias("t")).where("t != ''")
    both = F.regexp_extract("t", r"^(.*):([A-Za-z*][\w*-]*)$", 1)
    alone = F.col("t").rlike(r"^(?i:[A-Z]+-\d+[\w-]*|all|\*)$")
    return rows.select("pos", F.when(both != "", C.normal_path(both)).when(~alone, C.normal_path(F.col("t"))).alias("path"), F.when(both != "", F.regexp_extract("t", r":([A-Za-z*][\w*-]*)$", 1)).when(alone, F.col("t")).alias("rule"))
