"""Reports of findings: structured results, a capped text and one review comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most characters of a report, most findings in it.
MOST_CHARS, MOST_FINDINGS = 60_000, 20
#: Fixed value: the schema of SARIF 2.1.0.
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: Characters after which a group's next SARIF text begins, and tasks that count a group's.
PART_CHARS, SALTS = 4_000_000, 64


def sarif(findings: DataFrame, *by: str, part_chars: int = PART_CHARS) -> DataFrame:
    """by, part, sarif: the findings of each group as SARIF 2.1.0 texts, each a complete run of bounded size.

    findings has rule_id, level, message, path, start_line, end_line, and may have snippet and help_uri (of the rule); lines
    below 1 become 1, an end before its start the start, a blank path unknown. A run lists the rules that its results
    name, with their level and help, and results give their place among them. Results are ordered by path, line and rule within a part. A group of up to part_chars characters is part
    0 alone; of larger ones each part has about so many. Findings are placed by characters before them, counted by salt,
    so no task holds a group.
    """
    start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    snippet, help_uri = (F.col(c) if c in findings.columns else F.lit(None).cast("string") for c in ("snippet", "help_uri"))
    shown = F.when(F.trim(snippet) != "", F.struct(snippet.alias("text")))
    region = F.struct(start.alias("startLine"), F.greatest(start, F.coalesce("end_line", F.lit(1))).alias("endLine"), shown.alias("snippet"))
    uri = F.when(F.trim("path") != "", F.col("path")).otherwise("unknown")
    place = F.struct(F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    rule = F.struct(F.coalesce("rule_id", F.lit("")).alias("id"), help_uri.alias("helpUri"), F.struct(F.col("level").alias("level")).alias("defaultConfiguration"))
    keyed = F.struct(F.col("path"), start.alias("at"), F.col("rule_id").alias("r"), result.alias("result"), rule.alias("rule"))
    chars = sum((F.length(F.coalesce(c, F.lit(""))).cast("long") for c in ("message", "path", "rule_id", snippet)), F.lit(240).cast("long"))
    rows = findings.select(*by, keyed.alias("k"), F.pmod(F.xxhash64(*findings.columns), F.lit(SALTS)).alias("salt"), chars.alias("chars"))
    salts = Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, "salt").agg(F.sum("chars").alias("chars")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("salt").alias("_salt"), F.coalesce(F.sum("chars").over(salts), F.lit(0)).alias("before"))
    upto = Window.partitionBy(*by, "salt").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("inside", F.coalesce(F.sum("chars").over(upto), F.lit(0)))
    placed = counted.join(before, [counted[c].eqNullSafe(before[f"_{c}"]) for c in (*by, "salt")]).withColumn("part", F.floor((F.col("before") + F.col("inside")) / part_chars).cast("int"))
    # A part is bounded by its characters, and so are its results and rules.
    grouped = placed.groupBy(*by, "part").agg(F.array_sort(F.collect_list("k")).alias("ks"), F.array_sort(F.collect_set("k.rule")).alias("rules"))
    ids = F.transform("rules", lambda r: r["id"])
    numbered = F.transform("ks", lambda k: k["result"].withField("ruleIndex", F.array_position(ids, F.coalesce(k["r"], F.lit(""))).cast("int") - 1))
    driver = F.struct(F.lit("auditlake").alias("name"), F.col("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), numbered.alias("results"))
    whole = F.struct(F.lit(SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return grouped.select(*by, "part", F.to_json(whole).alias("sarif"))


def text_report(findings: DataFrame, *by: str, order: list) -> DataFrame:
    """by, findings, omitted, report: a line for each of the first findings in order, cut at the most characters.

    Only the first MOST_FINDINGS of a group are gathered: the cap is the report's, the counts are of all findings.
    """
    ranked = findings.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    line = F.concat_ws(" ", F.concat(F.col("pos").cast("string"), F.lit(".")), "rule_id", F.concat("path", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?"))))
    shown = ranked.where(F.col("pos") <= MOST_FINDINGS).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))
    counts = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"))
    return counts.join(shown, list(by)).select(*by, "findings", F.greatest(F.col("findings") - MOST_FINDINGS, F.lit(0)).alias("omitted"), F.substring("report", 1, MOST_CHARS).alias("report"))
