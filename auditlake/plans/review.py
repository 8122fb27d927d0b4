"""Queries of diffs, patches, taint, reports and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import catalog
from auditlake.functions import columns as C
from auditlake.operators import diffs, findings, ledger, matching, patches, reports, taint
from auditlake.plans.audit import _ENCLOSED, _FIRST, _KEY, _file, _path, _quoted
from auditlake.storage import table
from auditlake.streaming import ledger as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _fix_sql(at: str) -> str:
    def quoted(x: str) -> str:
        import re

        return _quoted(re.sub(r"\$(\d)", r"\\\1", x))

    if at == "patched":
        return "case " + " ".join(f"when rule_key = '{k}' then regexp_replace(snippet, {_quoted(w)}, {quoted(r)}, 'g')" for k, _, w, r in patches.FIXES) + " else snippet end"
    return "case " + " ".join(f"when rule_key = '{k}' then regexp_matches(coalesce({at}, ''), {_quoted(p)})" for k, p, _, _ in patches.FIXES) + " else false end"


_PATCHED = f"(select *, {_fix_sql('patched')} as patched from (select *, {_KEY} as rule_key from baseline_entries))"
_KNOWN = ", ".join(f"'{f[0]}'" for f in patches.FIXES)


_AFTER = "case " + " ".join(f"when rule_key = '{k}' then regexp_matches(coalesce(patched, ''), {_quoted(p)})" for k, p, _, _ in patches.FIXES) + " else false end"


@query("patched_snippets", f"select entry_id, {_fix_sql('snippet')} as fires, patched, {_AFTER} as fires_after from {_PATCHED}")
def patched_snippets(spark: SparkSession, d: str) -> DataFrame:
    return patches.patched(table(spark, d, "baseline_entries")).select("entry_id", "fires", "patched", "fires_after")


@query("patch_funnel", f"""select rule_key, case when snippet is null then 'NO_SNIPPET' when rule_key not in ({_KNOWN}) then 'NO_FIX' when not fires then 'NOT_DETECTED' when patched = snippet then 'UNCHANGED' when fires_after then 'STILL_FIRES' else 'FIXED' end as stage, count(*) as entries
  from (select *, {_fix_sql('snippet')} as fires, {_AFTER} as fires_after from {_PATCHED}) group by all""")
def patch_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = patches.patched(table(spark, d, "baseline_entries")).withColumn("stage", patches.stage())
    return rows.groupBy("rule_key", "stage").agg(F.count(F.lit(1)).alias("entries"))


_LIKE = "list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: {x} is not distinct from {y}), false)"
_GENERATED = f"""(select entry_id, file_path, snippet, patched, '--- a/' || p || chr(10) || '+++ b/' || p || chr(10) || '@@ -' || (lo + 1) || ',' || (len(a) - tail + least(2, tail) - lo) || ' +' || (lo + 1) || ',' || (len(b) - tail + least(2, tail) - lo) || ' @@' || chr(10)
    || array_to_string(list_transform(a[lo + 1:top], lambda x: ' ' || x) || list_transform(a[top + 1:len(a) - tail], lambda x: '-' || x) || list_transform(b[top + 1:len(b) - tail], lambda x: '+' || x)
    || list_transform(a[len(a) - tail + 1:len(a) - tail + least(2, tail)], lambda x: ' ' || x), chr(10)) as diff
  from (select *, greatest(top - 2, 0) as lo, least(same, len(a) - top, len(b) - top) as tail from (select *, coalesce(file_path, '') as p, {_LIKE.format(x="a[i]", y="b[i]")} - 1 as top,
    {_LIKE.format(x="(case when i <= len(a) then a[len(a) + 1 - i] end)", y="(case when i <= len(b) then b[len(b) + 1 - i] end)")} - 1 as same
    from (select *, string_split(snippet, chr(10)) as a, string_split(patched, chr(10)) as b from {_PATCHED} where patched != snippet))))"""


def _patch_diffs(spark: SparkSession, d: str) -> DataFrame:
    rows = patches.patched(table(spark, d, "baseline_entries")).where("patched != snippet")
    return diffs.generated(rows, "entry_id", "file_path", "snippet", "patched")


@query("patch_diffs", f"select entry_id, diff, true as applies from {_GENERATED}")
def patch_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs of the fixed snippets, each applied again."""
    return _patch_diffs(spark, d)


_DIFFS = rf"""(select source_id, unnest(range(1, len(a) + 1)) as pos, unnest(a) as line from (select source_id, regexp_split_to_array(t, '\r?\n') as a from (
    select 'source ' || source_id as source_id, raw_source as t from sources where regexp_matches(raw_source, '(?m)^@@ -\d+') union all select 'patch ' || entry_id, diff from {_GENERATED})))"""
_BODY = rf"""(select *, start + coalesce(sum(cast(sign in ('+', ' ') as int)) over (partition by source_id, hunk order by pos rows between unbounded preceding and 1 preceding), 0) as new_line
  from (select *, case when substr(line, 1, 1) in ('+', '-', '\') then substr(line, 1, 1) else ' ' end as sign from (
    select source_id, pos, line, regexp_matches(line, {_quoted(diffs.HUNK)}) as head, starts_with(line, '+++ ') or starts_with(line, '--- ') and coalesce(starts_with(lead(line) over w, '+++ '), false) as named,
      last_value(case when starts_with(line, '+++ ') then regexp_extract(line, '^\+\+\+ (?:[ab]/)?([^\t]*)', 1) end ignore nulls) over u as target, sum(cast(regexp_matches(line, {_quoted(diffs.HUNK)}) as int)) over u as hunk,
      last_value(case when regexp_matches(line, {_quoted(diffs.HUNK)}) then cast(regexp_extract(line, {_quoted(diffs.HUNK)}, 3) as int) end ignore nulls) over u as start
    from {_DIFFS} window w as (partition by source_id order by pos), u as (partition by source_id order by pos rows unbounded preceding)) where hunk > 0 and not head and not named))"""


def _diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the diffs of fixed snippets and of diffs saved as sources."""
    saved = table(spark, d, "sources").where(F.col("raw_source").rlike(r"(?m)^@@ -\d+")).select(F.concat(F.lit("source "), "source_id").alias("diff_id"), F.col("raw_source").alias("diff"))
    made = _patch_diffs(spark, d).select(F.concat(F.lit("patch "), "entry_id").alias("diff_id"), "diff")
    return diffs.diff_lines(saved.unionByName(made), "diff_id", "diff")


@query("diff_line_numbers", f"select source_id as diff_id, pos, target, cast(hunk as bigint) as hunk, sign, cast(new_line as int) as new_line from {_BODY}")
def diff_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _diff_lines(spark, d).select("diff_id", "pos", "target", "hunk", "sign", "new_line")


@query("diff_hunks", f"select source_id as diff_id, target, cast(hunk as bigint) as hunk, cast(min(new_line) as int) as lo, cast(max(new_line) as int) as hi, count_if(sign = '+') as added, count_if(sign = '-') as removed from {_BODY} group by all")
def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    return diffs.touched(_diff_lines(spark, d), "diff_id")


_ENDS = "({x} = {y} or ends_with({x}, '/' || {y}))"
_FIXED = f"(select *, upper(rule_id) as r, lower({_path('file_path')}) as p from {_PATCHED} where patched != snippet)"


@query("patch_lookup", f"""with p as materialized (select * from {_FIXED}), f as (select entry_id, repository_id, upper(rule_id) as r, lower({_path("file_path")}) as p from baseline_entries)
  select entry_id as finding_id, m.id as patch_id, ['id', 'rule', 'path', 'first'][m.rank + 1] as how from (select f.entry_id, min({{'rank': case when p.entry_id = f.entry_id then 0 when p.r = f.r then 1
    when p.p != '' and f.p != '' and ({_ENDS.format(x="f.p", y="p.p")} or {_ENDS.format(x="p.p", y="f.p")}) then 2 else 3 end, 'id': p.entry_id}}) as m from f join p on p.repository_id = f.repository_id group by 1)""")
def patch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The patch that goes with each entry: its own, else one of its rule, its file or its repository."""
    rows = patches.patched(table(spark, d, "baseline_entries"))
    fixed = rows.where("patched != snippet").select("repository_id", F.col("entry_id").alias("patch_id"), F.array(F.col("entry_id").cast("string")).alias("finding_ids"), F.array("rule_id").alias("rule_ids"), F.col("file_path").alias("path"))
    return matching.patch_of(rows.select("repository_id", F.col("entry_id").alias("finding_id"), "rule_id", F.col("file_path").alias("path")), fixed)


@query("composed_patches")
def composed_patches(spark: SparkSession, d: str) -> DataFrame:
    """Files with the fixes of all their findings, and what became of them."""
    src = table(spark, d, "sources")
    lines = C.lines(src, "source_id").select("source_id", "line_no", F.trim("line").alias("snippet"))
    found = findings.rule_lines(src).join(lines, ["source_id", "line_no"]).join(F.broadcast(catalog.rules(spark)), "rule_key", "left")
    return patches.composed(src, found).select("source_id", "status", "applied", "skipped", F.sha2("patched", 256).alias("patched"))


_STATEMENTS = rf"""(select source_id, function, line_no, (contains(line, '(') and regexp_matches(line, {_quoted(findings.FUNCTION)})) as head, case when not (contains(line, '(') and regexp_matches(line, {_quoted(findings.FUNCTION)})) then nullif(regexp_extract(line, {_quoted(taint.ASSIGNED)}, 1), '') end as target,
  regexp_extract_all(regexp_replace(regexp_extract(line, '\((.*)$', 1), {_quoted(taint.SCALAR)}, ' ', 'g'), {_quoted(taint.PARAMETER)}, 1) as params,
  list_distinct(regexp_extract_all(regexp_replace(case when regexp_extract(line, {_quoted(taint.ASSIGNED)}, 1) != '' then regexp_extract(line, {_quoted(taint.ASSIGNED)}, 2) else line end, '"[^"]*"|''[^'']*''', ' ', 'g'), {_quoted(taint.WORD)})) as words,
  regexp_matches(line, {_quoted(taint.OUTSIDE)}) as outside, not (contains(line, '(') and regexp_matches(line, {_quoted(findings.FUNCTION)})) and regexp_matches(line, {_quoted(taint.SINKS)}) as sink, regexp_matches(line, {_quoted(taint.CLEANED)}) as cleaned
  from {_ENCLOSED} where function != 'moduleScope')"""
_TAINT_STEP = """(select r.source_id, r.function, r.target as variable, min(r.line_no) as pos, {n} as hops, max(r.cleaned) as cleaned from k{m} k join reads r on r.source_id = k.source_id and r.function = k.function and r.variable = k.variable
  where k.hops = {m} and r.target is not null and r.line_no > k.pos and r.target != k.variable and not exists (select 1 from k{m} o where o.source_id = r.source_id and o.function = r.function and o.variable = r.target) group by all)"""
_TAINT = f"""with rows as materialized (select * from {_STATEMENTS}), reads as materialized (select source_id, function, line_no, target, sink, cleaned, unnest(words) as variable from rows where not head),
  k0 as materialized (select source_id, function, variable, min(line_no) as pos, 0 as hops, max(cleaned) as cleaned from (select source_id, function, unnest(params) as variable, line_no, false as cleaned from rows where head
    union all select source_id, function, target, line_no, cleaned from rows where outside and target is not null) group by all),
  {", ".join(f"k{n} as materialized (select * from k{n - 1} union all select source_id, function, variable, pos, hops, cleaned from {_TAINT_STEP.format(n=n, m=n - 1)})" for n in range(1, 5))}
  select distinct k.source_id, k.function, r.line_no as sink_line, k.variable, k.hops, k.cleaned from k4 k join reads r on r.source_id = k.source_id and r.function = k.function and r.variable = k.variable where r.sink and (r.line_no > k.pos or k.hops = 0 and r.line_no >= k.pos)"""


@query("taint_flows", _TAINT)
def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    return taint.flows(table(spark, d, "sources"))


@query("python_flows")
def python_flows(spark: SparkSession, d: str) -> DataFrame:
    """Sinks of Python functions that tainted variables reach, statement by statement."""
    return taint.python_flows(table(spark, d, "sources"))


@query("taint_across")
def taint_across(spark: SparkSession, d: str) -> DataFrame:
    """Sinks that values reach through calls of other functions."""
    return taint.flows_across(table(spark, d, "sources"))


def _reportable(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    rows = table(spark, d, "baseline_entries").withColumn("rule_key", C.rule_key(F.col("rule_id"))).join(F.broadcast(catalog.rules(spark)), "rule_key", "left")
    return rows.select("repository_id", "entry_id", "priority", F.upper("rule_id").alias("rule_id"), level.alias("level"), C.collapsed(F.col("snippet")).alias("message"), C.normal_path(F.col("file_path")).alias("path"), "start_line", "end_line", "snippet",
        F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.col("cwe").cast("string"), F.lit(".html")).alias("help_uri"))


@query("sarif_export")
def sarif_export(spark: SparkSession, d: str) -> DataFrame:
    """SARIF texts for each repository and file, in parts of bounded size."""
    return reports.sarif(_reportable(spark, d), "repository_id", "path")


@query("text_reports", f"""with f as (select repository_id, entry_id, coalesce(priority, 99) as priority, upper(rule_id) as rule_id, {_path("file_path")} as path, start_line from (select *, {_KEY} as k from baseline_entries) left join {catalog.rules_sql()} on r.rule_key = k),
  p as (select *, row_number() over (partition by repository_id order by priority, entry_id) as pos from f)
  select repository_id, count(*) as findings, greatest(count(*) - 20, 0) as omitted, substr(string_agg(pos || '. ' || rule_id || ' ' || path || ':' || coalesce(start_line::varchar, '?'), chr(10) order by pos) filter (where pos <= 20), 1, 60000) as report from p group by 1""")
def text_reports(spark: SparkSession, d: str) -> DataFrame:
    return reports.text_report(_reportable(spark, d), "repository_id", order=[F.coalesce("priority", F.lit(99)), F.col("entry_id")])


@query("inspection_changes", f"""with v as (select source_id, raw_source, lag(source_id) over (partition by repository_id, lower({_path("file_path")}) order by inspected_at, source_id) as before_id from sources where raw_source is not null),
  l as (select distinct source_id, line from (select source_id, unnest(regexp_split_to_array(raw_source, '\\r?\\n')) as line from sources where raw_source is not null)),
  a as (select v.source_id, count(*) as added from v join l on l.source_id = v.source_id where before_id is not null and not exists (select 1 from l o where o.source_id = v.before_id and o.line = l.line) group by 1),
  r as (select v.source_id, count(*) as removed from v join l on l.source_id = v.before_id where not exists (select 1 from l o where o.source_id = v.source_id and o.line = l.line) group by 1)
  select v.source_id, v.before_id, coalesce(added, 0) as added, coalesce(removed, 0) as removed from v left join a using (source_id) left join r using (source_id) where before_id is not null""")
def inspection_changes(spark: SparkSession, d: str) -> DataFrame:
    """Lines that came and went between a file's consecutive inspections."""
    from pyspark.sql import Window

    src = table(spark, d, "sources").where("raw_source is not null")
    order = Window.partitionBy("repository_id", F.lower(C.normal_path(F.col("file_path")))).orderBy("inspected_at", "source_id")
    pairs = src.select("source_id", F.lag("source_id").over(order).alias("before_id")).where("before_id is not null")
    rows = C.lines(src, "source_id").select("source_id", "line").distinct()
    now = pairs.join(rows, "source_id").select("source_id", "line", F.lit(1).alias("new"))
    old = pairs.select("source_id", F.col("before_id").alias("b")).join(rows.withColumnRenamed("source_id", "b"), "b").select("source_id", "line", F.lit(1).alias("old"))
    both = now.join(old, ["source_id", "line"], "full")
    counts = both.groupBy("source_id").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"))
    return pairs.join(counts, "source_id", "left").select("source_id", "before_id", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


@query("ledger_stream", f"select run_id, repository_id, total_findings from {_FIRST}")
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """First deliveries of runs, by a stream over the ledger's files; copies of a run differ in delivery only."""
    rows = streams.first_of(streams.arriving(spark, d, "audit_ledger"), ["run_id"], "received_at", "3650 days")
    return streams.drained(rows.select("run_id", "repository_id", "total_findings"), "ledger")


@query("content_stream", "select distinct sha256(raw_source) as fingerprint from sources where raw_source is not null")
def content_stream(spark: SparkSession, d: str) -> DataFrame:
    """Contents that a stream of inspections had to look at: known fingerprints are skipped."""
    rows = streams.arriving(spark, d, "sources").where("raw_source is not null").select(F.sha2("raw_source", 256).alias("fingerprint"), "ingested_at")
    return streams.drained(streams.first_of(rows, ["fingerprint"], "ingested_at", "3650 days").select("fingerprint"), "content")


@query("run_sessions", f"""with s as (select *, case when received_at > lag(received_at) over w + interval 1 hour or lag(received_at) over w is null then 1 else 0 end as fresh from {_FIRST} window w as (partition by repository_id order by received_at)),
  n as (select *, sum(fresh) over (partition by repository_id order by received_at rows unbounded preceding) as nth from s)
  select repository_id, epoch_us(min(received_at)) as started_us, epoch_us(max(received_at) + interval 1 hour) as ended_us, count(*) as "rows" from n group by repository_id, nth""")
def run_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.first_deliveries(table(spark, d, "audit_ledger"))
    return streams.sessions(rows, ["repository_id"], "received_at", "1 hour").select("repository_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "rows")
