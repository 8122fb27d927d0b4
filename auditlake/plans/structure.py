"""Queries of names across files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators import findings, structure, taint
from auditlake.plans.audit import _FACTS, _HEADERS, _KEY, _lines, _quoted
from auditlake.plans.audit import SQL as AUDIT_SQL
from auditlake.plans.review import _TAINT
from auditlake.storage import table

#: How far a rule's finding reaches.
RADIUS = {
    "SEC-001": "TENANT_DATA", "SEC-005": "TENANT_DATA", "SEC-008": "TENANT_DATA", "SEC-009": "TENANT_DATA", "SEC-004": "SYSTEM_WIDE", "SEC-006": "SYSTEM_WIDE", "SEC-007": "SYSTEM_WIDE",
    "SEC-002": "SERVICE_COMPONENT", "SEC-003": "SERVICE_COMPONENT", "SEC-010": "SERVICE_COMPONENT", "ARCH-002": "SERVICE_COMPONENT", "ARCH-001": "LOCAL_METHOD", "ARCH-003": "LOCAL_METHOD",
}

_LS = f"ls as materialized (select * from {_lines('source_id')})"
_HEAD = f"h as materialized (select * from {_HEADERS})"
_SPANS = f"f as materialized ({AUDIT_SQL['function_spans']})"
_CALL = r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)$"


def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return structure.resolved_calls(table(spark, d, "sources"))


def exposed_types(spark: SparkSession, d: str) -> DataFrame:
    return structure.exposed_types(table(spark, d, "sources"))


def consumers(spark: SparkSession, d: str) -> DataFrame:
    return structure.consumers(table(spark, d, "sources"))


def annotated_functions(spark: SparkSession, d: str) -> DataFrame:
    return structure.annotated_functions(table(spark, d, "sources"))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """Entries by how far their rules' findings reach; rules without an own reach count as a component's."""
    pairs = [F.lit(x) for pair in RADIUS.items() for x in pair]
    radius = F.coalesce(F.try_element_at(F.create_map(*pairs), C.rule_key(F.col("rule_id"))), F.lit("SERVICE_COMPONENT"))
    return table(spark, d, "baseline_entries").groupBy("repository_id", radius.alias("radius")).agg(F.count(F.lit(1)).alias("entries"))


def sink_operands(spark: SparkSession, d: str) -> DataFrame:
    return structure.sink_operands(table(spark, d, "sources"))


def taint_traces(spark: SparkSession, d: str) -> DataFrame:
    """Flows as trace texts, cut into hops again."""
    flows = taint.flows(table(spark, d, "sources"))
    trace = F.concat_ws(" -> ", "function", "variable", F.concat(F.lit("line "), F.col("sink_line").cast("string")))
    hops = F.transform(F.split(trace, r"\s*->\s*"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x))
    return flows.select("source_id", trace.alias("trace"), F.array_join(hops, "; ").alias("numbered"))


QUERIES = {
    "resolved_calls": resolved_calls, "exposed_types": exposed_types, "consumers": consumers, "annotated_functions": annotated_functions, "blast_radius": blast_radius, "taint_traces": taint_traces, "sink_operands": sink_operands,
}
SQL = {
    "resolved_calls": rf"""with {_LS}, {_HEAD}, {_SPANS}, m as materialized (select distinct f.source_id, f.function as name, h.repository_id, lower(h.primary_class) as class from f join h using (source_id)),
  c as (select s.repository_id, regexp_extract(x.name, '{_CALL}', 1) as scope, regexp_extract(x.name, '{_CALL}', 2) as name, count(*) as calls from ({_FACTS}) x join sources s using (source_id) where kind = 'call' and regexp_extract(x.name, '{_CALL}', 1) != '' group by all),
  k as (select c.*, (select min(source_id) from m where m.repository_id = c.repository_id and m.name = c.name and m.class = lower(c.scope)) as a, (select min(source_id) from m where m.repository_id = c.repository_id and m.name = c.name) as b from c)
  select repository_id, scope, name, calls, coalesce(a, b) as source_id, case when a is not null then 'scope' when b is not null then 'name' else 'none' end as how from k""",
    "exposed_types": rf"""with {_HEAD}, e as (select source_id, line_no, split_part(regexp_replace(trim(regexp_replace(regexp_extract(line, {_quoted(structure.ENDPOINT)}, 1), {_quoted(structure.WRAPPERS)}, ' ', 'g')), '\s+', ' ', 'g'), ' ', 1) as type
    from {_lines("source_id", "raw_source")} where regexp_matches(raw_source, '{structure.CONTROLLER}')), p as (select e.*, h.repository_id, h.package from e join h using (source_id) where type != ''),
  i as (select source_id, "full", regexp_extract("full", '([^.]*)$', 1) as type from (select source_id, unnest(imports) as "full" from h)), c as (select repository_id, package, primary_class as type, package || '.' || primary_class as "full" from h where package != ''),
  r as (select p.source_id, p.line_no, p.type, (select min("full") from i where i.source_id = p.source_id and i.type = p.type) as i, (select min("full") from c where c.repository_id = p.repository_id and c.package = p.package and c.type = p.type) as q,
    (select min("full") from c where c.repository_id = p.repository_id and c.type = p.type) as s from p)
  select source_id, line_no, type, coalesce(i, q, s) as resolved, case when i is not null then 'import' when q is not null then 'package' when s is not null then 'repository' else 'none' end as how from r""",
    "consumers": rf"""with {_HEAD}, w as materialized (select distinct repository_id, source_id, unnest(regexp_extract_all(raw_source, {_quoted(structure.TYPE)})) as word from sources where raw_source is not null)
  select h.source_id, min(w.source_id) as consumer_id from h join w on w.repository_id = h.repository_id and w.word = h.primary_class and w.source_id != h.source_id where h.primary_class != 'UnknownClass' group by 1""",
    "annotated_functions": f"""with {_LS}, {_SPANS} select distinct f.source_id, f.function, f.start_line, x.name as annotation from f join ({_FACTS}) x on x.source_id = f.source_id and f.start_line between x.line_no and x.line_no + 2 where x.kind = 'annotation'""",
    "blast_radius": f"""select repository_id, case {" ".join(f"when {_KEY} = '{k}' then '{v}'" for k, v in RADIUS.items())} else 'SERVICE_COMPONENT' end as radius, count(*) as entries from baseline_entries group by all""",
    "sink_operands": rf"""with {_LS}, k as materialized (select distinct source_id, regexp_extract(line, {_quoted(structure.CONSTANT)}, 1) as name from ls where regexp_extract(line, {_quoted(structure.CONSTANT)}, 1) != ''),
  c as (select source_id, line_no, list_distinct(regexp_extract_all(regexp_replace(regexp_extract(line, {_quoted(taint.SINKS + "(.*)$")}, 1), {_quoted(structure.STRINGS)}, ' ', 'g'), {_quoted(structure.OPERAND)}, 1)) as names
    from ls where regexp_matches(line, {_quoted(taint.SINKS)}) and not (contains(line, '(') and regexp_matches(line, {_quoted(findings.FUNCTION)}))),
  e as (select source_id, line_no, unnest(case when len(names) = 0 then [null] else names end) as name from c)
  select e.source_id, e.line_no, count(e.name) as operands, count_if(e.name is not null and k.name is null) as unproven from e left join k on k.source_id = e.source_id and k.name = e.name group by all""",
    "taint_traces": f"""select source_id, function || ' -> ' || variable || ' -> line ' || sink_line as trace, '1:' || function || '; 2:' || variable || '; 3:line ' || sink_line as numbered from ({_TAINT})""",
}
