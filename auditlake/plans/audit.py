"""Queries of the audit operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import catalog
from auditlake.functions import columns as C
from auditlake.operators import findings, ledger, matching, scoring, suppressions
from auditlake.storage import staged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Parts of SQL that several queries share.
def _path(x: str) -> str:
    return rf"regexp_replace(trim(replace({x}, '\', '/')), '^(\./|/)+', '')"


def _file(x: str) -> str:
    return rf"regexp_extract({_path(x)}, '([^/]*)$', 1)"


_LANG = "case " + " ".join(f"when lower(file_path) like '%.{e}' then '{v}'" for e, v in catalog.EXTENSIONS) + " end"
_KEY = r"regexp_extract(upper(rule_id), '^\s*([A-Z]+-[0-9]+)', 1)"


def _lines(*keep: str) -> str:
    cols = "".join(f"{k}, " for k in keep)
    return rf"(select {cols}unnest(range(1, len(a) + 1)) as line_no, unnest(a) as line from (select {cols}regexp_split_to_array(raw_source, '\r?\n') as a from sources where raw_source is not null))"


_COLLAPSED = r"trim(regexp_replace(coalesce(snippet, ''), '[ \t\r\n\f]+', ' ', 'g'))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("lang_dispatch", f"select lang, {_LANG} as language, count(*) as files, cast(sum(length(raw_source)) as bigint) as chars from sources group by all")
def lang_dispatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").select("lang", C.language_of(F.col("file_path")).alias("language"), "raw_source")
    return rows.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("raw_source")).alias("chars"))


_IGNORED = ", ".join(f"'{x}'" for x in catalog.IGNORED)


@query("scanned_files", rf"""select source_id, {_path("file_path")} as path, not list_has_any(string_split({_path("file_path")}, '/'), [{_IGNORED}]) and {_LANG} is not null as scanned from sources""")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    path = C.normal_path(F.col("file_path"))
    ignored = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, catalog.IGNORED)))
    return table(spark, d, "sources").select("source_id", path.alias("path"), (~ignored & C.language_of(F.col("file_path")).isNotNull()).alias("scanned"))


@query("line_lengths", f"select source_id, count(*) as n_lines, max(length(line)) as longest, count_if(trim(line) = '') as blank from {_lines('source_id')} group by 1")
def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    return C.lines(table(spark, d, "sources"), "source_id").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"), F.count_if(F.trim("line") == "").alias("blank")
    )


@query("content_fingerprint", "select source_id, sha256(raw_source) as fingerprint from sources where raw_source is not null")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("raw_source is not null").select("source_id", F.sha2("raw_source", 256).alias("fingerprint"))


@query("reinspected", """select sha256(raw_source) as fingerprint, min(source_id) as first_source_id, count(*) as inspections, count(distinct repository_id) as repositories
  from sources where raw_source is not null group by 1 having count(*) > 1""")
def reinspected(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").where("raw_source is not null").select(F.sha2("raw_source", 256).alias("fingerprint"), "source_id", "repository_id")
    return rows.groupBy("fingerprint").agg(F.min("source_id").alias("first_source_id"), F.count(F.lit(1)).alias("inspections"), F.countDistinct("repository_id").alias("repositories")).where("inspections > 1")


@query("finding_fingerprint", rf"""select entry_id, substr(sha256({_path("coalesce(file_path, '')")} || '|' || coalesce(rule_id, '') || '|' || coalesce(method_name, '') || '|' || {_COLLAPSED}), 1, 32) as computed from baseline_entries""")
def finding_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "baseline_entries").select("entry_id", C.finding_fingerprint(F.col("file_path"), F.col("rule_id"), F.col("method_name"), F.col("snippet")).alias("computed"))


_PATTERN = "case " + " ".join(f"when regexp_matches(line, {_quoted(p)}) then '{n}'" for n, p, _ in findings.SECRETS) + " end"
_MASK = r"""regexp_replace({x}, '(["''])([A-Za-z0-9_\-]{{4}})[A-Za-z0-9_\-]{{4,}}(["''])', '\1\2****\3', 'g')"""


def _entropy(x: str) -> str:
    return f"""coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -(length({x}) - length(replace({x}, c, ''))) / cast(length({x}) as double)
      * log2((length({x}) - length(replace({x}, c, ''))) / cast(length({x}) as double)))), 0.0)"""


_RUN = r"coalesce(list_sort(list_transform(regexp_extract_all(line, '[A-Za-z0-9_\-]{16,}'), lambda x: {'n': length(x), 'run': x}), 'DESC')[1].run, '')"


@query("secret_findings", rf"""select source_id, line_no, pattern, case when pattern = 'generic_key' then 'HIGH' else 'CRITICAL' end as severity, {_MASK.format(x="trim(line)")} as masked,
  case when run = '' then 0.0 else round({_entropy("run")}, 6) end as entropy,
  substr(sha256({_path("coalesce(file_path, '')")} || '|SEC-008||' || trim(regexp_replace(line, '[ \t\r\n\f]+', ' ', 'g'))), 1, 32) as fingerprint
  from (select *, {_PATTERN} as pattern, {_RUN} as run from {_lines("source_id", "file_path")}) where pattern is not null""")
def secret_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.secret_findings(table(spark, d, "sources"))


@query("snippet_entropy", f"select entry_id, case when snippet is null then null when snippet = '' then 0.0 else round({_entropy('snippet')}, 6) end as entropy from baseline_entries")
def snippet_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "baseline_entries").select("entry_id", F.round(C.entropy(F.col("snippet")), 6).alias("entropy"))


@query("masked_snippets", f"select observation_id, max({_MASK.format(x='finding_snippet')}) as masked from observations group by 1")
def masked_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").groupBy("observation_id").agg(F.max(C.masked(F.col("finding_snippet"))).alias("masked"))


def _rule_sql(rule: tuple) -> str:
    key, langs, must, must_not, file_not, confidence, *file_must = rule
    langs = ", ".join(f"'{x}'" for x in langs.split(","))
    tests = [f"regexp_matches(line, {_quoted(p)})" for p in ((must,) if isinstance(must, str) else must)] + [f"regexp_matches(raw_source, {_quoted(p)})" for p in file_must]
    tests += [f"not regexp_matches(line, {_quoted(must_not)})"] * bool(must_not) + [f"not regexp_matches(raw_source, {_quoted(file_not)})"] * bool(file_not)
    return f"select source_id, line_no, '{key}' as rule_key, cast({confidence} as double) as confidence from ls where language in ({langs}) and {' and '.join(tests)}"


_RULE_LINES = f"""with ls as materialized (select source_id, raw_source, {_LANG} as language, line_no, line from {_lines("source_id", "file_path", "raw_source")})
  select source_id, line_no, rule_key, max(confidence) as confidence from ({" union all ".join(map(_rule_sql, findings.RULES))}) group by all"""


@query("rule_lines", _RULE_LINES)
def rule_lines(spark: SparkSession, d: str) -> DataFrame:
    return findings.rule_lines(table(spark, d, "sources"))


@query("line_findings")
def line_findings(spark: SparkSession, d: str) -> DataFrame:
    """rule_lines and the rules over several lines, which SQL does not say; tested on texts of their own."""
    return findings.line_findings(table(spark, d, "sources"))


def _by_repository(spark: SparkSession, rows: DataFrame) -> DataFrame:
    ruled = rows.join(F.broadcast(catalog.rules(spark)), "rule_key")
    return ruled.groupBy("repository_id", "rule_key", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("source_id").alias("files"))


@query("rule_lines_by_repository", f"""select s.repository_id, f.rule_key, r.severity, count(*) as findings, count(distinct f.source_id) as files from ({_RULE_LINES}) f join sources s using (source_id)
  join {catalog.rules_sql()} on r.rule_key = f.rule_key group by all""")
def rule_lines_by_repository(spark: SparkSession, d: str) -> DataFrame:
    return _by_repository(spark, findings.rule_lines(table(spark, d, "sources"), "repository_id"))


@query("findings_by_repository")
def findings_by_repository(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all rules by repository, rule and severity; see line_findings."""
    return _by_repository(spark, findings.line_findings(table(spark, d, "sources"), "repository_id"))


_NAME = "case when contains(line, '(') then coalesce(" + ", ".join(f"nullif(regexp_extract(line, {_quoted(findings.FUNCTION)}, {i}), '')" for i in range(1, 6)) + ") end"
_ENCLOSED = f"(select source_id, line_no, line, coalesce(last_value({_NAME} ignore nulls) over (partition by source_id order by line_no rows unbounded preceding), 'moduleScope') as function from {_lines('source_id')})"


@query("enclosing_function", f"select source_id, function, count(*) as n_lines, min(line_no) as first_line from {_ENCLOSED} group by all")
def enclosing_function(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.enclosing_functions(table(spark, d, "sources"))
    return rows.groupBy("source_id", "function").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


@query("function_spans", f"""select source_id, function, min(line_no) as start_line, max(line_no) as end_line from (select *, sum(cast((contains(line, '(') and regexp_matches(line, {_quoted(findings.FUNCTION)})) as int))
  over (partition by source_id order by line_no rows unbounded preceding) as nth from {_ENCLOSED} where function != 'moduleScope') group by source_id, nth, function""")
def function_spans(spark: SparkSession, d: str) -> DataFrame:
    return findings.function_spans(table(spark, d, "sources"))


MARKER = "(?i)edit freely|keep for now|see ticket|by hand"


@query("suppress_window", f"""with f as ({_RULE_LINES}), m as (select source_id, line_no from {_lines("source_id")} where regexp_matches(line, '{MARKER}'))
  select f.source_id, f.line_no, f.rule_key, min(m.line_no) as suppressed_by from f left join m on m.source_id = f.source_id and m.line_no between f.line_no - 1 and f.line_no + 1 group by all""")
def suppress_window(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "sources")
    return findings.suppressed(findings.rule_lines(src).drop("confidence"), src, MARKER)


#: Findings of less confidence count as guesses: a setting.
LEAST_CONFIDENCE = 0.95


def _finding_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the rules over lines against annotations, directives, ignore rules, earlier inspections and the baseline.

    Each entry of the first batch stands for an ignore rule (its path and rule). A line that an earlier inspection of the
    file had as well is no change. Accepted are findings of a rule and file with an entry of a later batch at most five
    lines away.
    """
    src = table(spark, d, "sources")
    rows = findings.rule_lines(src.where("repository_id is not null"), "repository_id", "file_path").withColumnsRenamed({"rule_key": "rule", "file_path": "path"})
    found = staged(rows, "findings")
    plain = found.drop("repository_id", "path")
    entries = table(spark, d, "baseline_entries").select("repository_id", "batch_no", C.normal_path(F.col("file_path")).alias("path"), C.rule_key(F.col("rule_id")).alias("rule"), "start_line")
    ignored = entries.where("batch_no = 0").select("path", "rule")
    accepted = entries.where("batch_no > 0").select("repository_id", "rule", F.lower(C.file_of(F.col("path"))).alias("file"), F.explode(F.sequence(F.col("start_line") - 5, F.col("start_line") + 5)).alias("line_no")).distinct()
    known = found.withColumn("file", F.lower(C.file_of(F.col("path")))).join(accepted, ["repository_id", "rule", "file", "line_no"], "left_semi")
    hits = {
        "ANNOTATION": suppressions.by_annotation(plain, src), "INLINE_COMMENT": suppressions.by_directive(plain, src), "IGNORE_FILE": suppressions.by_ignore_rule(found.drop("repository_id"), ignored),
        "DIFF_BASELINE": _unchanged(src, plain), "BASELINE_ACCEPTED": known,
    }
    return suppressions.dispositions(plain, hits, LEAST_CONFIDENCE)


def _unchanged(src: DataFrame, found: DataFrame) -> DataFrame:
    """Findings on lines that the inspection of the file before held as well."""
    order = Window.partitionBy("repository_id", F.lower(C.normal_path(F.col("file_path")))).orderBy("inspected_at", "source_id")
    pairs = src.where("raw_source is not null").select("source_id", F.lag("source_id").over(order).alias("before_id")).where("before_id is not null")
    mine = found.join(pairs, "source_id")
    now = C.lines(src.join(mine.select("source_id").distinct(), "source_id", "left_semi"), "source_id").select("source_id", "line_no", F.xxhash64("line").alias("h"))
    before = C.lines(src.join(mine.select(F.col("before_id").alias("source_id")).distinct(), "source_id", "left_semi"), "source_id").select(F.col("source_id").alias("before_id"), F.xxhash64("line").alias("h")).distinct()
    return mine.join(now, ["source_id", "line_no"]).join(before, ["before_id", "h"], "left_semi").select("source_id", "line_no", "rule")


_TOKENS = f"lower(replace(t, '{suppressions.WORD}:', '')) in ('all', '*', lower(rule))"
_DIRECTIVE = rf"(?i)(//|#|/\*+)\s*{suppressions.WORD}-ignore\s+([A-Za-z0-9_:*-]+)"


@query("dispositions_all", rf"""with f as materialized (select f.*, f.rule_key as rule, s.repository_id, {_path("s.file_path")} as path from ({_RULE_LINES}) f join sources s using (source_id) where s.repository_id is not null),
  l as materialized (select * from {_lines("source_id")}), e as materialized (select repository_id, batch_no, {_path("file_path")} as path, {_KEY} as rule, start_line from baseline_entries),
  g as (select distinct source_id, line_no, unnest(regexp_extract_all(line, '"([^"]*)"', 1)) as t from l where contains(line, '@SuppressWarnings')),
  i as (select distinct source_id, line_no, regexp_extract(line, '{_DIRECTIVE}', 2) as t from l where regexp_matches(line, '{_DIRECTIVE}')),
  v as (select source_id, lag(source_id) over (partition by repository_id, lower({_path("file_path")}) order by inspected_at, source_id) as before_id from sources where raw_source is not null)
  select source_id, line_no, rule, confidence, case when confidence < {LEAST_CONFIDENCE} then 'LOW_CONFIDENCE_HEURISTIC'
    when exists (select 1 from g where g.source_id = f.source_id and g.line_no < f.line_no and {_TOKENS}) then 'ANNOTATION'
    when exists (select 1 from i where i.source_id = f.source_id and abs(i.line_no - f.line_no) <= 1 and {_TOKENS}) then 'INLINE_COMMENT'
    when exists (select 1 from e where e.batch_no = 0 and e.rule = f.rule and e.path != '' and (lower(f.path) = lower(e.path) or ends_with(lower(f.path), '/' || lower(e.path)))) then 'IGNORE_FILE'
    when exists (select 1 from v join l n on n.source_id = v.source_id join l o on o.source_id = v.before_id and o.line = n.line where v.source_id = f.source_id and n.line_no = f.line_no) then 'DIFF_BASELINE'
    when exists (select 1 from e where e.batch_no > 0 and e.repository_id = f.repository_id and e.rule = f.rule and lower(regexp_extract(e.path, '([^/]*)$', 1)) = lower(regexp_extract(f.path, '([^/]*)$', 1)) and abs(e.start_line - f.line_no) <= 5) then 'BASELINE_ACCEPTED'
    else 'ACTIVE' end as disposition from f""")
def dispositions_all(spark: SparkSession, d: str) -> DataFrame:
    return _finding_dispositions(spark, d)


_HEAD_IMPORTS = r"""case when language in ('JAVA', 'KOTLIN') then regexp_extract_all(raw_source, '(?m)^import\s+(?:static\s+)?([\w.]+)', 1)
  else regexp_extract_all(raw_source, '(?:from\s+|require\()[''"]([^''"]+)[''"]', 1) end"""
_HEADERS = rf"""(select source_id, repository_id, language, regexp_extract(raw_source, '(?m)^package\s+([\w.]+)', 1) as package, {_HEAD_IMPORTS} as imports,
  coalesce(nullif(regexp_extract(raw_source, 'public\s+(?:final\s+|abstract\s+)?(?:class|interface|enum)\s+([A-Z]\w*)', 1), ''), nullif(regexp_extract(raw_source, '(?:class|interface|enum|object)\s+([A-Z]\w*)', 1), ''), 'UnknownClass') as primary_class
  from (select *, {_LANG} as language from sources) where raw_source is not null and language in ('JAVA', 'KOTLIN', 'JAVASCRIPT', 'TYPESCRIPT'))"""


@query("source_headers", f"select source_id, language, package, array_to_string(imports, ',') as imports, primary_class from {_HEADERS}")
def source_headers(spark: SparkSession, d: str) -> DataFrame:
    return findings.headers(table(spark, d, "sources")).select("source_id", "language", "package", F.array_join("imports", ",").alias("imports"), "primary_class")


_FACTS = " union all ".join(
    f"select source_id, line_no, '{k}' as kind, unnest(regexp_extract_all(line, {_quoted(p)}, 1)) as name from ls"
    for k, p in (("annotation", r"@([A-Za-z_][\w.]*)"), ("creation", r"\bnew\s+([A-Z][\w.]*)"), ("call", r"([A-Za-z_][\w.]*)\s*\("), ("class", r"\b(?:class|interface|enum|object)\s+([A-Z]\w*)"), ("import", r"^\s*(?:import|from)\s+([\w.]+)"))
)


@query("syntax_facts", f"with ls as materialized (select * from {_lines('source_id')}) select kind, name, count(*) as n, count(distinct source_id) as files from ({_FACTS}) group by all")
def syntax_facts(spark: SparkSession, d: str) -> DataFrame:
    return findings.facts(table(spark, d, "sources")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("files"))


_EDGES = f"(select distinct src, dst from (select package || '.' || primary_class as src, unnest(imports) as dst from {_HEADERS} where package != '' and primary_class != 'UnknownClass') where src != dst)"
# References between the packages of imports and files, for graphs that are dense enough to have cycles.
_PACKAGES = rf"(select distinct regexp_replace(src, '\.[^.]*$', '') as src, regexp_replace(dst, '\.[^.]*$', '') as dst from {_EDGES} where regexp_replace(src, '\.[^.]*$', '') != regexp_replace(dst, '\.[^.]*$', ''))"


def _package_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = matching.references(findings.headers(table(spark, d, "sources")))
    cut = edges.select(F.regexp_replace("src", r"\.[^.]*$", "").alias("src"), F.regexp_replace("dst", r"\.[^.]*$", "").alias("dst"))
    return cut.where("src != dst").distinct()


@query("mutual_packages", f"with e as materialized (select * from {_PACKAGES}) select x.src as a, x.dst as b from e x join e y on x.src = y.dst and x.dst = y.src where x.src < x.dst")
def mutual_packages(spark: SparkSession, d: str) -> DataFrame:
    return matching.mutual(_package_edges(spark, d))


@query("reachable_packages", f"""with recursive e as materialized (select * from {_PACKAGES}), r(src, dst, hops) as (select src, dst, 1 from e union
  select r.src, e.dst, r.hops + 1 from r join e on e.src = r.dst where r.hops < 5 and r.src != e.dst) select src, dst, min(hops) as hops from r group by all""")
def reachable_packages(spark: SparkSession, d: str) -> DataFrame:
    return matching.reachable(_package_edges(spark, d))


_OLD, _NEW = "(select * from baseline_entries where batch_no < 6)", "(select * from baseline_entries where batch_no >= 6)"
_USABLE = "nullif(case when lower(trim(fingerprint)) in ('', 'n/a', 'pending', 'none', 'null') or regexp_matches(lower(trim(fingerprint)), '^0+$') then '' else lower(trim(fingerprint)) end, '')"
_EXACT = f"""(select n.entry_id, min(o.entry_id) as baseline_id from (select *, {_USABLE} as f from {_NEW}) n join (select *, {_USABLE} as f from {_OLD}) o on o.repository_id = n.repository_id and o.f = n.f group by 1)"""
_STRUCT = f"""(select n.entry_id, min(o.entry_id) as baseline_id from (select *, lower({_path("file_path")}) as p, lower(trim(rule_id)) as r from {_NEW}) n join (select *, lower({_path("file_path")}) as p, lower(trim(rule_id)) as r from {_OLD}) o
  on o.repository_id = n.repository_id and (o.p = n.p or o.p != '' and ends_with(n.p, '/' || o.p) or n.p != '' and ends_with(o.p, '/' || n.p)) and o.r = n.r and ((trim(o.method_name) != '' and trim(o.method_name) = trim(n.method_name)) or abs(o.start_line - n.start_line) <= 5)
  where n.p != '' group by 1)"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the later and of the earlier batches."""
    rows = table(spark, d, "baseline_entries")
    return rows.where("batch_no >= 6"), rows.where("batch_no < 6")


@query("baseline_exact", f"select * from {_EXACT}")
def baseline_exact(spark: SparkSession, d: str) -> DataFrame:
    return matching.baseline_exact(*_halves(spark, d))


@query("baseline_structural", f"select * from {_STRUCT}")
def baseline_structural(spark: SparkSession, d: str) -> DataFrame:
    return matching.baseline_structural(*_halves(spark, d))


#: Rules that a policy lets no baseline accept: a setting.
BLOCKED = ("SEC-004", "SEC-008")
_STOPPED = f"upper({_KEY}) in ({', '.join(repr(b) for b in BLOCKED)})"


@query("baseline_dispositions", f"""select n.entry_id, case when {_STOPPED} then 'BLOCKED' when e.baseline_id is not null then 'EXACT' when s.baseline_id is not null then 'STRUCTURAL' else 'NEW' end as disposition,
  case when not {_STOPPED} then coalesce(e.baseline_id, s.baseline_id) end as baseline_id from {_NEW} n left join {_EXACT} e using (entry_id) left join {_STRUCT} s using (entry_id)""")
def baseline_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return matching.dispositions(*_halves(spark, d), BLOCKED)


_REGRESSION = f"""select upper(trim(rule_id)) as rule_id, count(*) as new_findings from {_NEW} n where not exists (select 1 from {_OLD} o where o.repository_id = n.repository_id and lower(trim(o.rule_id)) = lower(trim(n.rule_id))
  and lower({_file("o.file_path")}) = lower({_file("n.file_path")})) group by 1"""


@query("regression_anti", _REGRESSION)
def regression_anti(spark: SparkSession, d: str) -> DataFrame:
    keys = [F.col("repository_id"), F.lower(F.trim("rule_id")).alias("rule"), F.lower(C.file_of(F.col("file_path"))).alias("file")]
    new, old = _halves(spark, d)
    fresh = new.select(*keys, "rule_id").join(old.select(*keys).distinct(), ["repository_id", "rule", "file"], "left_anti")
    return fresh.groupBy(F.upper(F.trim("rule_id")).alias("rule_id")).agg(F.count(F.lit(1)).alias("new_findings"))


_A = f"(select repository_id, lower({_file('file_path')}) as file, entry_id as row_id, start_line as lo, coalesce(end_line, start_line) as hi from baseline_entries)"
_B = f"(select distinct repository_id, lower({_file('code_location.file_path')}) as file, code_location.start_line as lo, code_location.end_line as hi from observations)"


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "baseline_entries").select("repository_id", F.lower(C.file_of(F.col("file_path"))).alias("file"), F.col("entry_id").alias("row_id"), F.col("start_line").alias("lo"), F.coalesce("end_line", "start_line").alias("hi"))
    b = table(spark, d, "observations").select("repository_id", F.lower(C.file_of(F.col("code_location.file_path"))).alias("file"), F.col("code_location.start_line").alias("lo"), F.col("code_location.end_line").alias("hi"))
    return a, b


_MEET = f"exists (select 1 from {_B} b where b.repository_id = a.repository_id and b.file = a.file and a.lo <= greatest(b.lo, b.hi) and b.lo <= greatest(a.lo, a.hi))"


@query("overlap_semi", f"select row_id, lo, hi from {_A} a where {_MEET}")
def overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    return matching.overlapping(*_intervals(spark, d), ["repository_id", "file"]).select("row_id", "lo", "hi")


@query("overlap_anti", f"select row_id from {_A} a where not {_MEET}")
def overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    a, b = _intervals(spark, d)
    return a.select("row_id").join(matching.overlapping(a, b, ["repository_id", "file"]).select("row_id"), "row_id", "left_anti")


@query("path_resolution", f"""with k as (select repository_id, source_id as known_id, lower({_path("file_path")}) as path from sources), w as (select distinct repository_id, observation_id as wanted_id, lower({_path("code_location.file_path")}) as path from observations),
  c as (select wanted_id, known_id, case when k.path = w.path then 0 when k.path like '%/' || replace(replace(w.path, '%', ''), '_', '\\_') escape '\\' then 1 else 2 end as rank
    from w join k on k.repository_id = w.repository_id and regexp_extract(k.path, '([^/]*)$', 1) = regexp_extract(w.path, '([^/]*)$', 1) where w.path != '' and k.path != ''),
  b as (select wanted_id, min({{'rank': rank, 'known_id': known_id}}) as m from c group by 1)
  select wanted_id, m.known_id as known_id, ['exact', 'suffix', 'name'][m.rank + 1] as how from b""".replace("'\\\\_'", "'\\_'").replace("'\\\\'", "'\\'"))
def path_resolution(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "sources").select("repository_id", F.col("source_id").alias("known_id"), F.col("file_path").alias("path"))
    wanted = table(spark, d, "observations").select("repository_id", F.col("observation_id").alias("wanted_id"), F.col("code_location.file_path").alias("path")).distinct()
    return matching.resolved_paths(wanted, known)


_OBS = "(select distinct * from observations)"


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations without second deliveries."""
    return table(spark, d, "observations").dropDuplicates(["observation_id"])


@query("confusion_by_rule", f"""with m as (select upper(rule_id) as rule_id, count_if(classification = 'TP') tp, count_if(classification = 'FP') fp, count_if(classification = 'TN') tn, count_if(classification = 'FN') fn from {_OBS} group by 1),
  r as (select *, case when tp + fp > 0 then tp / cast(tp + fp as double) when fn = 0 then 1.0 else 0.0 end as "precision", case when tp + fn > 0 then tp / cast(tp + fn as double) else 1.0 end as recall,
    case when fp + tn > 0 then fp / cast(fp + tn as double) else 0.0 end as fpr, case when fn + tp > 0 then fn / cast(fn + tp as double) else 0.0 end as fnr from m)
  select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0.0 end as f1 from r""")
def confusion_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_rates(scoring.matrix(_observations(spark, d).withColumn("rule_id", F.upper("rule_id")), "rule_id"))


@query("classification", f"""select observation_id, case when ground_truth = 'UNKNOWN' then 'UNCERTAIN' when ground_truth = 'VULNERABLE' then case when detection_status = 'DETECTED' then 'TP' else 'FN' end
  when detection_status = 'DETECTED' then 'FP' else 'TN' end as computed from {_OBS}""")
def classification(spark: SparkSession, d: str) -> DataFrame:
    found = F.col("detection_status") == "DETECTED"
    what = F.when(F.col("ground_truth") == "UNKNOWN", "UNCERTAIN").when(F.col("ground_truth") == "VULNERABLE", F.when(found, "TP").otherwise("FN")).when(found, "FP").otherwise("TN")
    return _observations(spark, d).select("observation_id", what.alias("computed"))


@query("confusion_sets", f"""select split_part(rule_id, '-', 1) as suite, detected_severity, grouping(split_part(rule_id, '-', 1)) as g, grouping(detected_severity) as h, count_if(classification = 'TP') as tp, count_if(classification = 'FP') as fp
  from {_OBS} group by grouping sets ((split_part(rule_id, '-', 1)), (split_part(rule_id, '-', 1), detected_severity), ())""")
def confusion_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _observations(spark, d).select(F.split_part("rule_id", F.lit("-"), F.lit(1)).alias("suite"), "detected_severity", "classification")
    suite, severity = F.col("suite"), F.col("detected_severity")
    counts = rows.groupingSets([[suite], [suite, severity], []], suite, severity).agg(
        F.grouping("suite").cast("int").alias("g"), F.grouping("detected_severity").cast("int").alias("h"), F.count_if(F.col("classification") == "TP").alias("tp"), F.count_if(F.col("classification") == "FP").alias("fp")
    )
    return counts


@query("severity_map", f"""select repository_id, map {{'CRITICAL': count_if(detected_severity = 'CRITICAL'), 'HIGH': count_if(detected_severity = 'HIGH'), 'MEDIUM': count_if(detected_severity = 'MEDIUM'), 'LOW': count_if(detected_severity = 'LOW')}}['HIGH'] as high,
  count_if(detected_severity in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')) as counted from {_OBS} group by 1""")
def severity_map(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.severity_map(_observations(spark, d), "repository_id", of="detected_severity")
    return rows.select("repository_id", F.col("severities")["HIGH"].alias("high"), F.aggregate(F.map_values("severities"), F.lit(0).cast("long"), lambda a, x: a + x).alias("counted"))


_SCORE = rf"""floor(least(greatest(0.35::double * (case when {_KEY} in ('SEC-004', 'SEC-005', 'SEC-006', 'SEC-007') then 0.45::double when trim(coalesce(finding_snippet, '')) != '' then 0.95::double else 0.70::double end)
  + 0.30::double * (case when m is null then 0.50::double when trim(coalesce(finding_snippet, '')) != '' and l > 0 then 1.0::double else 0.75::double end)
  + 0.20::double * (case when regexp_matches(coalesce(finding_snippet, ''), '\.replaceAll|\.replace|requireNonNull|isValid|sanitize|escape') then 0.20::double else 1.0::double end)
  + 0.15::double * (case when regexp_matches(lower(coalesce(m, '')), 'private|internal') then 0.15::double else 0.65::double end), 0.0::double), 1.0::double) * 100 + 0.5) / 100"""


@query("calibrated_score", f"""select observation_id, score, score >= 0.70 as kept, case when score >= 0.88 or (detected_severity = 'CRITICAL' and score >= 0.80) then 'CRITICAL' when score >= 0.75 or (detected_severity = 'HIGH' and score >= 0.70) then 'HIGH'
  when score >= 0.60 then 'MEDIUM' when score >= 0.40 then 'LOW' else 'VERY_LOW' end as exploitability from (select *, {_SCORE} as score from (select *, code_location.target_construct as m, code_location.start_line as l from {_OBS}))""")
def calibrated_score(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.calibrated(scoring.factors(F.col("rule_id"), F.col("finding_snippet"), F.col("code_location.target_construct"), F.col("code_location.start_line")))
    rows = _observations(spark, d).select("observation_id", "detected_severity", score.alias("score"))
    return rows.select("observation_id", "score", (F.col("score") >= scoring.KEPT).alias("kept"), scoring.bucket(F.col("score"), F.col("detected_severity")).alias("exploitability"))


@query("rule_join", f"""select entry_id, {_KEY} as rule_key, priority, r.severity, cwe, case when r.severity in ('CRITICAL', 'HIGH') then 'error' when r.severity = 'MEDIUM' then 'warning' when r.severity in ('LOW', 'INFO') then 'note' else 'warning' end as level
  from baseline_entries left join {catalog.rules_sql()} on r.rule_key = {_KEY}""")
def rule_join(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").when(F.col("severity").isin("LOW", "INFO"), "note").otherwise("warning")
    rows = table(spark, d, "baseline_entries").select("entry_id", C.rule_key(F.col("rule_id")).alias("rule_key"))
    return rows.join(F.broadcast(catalog.rules(spark)), "rule_key", "left").select("entry_id", "rule_key", "priority", "severity", "cwe", level.alias("level"))


@query("top_findings", f"""select repository_id, entry_id, pos from (select repository_id, entry_id, row_number() over (partition by repository_id order by coalesce(priority, 99), batch_no desc, entry_id) as pos
  from baseline_entries left join {catalog.rules_sql()} on r.rule_key = {_KEY}) where pos <= 20""")
def top_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "baseline_entries").select("repository_id", "entry_id", "batch_no", C.rule_key(F.col("rule_id")).alias("rule_key"))
    ranked = rows.join(F.broadcast(catalog.rules(spark)), "rule_key", "left")
    order = Window.partitionBy("repository_id").orderBy(F.coalesce("priority", F.lit(99)), F.col("batch_no").desc(), "entry_id")
    return ranked.withColumn("pos", F.row_number().over(order)).where("pos <= 20").select("repository_id", "entry_id", "pos")


@query("rule_strings", rf"""select repository_id, array_to_string(list_sort(list_distinct(list({_KEY}))), ', ') as rules, count(*) as entries from baseline_entries group by 1""")
def rule_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "baseline_entries").select("repository_id", C.rule_key(F.col("rule_id")).alias("k"))
    return rows.groupBy("repository_id").agg(F.array_join(F.array_sort(F.collect_set("k")), ", ").alias("rules"), F.count(F.lit(1)).alias("entries"))


_SIGNED = " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in ledger.SIGNED)
_FIRST = "(select * from audit_ledger qualify row_number() over (partition by run_id order by received_at, batch_no) = 1)"


@query("ledger_sign", f"select run_id, sha256({_SIGNED}) as signature from {_FIRST}")
def ledger_sign(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_deliveries(table(spark, d, "audit_ledger")).select("run_id", ledger.signature().alias("signature"))


@query("ledger_verify", f"""with k as (select run_id, sha256({_SIGNED}) as kept from {_FIRST}), a as (select run_id, received_at, sha256({_SIGNED}) as now,
    sha256({_SIGNED.replace("coalesce(cast(total_findings as varchar), '')", "coalesce(cast(total_findings + case when blocked_findings > 0 then 1 else 0 end as varchar), '')")}) as changed from audit_ledger)
  select run_id, count(*) as deliveries, count_if(now = kept) as sound, count_if(changed = kept) as sound_if_changed from a join k using (run_id) group by 1""")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each run whose fields give the signature of its first delivery, as they are and with a total altered where something was blocked."""
    rows = table(spark, d, "audit_ledger")
    kept = ledger.first_deliveries(rows).select("run_id", F.upper(ledger.signature()).alias("signature"))
    altered = rows.withColumn("total_findings", F.col("total_findings") + F.when(F.col("blocked_findings") > 0, 1).otherwise(0))
    found = ledger.verified(rows, kept).withColumn("as_is", F.lit(True)).unionByName(ledger.verified(altered, kept).withColumn("as_is", F.lit(False)))
    return found.groupBy("run_id").agg(F.count_if("as_is").alias("deliveries"), F.count_if(F.col("as_is") & F.col("ok")).alias("sound"), F.count_if(~F.col("as_is") & F.col("ok")).alias("sound_if_changed"))


_LOGGED = r"""case when regexp_matches(logged_text, '^\d{4}-\d\d-\d\dT') then epoch_us(try_cast(logged_text as timestamptz)) when regexp_matches(logged_text, '^\d+(\.\d+)?$') then cast(floor(try_cast(logged_text as decimal(20,9)) * 1000000) as bigint) end"""


@query("ledger_history", f"select run_id, {_LOGGED} as logged_us, row_number() over (partition by repository_id order by {_LOGGED} desc nulls last, run_id) as newest from {_FIRST}")
def ledger_history(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.first_deliveries(table(spark, d, "audit_ledger")).withColumn("logged_us", F.unix_micros(ledger.logged_at(F.col("logged_text"))))
    order = Window.partitionBy("repository_id").orderBy(F.col("logged_us").desc_nulls_last(), "run_id")
    return rows.select("run_id", "logged_us", F.row_number().over(order).alias("newest"))


@query("ledger_totals", f"""select repository_id, count(*) as runs, cast(sum(total_findings) as bigint) as findings, avg(execution_timings.total_ms) as mean_ms, max(execution_timings.parse_ms) as longest_parse,
  cast(sum(active_findings - suppressed_findings) as bigint) as balance from {_FIRST} group by 1""")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.first_deliveries(table(spark, d, "audit_ledger"))
    return rows.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total_findings").alias("findings"), F.avg("execution_timings.total_ms").alias("mean_ms"), F.max("execution_timings.parse_ms").alias("longest_parse"),
        F.sum(F.col("active_findings") - F.col("suppressed_findings")).alias("balance"),
    )


@query("running_delta", f"""select entry_id, sum(coalesce(end_line, start_line) - start_line + 1) over (partition by repository_id, lower({_file("file_path")}) order by start_line, entry_id rows between unbounded preceding and 1 preceding)::bigint as lines_before from baseline_entries""")
def running_delta(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("repository_id", "f").orderBy("start_line", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "baseline_entries").withColumn("f", F.lower(C.file_of(F.col("file_path"))))
    return rows.select("entry_id", F.sum(F.coalesce("end_line", "start_line") - F.col("start_line") + 1).over(w).alias("lines_before"))


@query("nearest_function", f"""with s as (select repository_id, lower({_file("file_path")}) as file, f.start_line as line_no from (select source_id, function, min(line_no) as start_line from (select *, sum(cast((contains(line, '(') and regexp_matches(line, {_quoted(findings.FUNCTION)})) as int))
    over (partition by source_id order by line_no rows unbounded preceding) as nth from {_ENCLOSED} where function != 'moduleScope') group by source_id, nth, function) f join sources using (source_id)),
  w as (select entry_id as wanted_id, repository_id, lower({_file("file_path")}) as file, start_line as expected from baseline_entries where start_line is not null),
  c as (select wanted_id, line_no, abs(expected - line_no) as distance, row_number() over (partition by wanted_id order by abs(expected - line_no), line_no) as nth from w join s on s.repository_id = w.repository_id and s.file = w.file)
  select wanted_id, line_no, distance from c where nth = 1""")
def nearest_function(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "sources")
    named = src.select("source_id", "repository_id", F.lower(C.file_of(F.col("file_path"))).alias("file"))
    heads = findings.function_spans(src).join(named, "source_id").select("repository_id", "file", F.col("start_line").alias("line_no"))
    wanted = table(spark, d, "baseline_entries").select("repository_id", F.lower(C.file_of(F.col("file_path"))).alias("file"), F.col("start_line").alias("expected"), F.col("entry_id").alias("wanted_id"))
    return matching.nearest_line(wanted, heads, ["repository_id", "file"])


_VERSION = r"(?i)(?:^|/)(?:vendor|deps|libs|third_party|external)/([a-z][a-z-]*?)-([0-9]+(?:\.[0-9]+)+)/"
#: Advisories: component, first version that is not affected. A setting, not data.
ADVISORIES = (("fernlet", "3.0.0"), ("gorsewire", "2.0.0"), ("lumenkit", "3.10.0"), ("quillstone", "3.6.0"), ("sorrelgrid", "2.0.0"), ("kestrelpy", "1.10.0"), ("tindrift", "2.4.6"), ("plumbline", "2.4.8"))
_ADVISED = "(values " + ", ".join(f"('{n}', '{v}')" for n, v in ADVISORIES) + ") as a(component, fixed)"


@query("advisory_match", rf"""select source_id, component, version, list_transform(string_split(version, '.'), lambda x: cast(x as int)) < list_transform(string_split(fixed, '.'), lambda x: cast(x as int)) as affected
  from (select source_id, lower(regexp_extract({_path("file_path")}, '{_VERSION}', 1)) as component, regexp_extract({_path("file_path")}, '{_VERSION}', 2) as version from sources) join {_ADVISED} using (component) where version != ''""")
def advisory_match(spark: SparkSession, d: str) -> DataFrame:
    path = C.normal_path(F.col("file_path"))
    rows = table(spark, d, "sources").select("source_id", F.lower(F.regexp_extract(path, _VERSION, 1)).alias("component"), F.regexp_extract(path, _VERSION, 2).alias("version")).where("version != ''")
    advised = F.broadcast(spark.createDataFrame(ADVISORIES, "component string, fixed string"))
    return rows.join(advised, "component").select("source_id", "component", "version", (_numbers("version") < _numbers("fixed")).alias("affected"))


def _numbers(version: str) -> F.Column:
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


@query("feedback_weights", f"""with o as (select rule_id, repository_id, count_if(classification = 'TP') as t, count_if(classification = 'FP') as f from {_OBS} group by all), g as (select rule_id, (4 + sum(t)) / cast(5 + sum(t) + sum(f) as double) as mean from o group by 1)
  select repository_id, rule_id, least(greatest(0.3::double * g.mean + 0.7::double * (4 + t) / cast(5 + t + f as double) - 0.8::double, -0.35::double), 0.10::double) as shift from o join g using (rule_id)""")
def feedback_weights(spark: SparkSession, d: str) -> DataFrame:
    """Shift of a rule's confidence from reviewers' verdicts: means of a Beta(4, 1) prior, 0.3 of all and 0.7 of the repository."""
    local = _observations(spark, d).groupBy("rule_id", "repository_id").agg(F.count_if(F.col("classification") == "TP").alias("t"), F.count_if(F.col("classification") == "FP").alias("f"))
    everywhere = local.groupBy("rule_id").agg(((4 + F.sum("t")) / (5 + F.sum("t") + F.sum("f"))).alias("mean"))
    shift = F.lit(0.3) * F.col("mean") + F.lit(0.7) * (4 + F.col("t")) / (5 + F.col("t") + F.col("f")) - F.lit(0.8)
    return local.join(everywhere, "rule_id").select("repository_id", "rule_id", F.least(F.greatest(shift, F.lit(-0.35)), F.lit(0.10)).alias("shift"))
