"""Tainted values inside functions: from parameters and request values over assignments to sinks.

Functions are cut by line; assignments and sinks become rows with the words they read. A value is followed from
assignment to later assignment by joins on (source, function, word), until nothing new is reached; a variable that is
known is reached again on an earlier line only, so cycles end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators.findings import enclosing_functions, is_head
from auditlake.storage import staged

#: Calls whose result comes from outside, sinks, and words that stand for a check or cleaning.
OUTSIDE = r"getParameter\(|getHeader\(|getQueryString\(|getInputStream\(|getReader\(|getPart\(|getCookies\(|request\.(?:args|form|values|json|GET|POST|params|query|body)|req\.(?:params|query|body)|sys\.argv|os\.environ"
SINKS = r"(?:executeQuery|executeUpdate|execute|prepareStatement|createQuery|queryForList|queryForObject|query|exec|readAllBytes|newBufferedReader|open|eval)\s*\("
CLEANED = r"(?i)sanitize|validate|clean|escape|encode|filter|whitelist|isvalid|check|normalize|canonical|torealpath|startswith|setparameter|setstring|setint"
ASSIGNED = r"^\s*(?:(?:final|const|let|var|val|String|int|long|Path|File|List<\w+>|[A-Z]\w*)\s+)*([A-Za-z_]\w*)\s*(?::\s*\w+\s*)?=\s*([^=].*)$"
WORD = r"[A-Za-z_]\w*"
#: Parameters of types that carry no text, and the names of the others, in the rest of a head's line.
SCALAR = r"\b(?:int|long|double|float|boolean|char|byte|short|Integer|Long|Double|Float|Boolean|BigDecimal|BigInteger|UUID)\s+\w+"
PARAMETER = r"([A-Za-z_]\w*)\s*[,):=]"


def statements(sources: DataFrame) -> DataFrame:
    """(source_id, function, line_no, head, target, params, words, outside, sink, cleaned) of heads, assignments and sinks inside functions.

    Patterns are looked for only in lines that hold their sign, and words only where they are read.
    """
    line, target = F.col("line"), F.col("target")
    rows = enclosing_functions(sources).where("function != 'moduleScope'").withColumn("head", is_head(line))
    rows = rows.withColumn("target", F.when(~F.col("head") & line.contains("="), F.nullif(F.regexp_extract("line", ASSIGNED, 1), F.lit("")))).withColumn("sink", ~F.col("head") & line.contains("(") & line.rlike(SINKS))
    some = rows.where("head or sink or target is not null")
    read = F.when(target.isNotNull(), F.regexp_extract("line", ASSIGNED, 2)).otherwise(line)
    return some.select(
        "source_id", "function", "line_no", "head", "target",
        F.when(F.col("head"), F.regexp_extract_all(F.regexp_replace(F.regexp_extract("line", r"\((.*)$", 1), SCALAR, " "), F.lit(PARAMETER), F.lit(1))).alias("params"),
        F.when(~F.col("head"), F.array_distinct(F.regexp_extract_all(F.regexp_replace(read, r"\"[^\"]*\"|'[^']*'", " "), F.lit(WORD), F.lit(0)))).alias("words"),
        (target.isNotNull() & line.rlike(OUTSIDE)).alias("outside"), "sink", (target.isNotNull() & line.rlike(CLEANED)).alias("cleaned"),
    )


def _followed(begin: DataFrame, reads: DataFrame, key: list[str]) -> DataFrame:
    """begin (key, variable, at, hops, cleaned) and all variables that its values reach, each at its earliest lines.

    reads has (source_id, function, line_no, target, cleaned, variable); key holds source_id and function, and may hold
    more that a value keeps. Only rows of a line earlier than known are followed, so cycles end.
    """
    assigned = reads.where("target is not null").select("source_id", "function", "variable", "line_no", "target", F.col("cleaned").alias("now"))
    known, frontier, hops = begin, begin, 0
    while True:
        hops += 1
        later = frontier.drop("cleaned").join(assigned, ["source_id", "function", "variable"]).where("line_no > at and target != variable")
        reached = later.groupBy(*key, F.col("target").alias("variable")).agg(F.min("line_no").alias("at"), F.min(F.lit(hops)).alias("hops"), F.max("now").alias("cleaned"))
        earliest = known.groupBy(*key, "variable").agg(F.min("at").alias("first"))
        frontier = staged(reached.join(earliest, [*key, "variable"], "left").where("first is null or at < first").drop("first"), "taint-step")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        if hops % 4 == 0:
            known = staged(known, "taint-known")


def flows(sources: DataFrame) -> DataFrame:
    """(source_id, function, sink_line, variable, hops, cleaned): sinks that read a tainted variable.

    Hops counts the assignments from the outside value to the variable. cleaned says whether the last assignment to the
    variable cleaned it; taint is flagged, never removed. Functions of one name in a file count as one.
    """
    key = ["source_id", "function"]
    rows = staged(statements(sources), "taint")
    reads = rows.where("not head").select(*key, "line_no", "target", "sink", "cleaned", F.explode("words").alias("variable"))
    given = rows.where("head").select(*key, F.explode("params").alias("variable"), "line_no", F.lit(False).alias("cleaned"))
    called = rows.where("outside and target is not null").select(*key, F.col("target").alias("variable"), "line_no", "cleaned")
    begin = staged(given.unionByName(called).groupBy(*key, "variable").agg(F.min("line_no").alias("at"), F.min(F.lit(0)).alias("hops"), F.max("cleaned").alias("cleaned")), "taint-begin")
    known = _followed(begin, reads, key)
    hits = known.join(reads.where("sink").drop("cleaned", "target"), [*key, "variable"]).where("line_no > at or hops = 0 and line_no >= at")
    # A variable with an earlier line after more steps has a row for each; a sink counts its fewest steps.
    nearest = hits.groupBy(*key, F.col("line_no").alias("sink_line"), "variable").agg(F.min(F.struct("hops", "cleaned")).alias("n"))
    return nearest.select(*key, "sink_line", "variable", "n.hops", "n.cleaned")


#: Calls with flat arguments, and the parameter that ends a part of a head's list.
CALL = r"([A-Za-z_]\w*)\s*\(([^()]*)\)"
GIVEN = r"(?:^|[\s*&.])([A-Za-z_]\w*)\s*(?:[:=].*)?$"
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "when", "elif", "and", "or", "not", "in")


def calls_and_parameters(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, function, line_no, callee, scope, nth, variable, arguments) of what calls take, and (source_id, function, nth, variable, parameters) of heads."""
    rows = enclosing_functions(sources).where("function != 'moduleScope'").withColumn("head", is_head(F.col("line")))
    bare = F.regexp_replace("line", r"\"[^\"]*\"|'[^']*'", "''")
    found = F.regexp_extract_all(bare, F.lit(rf"(?:[A-Za-z_]\w*\.)?{CALL}"), F.lit(0))
    each = rows.where("not head").select("source_id", "function", "line_no", F.explode(found).alias("call")).select(
        "source_id", "function", "line_no", F.regexp_extract("call", CALL, 1).alias("callee"), F.lower(F.regexp_extract("call", r"^([A-Za-z_]\w*)\.", 1)).alias("scope"), F.split(F.regexp_extract("call", CALL, 2), ",").alias("given")
    )
    some = each.where(~F.col("callee").isin(*NO_CALLS)).select("source_id", "function", "line_no", "callee", "scope", F.size("given").alias("arguments"), F.posexplode("given").alias("nth", "text"))
    args = some.select("source_id", "function", "line_no", "callee", "scope", "arguments", "nth", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("variable"))
    listed = F.split(F.regexp_replace(F.regexp_extract("line", r"\(([^()]*)\)?", 1), r"<[^<>]*>", ""), ",")
    heads = rows.where("head").select("source_id", "function", F.size(listed).alias("parameters"), F.posexplode(listed).alias("nth", "text"))
    params = heads.select("source_id", "function", "parameters", "nth", F.regexp_extract(F.trim("text"), GIVEN, 1).alias("variable")).where("variable != ''")
    return args, params


def flows_across(sources: DataFrame, depth: int = 5) -> DataFrame:
    """(source_id, function, variable, sink_source_id, sink_function, sink_line, calls): sinks that a value reaches through calls.

    Origins are parameters and variables given an outside value. A value given as an argument becomes the parameter of
    the function called: of the same repository, name and number of parameters, in the caller's file first, then in a
    file whose class is the call's scope, then in the smallest source_id. At most `depth` functions lie on the way, the
    first included, never the first again, and a (function, parameter) counts at its fewest calls, so cycles end. Functions of one name in a file
    count as one, and so do parameters of one place; null texts give no rows.
    """
    key = ["source_id", "function"]
    rows = staged(statements(sources), "across")
    args, params = calls_and_parameters(sources)
    args, params = staged(args, "across-args"), staged(params.distinct(), "across-params")
    reads = rows.where("not head").select(*key, "line_no", "target", "sink", "cleaned", F.explode("words").alias("variable"))
    given = params.select(*key, F.col("variable")).join(rows.where("head").groupBy(*key).agg(F.min("line_no").alias("at")), key)
    called = rows.where("outside and target is not null").select(*key, F.col("target").alias("variable"), F.col("line_no").alias("at"))
    begin = given.unionByName(called).groupBy(*key, "variable").agg(F.min("at").alias("at")).select(*key, F.col("variable").alias("origin"), "variable", "at", F.lit(0).alias("hops"), F.lit(False).alias("cleaned"))
    known = staged(_followed(staged(begin, "across-begin"), reads, [*key, "origin"]), "across-known")

    home = sources.where("raw_source is not null").select("source_id", "repository_id", F.lower(F.regexp_extract("raw_source", r"(?:class|interface|enum|object)\s+([A-Z]\w*)", 1)).alias("class"))
    made = params.select(F.col("source_id").alias("to_id"), F.col("function").alias("callee"), F.col("parameters").alias("arguments")).distinct()
    placed = made.join(home.withColumnRenamed("source_id", "to_id"), "to_id").where("repository_id is not null")
    by_class = placed.groupBy("repository_id", "callee", "arguments", F.col("class").alias("scope")).agg(F.min("to_id").alias("class_id"))
    by_name = placed.groupBy("repository_id", "callee", "arguments").agg(F.min("to_id").alias("name_id"))
    wanted = args.select("source_id", "callee", "scope", "arguments").distinct().join(home.select("source_id", "repository_id"), "source_id")
    resolved = (
        wanted.join(made.select(F.col("to_id").alias("source_id"), "callee", "arguments", F.lit(True).alias("own")), ["source_id", "callee", "arguments"], "left")
        .join(by_class, ["repository_id", "callee", "arguments", "scope"], "left").join(by_name, ["repository_id", "callee", "arguments"], "left")
        .select("source_id", "callee", "scope", "arguments", F.when(F.col("own"), F.col("source_id")).otherwise(F.coalesce("class_id", "name_id")).alias("to_id")).where("to_id is not null")
    )
    taken = known.select(*key, "origin", "variable", "at").join(args, [*key, "variable"]).where("line_no >= at")
    to = taken.select(*key, "origin", "callee", "scope", "arguments", "nth").distinct().join(resolved, ["source_id", "callee", "scope", "arguments"])
    named = params.select(F.col("source_id").alias("to_id"), F.col("function").alias("callee"), "nth", F.col("parameters").alias("arguments"), F.col("variable").alias("to_origin"))
    edges = staged(
        to.join(named, ["to_id", "callee", "arguments", "nth"]).select(*key, "origin", "to_id", F.col("callee").alias("to_function"), "to_origin").where("source_id != to_id or function != to_function").distinct(), "across-edges"
    )
    step = edges.select(F.col("source_id").alias("to_id"), F.col("function").alias("to_function"), F.col("origin").alias("to_origin"), F.col("to_id").alias("n_id"), F.col("to_function").alias("n_function"), F.col("to_origin").alias("n_origin"))
    place = ["to_id", "to_function", "to_origin"]
    reached = frontier = edges.withColumn("calls", F.lit(1))
    for calls in range(2, depth):
        further = frontier.join(step, place).where("source_id != n_id or function != n_function").select(*key, "origin", F.col("n_id").alias("to_id"), F.col("n_function").alias("to_function"), F.col("n_origin").alias("to_origin")).distinct()
        frontier = staged(further.join(reached, [*key, "origin", *place], "left_anti").withColumn("calls", F.lit(calls)), "across-reach")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    sinks = known.select(*key, "origin", "variable", "at").join(reads.where("sink").select(*key, "variable", "line_no"), [*key, "variable"]).where("line_no >= at")
    ends = sinks.select(F.col("source_id").alias("to_id"), F.col("function").alias("to_function"), F.col("origin").alias("to_origin"), F.col("line_no").alias("sink_line")).distinct()
    found = reached.join(ends, place).groupBy(*key, "origin", "to_id", "to_function", "sink_line").agg(F.min("calls").alias("calls"))
    return found.select(*key, F.col("origin").alias("variable"), F.col("to_id").alias("sink_source_id"), F.col("to_function").alias("sink_function"), "sink_line", "calls")


#: Fixed values of Python: decorators of handlers, names of parameters from outside, sources, cleaning calls and sinks.
HANDLER = r"^\s*@[\w.]*(?:route|get|post|put|delete|api)"
FROM_OUTSIDE = r"(?i)input|user|payload|query|param|body|path|url|data"
PY_SOURCES = r"request\.(?:args|form|values|json|GET|POST|query_params|body)|sys\.argv|os\.environ"
PY_CLEANERS = r"shlex\.quote|os\.path\.realpath|os\.path\.commonpath|yaml\.safe_load|ast\.literal_eval|escape|secrets\.token"
PY_SINKS = (
    r"(?<![\w.])(?:os\.(?:system|popen|remove)|subprocess\.\w+|eval|exec|open|io\.open|requests\.\w+|httpx\.\w+|urllib\.request\.\w+|_?pickle\.\w+)\s*\(|(?:\.|(?<![\w.]))(?:execute|executemany|raw)\s*\("
)
BOUND = r"\.execute(?:many)?\(\s*[\"'][^\"']*[\"']\s*,"
_PY_ASSIGNED = re.compile(r"^\s*([A-Za-z_]\w*)\s*(?::\s*[\w\[\], .|]+)?=\s*([^=].*)$")
_PY_STRING = re.compile(r"(?<![fF\w])(?:\"[^\"]*\"|'[^']*')")


def python_function(lines: list[tuple[int, str]], params: list[str]) -> list[tuple[int, str, int, bool]]:
    """(sink line, variable, assignments on the way, bound) for the lines of a function and its tainted parameters.

    Statements are taken in order: a source taints its target, a cleaning call clears it, a value that reads a tainted
    variable taints it; other values change nothing. Sinks then see what is tainted at the end, the variable tainted first
    counts. bound tells a query with its values apart from its text.
    """
    tainted: dict[str, int] = dict.fromkeys(params, 0)

    def read(text: str) -> str | None:
        words = set(re.findall(WORD, _PY_STRING.sub(" ", text)))
        return next((v for v in tainted if v in words), None)

    for _, line in lines:
        if m := _PY_ASSIGNED.match(line):
            target, value = m.groups()
            if re.search(PY_SOURCES, value):
                tainted[target] = 0
            elif re.search(PY_CLEANERS, value):
                tainted.pop(target, None)
            elif (origin := read(value)) is not None and origin != target:
                tainted[target] = tainted[origin] + 1
    out = []
    for number, line in lines:
        for m in re.finditer(PY_SINKS, _PY_STRING.sub(lambda x: " " * len(x.group()), line)):
            variable = read(line[m.end() :])
            if variable is not None:
                out.append((number, variable, tainted[variable], bool(re.search(BOUND, line[max(0, m.start() - 1) :]))))
                break
    return out


def python_flows(sources: DataFrame) -> DataFrame:
    """(source_id, function, sink_line, variable, hops, bound): sinks of Python functions that tainted variables reach.

    Parameters are tainted if the function is a handler of a route (a decorator up to three lines above says so) or their
    name speaks of outside values; self and cls are not. Cleaning clears a variable. Functions are followed one by one, each by
    its lines alone; files of other languages, null and empty texts give no rows.
    """
    python = sources.where(C.language_of(F.col("file_path")) == "PYTHON")
    above = Window.partitionBy("source_id").orderBy("line_no")
    rows = enclosing_functions(python).withColumn("head", is_head(F.col("line"))).withColumn("handler", F.coalesce(F.max(F.col("line").rlike(HANDLER)).over(above.rowsBetween(-3, -1)), F.lit(False)))
    nth = F.sum(F.col("head").cast("int")).over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = F.transform(F.split(F.regexp_extract("line", r"\(([^()]*)", 1), ","), lambda x: F.regexp_extract(x, r"^\s*\**\s*([A-Za-z_]\w*)", 1))
    mine = F.filter(names, lambda x: ~x.isin("", "self", "cls") & (F.col("handler") | x.rlike(FROM_OUTSIDE)))
    body = rows.withColumn("nth", nth).where("function != 'moduleScope'")
    params = F.first(F.when(F.col("head"), mine), ignorenulls=True).alias("params")
    lines = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))).alias("lines")
    each = body.groupBy("source_id", "function", "nth").agg(params, lines).select("source_id", "function", F.coalesce("params", F.array().cast("array<string>")).alias("params"), "lines")
    kind = each.schema["source_id"].dataType.simpleString()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *f) for i, (params, lines) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))) for f in python_function([(x["line_no"], x["line"]) for x in lines], params)]
            at, *columns = zip(*found) if found else [[]] * 5
            held = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:2]]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(held + [pa.array(c, k) for c, k in zip(columns, kinds)], ["source_id", "function", "sink_line", "variable", "hops", "bound"])

    return each.mapInArrow(follow, f"source_id {kind}, function string, sink_line int, variable string, hops int, bound boolean")
