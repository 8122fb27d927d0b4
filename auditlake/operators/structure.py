"""Resolution of names across files: methods, types, consumers and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators import findings, taint

#: Wrappers that say nothing about the type inside them, a controller's mark, and an endpoint's head with its type and name.
WRAPPERS = r"\b(?:List|Set|Collection|Iterable|ResponseEntity|Optional|Map|Mono|Flux)<|[<>\[\]?]|\b\w+\s*,"
CONTROLLER = r"@(?:Rest)?Controller"
ENDPOINT = r"^\s*public\s+([A-Z][\w<>\[\], ?]*)\s+[a-z]\w*\s*\("
TYPE = r"\b[A-Z]\w+"
#: A constant's definition by a literal, and the operands in the rest of a sink's call.
CONSTANT = r"^\s*(?:(?:public|private|protected|static|final|const|export|val|let|var|String|int|long)\s+)*([A-Z][A-Z0-9_]*)\s*(?::\s*\w+\s*)?=\s*[\"'`0-9]"
OPERAND = r"([A-Za-z_]\w*)\s*(?:[,)+%;]|$)"
STRINGS = r"\"[^\"]*\"|'[^']*'|`[^`]*`"


def clean_type(name: Column) -> Column:
    """A type without wrappers, brackets and key types."""
    return F.trim(F.regexp_replace(name, WRAPPERS, " "))


def resolved_calls(sources: DataFrame) -> DataFrame:
    """(repository_id, scope, name, calls, source_id, how): calls with a scope, by the class of that name, else any of the method.

    Definitions are reduced to the smallest source of each (repository, method, class) and of each (repository,
    method), so both ways are equi-joins with unique keys. Calls without any definition have no source.
    """
    named = findings.headers(sources).select("source_id", "repository_id", F.lower("primary_class").alias("class"))
    made = findings.function_spans(sources).select("source_id", F.col("function").alias("name")).distinct().join(named, "source_id")
    of_class = made.groupBy("repository_id", "name", "class").agg(F.min("source_id").alias("a"))
    of_name = made.groupBy("repository_id", "name").agg(F.min("source_id").alias("b"))
    scoped = findings.facts(sources).where("kind = 'call'").select("source_id", F.regexp_extract("name", r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)$", 1).alias("scope"), F.regexp_extract("name", r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)$", 2).alias("name"))
    calls = scoped.where("scope != ''").join(sources.select("source_id", "repository_id"), "source_id").groupBy("repository_id", "scope", "name").agg(F.count(F.lit(1)).alias("calls"))
    found = calls.withColumn("class", F.lower("scope")).join(of_class, ["repository_id", "name", "class"], "left").join(of_name, ["repository_id", "name"], "left")
    how = F.when(F.col("a").isNotNull(), "scope").when(F.col("b").isNotNull(), "name").otherwise("none")
    return found.select("repository_id", "scope", "name", "calls", F.coalesce("a", "b").alias("source_id"), how.alias("how"))


def exposed_types(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, type, resolved, how): types that controllers' endpoints give back, with their full name.

    An import of the name comes first, then a class of the same package, then any class of the repository; the smallest
    name among several. Each way is an equi-join with a unique key.
    """
    head = findings.headers(sources)
    rows = sources.where(F.col("raw_source").rlike(CONTROLLER)).select("source_id", "repository_id", "raw_source")
    ends = C.lines(rows, "source_id").select("source_id", "line_no", F.element_at(F.split(clean_type(F.regexp_extract("line", ENDPOINT, 1)), r"\s+"), 1).alias("type")).where("type != ''")
    imported = head.select("source_id", F.explode("imports").alias("full")).select("source_id", "full", F.regexp_extract("full", r"([^.]*)$", 1).alias("type")).groupBy("source_id", "type").agg(F.min("full").alias("i"))
    classes = head.where("package != ''").select("repository_id", "package", F.col("primary_class").alias("type"), F.concat_ws(".", "package", "primary_class").alias("full"))
    near = classes.groupBy("repository_id", "package", "type").agg(F.min("full").alias("p"))
    any_ = classes.groupBy("repository_id", "type").agg(F.min("full").alias("r"))
    placed = ends.join(head.select("source_id", "repository_id", "package"), "source_id")
    found = placed.join(imported, ["source_id", "type"], "left").join(near, ["repository_id", "package", "type"], "left").join(any_, ["repository_id", "type"], "left")
    how = F.when(F.col("i").isNotNull(), "import").when(F.col("p").isNotNull(), "package").when(F.col("r").isNotNull(), "repository").otherwise("none")
    return found.select("source_id", "line_no", "type", F.coalesce("i", "p", "r").alias("resolved"), how.alias("how"))


def consumers(sources: DataFrame) -> DataFrame:
    """(source_id, consumer_id): for each file the first other file of its repository that names its primary class.

    Words that are no class of the repository are left out first, so that words that all files hold, but for classes,
    never meet. The others are reduced to the two smallest files of each (repository, word), one of which is another.
    """
    own = findings.headers(sources).where("primary_class != 'UnknownClass'").select("source_id", "repository_id", F.col("primary_class").alias("word"))
    every = sources.where("raw_source is not null").select("source_id", "repository_id", F.explode(F.array_distinct(F.regexp_extract_all("raw_source", F.lit(TYPE), F.lit(0)))).alias("word"))
    words = every.join(own.select("repository_id", "word").distinct(), ["repository_id", "word"], "left_semi")
    first = words.groupBy("repository_id", "word").agg(F.min("source_id").alias("a"))
    later = words.join(first, ["repository_id", "word"]).where("source_id != a").groupBy("repository_id", "word").agg(F.min("source_id").alias("b"))
    two = first.join(later, ["repository_id", "word"], "left")
    return own.join(two, ["repository_id", "word"]).select("source_id", F.when(F.col("a") != F.col("source_id"), F.col("a")).otherwise(F.col("b")).alias("consumer_id")).where("consumer_id is not null")


def annotated_functions(sources: DataFrame, reach: int = 2) -> DataFrame:
    """(source_id, function, start_line, annotation): annotations on the lines just above a function's head or on it.

    Each annotated line stands for the lines below that it can belong to, so this is an equi-join.
    """
    marks = findings.facts(sources).where("kind = 'annotation'").select("source_id", F.col("name").alias("annotation"), F.explode(F.sequence("line_no", F.col("line_no") + reach)).alias("start_line"))
    return findings.function_spans(sources).select("source_id", "function", "start_line").join(marks, ["source_id", "start_line"]).select("source_id", "function", "start_line", "annotation").distinct()


def sink_operands(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, operands, unproven): names that a sink's call takes, and how many are no constants of the file.

    A constant is a name in capitals that its file gives a literal; a call with no unproven operand takes literals and
    constants alone.
    """
    rows = C.lines(sources, "source_id")
    known = rows.select("source_id", F.regexp_extract("line", CONSTANT, 1).alias("name")).where("name != ''").distinct()
    rest = F.regexp_extract("line", taint.SINKS + r"(.*)$", 1)
    names = F.array_distinct(F.regexp_extract_all(F.regexp_replace(rest, STRINGS, " "), F.lit(OPERAND), F.lit(1)))
    calls = rows.where(F.col("line").rlike(taint.SINKS) & ~findings.is_head(F.col("line"))).select("source_id", "line_no", names.alias("names"))
    each = calls.select("source_id", "line_no", F.explode_outer("names").alias("name")).join(known.withColumn("proven", F.lit(1)), ["source_id", "name"], "left")
    return each.groupBy("source_id", "line_no").agg(F.count("name").alias("operands"), F.count_if(F.col("name").isNotNull() & F.col("proven").isNull()).alias("unproven"))
