"""What takes findings back: annotations, directives in comments and ignore rules; and the disposition of each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators import findings as R

#: The word that begins a directive (word-ignore TOKEN reason) and may stand before a token (word:TOKEN).
WORD = "audit"
ANNOTATION = r"@(?:java\.lang\.)?SuppressWarnings\s*\(([^)]*)\)"
TYPE_HEAD = r"\b(?:class|interface|enum|record|object)\s+([A-Za-z_]\w*)"
#: Lines under an annotation on which its function, class or field may begin.
REACH = 3


def bare_token(token: Column, word: str = WORD) -> Column:
    """A token in lower case without word: before it."""
    return F.trim(F.regexp_replace(F.lower(F.trim(token)), rf"^{word}:", ""))


def names_of(rule: Column) -> Column:
    """The tokens that name a rule: all, *, its whole id and the first two parts of it, in lower case."""
    return F.array_distinct(F.array(F.lit("all"), F.lit("*"), F.lower(F.trim(rule)), F.lower(C.rule_key(rule))))


def token_matches(token: Column, rule: Column, word: str = WORD) -> Column:
    """Whether a token names a rule. Null tokens and rules match nothing."""
    return F.coalesce(F.array_contains(names_of(rule), bare_token(token, word)), F.lit(False)) & rule.isNotNull()


def directives(sources: DataFrame, word: str = WORD) -> DataFrame:
    """(source_id, line_no, token, reason): directives in comments to the end of the line or within it."""
    pattern = rf"(?i)(?://|#|/\*+)\s*{word}-ignore\s+([A-Za-z0-9_:*-]+)[ \t]*(.*?)\s*(?:\*+/.*)?$"
    found = C.lines(sources.where(F.lower("raw_source").contains(f"{word}-ignore")), "source_id").where(F.col("line").rlike(pattern))
    return found.select("source_id", "line_no", F.regexp_extract("line", pattern, 1).alias("token"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).alias("reason"))


def by_directive(found: DataFrame, sources: DataFrame, word: str = WORD) -> DataFrame:
    """(source_id, line_no, rule): findings with a directive for their rule on their line, the one before or the one after.

    A directive stands for the three lines it covers, so this is an equi-join on (source_id, line_no).
    """
    near = directives(sources, word).select("source_id", "token", F.explode(F.sequence(F.col("line_no") - 1, F.col("line_no") + 1)).alias("line_no")).distinct()
    hits = found.join(near, ["source_id", "line_no"]).where(token_matches(F.col("token"), F.col("rule"), word))
    return hits.select("source_id", "line_no", "rule").distinct()


def annotations(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, token): the values of annotations that suppress warnings, alone or in a list."""
    found = C.lines(sources.where(F.col("raw_source").contains("SuppressWarnings")), "source_id").where(F.col("line").rlike(ANNOTATION))
    return found.select("source_id", "line_no", F.explode(F.regexp_extract_all(F.regexp_extract("line", ANNOTATION, 1), F.lit(r'"([^"]*)"'), F.lit(1))).alias("token"))


def by_annotation(found: DataFrame, sources: DataFrame, word: str = WORD) -> DataFrame:
    """(source_id, line_no, rule): findings in a function or class, or on a line, that an annotation above it covers.

    An annotation covers all functions of the name that begins on it or up to REACH lines below, the whole file where
    a class begins there, and otherwise the line below.
    """
    marked = sources.where(F.col("raw_source").contains("SuppressWarnings"))
    marks = annotations(marked).select("source_id", "token", "line_no", F.explode(F.sequence("line_no", F.col("line_no") + REACH)).alias("at"))
    heads = R.enclosing_functions(marked)
    names = heads.where(R.is_head(F.col("line"))).select("source_id", F.col("line_no").alias("at"), "function")
    types = heads.where(F.col("line").rlike(TYPE_HEAD)).select("source_id", F.col("line_no").alias("at")).withColumn("type", F.lit(True))
    placed = marks.join(names, ["source_id", "at"], "left").join(types, ["source_id", "at"], "left")
    first = placed.where("function is not null or type").groupBy("source_id", "token", "line_no").agg(F.min(F.struct("at", F.coalesce("type", F.lit(False)).alias("type"), "function")).alias("m"))
    covered = annotations(marked).join(first, ["source_id", "token", "line_no"], "left").select("source_id", "token", F.col("line_no").alias("mark"), "m.type", "m.function")
    inside = found.join(heads.select("source_id", "line_no", F.col("function").alias("in")), ["source_id", "line_no"])
    below = (F.col("line_no") > F.col("mark")) & (F.col("line_no") <= F.col("mark") + 1)
    hits = inside.join(covered, "source_id").where(F.coalesce("type", F.lit(False)) | (F.col("function") == F.col("in")) | (F.col("function").isNull() & below))
    return hits.where(token_matches(F.col("token"), F.col("rule"), word)).select("source_id", "line_no", "rule").distinct()


def by_ignore_rule(found: DataFrame, rules: DataFrame, word: str = WORD) -> DataFrame:
    """(source_id, line_no, rule): findings that an ignore rule (path, rule) names.

    found needs path; a rule without a path holds for all files, one without a rule for all rules, and a path for files
    whose path ends with it or whose name it is. Paths are compared without case by an equi-join: a file stands for each
    end of its path.
    """
    named = rules.select(F.lower(C.normal_path(F.col("path"))).alias("end"), F.col("rule").alias("token")).distinct()
    parts = F.split(F.lower(C.normal_path(F.col("path"))), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    files = found.select("path").where("path is not null").distinct().select("path", F.explode(ends).alias("end")).join(named.where("end != ''"), "end").select("path", "token").distinct()
    of_file = found.join(files, "path").where(F.col("token").isNull() | token_matches(F.col("token"), F.col("rule"), word)).select("source_id", "line_no", "rule")
    everywhere = named.where("end is null or end = ''").select(bare_token(F.col("token"), word).alias("name")).distinct()
    ruled = found.select("rule").distinct().where("rule is not null").select("rule", F.explode(names_of(F.col("rule"))).alias("name")).join(everywhere, "name").select("rule").distinct()
    return of_file.unionByName(found.join(ruled, "rule").select("source_id", "line_no", "rule")).distinct()


#: Dispositions in order of precedence.
KINDS = ("LOW_CONFIDENCE_HEURISTIC", "ANNOTATION", "INLINE_COMMENT", "IGNORE_FILE", "DIFF_BASELINE", "BASELINE_ACCEPTED")


def dispositions(found: DataFrame, hits: dict[str, DataFrame], least: float) -> DataFrame:
    """found with disposition: the first of KINDS that applies, or ACTIVE.

    found has (source_id, line_no, rule, confidence); hits the findings (source_id, line_no, rule) of each kind but the
    first, which is a confidence below `least`. A kind without an entry applies to none.
    """
    key = ["source_id", "line_no", "rule"]
    what = F.when(F.col("confidence") < least, KINDS[0])
    for kind in KINDS[1:]:
        if kind in hits:
            found = found.join(hits[kind].select(*key).distinct().withColumn(f"_{kind}", F.lit(True)), key, "left")
            what = what.when(F.col(f"_{kind}"), kind)
    return found.withColumn("disposition", what.otherwise("ACTIVE")).drop(*(f"_{kind}" for kind in KINDS))
