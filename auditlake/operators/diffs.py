"""Unified diffs as tables: parsing by windows, and generation of one hunk a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, target, hunk, sign, new_line, line): the body lines of unified diffs with their line in the new file.

    A +++ line followed by hunks names the file, a hunk's head gives the first line; missing counts are 1. Context and
    added lines advance the new file, removed ones and notes about a missing end of line do not. Text before the first
    hunk gives no rows; null and empty texts give none.
    """
    rows = C.lines(diffs, key, text=text).withColumnRenamed("line_no", "pos")
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("line").rlike(HUNK)
    name = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:[ab]/)?([^\t]*)", 1))
    file_line = F.col("line").startswith("--- ") & F.coalesce(F.lead("line").over(order).startswith("+++ "), F.lit(False)) | F.col("line").startswith("+++ ")
    tagged = rows.select(
        key, "pos", "line", head.alias("head"), file_line.alias("named"), F.last(name, ignorenulls=True).over(upto).alias("target"), F.sum(head.cast("int")).over(upto).alias("hunk"),
        F.last(F.when(head, F.regexp_extract("line", HUNK, 3).cast("int")), ignorenulls=True).over(upto).alias("start"),
    )
    body = tagged.where("hunk > 0 and not head and not named").withColumn("sign", F.when(F.substring("line", 1, 1).isin("+", "-", "\\"), F.substring("line", 1, 1)).otherwise(" "))
    before = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    advanced = F.coalesce(F.sum(F.col("sign").isin("+", " ").cast("int")).over(before), F.lit(0))
    return body.select(key, "pos", "target", "hunk", "sign", (F.col("start") + advanced).cast("int").alias("new_line"), "line")


def touched(rows: DataFrame, key: str) -> DataFrame:
    """(key, target, hunk, lo, hi, added, removed): the lines of the new file that each hunk touches."""
    return rows.groupBy(key, "target", "hunk").agg(
        F.min("new_line").alias("lo"), F.max("new_line").alias("hi"), F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed")
    )


def unified(path: Column, old: Column, new: Column, context: int = 2) -> Column:
    """One hunk from the first to the last difference, with lines of context; empty if the texts agree. Nulls are empty texts."""
    empty = F.lit("")
    a, b = F.split(F.coalesce(old, empty), "\n"), F.split(F.coalesce(new, empty), "\n")

    def alike(x: Column, y: Column) -> Column:
        """How many lines agree from the begin."""
        return F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False).cast("int") - 1

    top = alike(a, b)
    end = F.least(alike(F.reverse(a), F.reverse(b)), F.size(a) - top, F.size(b) - top)
    first, after = F.greatest(top - context, F.lit(0)), F.least(F.lit(context), end)
    old_end, new_end = F.size(a) - end, F.size(b) - end

    def signed(sign: str, lines: Column, begin: Column, stop: Column) -> Column:
        return F.transform(F.slice(lines, begin + 1, stop - begin), lambda x: F.concat(F.lit(sign), x))

    body = F.concat(signed(" ", a, first, top), signed("-", a, top, old_end), signed("+", b, top, new_end), signed(" ", a, old_end, old_end + after))
    at = (first + 1).cast("string")
    spans = F.concat(F.lit("@@ -"), at, F.lit(","), (old_end + after - first).cast("string"), F.lit(" +"), at, F.lit(","), (new_end + after - first).cast("string"), F.lit(" @@"))
    name = F.coalesce(path, empty)
    whole = F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), spans), body), "\n")
    return F.when(F.coalesce(old, empty) == F.coalesce(new, empty), empty).otherwise(whole)


def applied(old: Column, diff: Column) -> Column:
    """The text that a diff of one hunk makes of an old text; null if the lines it takes are others. An empty diff changes nothing."""
    text = F.coalesce(old, F.lit(""))
    lines, rows = F.split(text, "\n"), F.split(diff, "\n")
    body = F.slice(rows, 4, F.greatest(F.size(rows) - 3, F.lit(0)))
    first = F.regexp_extract(F.element_at(rows, 3), HUNK, 1).cast("int") - 1
    sign = lambda x: F.substring(x, 1, 1)
    bare = lambda x: F.substring(x, 2, 1_000_000_000)
    taken = F.transform(F.filter(body, lambda x: sign(x).isin(" ", "-")), bare)
    given = F.transform(F.filter(body, lambda x: sign(x).isin(" ", "+")), bare)
    rest = F.slice(lines, first + 1 + F.size(taken), F.greatest(F.size(lines) - first - F.size(taken), F.lit(0)))
    fits = F.slice(lines, first + 1, F.size(taken)) == taken
    return F.when(diff == "", text).when(fits, F.array_join(F.concat(F.slice(lines, F.lit(1), first), given, rest), "\n"))


def generated(rows: DataFrame, key: str, path: str, old: str, new: str) -> DataFrame:
    """(key, diff, applies): the diff of each row's texts, and whether applying it to the old gives the new.

    Null texts are empty; equal texts give an empty diff.
    """
    made = rows.select(F.col(key), unified(F.col(path), F.col(old), F.col(new)).alias("diff"), F.col(old).alias("_old"), F.coalesce(F.col(new), F.lit("")).alias("_new"))
    return made.select(key, "diff", F.coalesce(applied(F.col("_old"), F.col("diff")) == F.col("_new"), F.lit(False)).alias("applies"))
