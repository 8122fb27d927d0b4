"""Joins of findings with baselines, intervals, paths and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C

FILLERS = ("", "n/a", "pending", "none", "null")


def usable(fingerprint: Column) -> Column:
    """A fingerprint in lower case; null for fillers, which prove nothing."""
    low = F.lower(F.trim(fingerprint))
    return F.when(low.isNotNull() & ~low.isin(*FILLERS) & ~low.rlike("^0+$"), low)


def baseline_exact(new: DataFrame, old: DataFrame) -> DataFrame:
    """(entry_id, baseline_id): each new entry with the smallest old entry of the same repository and fingerprint.

    Old entries are aggregated by key before the join, so a key held by a third of them is one row.
    """
    keyed = old.select("repository_id", usable(F.col("fingerprint")).alias("f"), "entry_id").where("f is not null")
    first = keyed.groupBy("repository_id", "f").agg(F.min("entry_id").alias("baseline_id"))
    return new.select("repository_id", usable(F.col("fingerprint")).alias("f"), "entry_id").join(first, ["repository_id", "f"]).select("entry_id", "baseline_id")


def path_ends(path: Column) -> Column:
    """The ends of a path that are paths themselves: the whole one first, the file name last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def baseline_structural(new: DataFrame, old: DataFrame, window: int = 5) -> DataFrame:
    """(entry_id, baseline_id): the smallest old entry of the same repository and rule by path and method or nearby line.

    Paths are the same, without case, if they are equal or one ends with the other. Same method means the same non-blank
    method name; nearby at most `window` lines apart. Every way is an equi-join: old entries are aggregated by path and
    method, and by path and line; one side stands for the 2 * window + 1 lines around it, and the longer of two paths for
    each of its ends. So no key pairs all its rows with all others.
    """
    key = ["repository_id", "rule", "path"]

    def keyed(df: DataFrame) -> DataFrame:
        path = F.lower(C.normal_path(F.col("file_path")))
        return df.select("repository_id", F.lower(F.trim("rule_id")).alias("rule"), path.alias("path"), "entry_id", F.trim("method_name").alias("method"), "start_line").dropna(subset=key).where("path != ''")

    def ends(df: DataFrame) -> DataFrame:
        return df.withColumn("path", F.explode(path_ends(F.col("path"))))

    a, b = keyed(new), keyed(old)
    by_method = b.where("method != ''").groupBy(*key, "method").agg(F.min("entry_id").alias("baseline_id"))
    near = b.where("start_line is not null").select(*key, "entry_id", F.explode(F.sequence(F.col("start_line") - window, F.col("start_line") + window)).alias("start_line"))
    by_line = near.groupBy(*key, "start_line").agg(F.min("entry_id").alias("baseline_id"))
    def ended(df: DataFrame, of: str) -> DataFrame:
        """df with its paths' ends for its paths, aggregated again."""
        return ends(df).groupBy(*key, of).agg(F.min("baseline_id").alias("baseline_id"))

    # The new path ends with the old one or is it; the old one ends with the new one, where the new side stands for its lines.
    at_line = b.where("start_line is not null").groupBy(*key, "start_line").agg(F.min("entry_id").alias("baseline_id"))
    around = a.where("start_line is not null").withColumn("start_line", F.explode(F.sequence(F.col("start_line") - window, F.col("start_line") + window)))
    ways = ((ends(a), by_method, "method"), (a, ended(by_method, "method"), "method"), (ends(a), by_line, "start_line"), (around, ended(at_line, "start_line"), "start_line"))
    hits = reduce(DataFrame.unionByName, [left.join(right, [*key, of]).select("entry_id", "baseline_id") for left, right, of in ways])
    return hits.groupBy("entry_id").agg(F.min("baseline_id").alias("baseline_id"))


def dispositions(new: DataFrame, old: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(entry_id, disposition, baseline_id): BLOCKED before EXACT before STRUCTURAL before NEW.

    Entries of blocked rules (keys, any case) never consult the baseline.
    """
    stopped = F.upper(C.rule_key(F.col("rule_id"))).isin([b.upper() for b in blocked]) if blocked else F.lit(False)
    rows = new.withColumn("blocked", F.coalesce(stopped, F.lit(False)))
    asking = rows.where("not blocked").drop("blocked")
    exact = baseline_exact(asking, old).withColumnRenamed("baseline_id", "exact_id")
    near = baseline_structural(asking, old).withColumnRenamed("baseline_id", "near_id")
    joined = rows.select("entry_id", "blocked").join(exact, "entry_id", "left").join(near, "entry_id", "left")
    what = F.when(F.col("blocked"), "BLOCKED").when(F.col("exact_id").isNotNull(), "EXACT").when(F.col("near_id").isNotNull(), "STRUCTURAL").otherwise("NEW")
    return joined.select("entry_id", what.alias("disposition"), F.coalesce("exact_id", "near_id").alias("baseline_id"))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], bin_size: int = 32) -> DataFrame:
    """Rows of left whose interval [lo, hi] meets one of right with the same keys: a semi-join by bins of lines.

    Intervals stand for the bins they touch; a row is kept once however many bins or partners it meets. Right's
    intervals are reduced, per key and bin, to their distinct bounds. Null bounds meet nothing; lo > hi is taken as lo.
    """

    def binned(df: DataFrame, *keep: str) -> DataFrame:
        fixed = df.where("lo is not null and hi is not null").withColumn("hi", F.greatest("lo", "hi"))
        bins = F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))
        return fixed.select(*on, *keep, "lo", "hi", F.explode(bins).alias("bin"))

    b = binned(right).distinct().select(*on, "bin", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    hits = binned(left, "row_id").join(b, [*on, "bin"]).where("lo <= b_hi and b_lo <= hi").select("row_id").distinct()
    return left.join(hits, "row_id", "left_semi")


def resolved_paths(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(wanted_id, known_id, how): exact path, else a known path that ends with the wanted one, else the same file name.

    Both need repository_id and path; the smallest known id wins among equals. The suffix way is an equi-join too: each
    known path stands for all its suffixes, so no nested loop is needed.
    """
    k = known.select("repository_id", "known_id", F.lower(C.normal_path(F.col("path"))).alias("path")).where("path != ''")
    w = wanted.select("repository_id", "wanted_id", F.lower(C.normal_path(F.col("path"))).alias("path")).where("path != ''")
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("path"), F.when(i == 1, 0).otherwise(1).alias("rank")))
    suffixes = k.select("repository_id", "known_id", F.explode(ends).alias("s")).groupBy("repository_id", "s.path", "s.rank").agg(F.min("known_id").alias("known_id"))
    names = k.groupBy("repository_id", F.element_at(parts, -1).alias("name")).agg(F.min("known_id").alias("known_id"))
    by_path = w.join(suffixes, ["repository_id", "path"]).select("wanted_id", "known_id", "rank")
    by_name = w.select("repository_id", "wanted_id", F.element_at(parts, -1).alias("name")).join(names, ["repository_id", "name"]).select("wanted_id", "known_id", F.lit(2).alias("rank"))
    best = by_path.unionByName(by_name).groupBy("wanted_id").agg(F.min(F.struct("rank", "known_id")).alias("m"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("suffix"), F.lit("name")), F.col("m.rank") + 1)
    return best.select("wanted_id", F.col("m.known_id").alias("known_id"), how.alias("how"))


def patch_of(found: DataFrame, patches: DataFrame) -> DataFrame:
    """(finding_id, patch_id, how): the patch of each finding: by its id, else by its rule, else by the end of its path, else the first.

    found has repository_id, finding_id, rule_id and path; patches repository_id, patch_id, finding_ids and rule_ids
    (arrays) and path. Only patches of the finding's repository count, the one of the smallest patch_id among equals;
    findings of repositories without patches give no row. Paths match if one is an end of the other. Every way is an
    equi-join with patches that are aggregated by their key first.
    """
    def lowered(name: str) -> Column:
        return F.lower(C.normal_path(F.col(name)))

    def keyed(key: Column, rank: int) -> DataFrame:
        rows = patches.select("repository_id", "patch_id", key.alias("key")).where("key is not null and key != ''")
        return rows.groupBy("repository_id", "key").agg(F.min("patch_id").alias("patch_id")).withColumn("rank", F.lit(rank))

    def asked(key: Column) -> DataFrame:
        return found.select("repository_id", "finding_id", key.alias("key"))

    ways = (
        (asked(F.col("finding_id").cast("string")), keyed(F.explode("finding_ids"), 0)), (asked(F.lower("rule_id")), keyed(F.explode(F.transform("rule_ids", F.lower)), 1)),
        (asked(F.explode(path_ends(lowered("path")))), keyed(lowered("path"), 2)), (asked(lowered("path")), keyed(F.explode(path_ends(lowered("path"))), 2)), (asked(F.lit("any")), keyed(F.lit("any"), 3)),
    )
    hits = reduce(DataFrame.unionByName, [a.join(b, ["repository_id", "key"]).select("finding_id", "rank", "patch_id") for a, b in ways])
    best = hits.groupBy("finding_id").agg(F.min(F.struct("rank", "patch_id")).alias("m"))
    how = F.element_at(F.array(*map(F.lit, ("id", "rule", "path", "first"))), F.col("m.rank") + 1)
    return best.select("finding_id", F.col("m.patch_id").alias("patch_id"), how.alias("how"))


def references(headers: DataFrame) -> DataFrame:
    """(src, dst): distinct references between a repository's classes, from their imports; src and dst are qualified."""
    own = F.concat_ws(".", "package", "primary_class")
    rows = headers.where("package != '' and primary_class != 'UnknownClass'").select(own.alias("src"), F.explode("imports").alias("dst"))
    return rows.where("src != dst").distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes that refer to each other; both directions become one key, so this is one aggregation."""
    low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    return edges.select(low, high, (F.col("src") < F.col("dst")).alias("up")).groupBy("a", "b").agg(F.max("up").alias("f"), F.min("up").alias("g")).where("f and not g").select("a", "b")


def reachable(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(src, dst, hops): nodes within `depth` steps and their least number; cycles end by keeping the first visit only.

    Each step joins the last frontier with the edges and drops pairs already reached.
    """
    from auditlake.storage import staged

    first = edges.select("src", "dst").distinct()
    frontier = staged(first.withColumn("hops", F.lit(1)), "reach")
    reached = frontier
    for hops in range(2, depth + 1):
        further = frontier.select("src", F.col("dst").alias("mid")).join(first.select(F.col("src").alias("mid"), "dst"), "mid").where("src != dst").select("src", "dst").distinct()
        frontier = staged(further.join(reached, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)), "reach")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def nearest_line(wanted: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
    """(wanted_id, line_no, distance): of the lines with the same keys the one nearest to the expected line, earliest on ties.

    A row's nearest lines are the last one at or before and the first one at or after its expected line: one sort of both
    sides by line within the keys finds them, without pairing a key's rows with each other. Nulls match nothing.
    """
    w = wanted.dropna(subset=[*on, "expected"]).select(*on, F.col("expected").alias("at"), "wanted_id", F.lit(None).cast("int").alias("found"))
    ls = lines.dropna(subset=[*on, "line_no"]).select(*on, F.col("line_no").alias("at"), F.lit(None).cast("long").alias("wanted_id"), F.col("line_no").alias("found")).distinct()
    both = w.unionByName(ls)
    order = Window.partitionBy(*on).orderBy("at", F.col("found").isNull())
    back = Window.partitionBy(*on).orderBy("at", F.col("found").isNotNull())
    before = F.last("found", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("found", ignorenulls=True).over(back.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.select("*", before.alias("p"), after.alias("n")).where("wanted_id is not null and (p is not null or n is not null)")
    pick = F.when(F.col("n").isNull() | (F.col("at") - F.col("p") <= F.col("n") - F.col("at")), F.col("p")).otherwise(F.col("n"))
    return near.select("wanted_id", pick.alias("line_no"), F.abs(F.col("at") - pick).alias("distance"))
