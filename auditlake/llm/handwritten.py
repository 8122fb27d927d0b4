"""Problem 1: files that nobody in the repository wrote by hand.

Each file is reduced to layout statistics (line lengths, share of white space and of letters and digits, density of
number literals, share of long encoded runs, and how far its lines repeat one pattern of shapes), compared with
thresholds of its language. Copies of third-party files show no odd layout; they are found by their licence notice, by
their package's name space, or because the same lines stand under the same file name in other repositories. For that,
the same scan gives a number for each different line of a file; every line is counted once per (file name, line), as the
smallest and largest repository that holds it, so that a frequent line is two values and no list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.storage import spread, staged

#: Languages by file extension.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "py": "python", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
}

#: Thresholds by language, in the middle of the gap between files with and without the property: least mean length of lines
#: and most white space of compressed code; least share of encoded runs, least share of letters and digits and least share
#: of number literals among the words, of data; least share of repeating lines and number of repeats of generated code.
THRESHOLDS = {
    "java": (110, 0.05, 0.45, 0.88, 0.48, 0.69, 5),
    "kotlin": (105, 0.07, 0.40, 0.87, 0.54, 0.74, 5),
    "python": (105, 0.045, 0.42, 0.90, 0.53, 0.79, 5),
    "javascript": (96, 0.065, 0.45, 0.87, 0.52, 0.78, 5),
    "typescript": (130, 0.055, 0.40, 0.87, 0.55, 0.70, 5),
}
#: With a generator's notice in a comment, lines need repeat no more than this.
NOTICED = 0.45
COPIED_SHARE = 0.5
#: A line that holds more than one of so many places of lines is joined by broadcast: there are at most so many of them.
HOT_SHARE = 1000

#: A generator's notice, in the words of several languages, and the words that take it back.
NOTICE = re.compile(
    r"(?i)\bauto-?generated\b|@generated|\bgenerated (?:by|from|with|using|file)|\bcode generated\b|do not (?:edit|modify|touch)|"
    r"will be (?:overwritten|lost)|nicht bearbeiten|nicht ändern|\bgeneriert\b|no (?:editar|modificar)|\bgenerado (?:por|con|desde)|ne pas modifier|généré par"
)
RETRACTED = re.compile(r"(?i)\bnot (?:auto-?)?generated|generated once|by hand since|hand-kept|any more|edit freely|writes? the|no longer")
GENERATED_CODE = re.compile(r"^\s*(?:@(?:[\w.]*\.)?Generated\b|__generated__\s*=)", re.M)
LICENCE = re.compile(
    r"(?i)^\s*(?:/\*!?|\*|//|#|<!--)?\s*(?:copyright \(c\) [\d, -]+ the [\w.-]+ (?:contributors|authors|developers)|"
    r"part of [\w.-]+ - |[\w.-]+ is (?:open|free) software|[\w.-]+, released under|released under the|free to use, copy|"
    r"licensed under the (?:mit|apache|bsd)|permission is hereby granted)"
)
COMMENT_LINES = re.compile(r"^[ \t]*(?://|#|/\*|\*|<!--).*$", re.M)
#: Parts of words without which a comment holds neither notice.
HINT = re.compile(r"(?i)g.n.r|edit|modif|touch|overwr|lost|bearb|ndern")
LICENCE_HINT = re.compile(r"(?i)copyright|licen|part of|software|released|permission|copy")
ENCODED = re.compile(rb"[A-Za-z0-9+/=_-]{40,}")
PACKAGE = re.compile(r"^[ \t]*package[ \t]+([\w.]+)", re.M)
LINE_END = re.compile(r"\r\n|\r|\n")
_RUNS = re.compile(rb"[w0]+")
_NUMBERS = re.compile(rb"(?<![w0])0[w0]*")
_BLANK = b" \t\r\n\f\v"
_ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_SHAPES = bytes.maketrans(_ALNUM + b"_$", b"0" * 10 + b"w" * (len(_ALNUM) - 8))
_COMMENTS = (b"//", b"#", b"/*", b"*", b"<!--")


def repetition(shapes: list[bytes]) -> tuple[float, int]:
    """How far shapes repeat with one period: the share that equal the one a period before, and the repeats.

    Periods of up to twelve lines are all tried, and longer ones, up to a third of the lines, at which one to three lines
    in a row come again for at least a twentieth of the lines.
    """
    codes: dict[bytes, int] = {}
    row = np.array([codes.setdefault(x, len(codes)) for x in shapes], np.int64)
    n, best = len(row), (0.0, 0)
    periods = set(range(1, min(12, n // 3) + 1))
    if n // 3 > 12:
        runs = row
        for more in range(3):
            if more:
                runs = np.unique(runs[:-1] * (len(codes) + 1) + row[more:], return_inverse=True)[1]
            order = np.argsort(runs, kind="stable")
            gaps = np.diff(order)[runs[order[1:]] == runs[order[:-1]]]
            often = np.bincount(gaps[gaps <= n // 3], minlength=1)
            periods.update(np.flatnonzero(often * 20 >= n).tolist())
    for period in sorted(periods):
        best = max(best, (float(np.count_nonzero(row[period:] == row[:-period])) / (n - period), n // period))
    return best


def statistics(text: str) -> dict:
    """The layout statistics of a text."""
    raw = text.encode("utf-8")
    kinds = raw.translate(_SHAPES)
    shapes = [x for x in (line.strip() for line in _RUNS.sub(b"w", kinds).splitlines()) if x]
    sizes = [len(line) for line in raw.splitlines() if not line.isspace() and line]
    share, repeats = repetition([x for x in shapes if not x.startswith(_COMMENTS)])
    comments = COMMENT_LINES.findall(text)
    notes = [c for c in comments if HINT.search(c)]
    package = PACKAGE.search(text)
    return {
        "max_line": max(sizes, default=0),
        "mean_line": sum(sizes) / max(1, len(sizes)),
        "space_share": 1 - len(raw.translate(None, _BLANK)) / max(1, len(raw)),
        "alnum_share": 1 - len(raw.translate(None, _ALNUM)) / max(1, len(raw)),
        "number_share": len(_NUMBERS.findall(kinds)) / max(1, len(_RUNS.findall(kinds))),
        "encoded_share": sum(map(len, ENCODED.findall(raw))) / max(1, len(raw)),
        "repeat_share": share,
        "repeats": repeats,
        "noticed": bool(GENERATED_CODE.search(text)) or any(NOTICE.search(c) and not RETRACTED.search(c) for c in notes),
        "licensed": any(LICENCE.search(c) for c in comments if LICENCE_HINT.search(c)),
        "package": package.group(1) if package else None,
    }


def distinct_lines(text: str, name: str) -> tuple[list[int], list[int]]:
    """A number for each different line of a file of that name, without white space, and its length."""
    lines = dict.fromkeys("".join(line.split()) for line in LINE_END.split(text))
    lines.pop("", None)
    prefix = name + "\0"
    return [xxhash.xxh64_intdigest(prefix + line) - (1 << 63) for line in lines], [len(line) for line in lines]


STATISTICS = (
    "max_line int, mean_line double, space_share double, alnum_share double, number_share double, encoded_share double, "
    "repeat_share double, repeats int, noticed boolean, licensed boolean, package string"
)
LINES = "lines array<bigint>, sizes array<int>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), *[pa.float64()] * 6, pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    for batch in batches:
        texts = batch.column("raw_source").to_pylist()
        found = [statistics(text) for text in texts]
        columns = [pa.array([f[name] for f in found], kind) for name, kind in zip(names, kinds)]
        each = [distinct_lines(text, name or "") for text, name in zip(texts, batch.column("stem").to_pylist())]
        columns += [pa.array([e[0] for e in each], pa.list_(pa.int64())), pa.array([e[1] for e in each], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, [*batch.schema.names[:-1], *names, "lines", "sizes"])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.translate(path, "\\", "/"), r"\.([A-Za-z0-9]+)\s*$", 1))


def language(path: Column) -> Column:
    """The language that a path's extension stands for; null for others."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def stem(path: Column) -> Column:
    """A file's name without extension, case and separators."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*?)(?:\.[A-Za-z0-9]+)?\s*$", 1)
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def measured(sources: DataFrame) -> DataFrame:
    """(source_id, repository_id, stem, language, statistics, lines, sizes) of all files that have text, in one scan of it."""
    rows = sources.where(F.col("raw_source").rlike(r"\S")).select(
        "source_id", "repository_id", stem(F.col("file_path")).alias("stem"), language(F.col("file_path")).alias("language"), "raw_source"
    )
    kind = f"source_id {sources.schema['source_id'].dataType.simpleString()}, repository_id string, stem string, language string"
    return spread(rows).mapInArrow(_measure, f"{kind}, {STATISTICS}, {LINES}")


def copied_share(facts: DataFrame) -> DataFrame:
    """(source_id, copied): the share of a file's text in lines that files of that name in other repositories hold as well.

    facts are measured() files. Names of one repository alone are left out first; files of null paths have no name.
    Lines are counted with partial aggregates, and the few that very many files hold are joined by broadcast.
    """
    rows = facts.where("stem is not null").select("source_id", "stem", F.when(F.col("repository_id").isNotNull(), F.xxhash64("repository_id")).alias("repository"), "lines", "sizes")
    across = rows.groupBy("stem").agg(F.min("repository").alias("a"), F.max("repository").alias("b")).where("a != b").select("stem")
    some = rows.join(across, "stem", "left_semi")
    each = some.select("source_id", "repository", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("source_id", "repository", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    counts = each.groupBy("line").agg(F.min("repository").alias("a"), F.max("repository").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = staged(counts.where("a != b").select("line", "n"), "p1-shared")
    places = facts.agg(F.sum(F.size("lines"))).first()[0] or 0
    # At most HOT_SHARE lines can hold a share of 1 / HOT_SHARE of all places each, so this side is bounded whatever the input.
    hot = F.broadcast(shared.where(F.col("n") * HOT_SHARE > places).select("line"))
    common = each.join(hot, "line", "left_semi")
    rest = each.join(hot, "line", "left_anti").join(shared.where(F.col("n") * HOT_SHARE <= places).select("line"), "line", "left_semi")
    held = common.unionByName(rest).groupBy("source_id").agg(F.sum("size").alias("held"))
    whole = facts.groupBy("source_id").agg(F.max(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("whole"), F.count(F.lit(1)).alias("rows"))
    return whole.join(held, "source_id").select("source_id", (F.col("held") / F.col("rows") / F.col("whole")).alias("copied"))


def _threshold(at: int) -> Column:
    pairs = [F.lit(x) for name, values in THRESHOLDS.items() for x in (name, float(values[at]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("language")), F.lit(float(THRESHOLDS["javascript"][at])))


def kinds(sources: DataFrame, repositories: DataFrame) -> DataFrame:
    """(source_id, kind, by_layout) of every file with text: generated, minified, data, vendored or handwritten.

    by_layout tells whether the statistics of its layout alone say that nobody wrote it.

    sources needs source_id, repository_id, file_path and raw_source; repositories repository_id and repo_name, whose
    first part names the owner: a package of another root than any owner's is foreign. A file of several kinds counts
    as the first of data, minified, generated, vendored. Null and blank texts give no row; a null path is of no
    language and takes the thresholds of JavaScript; repeated inspections count row by row.
    """
    owners = repositories.select(F.lower(F.split("repo_name", "/")[0]).alias("owner")).where("owner is not null").distinct()
    facts = staged(measured(sources), "p1-facts")
    named = facts.where("package is not null").withColumn("parts", F.split(F.lower("package"), r"\."))
    own = (
        named.select("source_id", F.explode(F.slice("parts", 1, 2)).alias("owner"))
        .join(owners, "owner", "left_semi").select("source_id", F.lit(True).alias("own")).distinct()
    )
    every = facts.join(own, "source_id", "left").join(copied_share(facts), "source_id", "left")
    foreign = F.col("package").rlike(r"^\w+\.\w+") & F.col("own").isNull()
    minified = (F.col("mean_line") >= _threshold(0)) & (F.col("max_line") >= 1.2 * _threshold(0)) & (F.col("space_share") <= _threshold(1))
    data = (F.col("encoded_share") >= _threshold(2)) | (F.col("alnum_share") >= _threshold(3)) | (F.col("number_share") >= _threshold(4))
    repeating = (F.col("repeat_share") >= _threshold(5)) & (F.col("repeats") >= _threshold(6))
    generated = repeating | (F.col("noticed") & (F.col("repeat_share") >= NOTICED))
    vendored = (F.col("copied") >= COPIED_SHARE) | (F.col("licensed") & F.col("own").isNull()) | foreign
    kind = F.when(data, "data").when(minified, "minified").when(generated, "generated").when(vendored, "vendored").otherwise("handwritten")
    layout = data | minified | repeating
    return every.select("source_id", "repository_id", "language", "copied", *[x.split()[0] for x in STATISTICS.split(", ")], kind.alias("kind"), layout.alias("by_layout"))


def not_handwritten(sources: DataFrame, repositories: DataFrame) -> DataFrame:
    """(source_id): the files that nobody in the repository wrote by hand."""
    return kinds(sources, repositories).where("kind != 'handwritten'").select("source_id")
