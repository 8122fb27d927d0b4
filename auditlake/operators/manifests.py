"""Dependencies in manifests, and advisories on their versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C

_NAME, _VERSION = r"[A-Za-z0-9][A-Za-z0-9._-]*", r"[0-9]+(?:\.[0-9]+)*"
#: By file name: a pattern of an entry with the name and the version as groups. Versions of ranges are their lowest.
FORMATS = (
    ("requirements.txt", rf"(?m)^[ \t]*({_NAME})(?:\[[^\]]*\])?[ \t]*(?:===?|~=|>=)[ \t]*({_VERSION})"),
    ("poetry.lock", rf'(?m)^name\s*=\s*"({_NAME})"\s*^version\s*=\s*"({_VERSION})'),
    ("pipfile", rf'(?m)^[ \t]*"?({_NAME})"?[ \t]*=[ \t]*(?:\{{[^}}\n]*version[ \t]*=[ \t]*)?"[=~^><]*[ \t]*({_VERSION})'),
    ("pyproject.toml", rf'(?m)^[ \t]*(?:"({_NAME})(?:\[[^\]]*\])?[ \t]*(?:===?|~=|>=)[ \t]*({_VERSION})[^"]*"|({_NAME})[ \t]*=[ \t]*(?:\{{[^}}\n]*version[ \t]*=[ \t]*)?"[=~^><]*[ \t]*({_VERSION})[^"]*")'),
)
#: Names of a project file that are settings and no dependencies.
SETTINGS = ("python", "version", "requires-python", "target-version", "line-length", "python_version", "python_full_version")


def dependencies(files: DataFrame) -> DataFrame:
    """(file_path, component, version): the dependencies with a version in requirements.txt, pyproject.toml, poetry.lock and Pipfile.

    files has file_path and text. Names are in lower case with - for _ and dots; of several versions an entry names the
    first counts. Comments, entries without a version, other files, null and empty texts give no rows.
    """
    name, text = F.lower(C.file_of(F.col("file_path"))), F.regexp_replace("text", r"(?m)(?:^|\s)#.*$", "")
    entries = F.array().cast("array<struct<component:string,version:string>>")
    for file, pattern in reversed(FORMATS):
        pairs = [(1, 2), (3, 4)] if file == "pyproject.toml" else [(1, 2)]
        found = [F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(a)).alias("component"), F.regexp_extract_all(text, F.lit(pattern), F.lit(b)).alias("version")) for a, b in pairs]
        named = [F.transform(x, lambda e: F.struct(e["component"].alias("component"), e["version"].alias("version"))) for x in found]
        entries = F.when(name == file, F.concat(*named)).otherwise(entries)
    rows = files.where("text is not null").select("file_path", F.explode(entries).alias("e")).where("e.component != ''")
    return rows.select("file_path", F.regexp_replace(F.lower("e.component"), r"[_.]", "-").alias("component"), F.col("e.version").alias("version")).where(~F.col("component").isin(*SETTINGS)).distinct()


def numbers(version: Column) -> Column:
    """A version's numbers, without zeros at the end, to be compared from the left."""
    return F.transform(F.split(F.regexp_replace(version, r"(?:\.0+)+$", ""), r"\."), lambda x: x.try_cast("int"))


def affected(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """found with fixed and affected: rows (component, version) with an advisory (component, fixed): the first version that is not affected.

    A component with several advisories has a row for each. Null versions are of unknown effect: null.
    """
    return found.join(advisories, "component").withColumn("affected", numbers(F.col("version")) < numbers(F.col("fixed")))
