"""Problem 4: records that are equal but for white space, letter case, punctuation and order of fields.

Each record becomes one canonical text. Tasks first count equal texts among their own rows, so that a group of copies
reaches the shuffle as a few rows, however many copies it has. These counts are partitioned by leading bytes of the
canonical text; buckets that hold too many are split by further bytes, again and again, until each fits. Each bucket is
counted in a trie whose terminals hold the number of copies and the smallest record. Records find their group by a
join; groups that hold at least a thousandth of all records (at most a thousand of them) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.storage import staged

#: Characters that no canonical text contains: between fields, entries, names and values, and for null.
FIELD, ENTRY, VALUE, NULL = "\x01", "\x02", "\x03", "\x04"
HOT_SHARE = 1000
#: Characters of different texts that a task counts at once.
HELD = 32_000_000


def bare(text: Column) -> Column:
    """Letters and digits of a text in lower case, sharp s as its capitals SS; null stays null."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def canonical(fingerprint: Column, snippet: Column, fields: Column) -> Column:
    """One text that agrees for exactly the records that are the same; fields is a flat JSON object as text.

    Field names and values are bare, sorted by name; a number is its digits; a field that is null differs from an empty
    one. Text that is no JSON object is taken as a whole.
    """
    entries = F.map_entries(F.from_json(fields, "map<string,string>"))
    pairs = F.transform(entries, lambda e: F.concat(bare(e["key"]), F.lit(VALUE), F.coalesce(bare(e["value"]), F.lit(NULL))))
    parsed = F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ENTRY))
    parts = [bare(fingerprint), bare(snippet), F.when(fields.isNotNull(), F.coalesce(parsed, bare(fields)))]
    return F.concat_ws(FIELD, *[F.coalesce(x, F.lit(NULL)) for x in parts])


class CountingTrie:
    """A byte trie with joined single-child paths; terminals hold the number of copies and the smallest id."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [None, {}]  # terminal, edges: first byte -> [label, node]

    def add(self, key: bytes, smallest: int, copies: int) -> None:
        node, at, size = self.root, 0, len(key)
        while at < size:
            edge = node[1].get(key[at])
            if edge is None:
                leaf: list = [None, {}]
                node[1][key[at]] = [key[at:], leaf]
                node = leaf
                break
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            n, most = 1, min(len(label), size - at)
            while n < most and label[n] == key[at + n]:
                n += 1
            middle: list = [None, {label[n]: [label[n:], edge[1]]}]
            edge[0], edge[1] = label[:n], middle
            node, at = middle, at + n
        held = node[0]
        node[0] = (smallest, copies) if held is None else (min(held[0], smallest), held[1] + copies)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, (held, edges) = stack.pop()
            if held is not None:
                yield prefix, *held
            stack += [(prefix + label, node) for label, node in edges.values()]


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts equal texts among all rows of a task; counts are handed on when their texts exceed HELD characters."""
    counts: dict[str, list[int]] = {}
    held = 0

    def counted() -> pd.DataFrame:
        return pd.DataFrame([(canon, *c) for canon, c in counts.items()], columns=["canon", "first_id", "copies"])

    for frame in batches:
        for canon, i in zip(frame["canon"], frame["id"]):
            count = counts.get(canon)
            if count is None:
                counts[canon] = [i, 1]
                held += len(canon)
            else:
                count[0] = min(count[0], i)
                count[1] += 1
        if held > HELD:
            yield counted()
            counts.clear()
            held = 0
    yield counted()


def _count_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    trie = CountingTrie()
    for key, first, copies in zip(frame["canon"], frame["first_id"], frame["copies"]):
        trie.add(key.encode(), int(first), int(copies))
    rows = [(key.decode(), first, copies) for key, first, copies in trie.items()]
    return pd.DataFrame(rows, columns=["canon", "first_id", "copies"])


def radix_buckets(counted: DataFrame, fits: int = 50_000, step: int = 2) -> DataFrame:
    """counted with a column bucket: the leading bytes of canon, as many as leave at most `fits` rows in a bucket.

    Rows of one text cannot be told apart by further bytes: once a bucket's bytes end, it stays as it is.
    """
    depth, done, active = step, None, counted.withColumn("bytes", F.encode("canon", "utf-8"))
    while True:
        prefix = F.concat(F.lit(f"{depth}:"), F.hex(F.substring("bytes", 1, depth)))
        labelled = active.withColumn("bucket", prefix)
        large = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("bytes")).alias("longest"))
        large = staged(large.where((F.col("n") > fits) & (F.col("longest") > depth)).select("bucket"), "p4-large")
        if large.isEmpty():
            return (done.unionByName(labelled) if done is not None else labelled).drop("bytes")
        part = labelled.join(large, "bucket", "left_anti")
        done = part if done is None else done.unionByName(part)
        active = staged(labelled.join(large, "bucket", "left_semi").drop("bucket"), "p4-active")
        depth *= 2


def grouped(records: DataFrame, fits: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The records as (id, canon), and their groups as (canon, first_id, copies)."""
    rows = records.where("record_id is not null").select(F.col("record_id").alias("id"), canonical(F.col("fingerprint"), F.col("snippet"), F.col("fields_json")).alias("canon"))
    rows = staged(rows, "p4-canon")
    counted = staged(rows.mapInPandas(_combine, "canon string, first_id bigint, copies bigint"), "p4-counted")
    groups = radix_buckets(counted, fits).groupBy("bucket").applyInPandas(_count_bucket, "canon string, first_id bigint, copies bigint")
    return rows, staged(groups, "p4-groups")


def kept(records: DataFrame, fits: int = 50_000) -> DataFrame:
    """(record_id, copies): the smallest record of each group and how many records the group has."""
    return grouped(records, fits)[1].select(F.col("first_id").alias("record_id"), "copies")


def copies(records: DataFrame, fits: int = 50_000) -> DataFrame:
    """(first_record_id, record_id): each record that is not the smallest of its group, with the smallest.

    records needs record_id (unique), fingerprint, snippet and fields_json. Nulls equal nulls only; empty texts equal
    texts of punctuation alone. Rows with a null record_id are left out; an empty table gives no rows.
    """
    rows, groups = grouped(records, fits)
    many = groups.where("copies > 1").withColumn("key", F.sha2("canon", 256)).select("key", "first_id", "copies")
    total = rows.count()
    hot = many.where(F.col("copies") * HOT_SHARE >= total).select("key", F.col("first_id").alias("hot_id"))
    keyed = rows.select("id", F.sha2("canon", 256).alias("key"))
    # At most HOT_SHARE groups can hold a share of 1 / HOT_SHARE each, so this side is bounded whatever the input.
    split = keyed.join(F.broadcast(hot), "key", "left")
    of_hot = split.where("hot_id is not null").select(F.col("hot_id").alias("first_record_id"), F.col("id").alias("record_id"))
    rest = split.where("hot_id is null").select("id", "key").join(many.where(F.col("copies") * HOT_SHARE < total), "key")
    of_rest = rest.select(F.col("first_id").alias("first_record_id"), F.col("id").alias("record_id"))
    return of_hot.unionByName(of_rest).where("first_record_id < record_id")
