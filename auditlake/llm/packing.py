"""Problem 7: items of varying length into containers of fixed capacity.

A plan depends on the number of items of each length alone, so it is made from the histogram of lengths, which has at
most `capacity` rows whatever the number of items: combinations of lengths with the number of containers that repeat
them. Items then find their place by their rank among the items of their length.

Plan, per kind of container (exact-complement hashing): take the longest length left, add the longest that fits while
the gap is beyond three items, and look the gap up among the single lengths, the sums of pairs and the sums of
triples, which are all indexed. A combination that fills the container exactly is used as often as the counts of its
lengths allow. Lengths for which no filling is found, also not with each other length in second place, go, longest
first, to the container with the smallest gap that holds them.

Ranks come from counts per (length, salt) and a row number inside each, so that a length held by a third of all items
is numbered by many tasks; there is a salt for so many items. Places are joined by blocks of ranks, so no join key holds more than a block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.storage import staged

#: Salts at least, and items for one; ranks of a block; used up lengths and failed searches after which sums are indexed anew.
SALTS, SALTED = 64, 500_000
BLOCK = 64
REINDEX, STALE = 512, 32


class _Lengths:
    """Counts of the lengths still to be placed, with bit sets of the single lengths and of the sums of pairs and triples.

    Lengths that are used up leave the sets of pairs and triples only when these are made anew, so a sum that is not in
    a set does not exist; one that is in it is looked for among the counts.
    """

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.left[size] += n
        self.singles = 0
        for size in np.flatnonzero(self.left):
            self.singles |= 1 << int(size)
        self._index()

    def _index(self) -> None:
        self.pairs, self.triples, self.changed, mask = 0, 0, 0, (1 << (self.capacity + 1)) - 1
        sizes = [int(size) for size in np.flatnonzero(self.left)]
        for size in sizes:
            self.pairs |= self.singles << size
        self.pairs &= mask
        for size in sizes:
            self.triples |= self.pairs << size
        self.triples &= mask

    def take(self, used: Counter, times: int) -> None:
        for size, n in used.items():
            self.left[size] -= n * times
            if not self.left[size]:
                self.singles &= ~(1 << size)
                self.changed += 1
        if self.changed > REINDEX:
            self._index()

    def descending(self, most: int) -> Iterator[int]:
        """The lengths left of at most `most`, longest first."""
        bits = self.singles & ((1 << (most + 1)) - 1) if most > 0 else 0
        while bits:
            size = bits.bit_length() - 1
            yield size
            bits ^= 1 << size

    def largest(self, most: int, used: Counter) -> int:
        """The longest length of at most `most` of which one is left; 0 if there is none."""
        return next((size for size in self.descending(most) if self.left[size] > used[size]), 0)

    def _pair(self, gap: int, used: Counter) -> tuple[int, ...]:
        half = gap // 2
        low = np.arange(1, half + 1)
        for a in low[(self.left[1 : half + 1] > 0) & (self.left[gap - half : gap][::-1] > 0)]:
            a = int(a)
            want = Counter((a, gap - a))
            if all(self.left[s] >= used[s] + n for s, n in want.items()):
                return a, gap - a
        return ()

    def complement(self, gap: int, used: Counter) -> tuple[int, ...]:
        """Up to three lengths that fill the gap exactly; () if there are none."""
        if self.left[gap] > used[gap]:
            return (gap,)
        if self.pairs >> gap & 1 and (two := self._pair(gap, used)):
            return two
        if not self.triples >> gap & 1:
            return ()
        failed = 0
        for size in self.descending(gap - 2):
            if self.pairs >> (gap - size) & 1 and self.left[size] > used[size]:
                more = used.copy()
                more[size] += 1
                if two := self._pair(gap - size, more):
                    return (size, *two)
                failed += 1
                if failed == STALE and self.changed:  # sums of used up lengths
                    self._index()
        return ()

    def filling(self, first: int) -> Counter:
        """Lengths that with `first` fill a container exactly; empty if none are found.

        The longest lengths that fit are added while the gap is beyond three of them, with its complement looked up at
        every step; where that way ends with a gap, each length left is tried in second place with a complement of its own.
        """
        used, gap = Counter((first,)), self.capacity - first
        while gap:
            size = self.largest(gap, used)
            if not size:
                break
            if gap <= 3 * size and (more := self.complement(gap, used)):
                return used + Counter(more)
            used[size] += 1
            gap -= size
        if not gap:
            return used
        gap = self.capacity - first
        sums = self.singles | self.pairs | self.triples
        for size in self.descending(gap - 1):
            used = Counter((first, size))
            if sums >> (gap - size) & 1 and self.left[size] >= used[size] and (more := self.complement(gap - size, used)):
                return used + Counter(more)
        return Counter()


def plan(capacity: int, counts: dict[int, int]) -> list[tuple[list[int], int]]:
    """Combinations of lengths (1 to capacity) and how many containers repeat each; all items are placed."""
    lengths = _Lengths(capacity, counts)
    plans: list[tuple[list[int], int]] = []
    rest: Counter = Counter()
    while first := lengths.largest(capacity, Counter()):
        used = lengths.filling(first)
        if used:
            times = min(int(lengths.left[s]) // n for s, n in used.items())
            plans.append((list(used.elements()), times))
            lengths.take(used, times)
        else:
            rest[first] += int(lengths.left[first])
            lengths.take(Counter((first,)), int(lengths.left[first]))
    return plans + _best_fit(capacity, rest)


def _best_fit(capacity: int, rest: Counter) -> list[tuple[list[int], int]]:
    """Longest first into the smallest gap that holds it; equal containers are kept once, with their number."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps = 0
    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            fits = gaps >> size
            if not fits:
                each = capacity // size
                whole, left = divmod(n, each)
                for held, times in ((each, whole), (left, bool(left))):
                    if held and times:
                        gap = capacity - held * size
                        open_[gap].append(((size,) * held, int(times)))
                        gaps |= 1 << gap
                break
            gap = size + (fits & -fits).bit_length() - 1
            items, times = open_[gap].pop()
            used = min(n, times)
            if times > used:
                open_[gap].append((items, times - used))
            if not open_[gap]:
                gaps &= ~(1 << gap)
            open_[gap - size].append(((*items, size), used))
            gaps |= 1 << (gap - size)
            n -= used
    return [(list(items), times) for entries in open_.values() for items, times in entries]


def _places(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The places of one kind of container: ranks first..first+times-1 of a length, one in each of `times` containers."""
    kind, capacity = keys
    counts = dict(zip(frame["size"].astype(int), frame["n"].astype(int)))
    rows, taken = [], Counter()
    for number, (items, times) in enumerate(plan(int(capacity), counts)):
        for size in items:
            rows.append((kind, size, taken[size], times, number, sum(items)))
            taken[size] += times
    return pd.DataFrame(rows, columns=["container_kind", "size", "first", "times", "pattern", "used"])


def packed(sizes: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container_kind, container_id, capacity, used, doc_id, piece_no, tokens): a packing of all items for each kind.

    sizes has one row per item; limits has container_kind and capacity_tokens (kinds with a null or no positive
    capacity are left out). Each kind's containers hold every item once. Items longer than the capacity are cut into
    pieces of the capacity, which fill containers of their own, and a rest that is packed like an item. Items of null
    or no size need no space: they are put one by one into the kind's containers of whole items, in turn, or,
    where there are none, into one empty container. Ties and repeated rows are items like any other.
    """
    kinds = limits.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    salts = max(SALTS, sizes.count() // SALTED)
    items = sizes.select(F.col(key).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    )
    each = items.withColumn("kind", F.explode(_kind_list(kinds))).select(
        "doc_id", "n", "salt", "kind.*", F.floor(F.col("n") / F.col("kind.capacity")).cast("long").alias("whole"), (F.col("n") % F.col("kind.capacity")).alias("size")
    )
    again = F.row_number().over(Window.partitionBy("container_kind", "doc_id").orderBy("n"))
    full = each.where("whole > 0").withColumn("nth", again).select(
        "container_kind", "capacity", "doc_id", "nth", F.explode(F.sequence(F.lit(1).cast("long"), "whole")).alias("piece_no")
    ).select(
        "container_kind", F.concat_ws("-", "container_kind", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string"), F.when(F.col("nth") > 1, F.col("nth").cast("string"))).alias("container_id"),
        "capacity", F.col("capacity").alias("used"), "doc_id", F.col("piece_no").cast("int"), F.col("capacity").alias("tokens"),
    )
    parts = each.where("size > 0 or n = 0")
    counts = parts.groupBy("container_kind", "capacity", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "p7-counts")
    per_size = Window.partitionBy("container_kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("container_kind", "size", "salt", F.coalesce(F.sum("n").over(per_size), F.lit(0)).alias("before"))
    places = (
        counts.where("size > 0").groupBy("container_kind", "capacity", "size").agg(F.sum("n").alias("n"))
        .groupBy("container_kind", "capacity")
        .applyInPandas(_places, "container_kind string, size long, first long, times long, pattern long, used long")
    )
    places = staged(places, "p7-places")
    ranked = (
        parts.withColumn("at", F.row_number().over(Window.partitionBy("container_kind", "size", "salt").orderBy("doc_id")) - 1)
        .join(offsets, ["container_kind", "size", "salt"])
        .select("container_kind", "capacity", "doc_id", "whole", "size", (F.col("before") + F.col("at")).alias("rank"))
    )
    by_block = places.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("times") - 1) / BLOCK)))
    )
    inside = (
        ranked.where("size > 0").withColumn("block", F.floor(F.col("rank") / BLOCK)).join(by_block, ["container_kind", "size", "block"])
        .where("rank >= first and rank < first + times")
        .select("container_kind", _container("pattern", F.col("rank") - F.col("first")), "capacity", "used", "doc_id", (F.col("whole") + 1).cast("int").alias("piece_no"), F.col("size").alias("tokens"))
    )
    return full.unionByName(inside).unionByName(_without_size(ranked, places, kinds))


def _kind_list(kinds: DataFrame, most: int = 1000) -> F.Column:
    """The kinds of container as a literal: the limits are a handful of settings, checked to be no more than `most`."""
    rows = kinds.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of container")
    if not rows:
        return F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    return F.array(*[F.struct(F.lit(r[0]).alias("container_kind"), F.lit(r[1]).cast("long").alias("capacity")) for r in rows])


def _container(pattern: str, number) -> F.Column:
    return F.concat_ws("-", "container_kind", F.col(pattern).cast("string"), number.cast("string")).alias("container_id")


def _without_size(ranked: DataFrame, places: DataFrame, kinds: DataFrame) -> DataFrame:
    """Items that need no space, in turn into the containers that repeat the kind's most frequent combination."""
    most = places.groupBy("container_kind").agg(F.max_by(F.struct("pattern", "times", "used"), F.struct("times", -F.col("pattern"))).alias("m"))
    home = kinds.join(most, "container_kind", "left").select(
        "container_kind", F.coalesce("m.pattern", F.lit(0)).alias("pattern"), F.coalesce("m.times", F.lit(1)).alias("times"), F.coalesce("m.used", F.lit(0)).alias("used")
    )
    return ranked.where("size = 0 and whole = 0").join(F.broadcast(home), "container_kind").select(
        "container_kind", _container("pattern", F.pmod(F.col("rank"), F.col("times"))), "capacity", "used", "doc_id",
        F.lit(1).alias("piece_no"), F.col("size").alias("tokens"),
    )


def container_fill(rows: DataFrame) -> DataFrame:
    """(container_kind, containers, items, used_tokens, unused_tokens, unused_share) of a packing, by kind."""
    one = rows.groupBy("container_kind", "container_id").agg(F.max("capacity").alias("capacity"), F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return one.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used_tokens"),
        F.sum(F.col("capacity") - F.col("used")).alias("unused_tokens"), (F.sum(F.col("capacity") - F.col("used")) / F.sum("capacity")).alias("unused_share"),
    )
