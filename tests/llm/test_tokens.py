import base64
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from auditlake.llm import packing as P
from auditlake.llm import tokens as T
from auditlake.llm.bpe import BpeTransducer, Utf8Machine, read_ranks

PATH = os.path.join(T.TOKENIZERS, T.VOCABULARY)


@pytest.fixture(scope="module")
def machine():
    with open(PATH, "rb") as file:
        return BpeTransducer(read_ranks(file.read()))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _random(n):
    r = random.Random(7)
    for i in range(n):
        k = i % 4
        if k == 0:
            yield "".join(r.choice("aA bé字\n\t'0'9_-= \x1c\x85  ") for _ in range(r.randint(1, 40)))
        elif k == 1:
            yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(20))
        elif k == 2:
            yield "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 60)))
        else:
            yield "<|endoftext|> I'll don't " + "ab" * r.randint(0, 30) + " " * r.randint(0, 9)


def test_ids_equal_the_library(machine, library):
    for text in _random(4000):
        assert machine.encode(text) == library.encode_ordinary(text), repr(text)
    long = "x" * 3000 + "-" * 2000 + "\n" * 500
    assert machine.encode(long) == library.encode_ordinary(long)


def test_bounded_states_change_nothing(library):
    with open(PATH, "rb") as file:
        small = BpeTransducer(read_ranks(file.read()), max_states=50, max_chars=60)
    for text in _random(300):
        assert small.encode(text) == library.encode_ordinary(text)
    assert len(small.words) <= 22


def test_incremental_utf8():
    r = random.Random(3)
    for _ in range(500):
        raw = "".join(chr(r.choice([65, 0xE9, 0x5B57, 0x1F600])) for _ in range(9)).encode()
        if r.random() < 0.5:
            raw = bytes(r.choice([b ^ r.randrange(256), b, b]) for b in raw)
        m, out, at = Utf8Machine(), "", 0
        while at < len(raw):
            n = r.randint(1, 4)
            out += m.feed(raw[at : at + n])
            at += n
        assert out + m.close() == raw.decode("utf-8", "replace")


def test_tables(spark, machine):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (4, "é 字\n" * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = sorted((r.doc_id, list(r.ids)) for r in T.token_ids(df).collect())
    assert ids == sorted((a, machine.encode(t)) for a, t, _ in rows) and (2, []) in ids and (3, []) in ids
    back = {r.doc_id: r.text for r in T.decoded(T.token_ids(df)).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "é 字\n" * 3000}
    assert all(r.same for r in T.round_trip(df).collect())
    assert T.token_ids(df.limit(0)).count() == 0


def _check(rows, sizes, capacity):
    used, pieces = Counter(), defaultdict(list)
    for r in rows:
        used[r.container_id] += r.tokens
        pieces[r.doc_id].append((r.piece_no, r.tokens))
        assert r.capacity == capacity
    assert max(used.values(), default=0) <= capacity
    for r in rows:
        assert r.used == used[r.container_id]
    assert set(pieces) == set(sizes)
    for doc, n in sizes.items():
        parts = sorted(pieces[doc])
        assert [p for p, _ in parts] == list(range(1, len(parts) + 1)) and sum(t for _, t in parts) == max(0, n or 0)
        assert len(parts) == 1 or (n > capacity and all(t == capacity for _, t in parts[:-1]))
    return len(used), sum(used.values())


def test_packing(spark):
    r = random.Random(2)
    sizes = {i: r.choice([r.randint(1, 40), r.randint(1, 700), 77, 77, 77]) for i in range(1500)} | {9001: 0, 9002: None, 9003: 100, 9004: 1234, 9005: 200}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id long, n_tokens long, container_kind string")
    limits = spark.createDataFrame([("a", 100), ("b", 512), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = P.packed(df, limits).collect()
    assert {x.container_kind for x in rows} == {"a", "b"}
    for kind, capacity in (("a", 100), ("b", 512)):
        n, total = _check([x for x in rows if x.container_kind == kind], sizes, capacity)
        assert n <= 1.12 * -(-total // capacity)
    fill = {x.container_kind: x for x in P.container_fill(P.packed(df, limits)).collect()}
    assert fill["b"].unused_share < 0.12 and fill["b"].used_tokens == sum(v or 0 for v in sizes.values())
    assert P.packed(df.limit(0), limits).count() == 0 and P.packed(df, limits.limit(0)).count() == 0
    only_empty = P.packed(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long"), limits).collect()
    assert len(only_empty) == 4 and {x.tokens for x in only_empty} == {0}


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, 250)] * 3 + [(2, 7)] * 40, "doc_id long, n_tokens long")
    rows = P.packed(df, spark.createDataFrame([("a", 100)], "container_kind string, capacity_tokens int")).collect()
    used = Counter()
    for r in rows:
        used[r.container_id] += r.tokens
    assert sum(used.values()) == 3 * 250 + 40 * 7 and max(used.values()) <= 100 and all(r.used == used[r.container_id] for r in rows)


def test_plan_uses_counts_exactly():
    r = random.Random(4)
    for capacity in (10, 64, 300):
        counts = {s: r.randint(1, 5000) for s in r.sample(range(1, capacity + 1), min(capacity, 40) - 2)}
        used = Counter()
        for items, times in P.plan(capacity, counts):
            assert 0 < sum(items) <= capacity and times > 0
            for s in items:
                used[s] += times
        assert used == Counter(counts)
    assert [(sorted(i), t) for i, t in P.plan(10, {6: 5, 4: 5})] == [([4, 6], 5)]
    assert P.plan(10, {}) == []


def test_exact_complements_are_found_however_late_they_come():
    draw = random.Random(3)
    for _ in range(60):
        counts = Counter(draw.choices(range(1, 400), k=draw.randint(3, 25)))
        lengths = P._Lengths(400, counts)
        for gap in range(3, 400, 7):
            found = lengths.complement(gap, Counter())
            items = sorted(counts.elements())
            exists = counts[gap] or any(a + b == gap for a, b in combinations(items, 2)) or any(sum(c) == gap for c in combinations(items, 3))
            assert bool(found) == bool(exists) and (not found or sum(found) == gap and not Counter(found) - counts)
    # The longest length ends with a gap on the greedy way, but not with another in second place.
    filled = P._Lengths(100, {60: 1, 39: 1, 21: 1, 19: 1}).filling(60)
    assert filled == P.Counter((60, 21, 19))
    placed = P.plan(100, {60: 3, 39: 5, 21: 3, 19: 3})
    assert sum(n for items, n in placed if sum(items) == 100) == 3


def test_long_words_are_not_kept():
    with open(PATH, "rb") as file:
        machine = BpeTransducer(read_ranks(file.read()), max_chars=40)
    long = "ab" * 4000
    first = machine.encode(f"{long} some words here {long}")
    assert not any(len(w) > machine.LONG for w in machine.words)
    for text in ("other words", "more and more of them", f"{long} some words here {long}"):
        found = machine.encode(text)
    assert found == first and machine.held <= 40 + machine.LONG
