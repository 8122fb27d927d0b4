import json
import random

from auditlake.llm import copies as C

SCHEMA = "record_id long, fingerprint string, snippet string, fields_json string, canon string, bucket int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def _pairs(df):
    return {(r.first_record_id, r.record_id) for r in df.collect()}


def test_what_is_the_same(spark):
    f = {"rule_id": "SEC-005", "start_line": 12, "class_name": None}
    rows = [
        (1, "AB12", "a = b;", json.dumps(f)),
        (2, "ab-12", "A=B", json.dumps({"className": None, "StartLine": "12", "ruleId": "sec 005"})),
        (3, "ab12", "a = b", json.dumps({**f, "class_name": ""})),  # null equals only null
        (4, None, "a = b", json.dumps(f)),
        (5, None, "A B", json.dumps(f)),
        (6, "", "a = b", json.dumps(f)),  # empty is not null
        (7, "ab12", None, json.dumps(f)),
        (8, "ab12", "ab", None),
        (9, "ab12", "ab", "no json"),
        (10, "ab1", "2ab", json.dumps(f)),  # letters stay in their field
        (11, "AB12", "straße", json.dumps(f)),
        (12, "AB12", "STRASSE", json.dumps(f)),
        (None, "AB12", "a = b;", json.dumps(f)),
    ]
    assert _pairs(C.copies(_frame(spark, rows))) == {(1, 2), (4, 5), (11, 12)}
    kept = {r.record_id: r.copies for r in C.kept(_frame(spark, rows)).collect()}
    assert kept == {1: 2, 3: 1, 4: 2, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 2}


def test_splitting_hot_groups_and_long_texts(spark):
    random.seed(5)
    long = "x" * 50_000
    rows = [(i, "f", "hot group", "{}") for i in range(600)] + [(600 + i, "f", f"{long}{i % 40}", "{}") for i in range(200)]
    rows += [(900 + i, None, "".join(random.choice("abc ") for _ in range(6)), '{"a": 1}') for i in range(400)]
    random.shuffle(rows)
    first, expected = {}, set()
    for r in sorted(rows):
        key = (r[1], "".join(c for c in r[2] if c.isalnum()), r[3])
        if key in first:
            expected.add((first[key], r[0]))
        first.setdefault(key, r[0])
    assert _pairs(C.copies(_frame(spark, rows), fits=8)) == expected


def test_empty(spark):
    assert C.copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.kept(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_against_counter():
    random.seed(1)
    keys = ["".join(random.choice("ab") for _ in range(random.randint(0, 9))).encode() for _ in range(2000)]
    trie = C.CountingTrie()
    for i, key in enumerate(keys):
        trie.add(key, i, 1)
    assert {k: (first, n) for k, first, n in trie.items()} == {k: (keys.index(k), keys.count(k)) for k in set(keys)}


def test_a_task_counts_across_batches_and_hands_on_in_parts(monkeypatch):
    import pandas as pd

    frames = [pd.DataFrame({"canon": ["a", "b", "a"], "id": [5, 6, 7]}), pd.DataFrame({"canon": ["a", "c"], "id": [2, 9]})]
    rows = [tuple(r) for f in C._combine(iter(frames)) for r in f.itertuples(index=False)]
    assert sorted(rows) == [("a", 2, 3), ("b", 6, 1), ("c", 9, 1)]
    monkeypatch.setattr(C, "HELD", 1)
    rows = [tuple(r) for f in C._combine(iter(frames)) for r in f.itertuples(index=False)]
    assert sorted(rows) == [("a", 2, 1), ("a", 5, 2), ("b", 6, 1), ("c", 9, 1)]
