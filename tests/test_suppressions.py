from pyspark.sql import functions as F

from auditlake.operators import matching, patches
from auditlake.operators import suppressions as S

SOURCES = "source_id long, repository_id string, file_path string, raw_source string, token string"
FOUND = "source_id long, line_no int, rule string, confidence double, path string"
JAVA = """class A {
  @SuppressWarnings({"unchecked", "audit:SEC-005"})
  public void run(String q) {
    db.execute(q);
  }
  public void other(String q) {
    db.execute(q); // audit-ignore sec-005-sql reviewed by two
    db.execute(q);
    db.execute(q);
    /* Audit-Ignore * */
    open(q);
  }
}
"""
WHOLE = """@SuppressWarnings(value = "all")
@Other
public class B {
  int x = new Random().nextInt();
}
"""
FIELD = """def f():
    # audit-ignore SEC-007
    pickle.loads(x)
"""


def _found(spark, rows):
    return spark.createDataFrame(rows, FOUND)


def _keys(df):
    return {(r.source_id, r.line_no, r.rule) for r in df.collect()}


def test_tokens(spark):
    rows = [("all", "SEC-005-SQL", True), ("*", "SEC-001", True), ("audit:Sec-005", "SEC-005-SQL", True), ("sec-005-sql", "SEC-005-SQL", True), ("sec-00", "SEC-005-SQL", False), ("SEC-006", "SEC-005-SQL", False), (None, "SEC-005", False), ("all", None, False)]
    df = spark.createDataFrame(rows, "token string, rule string, expected boolean")
    assert df.where(S.token_matches(F.col("token"), F.col("rule")) != F.col("expected")).count() == 0


def test_annotations_and_directives(spark):
    src = spark.createDataFrame([(1, "R", "A.java", JAVA, "k"), (2, "R", "B.java", WHOLE, "k"), (3, "R", "f.py", FIELD, "k"), (4, "R", "n.py", None, "k"), (5, "R", "e.py", "", "k")], SOURCES)
    found = _found(spark, [
        (1, 4, "SEC-005-SQL", 0.9, "A.java"), (1, 4, "SEC-006", 0.9, "A.java"), (1, 7, "SEC-005-SQL", 0.9, "A.java"), (1, 8, "SEC-005-SQL", 0.9, "A.java"), (1, 9, "SEC-005-SQL", 0.9, "A.java"),
        (1, 11, "SEC-006", 0.9, "A.java"), (2, 4, "ARCH-003", 0.9, "B.java"), (3, 3, "SEC-007", 0.9, "f.py"), (3, 3, "SEC-004", 0.9, "f.py"), (4, 1, "SEC-004", 0.9, None),
    ])
    assert _keys(S.by_annotation(found, src)) == {(1, 4, "SEC-005-SQL"), (2, 4, "ARCH-003")}
    # The directive on line 7 covers 6 to 8, the one on line 10 covers 9 to 11 and names all rules.
    assert _keys(S.by_directive(found, src)) == {(1, 7, "SEC-005-SQL"), (1, 8, "SEC-005-SQL"), (1, 9, "SEC-005-SQL"), (1, 11, "SEC-006"), (3, 3, "SEC-007")}
    assert {(r.token, r.reason) for r in S.directives(src).collect()} == {("sec-005-sql", "reviewed by two"), ("*", None), ("SEC-007", None)}
    assert S.by_annotation(found.limit(0), src).count() == 0 and S.by_directive(found, src.limit(0)).count() == 0


def test_ignore_rules_and_precedence(spark):
    found = _found(spark, [(1, 1, "SEC-005-SQL", 0.9, "src/a/File.java"), (1, 2, "SEC-006", 0.99, "src/a/File.java"), (2, 1, "SEC-006", 0.99, "lib/xFile.java"), (3, 1, "SEC-010", 0.99, None), (4, 1, None, 0.99, "b/Whole.py")])
    rules = spark.createDataFrame([("a\\FILE.java", "sec-006"), (None, "audit:sec-010"), ("Whole.py", None), ("", "nothing")], "path string, rule string")
    hits = S.by_ignore_rule(found, rules)
    assert _keys(hits) == {(1, 2, "SEC-006"), (3, 1, "SEC-010"), (4, 1, None)}
    out = S.dispositions(found, {"IGNORE_FILE": hits, "BASELINE_ACCEPTED": found.where("source_id in (1, 2)")}, 0.95)
    assert {(r.source_id, r.line_no, r.disposition) for r in out.collect()} == {(1, 1, "LOW_CONFIDENCE_HEURISTIC"), (1, 2, "IGNORE_FILE"), (2, 1, "BASELINE_ACCEPTED"), (3, 1, "IGNORE_FILE"), (4, 1, "ACTIVE")}


def test_structural_match_by_path_ends(spark):
    row = "entry_id long, repository_id string, rule_id string, file_path string, method_name string, start_line int, fingerprint string"
    old = spark.createDataFrame([(1, "R", "SEC-5", "src/main/a/File.java", "m", 10, None), (2, "R", "SEC-5", "File.java", None, 90, None), (3, "R", "SEC-5", "x/Other.java", " ", 5, "f" * 9 + "1"), (4, "R", None, "File.java", None, 1, None)], row)
    new = spark.createDataFrame([
        (10, "R", "sec-5", "a\\file.java", "m", 500, None), (11, "R", "SEC-5", "deep/src/main/a/File.java", None, 15, None), (12, "R", "SEC-5", "z/File.java", None, 86, None), (13, "R", "SEC-5", "zFile.java", None, 90, None),
        (14, "R", "SEC-5", "a/File.java", "other", 16, None), (15, "Q", "SEC-5", "File.java", "m", 10, None), (16, "R", "SEC-5", "", "m", 10, None), (17, "R", "SEC-5", None, "m", 10, None), (18, "R", "SEC-5", "x/Other.java", "", 11, "F" * 9 + "1"),
    ], row)
    assert {(r.entry_id, r.baseline_id) for r in matching.baseline_structural(new, old).collect()} == {(10, 1), (11, 1), (12, 2)}
    found = {r.entry_id: (r.disposition, r.baseline_id) for r in matching.dispositions(new, old).collect()}
    assert found[18] == ("EXACT", 3) and found[10] == ("STRUCTURAL", 1) and found[13] == ("NEW", None)
    assert {r.disposition for r in matching.dispositions(new, old, ("sec-5",)).collect()} == {"BLOCKED"}


def test_composition():
    assert patches.nearest(["a", "x = 1", "b", "x = 1"], " x = 1 ", 3) == (2, 2) and patches.nearest(["a"], "b", 1) is None and patches.nearest(["q", "a", "b", "a", "b"], "a\nb", 5) == (4, 5)
    text = "long a = System.currentTimeMillis();\nvolatile long n;\nlong b = System.currentTimeMillis();"
    found = [("SEC-003", 9, "volatile long n;"), ("ARCH-003", 1, "long a = System.currentTimeMillis();"), ("ARCH-003", 1, "long a = System.currentTimeMillis();"), ("SEC-999", 1, "long a")]
    status, patched, applied, skipped = patches.compose(text, found)
    assert (status, applied, skipped) == ("SUCCESS", 2, 2)
    assert patched == "long a = clock.millis();\nfinal AtomicLong n = new AtomicLong();\nlong b = System.currentTimeMillis();"
    assert patches.compose("x", [("ARCH-001", 1, "x")])[0] == "DEFERRED_TO_MULTI_FILE_PLAN" and patches.compose("x", [("SEC-005", 7, None)])[0] == "FAILED"


def test_composition_of_tables(spark):
    src = spark.createDataFrame([(1, "R", "A.java", "volatile int n;\r\nn = 1;", "k"), (2, "R", "a.py", "pickle.loads(x)", "k"), (3, "R", "C.java", None, "k"), (4, "R", "D.java", "int x;", "k")], SOURCES)
    found = spark.createDataFrame([(1, "SEC-003", 1, "volatile int n;", 1), (1, "SEC-003", 1, "volatile int n;", 1), (2, "SEC-007", 1, "pickle.loads(x)", 7), (3, "SEC-003", 1, "x", None)], "source_id long, rule_key string, line_no int, snippet string, priority int")
    rows = {r.source_id: (r.status, r.applied, r.patched) for r in patches.composed(src, found).collect()}
    assert rows == {1: ("SUCCESS", 1, "final AtomicLong n = new AtomicLong();\nn = 1;"), 2: ("MANUAL_REMEDIATION_REQUIRED", 0, "pickle.loads(x)")}
    assert patches.composed(src, found.limit(0)).count() == 0


def test_patch_of_a_finding(spark):
    fixed = spark.createDataFrame(
        [("R", 1, ["7", "8"], ["SEC-001"], "src/a/File.java"), ("R", 2, [], ["SEC-002", "SEC-003"], "src/b/Other.java"), ("R", 3, None, None, "B/other.java"), ("R", 4, ["x"], ["SEC-003"], None)],
        "repository_id string, patch_id long, finding_ids array<string>, rule_ids array<string>, path string",
    )
    found = spark.createDataFrame(
        [(7, "R", "SEC-009", "q"), (20, "R", "sec-003", "q"), (21, "R", "SEC-009", "deep\\src\\b\\OTHER.java"), (22, "R", "SEC-009", "File.java"), (23, "R", None, None), (24, "Q", "SEC-001", "File.java"), (25, "R", "SEC-009", "xFile.java")],
        "finding_id long, repository_id string, rule_id string, path string",
    )
    got = {(r.finding_id, r.patch_id, r.how) for r in matching.patch_of(found, fixed).collect()}
    assert got == {(7, 1, "id"), (20, 2, "rule"), (21, 2, "path"), (22, 1, "path"), (23, 1, "first"), (25, 1, "first")}
    assert matching.patch_of(found, fixed.limit(0)).count() == 0 and matching.patch_of(found.limit(0), fixed).count() == 0
