import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators import diffs, findings, ledger, matching, patches, reports, scoring, taint
from auditlake.sources import files, sinks
from auditlake.streaming import ledger as streams

SOURCES = "source_id long, repository_id string, file_path string, raw_source string, line string, kind string"


def _sources(spark, rows):
    return spark.createDataFrame([(i + 1, "R", path, text, "l", "k") for i, (path, text) in enumerate(rows)], SOURCES)


def test_columns(spark):
    df = spark.createDataFrame([("./a\\b/C.java", "aabb"), (None, None), ("//x.KT", "")], "p string, t string")
    rows = df.select(C.normal_path(F.col("p")).alias("p"), C.language_of(F.col("p")).alias("l"), C.entropy(F.col("t")).alias("e"), C.file_of(F.col("p")).alias("f")).collect()
    assert [tuple(r) for r in rows] == [("a/b/C.java", "JAVA", 1.0, "C.java"), (None, None, None, None), ("x.KT", "KOTLIN", 0.0, "x.KT")]
    one = spark.range(1).select(C.finding_fingerprint(F.lit("a/b"), F.lit("R"), F.lit(None).cast("string"), F.lit(" x \n y ")).alias("f"), C.masked(F.lit('k = "abcdefghij"')).alias("m"), C.half_up(F.lit(0.605)).alias("h")).first()
    import hashlib

    assert one.f == hashlib.sha256(b"a/b|R||x y").hexdigest()[:32] and one.m == 'k = "abcd****"' and math.isclose(one.h, 0.61)


def test_secrets_first_match_and_nulls(spark):
    key = "AKIA" + "A" * 16
    df = _sources(spark, [("a.py", f'x = 1\npassword = "{key}zz"\r\ny'), ("b.py", None), ("c.py", ""), ("d.py", "-----BEGIN RSA PRIVATE KEY-----"), (None, 'auth_token: "abcdefghijabcdefghij"')])
    rows = {(r.source_id, r.line_no): r.pattern for r in findings.secret_findings(df).collect()}
    assert rows == {(1, 2): "aws_key", (4, 1): "private_key", (5, 1): "generic_key"}


def test_line_rules_guards_and_functions(spark):
    java = "class A {\n  public void run() {\n    Runtime.getRuntime().exec(x);\n  }\n  public void stop() {\n    // kept by hand\n    http.csrf(c -> c.disable());\n  }\n}"
    df = _sources(spark, [("A.java", java), ("B.java", java + "\n// STATELESS"), ("a.txt", java), ("n.java", None)])
    found = {(r.source_id, r.line_no, r.rule_key) for r in findings.line_findings(df).collect()}
    assert found == {(1, 3, "SEC-004"), (1, 7, "SEC-009"), (2, 3, "SEC-004")}
    named = {(r.line_no, r.function) for r in findings.enclosing_functions(df.where("source_id = 1")).collect()}
    assert (1, "moduleScope") in named and (3, "run") in named and (7, "stop") in named
    rows = findings.suppressed(findings.line_findings(df), df, "by hand").collect()
    assert {(r.source_id, r.line_no): r.suppressed_by for r in rows} == {(1, 3): None, (1, 7): 6, (2, 3): None}
    spans = {(r.function, r.start_line, r.end_line) for r in findings.function_spans(df.where("source_id = 1")).collect()}
    assert spans == {("run", 2, 4), ("stop", 5, 9)}


def test_line_rules_of_blocks_and_missing_ones(spark):
    java = """class A {
  private volatile int n = 0, m;
  boolean ok(String s) throws IOException {
    n++;
    m += 2; // n++
    int k = n;
    FileReader r = new FileReader(s);
    FileReader q = new FileReader(s);
    try (BufferedReader b = new BufferedReader(new FileReader(s))) {
      return k == 1;
    } catch (IOException e) {
      if (k > 1) { log("}"); }
      return true;
    } catch (Exception e) {
      return false;
    } finally {
      r.close();
    }
  }
}"""
    kotlin = 'fun a() {\n  try { x() } catch (e: Exception) {\n    return true\n  }\n  try { x() } catch (e: Exception) { return false }\n  db.rawQuery("SELECT * FROM t WHERE a = $b", null)\n}'
    python = "def f():\n    try:\n        x()\n    except Exception:\n        log()\n        return True\n    try:\n        x()\n    except Exception:\n        return None\n    requests.get(\n        'https://a',\n        verify=False)"
    script = "function b(n) {\n  if (!path.resolve(n).startsWith(base)) throw n;\n  return fs.readFile(`/a/${n}`);\n}\nfunction a(n) {\n  return fs.readFileSync('/a/' + n);\n}\njwt.verify(t, k, { algorithms: ['none'] });"
    df = _sources(spark, [("A.java", java), ("a.kt", kotlin), ("a.py", python), ("a.ts", script)])
    got = {(r.source_id, r.line_no, r.rule_key, r.confidence) for r in findings.line_findings(df).collect()}
    assert got == {
        (1, 4, "SEC-003", 0.97), (1, 5, "SEC-003", 0.97), (1, 8, "SEC-002", 0.95), (1, 11, "SEC-001", 0.98), (2, 2, "SEC-001", 0.98), (2, 6, "SEC-005", 0.97),
        (3, 4, "SEC-001", 0.94), (3, 11, "SEC-001", 0.99), (4, 6, "SEC-006", 0.95), (4, 8, "SEC-013", 0.99),
    }


ENTRIES = "entry_id long, repository_id string, rule_id string, file_path string, method_name string, start_line int, fingerprint string, baseline_id int"


def _entries(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], ENTRIES)


def test_baseline_matching(spark):
    old = _entries(spark, [(1, "R", "S1", "a/B.java", "run", 10, "AA"), (2, "R", "S1", "a/B.java", "", 50, "n/a"), (3, "R", "S1", "a/B.java", None, None, None), (4, "R", "S1", "a/B.java", "run", 10, "aa")])
    new = _entries(spark, [(11, "R", "s1", "./a/b.java", "run", 99, "zz"), (12, "R", "S1", "a\\B.java", "", 55, "n/a"), (13, "R", "S1", "a/B.java", "x", 56, ""), (14, "Q", "S1", "a/B.java", "run", 10, "aa"), (15, "R", "S2", "q", None, None, "aA ")])
    got = {r.entry_id: (r.disposition, r.baseline_id) for r in matching.dispositions(new, old).collect()}
    assert got == {11: ("STRUCTURAL", 1), 12: ("STRUCTURAL", 2), 13: ("NEW", None), 14: ("NEW", None), 15: ("EXACT", 1)}
    assert matching.dispositions(new, old.limit(0)).where("disposition != 'NEW'").count() == 0


def test_overlap_against_brute_force(spark):
    a = [(i, "R", (i * 37) % 300, (i * 37) % 300 + i % 70 - 3) for i in range(120)] + [(900, "R", None, 5)]
    b = [("R", (i * 91) % 300, (i * 91) % 300 + i % 9) for i in range(12)] * 2
    left = spark.createDataFrame(a, "row_id long, k string, lo int, hi int")
    right = spark.createDataFrame(b, "k string, lo int, hi int")
    expected = {r for r, _, lo, hi in a if lo is not None and any(lo <= max(x, y) and x <= max(lo, hi) for _, x, y in b)}
    assert {r.row_id for r in matching.overlapping(left, right, ["k"], 16).collect()} == expected


def test_paths_references_reach_and_nearest(spark):
    known = spark.createDataFrame([("R", 1, "src/a/X.java"), ("R", 2, "b/X.java"), ("R", 3, "c/Y.java")], "repository_id string, known_id long, path string")
    wanted = spark.createDataFrame([("R", "w1", "a/X.java"), ("R", "w2", "b\\x.java"), ("R", "w3", "z/Y.java"), ("R", "w4", "none.java"), ("R", "w5", None)], "repository_id string, wanted_id string, path string")
    got = {r.wanted_id: (r.known_id, r.how) for r in matching.resolved_paths(wanted, known).collect()}
    assert got == {"w1": (1, "suffix"), "w2": (2, "exact"), "w3": (3, "name")}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "b")], "src string, dst string")
    assert [tuple(r) for r in matching.mutual(edges).collect()] == [("a", "b")]
    assert {tuple(r) for r in matching.reachable(edges, 3).collect()} == {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 2), ("b", "d", 2), ("a", "d", 3)}
    lines = spark.createDataFrame([("k", 10), ("k", 20), ("k", 20), ("j", 1)], "k string, line_no int")
    asked = spark.createDataFrame([(1, "k", 15), (2, "k", 20), (3, "k", 99), (4, "k", 1), (5, "m", 3), (6, "k", None)], "wanted_id long, k string, expected int")
    assert {tuple(r) for r in matching.nearest_line(asked, lines, ["k"]).collect()} == {(1, 10, 5), (2, 20, 0), (3, 20, 79), (4, 10, 9)}


def test_scores_and_rates(spark):
    rows = spark.createDataFrame([("a", "TP"), ("a", "FP"), ("b", "TN"), ("c", "FN"), ("d", None)], "r string, classification string")
    rates = {r.r: (r.precision, r.recall, r.f1, r.fpr, r.fnr) for r in scoring.with_rates(scoring.matrix(rows, "r")).collect()}
    assert rates["a"] == (0.5, 1.0, pytest.approx(2 / 3), 1.0, 0.0) and rates["b"] == (1.0, 1.0, 1.0, 0.0, 0.0) and rates["c"] == (0.0, 0.0, 0.0, 0.0, 1.0)
    row = spark.range(1).select(
        scoring.calibrated(scoring.factors(F.lit("SEC-005-X"), F.lit("x"), F.lit(None).cast("string"), F.lit(1))).alias("low"),
        scoring.calibrated(scoring.factors(F.lit("SEC-001-X"), F.lit("x"), F.lit(None).cast("string"), F.lit(1))).alias("high"),
        scoring.bucket(F.lit(0.81), F.lit("CRITICAL")).alias("b"), scoring.bucket(F.lit(0.1), F.lit(None).cast("string")).alias("v"),
    ).first()
    assert (row.low, row.high, row.b, row.v) == (0.61, 0.78, "CRITICAL", "VERY_LOW")


def test_ledger(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [("r1", 0, base, "2026-01-05T23:08:08Z", 3), ("r1", 0, base + dt.timedelta(hours=1), "2026-01-05T23:08:08Z", 3), ("r2", 1, base, "1767570302.651156655", 4), ("r3", 1, base, "never", 4)]
    df = spark.createDataFrame(rows, "run_id string, batch_no int, received_at timestamp, logged_text string, n int")
    first = ledger.first_deliveries(df)
    assert first.count() == 3
    logged = {r.run_id: r.us for r in first.select("run_id", F.unix_micros(ledger.logged_at(F.col("logged_text"))).alias("us")).collect()}
    assert logged == {"r1": 1767654488000000, "r2": 1767570302651156, "r3": None}
    a, b = (spark.range(1).select(F.lit(x).cast("string").alias("x"), F.lit("y").alias("y")).select(ledger.signature("x", "y").alias("s")).first().s for x in (None, ""))
    assert a == b


DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +2,4 @@ def\n a\n-b\n+B\n+C\n\\ No newline\n@@ -9 +10 @@\n-- q\n+z\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n+n"


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "@@ no")], "id long, text string")
    rows = diffs.diff_lines(df, "id", "text")
    assert [(r.target, r.hunk, r.sign, r.new_line) for r in rows.orderBy("pos").collect()] == [
        ("x.py", 1, " ", 2), ("x.py", 1, "-", 3), ("x.py", 1, "+", 3), ("x.py", 1, "+", 4), ("x.py", 1, "\\", 5), ("x.py", 2, "-", 10), ("x.py", 2, "+", 10), ("y", 3, "+", 1),
    ]
    pairs = [("a\nb\nc", "a\nX\nc"), ("", "a"), ("a", ""), ("a\nb", "a\nb"), ("a\na\na", "a\na"), ("x\ny", "x\nz\ny"), ("\n".join("abcdefghij"), "\n".join("abcdeXfghij")), ("a", "a\n"), (None, "q"), ("q", None)]
    both = spark.createDataFrame(pairs, "old string, new string").withColumn("diff", diffs.unified(F.lit("f"), F.col("old"), F.col("new")))
    assert both.where(~diffs.applied(F.col("old"), F.col("diff")).eqNullSafe(F.coalesce("new", F.lit("")))).count() == 0
    assert both.where("old like 'a%j'").first()["diff"] == "--- a/f\n+++ b/f\n@@ -4,4 +4,5 @@\n d\n e\n+X\n f\n g"
    other = spark.createDataFrame([("other",)], "old string").select(diffs.applied(F.col("old"), diffs.unified(F.lit("f"), F.lit("a"), F.lit("b"))).alias("x"))
    assert other.first().x is None
    made = diffs.generated(spark.createDataFrame([(1, "p", None, "x"), (2, None, "y", "y")], "id long, p string, a string, b string"), "id", "p", "a", "b")
    assert [(r.applies, r["diff"] == "") for r in made.orderBy("id").collect()] == [(True, False), (True, True)]


def test_patches(spark):
    rows = [(1, "SEC-004-X", 'run(f"x {a}", shell=True)'), (2, "SEC-010-X", '{"origins": "*"}'), (3, "SEC-002", "open(x)"), (4, "SEC-004", None), (5, None, "x")]
    df = patches.patched(spark.createDataFrame(rows, "entry_id long, rule_id string, snippet string")).withColumn("stage", patches.stage())
    got = {r.entry_id: (r.patched, r.stage) for r in df.collect()}
    assert got[1] == ('run(f"x {a}", shell=False)', "FIXED") and got[2] == ('{"origins": "https://trusted.invalid"}', "FIXED")
    assert got[3] == ("open(x)", "NO_FIX") and got[4] == (None, "NO_SNIPPET")


def test_taint(spark):
    code = "def load(name, n):\n    path = root + name\n    full = path\n    with open(full) as f:\n        pass\n\ndef other(x):\n    y = 1\n    open(y)\n\ndef safe(a):\n    b = sanitize(a)\n    execute(b)"
    got = {(r.function, r.sink_line, r.variable, r.hops, r.cleaned) for r in taint.flows(_sources(spark, [("a.py", code), ("b.py", None)])).collect()}
    assert got == {("load", 4, "full", 2, False), ("safe", 13, "b", 1, True)}


def test_taint_over_many_assignments_and_earlier_lines(spark):
    code = "def f(a):\n    b = a\n    x = b\n    exec(x)\n    x = a\n    c = x\n    d = c\n    e = d\n    g = e\n    h = g\n    open(h)\n    eval(x)"
    got = {(r.sink_line, r.variable, r.hops) for r in taint.flows(_sources(spark, [("a.py", code)])).collect()}
    assert got == {(4, "x", 2), (11, "h", 6), (12, "x", 1)}


def test_reports(spark):
    rows = spark.createDataFrame([("R", "S1", "error", "m", "p", 0, None), ("R", "S0", "note", None, "p", 5, 2)] + [("Q", "S1", "error", "m", f"p{i:02}", i, i) for i in range(25)], "repository_id string, rule_id string, level string, message string, path string, start_line int, end_line int")
    texts = {r.repository_id: json.loads(r.sarif) for r in reports.sarif(rows, "repository_id").collect()}
    results = texts["R"]["runs"][0]["results"]
    assert texts["R"]["version"] == "2.1.0" and [r["locations"][0]["physicalLocation"]["region"] for r in results] == [{"startLine": 1, "endLine": 1}, {"startLine": 5, "endLine": 5}]
    capped = {r.repository_id: r for r in reports.text_report(rows, "repository_id", order=["path", "rule_id"]).collect()}
    assert capped["Q"].omitted == 5 and capped["Q"].report.count("\n") == 19 and capped["R"].omitted == 0


def test_sarif_parts_are_bounded_and_whole(spark):
    many = [("R", None if i % 2 else "p", "S1", "error", "m" * 100, "p", i, i) for i in range(400)]
    rows = spark.createDataFrame([*many, ("Q", "p", "S1", "error", "m", "p", 1, 1)], "repository_id string, file string, rule_id string, level string, message string, path string, start_line int, end_line int")
    parts = reports.sarif(rows, "repository_id", "file", part_chars=10_000).collect()
    lines = [[x["locations"][0]["physicalLocation"]["region"]["startLine"] for x in json.loads(r.sarif)["runs"][0]["results"]] for r in parts]
    assert len(parts) > 10 and max(map(len, lines)) <= 40 and all(x == sorted(x) for x in lines) and len({(r.repository_id, r.file, r.part) for r in parts}) == len(parts)
    assert sorted(x for x in sum(lines, [])) == sorted([1, 1, *range(1, 400)])
    assert [r.part for r in parts if r.repository_id == "Q"] == [0]


def test_reachable_packages_over_five_steps(spark, tmp_path):
    from auditlake.plans import audit

    texts = [(i, "R", f"A{i}.java", f"package p{i};\nimport p{i + 1}.A{i + 1};\npublic class A{i} {{}}\n") for i in range(7)]
    spark.createDataFrame(texts, "source_id long, repository_id string, file_path string, raw_source string").write.parquet(str(tmp_path / "sources.parquet"))
    got = {(r.dst, r.hops) for r in audit.reachable_packages(spark, str(tmp_path)).where("src = 'p0'").collect()}
    assert got == {("p1", 1), ("p2", 2), ("p3", 3), ("p4", 4), ("p5", 5)}


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "t/src").mkdir(parents=True)
    (tmp_path / "t/node_modules").mkdir()
    (tmp_path / "t/src/A.java").write_text("class A {}\n")
    (tmp_path / "t/src/readme.md").write_text("x")
    (tmp_path / "t/node_modules/b.js").write_text("y")
    assert [(r.language, r.raw_source) for r in files.source_tree(spark, str(tmp_path / "t")).collect()] == [("JAVA", "class A {}\n")]
    assert files.one_source(spark, "x").first().language == "JAVA"
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "entries": [{"fingerprint": "a", "ruleId": "S", "capturedAt": "2026-01-01T00:00:00Z"}, {"fingerprint": "b"}]}, indent=1))
    assert [(r.pos, r.fingerprint) for r in files.baseline(spark, str(tmp_path / "b.json")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "p.json").write_text('{"policyName": "x", "blockedRules": ["S"]}')
    assert files.policy(spark, str(tmp_path / "p.json")).first().maxAllowedMedium == -1
    sinks.append_ledger(spark.createDataFrame([("r1",), ("r2",)], "runId string"), str(tmp_path / "l"))
    sinks.append_ledger(spark.createDataFrame([("r1",)], "runId string"), str(tmp_path / "l"))
    assert files.ledger(spark, str(tmp_path / "l")).count() == 2
    (tmp_path / "ignore").write_text("# all\nsrc/A.java:SEC-001\nSEC-002\nsrc/B.java # why\n")
    assert [(r.pos, r.path, r.rule) for r in files.ignore_rules(spark, str(tmp_path / "ignore")).collect()] == [(1, "src/A.java", "SEC-001"), (2, None, "SEC-002"), (3, "src/B.java", None)]


def test_streams_give_the_batch_result(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(f"r{i % 5}", "R", base + dt.timedelta(minutes=i * (40 if i > 6 else 5))) for i in range(10)]
    df = spark.createDataFrame(rows, "run_id string, repository_id string, received_at timestamp")
    df.write.parquet(str(tmp_path / "runs.parquet"))
    stream = streams.first_of(streams.arriving(spark, str(tmp_path), "runs"), ["run_id"], "received_at")
    assert streams.drained(stream.select("run_id"), "t").count() == 5
    got = [(r.rows, (r.ended - r.started).total_seconds() / 60) for r in streams.sessions(df, ["repository_id"], "received_at", "30 minutes").orderBy("started").collect()]
    assert got == [(7, 60.0), (1, 30.0), (1, 30.0), (1, 30.0)]


def test_python_frameworks(spark):
    lines = [
        ("    return render_template_string(template)", {"SEC-020"}), ("    return Markup(user_bio)", {"SEC-020"}), ('    return render_template("hello.html", name="guest")', set()), ('x = mark_safe("<b>fixed</b>")', set()), ("x = mark_safe(f'<b>{y}</b>')", {"SEC-020"}),
        ("from flask import Flask, Markup", set()), ("app.config['DEBUG'] = True", {"SEC-001"}), ("DEBUG = True", {"SEC-001"}), ("DEBUG = False", set()), ("ALLOWED_HOSTS = ['*']", {"SEC-001"}), ("ALLOWED_HOSTS = ['a.b']", set()), ("app.run(port=1, debug=True)", {"SEC-001"}),
        ('users = User.objects.raw("SELECT * FROM users WHERE id = " + user_id)', {"SEC-005"}), ('users = User.objects.raw("SELECT 1")', set()), ('resp.set_cookie("session_id", "s")', {"SEC-001"}), ('r.set_cookie("auth_token", "v", httponly=True, secure=False)', {"SEC-001"}),
        ('resp.set_cookie("session_id", "s", httponly=True, secure=True, samesite="Lax")', set()), ('resp.set_cookie("ui_theme", "dark")', set()),
    ]
    rows = [(1, "a.py", "\n".join(t for t, _ in lines)), (2, "b.py", 'add(\n    allow_origins=["*"],\n    allow_credentials=True,\n)'), (3, "c.py", 'add(\n    allow_origins=["https://a.b"],\n    allow_credentials=True,\n)'), (4, "d.py", 'add(allow_origins=["*"])')]
    found = {(r.source_id, r.line_no, r.rule_key) for r in findings.rule_lines(spark.createDataFrame(rows, "source_id long, file_path string, raw_source string")).collect()}
    expected = {(1, i, key) for i, (_, keys) in enumerate(lines, 1) for key in keys} | {(2, 2, "SEC-010")}
    assert found == expected


def test_hints_lose_no_finding(spark):
    """Rules with and without their hints find the same in files of every rule's own words."""
    df = spark.read.parquet("/root/testdata/sf0.01/sources.parquet") if os.path.exists("/root/testdata/sf0.01") else None
    if df is None:
        pytest.skip("no test tables")
    with_hints = {(r.source_id, r.line_no, r.rule_key, r.confidence) for r in findings.rule_lines(df).collect()}
    held = dict(findings.HINTS)
    findings.HINTS.clear()
    try:
        without = {(r.source_id, r.line_no, r.rule_key, r.confidence) for r in findings.rule_lines(df).collect()}
    finally:
        findings.HINTS.update(held)
    assert with_hints == without and with_hints


def test_sarif_names_the_rules_of_its_results(spark):
    rows = [("R", "a.py", "SEC-002", "note", "m", 3, 2, "x = 1", "u2"), ("R", "a.py", "SEC-001", "error", "m", None, None, None, "u1"), ("R", None, None, "note", None, 1, 1, " ", None), ("R", "a.py", "SEC-001", "error", "n", 9, 9, "y", "u1")]
    df = spark.createDataFrame(rows, "repository_id string, path string, rule_id string, level string, message string, start_line int, end_line int, snippet string, help_uri string")
    runs = [json.loads(r.sarif)["runs"][0] for r in reports.sarif(df, "repository_id").collect()]
    assert len(runs) == 1
    ids = [r["id"] for r in runs[0]["tool"]["driver"]["rules"]]
    assert sorted(ids) == ["", "SEC-001", "SEC-002"] and all(ids[r["ruleIndex"]] == r.get("ruleId", "") for r in runs[0]["results"])
    places = [r["locations"][0]["physicalLocation"] for r in runs[0]["results"]]
    assert places[0]["artifactLocation"] == {"uri": "unknown", "uriBaseId": "%SRCROOT%"} and {"startLine": 3, "endLine": 3, "snippet": {"text": "x = 1"}} in [p["region"] for p in places]
