from pathlib import Path

from auditlake.operators import structure, taint

SOURCES = "source_id long, repository_id string, file_path string, raw_source string, name string"
STORE = "package org.a.x;\npublic class ShelfStore {\n    @Cached\n    public Shelf findShelf(long id) {\n        return null;\n    }\n}\n"
CONTROLLER = (
    "package org.a.y;\nimport org.a.z.ShelfEntity;\n@RestController\npublic class ShelfController {\n    @GetMapping(\"/s\")\n    public ResponseEntity<List<ShelfEntity>> all() {\n"
    "        return shelfStore.findShelf(1);\n    }\n    public Helper help() {\n        other.findShelf(2);\n        nobody.knows(3);\n    }\n}\n"
)


def _frame(spark, rows):
    return spark.createDataFrame([(i + 1, repo, path, text, "n") for i, (repo, path, text) in enumerate(rows)], SOURCES)


def test_names_across_files(spark):
    src = _frame(spark, [("R", "a/ShelfStore.java", STORE), ("R", "a/ShelfController.java", CONTROLLER), ("Q", "a/ShelfStore.java", STORE), ("R", "n.java", None), ("R", "e.java", "")])
    calls = {(r.repository_id, r.scope, r.name): (r.source_id, r.how) for r in structure.resolved_calls(src).collect()}
    assert calls["R", "shelfStore", "findShelf"] == (1, "scope") and calls["R", "other", "findShelf"] == (1, "name") and calls["R", "nobody", "knows"] == (None, "none")
    types = {(r.line_no, r.type): (r.resolved, r.how) for r in structure.exposed_types(src).collect()}
    assert types == {(6, "ShelfEntity"): ("org.a.z.ShelfEntity", "import"), (9, "Helper"): (None, "none")}
    assert structure.consumers(src).collect() == []
    more = _frame(spark, [("R", "a/ShelfStore.java", STORE), ("R", "b.java", "class Other { ShelfStore s; }"), ("R", "c.java", "class Third { ShelfStore s; Other o; }"), ("Q", "d.java", "class Far { ShelfStore s; }")])
    assert {(r.source_id, r.consumer_id) for r in structure.consumers(more).collect()} == {(1, 2), (2, 3)}
    marks = {(r.function, r.annotation) for r in structure.annotated_functions(src.where("source_id < 3")).collect()}
    assert {("findShelf", "Cached"), ("all", "GetMapping")} <= marks
    assert structure.resolved_calls(src.limit(0)).count() == 0 and structure.consumers(src.limit(0)).count() == 0


def test_sink_operands(spark):
    text = 'class A {\n    static final String ROOT = "/srv";\n    public void f(String x) {\n        open(ROOT + "a");\n        open(ROOT + x);\n        query("plain");\n    }\n}\n'
    got = {r.line_no: (r.operands, r.unproven) for r in structure.sink_operands(_frame(spark, [("R", "a.java", text), ("R", "n.java", None)])).collect()}
    assert got == {4: (1, 0), 5: (2, 1), 6: (0, 0)}


def test_nothing_outside_llm_imports_it():
    root = Path(__file__).resolve().parent.parent / "auditlake"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "auditlake.llm" not in path.read_text(), path


def test_every_sql_has_its_query_and_every_name_is_its_own():
    from auditlake.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) == sum(len(m.QUERIES) for m in catalog.MODULES)


def test_taint_through_calls(spark):
    rows = [
        (1, "R", "a/Web.java", 'class Web {\n  public void handle(HttpServletRequest request) {\n    String name = request.getParameter("n");\n    String full = name + "x";\n    store.save(7, full);\n  }\n  private void own(String q) {\n    run(q);\n  }\n  private void run(String sql) {\n    db.executeQuery(sql);\n  }\n}\n'),
        (2, "R", "a/Store.java", "class Store {\n  public void save(int id, String text) {\n    String part = text;\n    deeper(part);\n  }\n  private void deeper(String last) {\n    save(1, last);\n    db.execute(last);\n  }\n}\n"),
        (3, "R", "a/Other.java", "class Other {\n  public void save(String only) {\n    db.execute(only);\n  }\n}\n"),
        (4, "Q", "b/Store.java", "class Store {\n  public void save(int id, String text) {\n    db.execute(text);\n  }\n}\n"),
        (5, "R", None, None),
    ]
    src = spark.createDataFrame(rows, "source_id long, repository_id string, file_path string, raw_source string")
    found = {(r.source_id, r.function, r.variable, r.sink_source_id, r.sink_function, r.sink_line, r.calls) for r in taint.flows_across(src).collect()}
    assert found == {
        (1, "handle", "request", 2, "deeper", 8, 2), (1, "handle", "name", 2, "deeper", 8, 2), (1, "own", "q", 1, "run", 11, 1), (2, "save", "text", 2, "deeper", 8, 1),
    }
    assert taint.flows_across(src, depth=2).where("calls > 1").count() == 0
    assert taint.flows_across(src.limit(0)).count() == 0


def test_a_chain_of_calls_ends_at_the_depth(spark):
    body = "".join(f"  private void f{i}(String a{i}) {{\n    f{i + 1}(a{i});\n  }}\n" for i in range(7)) + "  private void f7(String z) {\n    db.execute(z);\n  }\n"
    src = spark.createDataFrame([(1, "R", "A.java", "class A {\n" + body + "}\n")], "source_id long, repository_id string, file_path string, raw_source string")
    assert {(r.function, r.calls) for r in taint.flows_across(src).collect()} == {(f"f{i}", 7 - i) for i in range(3, 7)}


def test_python_flows(spark):
    text = """import os
@app.route("/a")
def a(self, name, n=3):
    cmd = "ls " + name
    os.system(cmd)
    cursor.execute("select %s", (cmd,))
    cursor.execute("select " + name)

def b(other, user_id, *rest):
    safe = shlex.quote(user_id)
    os.system(safe)
    os.system(other)
    requests.get(user_id)

def c():
    x = request.args.get("q")
    y = x
    y = html.escape(y)
    open(y)
    eval(f"{x}")
    print("x", 'os.system(x')

def d(x):
    pickle.loads(x)
"""
    rows = [(1, "R", "a.py", text), (2, "R", "A.java", "class A { void f(String user) {\n  exec(user);\n} }"), (3, "R", "b.py", None), (4, "R", "c.py", "")]
    src = spark.createDataFrame(rows, "source_id long, repository_id string, file_path string, raw_source string")
    found = {(r.source_id, r.function, r.sink_line, r.variable, r.hops, r.bound) for r in taint.python_flows(src).collect()}
    assert found == {
        (1, "a", 5, "cmd", 1, False), (1, "a", 6, "cmd", 1, True), (1, "a", 7, "name", 0, False), (1, "b", 13, "user_id", 0, False), (1, "c", 20, "x", 0, False),
    }
    assert taint.python_flows(src.limit(0)).count() == 0
