from auditlake.operators import manifests as M

TEXTS = {
    "a/requirements.txt": "# note==1\nflask==2.0.1  # web\nRequests[socks] >= 2.31\nno_version\nDja_ngo~=4.2,<5\n",
    "pyproject.toml": "[project]\nname = \"x\"\nversion = \"0.1\"\ndependencies = [\n  \"httpx>=0.24,<1\",\n  \"rich\",\n]\n[tool.poetry.dependencies]\npython = \"^3.11\"\njinja2 = \"^3.1.2\"\nnumpy = {version = \"~1.26\", optional = true}\n",
    "poetry.lock": "[[package]]\nname = \"urllib3\"\nversion = \"1.26.5\"\ndescription = \"\"\n\n[[package]]\nname = \"idna\"\nversion = \"3.4\"\n",
    "b/Pipfile": "[packages]\npyyaml = \"==5.3\"\nclick = \"*\"\nlxml = {version = \">=4.9\", extras = [\"x\"]}\n",
    "other.txt": "flask==1.0\n", "c/requirements.txt": "", "d/requirements.txt": None,
}


def test_manifests(spark):
    files = spark.createDataFrame([(p, t, "clash") for p, t in TEXTS.items()], "file_path string, text string, component string").select("file_path", "text", "component")
    found = {(r.file_path, r.component, r.version) for r in M.dependencies(files).collect()}
    assert found == {
        ("a/requirements.txt", "flask", "2.0.1"), ("a/requirements.txt", "requests", "2.31"), ("a/requirements.txt", "dja-ngo", "4.2"), ("pyproject.toml", "httpx", "0.24"), ("pyproject.toml", "jinja2", "3.1.2"),
        ("pyproject.toml", "numpy", "1.26"), ("poetry.lock", "urllib3", "1.26.5"), ("poetry.lock", "idna", "3.4"), ("b/Pipfile", "pyyaml", "5.3"), ("b/Pipfile", "lxml", "4.9"),
    }
    assert M.dependencies(files.limit(0)).count() == 0


def test_versions_are_compared_as_numbers(spark):
    found = spark.createDataFrame([("a", "1.9.9"), ("a", "1.10"), ("a", "1.10.0"), ("a", "2"), ("b", "1.0"), ("a", None)], "component string, version string")
    advised = spark.createDataFrame([("a", "1.10.0")], "component string, fixed string")
    assert {(r.version, r.affected) for r in M.affected(found, advised).collect()} == {("1.9.9", True), ("1.10", False), ("1.10.0", False), ("2", False), (None, None)}
