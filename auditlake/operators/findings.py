"""Rules over source lines: each is a language, a pattern, and patterns of the file or line that take it back."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators.blocks import block_findings
from auditlake.storage import spread

#: Secret patterns in order of priority (name, pattern, severity); the first match of a line counts.
SECRETS = (
    ("aws_key", r"(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}", "CRITICAL"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,255}", "CRITICAL"),
    ("slack_token", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}", "CRITICAL"),
    ("private_key", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", "CRITICAL"),
    ("generic_key", r"(?i)(api_?key|secret_?key|auth_?token|password)[a-z_]*[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']", "HIGH"),
)

#: Rules by language: rule key, languages, pattern a line must hold, pattern it must not, pattern its file must not, confidence.
LINE_RULES = (
    ("SEC-001", "KOTLIN", r"catch\s*\(\s*\w+\s*:\s*(NullPointerException|Exception|Throwable|RuntimeException|SecurityException)\s*\)", r"throw ", "", 0.94),
    ("SEC-001", "PYTHON", r"^\s*except(\s+\w+(\s+as\s+\w+)?)?\s*:", r"raise", "", 0.94),
    ("SEC-002", "JAVA", r"new\s+(FileInputStream|FileOutputStream|FileReader|FileWriter|Scanner|ObjectInputStream|BufferedReader|Socket)\s*\(", r"try\s*\(", "", 0.95),
    ("SEC-002", "PYTHON", r"=\s*open\s*\(", r"^\s*with\s", "", 0.95),
    ("SEC-003", "JAVA,KOTLIN", r"volatile\s+(int|long|var\s)", "", "AtomicInteger|AtomicLong", 0.97),
    ("SEC-004", "JAVA,KOTLIN", r"Runtime\.getRuntime\(\)\.exec\s*\(|new ProcessBuilder\(|ProcessBuilder\(\"sh\"", "", "", 0.94),
    ("SEC-004", "PYTHON", r"os\.(system|popen)\s*\(|subprocess\.\w+\(.*shell\s*=\s*True", "", "shlex.quote", 0.96),
    ("SEC-004", "JAVASCRIPT,TYPESCRIPT", r"(^|[^A-Za-z0-9_.])(exec|execSync|eval)\s*\(", "", "", 0.95),
    ("SEC-005", "JAVA,KOTLIN", r"(?i)\"\s*(select|insert|update|delete)\s[^\"]*\"\s*\+", "", "", 0.96),
    ("SEC-005", "PYTHON", r"(?i)execute\s*\(\s*f?[\"'](select|insert|update|delete)\b.*[\"']\s*%|execute\s*\(\s*f[\"']", "", "", 0.96),
    ("SEC-005", "JAVASCRIPT,TYPESCRIPT", r"(?i)[`\"'](select|insert|update|delete)\s.*(\$\{|[\"']\s*\+)", "", "", 0.96),
    ("SEC-006", "JAVA,KOTLIN", r"new File\([^)\"]+,|Paths\.get\(.*\+", "", r"toRealPath|getCanonicalPath|\.normalize\(\)", 0.95),
    ("SEC-006", "PYTHON", r"open\s*\(\s*(os\.path\.join|f[\"'])", "", "realpath|commonpath", 0.95),
    ("SEC-007", "JAVA,KOTLIN", r"\.read(Object|Unshared)\s*\(", "", "ObjectInputFilter|setObjectInputFilter", 0.98),
    ("SEC-007", "PYTHON", r"pickle\.loads?\s*\(|yaml\.load\s*\(", "SafeLoader", "", 0.98),
    ("SEC-009", "JAVA,KOTLIN", r"csrf\s*\(.*disable", "", "STATELESS", 0.97),
    ("SEC-009", "PYTHON", r"@csrf_exempt", "", "", 0.97),
    ("SEC-010", "JAVA,KOTLIN", r"@CrossOrigin|allowedOrigins\(\"\*\"\)", "", "", 0.98),
    ("SEC-010", "PYTHON", r"CORS\(.*\"\*\"", "", "", 0.98),
    ("SEC-012", "JAVASCRIPT,TYPESCRIPT", r"(^|[^A-Za-z0-9_.])(fetch|axios\.get|http\.get)\s*(<[^>]*>)?\(\s*`", r"https?://|refetch|prefetch", "allowlist|whitelist", 0.95),
    ("SEC-012", "PYTHON", r"requests\.(get|post|put)\s*\(\s*[a-z_f]", "", "allowlist|whitelist", 0.95),
    ("SEC-018", "PYTHON", r"hashlib\.(md5|sha1)\s*\(", "usedforsecurity", "", 0.96),
    ("SEC-018", "JAVA,KOTLIN", r"getInstance\(\"(MD5|SHA-?1|DES|RC4)\"", "", "", 0.96),
    ("SEC-018", "JAVASCRIPT,TYPESCRIPT", r"createHash\([\"'](md5|sha1)", "", "", 0.96),
    ("SEC-019", "JAVASCRIPT,TYPESCRIPT", r"(?i)(token|secret|key|password|auth|nonce|salt|session|otp).*Math\.random\(\)", "", "", 0.95),
    ("SEC-020", "JAVASCRIPT,TYPESCRIPT", r"innerHTML\s*=|document\.write\(|dangerouslySetInnerHTML", "", "", 0.95),
    ("ARCH-003", "JAVA,KOTLIN", r"System\.(currentTimeMillis|nanoTime)\(\)|Math\.random\(\)|new Random\(", "", "", 0.9),
)

#: Rows of LINE_RULES whose condition needs more than the line: blocks.py has them.
IN_BLOCKS = (("SEC-001", "KOTLIN"), ("SEC-001", "PYTHON"), ("SEC-002", "JAVA"), ("SEC-003", "JAVA,KOTLIN"))
#: All rules that one line decides. Of several patterns a line must hold each; a last one is what its file must hold.
RULES = tuple(r for r in LINE_RULES if r[:2] not in IN_BLOCKS) + (
    ("SEC-004", "KOTLIN", r"\.exec\(.*Runtime|Runtime.*\.exec\(", "", "", 0.96),
    ("SEC-005", "KOTLIN", (r"(rawQuery|execSQL|prepareStatement|createQuery)\(", r"[$+]"), "", "", 0.97),
    ("SEC-005", "KOTLIN", (r"sql =|query =|val sql|val query", r"(?i)(select |insert |update |delete )", r"[$+]"), "", "", 0.97),
    ("SEC-006", "KOTLIN", (r"File\(|FileInputStream\(|Path\.of\(", r"[$+]"), "", r"\.normalize\(\)|\.canonicalFile", 0.95),
    ("SEC-012", "KOTLIN", (r"URL\(", r"\.(openConnection|readText|openStream)\(\)"), "", "allowlist|whitelist", 0.95),
    ("SEC-019", "KOTLIN", r"Random\(\)|java\.util\.Random|kotlin\.random\.Random", "", "", 0.94, "(?i)token|secret|password"),
    ("SEC-005", "JAVASCRIPT,TYPESCRIPT", (r"\.query\(|db\.execute\(", r"\$\{|\+"), "", "", 0.98),
    ("SEC-013", "JAVASCRIPT,TYPESCRIPT", (r"jwt\.verify\(", r"algorithms: \[('none'|\"none\")\]|algorithm: 'none'"), "", "", 0.99),
    ("SEC-001", "PYTHON", r"\bDEBUG['\"]?\]?\s*=\s*True\b|\.run\(.*\bdebug\s*=\s*True\b|\bALLOWED_HOSTS\s*=\s*[\[(]\s*['\"]\*['\"]", "", "", 0.95),
    ("SEC-001", "PYTHON", r"\.set_cookie\(\s*['\"](?i)[\w-]*(session|auth|token|jwt|csrf|sid)", r"httponly\s*=\s*True.*secure\s*=\s*True|secure\s*=\s*True.*httponly\s*=\s*True", "", 0.95),
    ("SEC-005", "PYTHON", r"\.objects\.raw\(\s*(f['\"]|['\"].*['\"]\s*[%+]|['\"].*['\"]\.format)", "", "", 0.96),
    ("SEC-010", "PYTHON", r"\ballow_origins\s*=\s*[\[(]\s*['\"]\*['\"]", "", "", 0.98, r"\ballow_credentials\s*=\s*True\b"),
    ("SEC-020", "PYTHON", r"\b(render_template_string|Markup|mark_safe)\(\s*([A-Za-z_][\w.\[\]]*\s*[,)]|f['\"]|['\"].*['\"]\s*[%+]|['\"].*['\"]\.format)", r"^\s*def\s", "", 0.95),
    ("SEC-018", "JAVASCRIPT,TYPESCRIPT", r"crypto\.createCipher(iv)?\(\s*['\"]des[^'\"]*['\"]", "", "", 0.99),
)
#: By rule and a language: texts in lower case of which a file that breaks the rule holds one; cheaper to see than patterns.
HINTS = {
    ("SEC-001", "PYTHON"): ("debug", "allowed_hosts", "set_cookie"), ("SEC-020", "PYTHON"): ("render_template_string", "markup(", "mark_safe"), ("SEC-002", "PYTHON"): ("open",), ("SEC-004", "JAVA"): ("getruntime", "processbuilder"), ("SEC-004", "PYTHON"): ("os.", "subprocess."), ("SEC-004", "JAVASCRIPT"): ("exec", "eval"),
    ("SEC-004", "KOTLIN"): ("runtime",), ("SEC-005", "JAVA"): ("select", "insert", "update", "delete"), ("SEC-005", "PYTHON"): ("execute", ".raw("), ("SEC-005", "JAVASCRIPT"): ("select", "insert", "update", "delete", ".query(", "db.execute("),
    ("SEC-005", "KOTLIN"): ("rawquery(", "execsql(", "preparestatement(", "createquery(", "select ", "insert ", "update ", "delete "), ("SEC-006", "JAVA"): ("new file(", "paths.get("), ("SEC-006", "PYTHON"): ("open",),
    ("SEC-006", "KOTLIN"): ("file(", "fileinputstream(", "path.of("), ("SEC-007", "JAVA"): (".readobject", ".readunshared"), ("SEC-007", "PYTHON"): ("pickle.", "yaml."), ("SEC-009", "JAVA"): ("csrf",), ("SEC-009", "PYTHON"): ("@csrf_exempt",),
    ("SEC-010", "JAVA"): ("@crossorigin", "allowedorigins("), ("SEC-010", "PYTHON"): ("cors(", "allow_origins"), ("SEC-012", "JAVASCRIPT"): ("fetch", "axios.get", "http.get"), ("SEC-012", "PYTHON"): ("requests.",), ("SEC-012", "KOTLIN"): ("url(",),
    ("SEC-013", "JAVASCRIPT"): ("jwt.verify(",), ("SEC-018", "PYTHON"): ("hashlib.",), ("SEC-018", "JAVA"): ("getinstance(",), ("SEC-018", "JAVASCRIPT"): ("createhash(", "createcipher"), ("SEC-019", "JAVASCRIPT"): ("math.random()",),
    ("SEC-019", "KOTLIN"): ("random",), ("SEC-020", "JAVASCRIPT"): ("innerhtml", "document.write(", "dangerouslysetinnerhtml"), ("ARCH-003", "JAVA"): ("system.", "math.random()", "new random("),
}

#: A function's head by language, with its name as a group.
FUNCTION = (
    r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)|\bfun\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)|\bfunction\s*\*?\s*([A-Za-z_]\w*)"
    r"|^\s*(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)+[A-Za-z_][\w<>\[\], .]*\s+([A-Za-z_]\w*)\s*\("
    r"|^\s*(?:export\s+)?const\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\("
)


def first_secret(line: Column) -> Column:
    """The first secret pattern of a line, by priority, or null."""
    found = F.lit(None).cast("string")
    for name, pattern, _ in reversed(SECRETS):
        found = F.when(line.rlike(pattern), name).otherwise(found)
    return found


def secret_findings(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, pattern, severity, masked, entropy, fingerprint): at most one secret a line, by priority.

    The entropy is that of the line's longest run of 16 or more token characters, 0 without one. Null texts give no
    rows; repeated inspections are reported row by row.
    """
    each = C.lines(sources, "source_id", "file_path").withColumn("pattern", first_secret(F.col("line"))).where("pattern is not null")
    runs = F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_\-]{16,}"), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("run"))))["run"], F.lit(""))
    severity = F.when(F.col("pattern") == "generic_key", "HIGH").otherwise("CRITICAL")
    return each.select(
        "source_id", "line_no", "pattern", severity.alias("severity"), C.masked(F.trim("line")).alias("masked"), F.round(C.entropy(longest), 6).alias("entropy"),
        C.finding_fingerprint(F.col("file_path"), F.lit("SEC-008"), F.lit(None).cast("string"), F.col("line")).alias("fingerprint"),
    )


def _known(sources: DataFrame, *keep: str) -> DataFrame:
    """Files of known languages with text."""
    return sources.select("source_id", *keep, "raw_source", C.language_of(F.col("file_path")).alias("language")).where("language is not null and raw_source is not null")


def rule_lines(sources: DataFrame, *keep: str, rules: tuple = RULES) -> DataFrame:
    """keep, (source_id, line_no, rule_key, confidence): all rules that a line breaks by itself, once, with the highest confidence.

    One pass over the lines. A rule of a language the file is not in, with a pattern the line must not hold, or taken
    back by its file, does not fire; its patterns are looked for only in files that hold one of its hints. Files of
    unknown languages and null texts give no rows; a source_id that comes twice is reported twice.
    """
    lang, text, line, low = F.col("language"), F.col("raw_source"), F.col("line"), F.lower("raw_source")
    fires: dict[tuple[str, float], Column] = {}
    flags = {}
    for i, (key, langs, must, must_not, file_not, confidence, *file_must) in enumerate(rules):
        hints = HINTS.get((key, langs.split(",")[0]), ("",))
        may = lang.isin(langs.split(",")) & reduce(or_, [low.contains(h) for h in hints])
        for pattern in file_must:
            may &= text.rlike(pattern)
        flags[f"t{i}"] = may & ~text.rlike(file_not) if file_not else may
        broken = F.col(f"t{i}")
        for pattern in (must,) if isinstance(must, str) else must:
            broken &= line.rlike(pattern)
        if must_not:
            broken &= ~line.rlike(must_not)
        fires[key, confidence] = fires[key, confidence] | broken if (key, confidence) in fires else broken
    each = C.lines(spread(_known(sources, *keep)).withColumns(flags), "source_id", *keep, "language", *flags)
    # Of a rule's confidences the highest that applies; so no line has a rule twice.
    checked = []
    for key in dict.fromkeys(k for k, _ in fires):
        found = F.lit(None).cast("double")
        for confidence in sorted(c for k, c in fires if k == key):
            found = F.when(fires[key, confidence], confidence).otherwise(found)
        checked.append(F.struct(F.lit(key).alias("rule_key"), found.alias("confidence")))
    some = each.select("source_id", *keep, "line_no", F.explode(F.filter(F.array(*checked), lambda x: x["confidence"].isNotNull())).alias("f"))
    return some.select("source_id", *keep, "line_no", "f.*")


def line_findings(sources: DataFrame, *keep: str) -> DataFrame:
    """keep, (source_id, line_no, rule_key, confidence): rule_lines, and rules whose condition needs more than the line."""
    blocks = block_findings(_known(sources, *keep), *keep)
    both = rule_lines(sources, *keep).unionByName(blocks)
    return both.groupBy("source_id", *keep, "line_no", "rule_key").agg(F.max("confidence").alias("confidence"))


def is_head(line: Column) -> Column:
    """Whether a line begins a function: it needs a parenthesis, which is cheaper to see than the pattern."""
    return line.contains("(") & line.rlike(FUNCTION)


def enclosing_functions(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, line, function): every line with the last function head at or before it, or moduleScope."""
    names = [F.regexp_extract("line", FUNCTION, i) for i in range(1, 6)]
    name = F.when(is_head(F.col("line")), F.coalesce(*[F.when(n != "", n) for n in names]))
    upto = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return C.lines(sources, "source_id").withColumn("function", F.coalesce(F.last(name, ignorenulls=True).over(upto), F.lit("moduleScope")))


def function_spans(sources: DataFrame) -> DataFrame:
    """(source_id, function, start_line, end_line): each function from its head to the line before the next head or the end."""
    rows = enclosing_functions(sources).where("function != 'moduleScope'")
    head = is_head(F.col("line"))
    run = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("nth", F.sum(head.cast("int")).over(run)).groupBy("source_id", "nth", "function").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("nth")


def suppressed(findings: DataFrame, sources: DataFrame, marker: str) -> DataFrame:
    """findings with suppressed_by: the first line from the one before to the one after that holds the marker, or null.

    The neighbourhood is an equi-join on (source_id, line), each marked line standing for the three it covers.
    """
    marked = C.lines(sources, "source_id").where(F.col("line").rlike(marker)).select("source_id", F.col("line_no").alias("marker_line"), F.explode(F.array(F.col("line_no") - 1, F.col("line_no"), F.col("line_no") + 1)).alias("line_no"))
    nearest = marked.groupBy("source_id", "line_no").agg(F.min("marker_line").alias("suppressed_by"))
    return findings.join(nearest, ["source_id", "line_no"], "left")


def headers(sources: DataFrame) -> DataFrame:
    """(source_id, language, package, imports, primary_class): by pattern, for Java, Kotlin, JavaScript and TypeScript.

    The first public class is the primary one, else the first class; UnknownClass without any.
    """
    text = F.col("raw_source")
    first = F.regexp_extract(text, r"(?:class|interface|enum|object)\s+([A-Z]\w*)", 1)
    public = F.regexp_extract(text, r"public\s+(?:final\s+|abstract\s+)?(?:class|interface|enum)\s+([A-Z]\w*)", 1)
    imports = F.when(F.col("language").isin("JAVA", "KOTLIN"), F.regexp_extract_all(text, F.lit(r"(?m)^import\s+(?:static\s+)?([\w.]+)"), F.lit(1))).otherwise(
        F.regexp_extract_all(text, F.lit(r"(?:from\s+|require\()['\"]([^'\"]+)['\"]"), F.lit(1))
    )
    rows = sources.withColumn("language", C.language_of(F.col("file_path"))).where("raw_source is not null and language in ('JAVA', 'KOTLIN', 'JAVASCRIPT', 'TYPESCRIPT')")
    return rows.select(
        "source_id", "repository_id", "language", F.regexp_extract(text, r"(?m)^package\s+([\w.]+)", 1).alias("package"), imports.alias("imports"),
        F.coalesce(F.when(public != "", public), F.when(first != "", first), F.lit("UnknownClass")).alias("primary_class"),
    )


def facts(sources: DataFrame) -> DataFrame:
    """(source_id, kind, line_no, name): calls, object creations, annotations, imports, classes and functions by line.

    A lexical form of syntax facts: names are read from each line, in their order; comments are not told apart.
    """
    kinds = {
        "annotation": r"@([A-Za-z_][\w.]*)", "creation": r"\bnew\s+([A-Z][\w.]*)", "call": r"([A-Za-z_][\w.]*)\s*\(",
        "class": r"\b(?:class|interface|enum|object)\s+([A-Z]\w*)", "import": r"^\s*(?:import|from)\s+([\w.]+)",
    }

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    all_ = F.array(*[named(*k) for k in kinds.items()])
    return C.lines(sources, "source_id").select("source_id", "line_no", F.explode(F.flatten(all_)).alias("f")).select("source_id", "line_no", "f.kind", "f.name")
