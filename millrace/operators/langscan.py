"""Scanners of languages without a parser here: line rules, and the import graph of TypeScript and JavaScript.

These find what a line or an import statement shows.  A file of such a language stays
incomplete: no finding does not mean that it is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import reachable

_TS = ["typescript", "javascript"]
#: Rules on lines: languages, rule, severity, pattern, pattern that takes the line out.
LINE_RULES = [
    (_TS, "SKY-D201", "HIGH", r"(^|[^\w.])eval\s*\(", None),
    (_TS, "SKY-D202", "HIGH", r"new\s+Function\s*\(|set(Timeout|Interval)\s*\(\s*['\"`]", None),
    (_TS, "SKY-D212", "CRITICAL", r"(child_process\.)?exec(Sync)?\s*\(\s*(`[^`]*\$\{|[\"'][^\"']*[\"']\s*\+)", None),
    (_TS, "SKY-D226", "CRITICAL", r"\.(innerHTML|outerHTML)\s*=(?!=)|dangerouslySetInnerHTML|document\.write\s*\(", r"=\s*[\"'][^\"'$]*[\"'];?\s*$|sanitize"),
    (_TS, "SKY-D211", "CRITICAL", r"\.(query|execute|raw)\s*\(\s*(`[^`]*\$\{|[\"'][^\"']*[\"']\s*\+)", None),
    (_TS, "SKY-D207", "MEDIUM", r"createHash\s*\(\s*[\"']md5", None),
    (_TS, "SKY-D208", "MEDIUM", r"createHash\s*\(\s*[\"']sha1", None),
    (_TS, "SKY-D210", "HIGH", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED", None),
    (_TS, "SKY-D230", "HIGH", r"\.redirect\s*\(\s*req\.(query|body|params)", None),
    (_TS, "SKY-D245", "HIGH", r"[^\w]require\s*\(\s*[^\"'`)\s]", None),
    (_TS, "SKY-D246", "HIGH", r"jwt\.decode\s*\(|jwtDecode\s*\(", None),
    (_TS, "SKY-D247", "MEDIUM", r"Access-Control-Allow-Origin[\"']\s*,\s*[\"']\*|origin\s*:\s*[\"']\*[\"']", None),
    (_TS, "SKY-D250", "MEDIUM", r"(?i)(token|secret|password|nonce|session|id)\w*\s*=.*Math\.random\s*\(", None),
    (_TS, "SKY-D251", "HIGH", r"(?i)console\.(log|info|debug|warn|error)\s*\([^)]*(password|secret|token|apikey)", None),
    (_TS, "SKY-D253", "MEDIUM", r"(?i)(password|secret|token|hash|signature)\s*(===|==|!==)\s*\w", r"(null|undefined|[\"']{2}|typeof)"),
    (_TS, "SKY-D270", "MEDIUM", r"(?i)(local|session)Storage\.setItem\s*\(\s*[\"'][^\"']*(token|secret|password|jwt)", None),
    (_TS, "SKY-D510", "HIGH", r"\[[\"']__proto__[\"']\]|\.__proto__\s*=", None),
    (_TS, "SKY-D216", "CRITICAL", r"\b(fetch|axios(\.\w+)?|got|request)\s*\(\s*req\.(query|body|params)", None),
    (_TS, "SKY-D215", "HIGH", r"\b(readFile|writeFile|createReadStream|unlink)(Sync)?\s*\(\s*req\.(query|body|params)", None),
    (_TS, "SKY-D271", "MEDIUM", r"\.(send|json|end)\s*\(.*\b(err|error|e)\.(stack|message)", None),
    (_TS, "SKY-D281", "CRITICAL", r"\$(queryRawUnsafe|executeRawUnsafe)\s*\(", None),
    (_TS, "SKY-S102", "HIGH", r"(NEXT_PUBLIC|REACT_APP|VITE)_\w*(SECRET|PRIVATE|PASSWORD)", None),
    (["java", "kotlin"], "SKY-D254", "HIGH", r"[sS]ession(\(\))?\.setAttribute\s*\(.*getParameter\s*\(", None),
    (["java", "kotlin"], "SKY-D215", "HIGH", r"new\s+File(InputStream|Reader|OutputStream)?\s*\(.*getParameter\s*\(", None),
    (["java", "kotlin"], "SKY-D230", "HIGH", r"sendRedirect\s*\(.*getParameter\s*\(", None),
    (["go"], "SKY-D215", "HIGH", r"os\.(Open|ReadFile|Create|Remove)\s*\(.*r\.(URL\.Query|FormValue|PostFormValue)", None),
    (["go"], "SKY-D216", "CRITICAL", r"http\.(Get|Post|Head)\s*\(\s*r\.(URL\.Query|FormValue|PostFormValue)", None),
    (["go"], "SKY-D230", "HIGH", r"http\.Redirect\s*\(.*r\.(URL\.Query|FormValue|PostFormValue)", None),
    (["go"], "SKY-D252", "MEDIUM", r"\b(Secure|HttpOnly)\s*:\s*false", None),
    (["java", "kotlin"], "SKY-D203", "CRITICAL", r"Runtime\.getRuntime\(\)\.exec\s*\(|new\s+ProcessBuilder\s*\([^\"']*\+", None),
    (["java", "kotlin"], "SKY-D204", "CRITICAL", r"new\s+ObjectInputStream\s*\(|\.readObject\s*\(\s*\)", None),
    (["java", "kotlin"], "SKY-D207", "MEDIUM", r"MessageDigest\.getInstance\s*\(\s*\"MD5\"", None),
    (["java", "kotlin"], "SKY-D208", "MEDIUM", r"MessageDigest\.getInstance\s*\(\s*\"SHA-?1\"", None),
    (["java", "kotlin"], "SKY-D211", "CRITICAL", r"\.(executeQuery|executeUpdate|execute|createQuery|prepareStatement)\s*\(\s*\"[^\"]*\"\s*\+", None),
    (["java", "kotlin"], "SKY-D250", "MEDIUM", r"new\s+(java\.util\.)?Random\s*\(|Math\.random\s*\(", None),
    (["java", "kotlin"], "SKY-D252", "MEDIUM", r"\.set(Secure|HttpOnly)\s*\(\s*false", None),
    (["go"], "SKY-D207", "MEDIUM", r"\bmd5\.(New|Sum)\b", None),
    (["go"], "SKY-D208", "MEDIUM", r"\bsha1\.(New|Sum)\b", None),
    (["go"], "SKY-D210", "HIGH", r"InsecureSkipVerify\s*:\s*true", None),
    (["go"], "SKY-D211", "CRITICAL", r"\.(Query|QueryRow|Exec)(Context)?\s*\(.*(fmt\.Sprintf\s*\(|\"\s*\+)", None),
    (["go"], "SKY-D212", "CRITICAL", r"exec\.Command\s*\(\s*\"(sh|bash)\"\s*,\s*\"-c\"\s*,\s*[^\"]", None),
    (["go"], "SKY-D250", "MEDIUM", r"^\s*(\w+\s+)?\"math/rand\"", None),
    (["go"], "SKY-G206", "HIGH", r"^\s*(\w+\s+)?\"unsafe\"", None),
    (["go"], "SKY-G280", "HIGH", r"MinVersion\s*:\s*tls\.Version(SSL30|TLS10|TLS11)", None),
    (["php"], "SKY-D201", "HIGH", r"(^|[^\w>:])(eval|assert)\s*\(\s*\$", None),
    (["php"], "SKY-D203", "CRITICAL", r"(^|[^\w>:])(system|exec|shell_exec|passthru|popen)\s*\([^)]*\$", r"escapeshell"),
    (["php"], "SKY-D204", "CRITICAL", r"\bunserialize\s*\(\s*\$", None),
    (["php"], "SKY-D211", "CRITICAL", r"(mysqli?_query|->query)\s*\([^)]*\$_(GET|POST|REQUEST)", None),
    (["php"], "SKY-D226", "CRITICAL", r"\becho\b[^;]*\$_(GET|POST|REQUEST|COOKIE)", r"htmlspecialchars|htmlentities"),
    (["rust"], "SKY-D210", "HIGH", r"danger_accept_invalid_(certs|hostnames)\s*\(\s*true", None),
    (["rust"], "SKY-D212", "CRITICAL", r"Command::new\s*\(\s*\"(sh|bash)\"\s*\)", None),
    (["csharp"], "SKY-D204", "CRITICAL", r"new\s+BinaryFormatter\s*\(", None),
    (["csharp"], "SKY-D207", "MEDIUM", r"MD5\.Create\s*\(", None),
    (["csharp"], "SKY-D211", "CRITICAL", r"new\s+SqlCommand\s*\(\s*(\$\"|\"[^\"]*\"\s*\+)", None),
    (["dart"], "SKY-D210", "HIGH", r"badCertificateCallback\s*=.*true", None),
    (["shell"], "SKY-D201", "HIGH", r"(^|[;&|]\s*)eval\s+.*\$", None),
]
#: Starts of comment lines by language family.
COMMENT = r"^\s*(//|\*|/\*|#)"


def scan_languages(files: DataFrame) -> DataFrame:
    """``rule_id, severity, path, line`` of the line rules over ``SOURCE_FILES`` of all languages but Python; comment lines count for none."""
    lines = files.where("lang is not null and lang <> 'python'").select("path", "lang", F.posexplode(F.split("text", "\r?\n")).alias("k", "text")).where(~F.col("text").rlike(COMMENT))
    hits = []
    for langs, rule, severity, fits, unless in LINE_RULES:
        ok = F.col("lang").isin(*langs) & F.col("text").rlike(fits)
        ok = ok & ~F.col("text").rlike(unless) if unless else ok
        hits.append(F.when(ok, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))))
    return lines.select("path", (F.col("k") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line", "h.rule_id", "h.severity")


#: Shapes of definitions: languages, type, pattern with the name as its group, pattern of lines whose names others may use (null: the name decides).
DEFINITIONS = [
    (["go"], "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", None),
    (["go"], "class", r"^type\s+(\w+)\s+(?:struct|interface|\w)", None),
    (["java", "kotlin", "csharp"], "function", r"^\s*(?:(?:public|private|protected|internal|static|final|override|async|virtual|synchronized)\s+)+(?:fun\s+|[\w<>\[\],.?]+\s+)+(\w+)\s*\([^;]*$", r"^(?!.*\bprivate\b)"),
    (["java", "kotlin", "csharp"], "class", r"\b(?:class|interface|enum|record)\s+(\w+)", r"^(?!.*\bprivate\b)"),
    (_TS, "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)", r"\bexport\b"),
    (_TS, "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", r"\bexport\b"),
    (_TS, "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", r"\bexport\b"),
    (["rust"], "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)", r"\bpub\b"),
    (["rust"], "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"\bpub\b"),
    (["php"], "function", r"^\s*(?:(?:public|private|protected|static|final)\s+)*function\s+(\w+)\s*\(", r"^(?!.*\bprivate\b)"),
    (["shell"], "function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{?", r"^$"),
]
#: Names that run by themselves.
SELF_RUN = r"^(main|init|setUp|tearDown|[tT]est\w*|_+\w*)$"


def definitions(files: DataFrame) -> DataFrame:
    """``path, lang, line, type, name, private``: functions and types that lines of other languages than Python define."""
    lines = files.where("lang is not null and lang <> 'python'").select("path", "lang", F.posexplode(F.split("text", "\r?\n")).alias("k", "text")).where(~F.col("text").rlike(COMMENT))
    hits = []
    for langs, kind, shape, shared in DEFINITIONS:
        name = F.regexp_extract("text", shape, 1)
        public = name.rlike(r"^[A-Z]") if shared is None else F.col("text").rlike(shared)
        hits.append(F.when(F.col("lang").isin(*langs) & (name != ""), F.struct(F.lit(kind).alias("type"), name.alias("name"), (~public).alias("private"))))
    found = lines.select("path", "lang", (F.col("k") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.select("path", "lang", "line", "h.*").distinct()


def unused_private(files: DataFrame) -> DataFrame:
    """``path, line, type, name``: definitions that only their own file (in Go: their folder) can use and that nothing in it names.

    Names are counted in the code without comments and texts; one that stands nowhere but where it is defined is unused.
    """
    scope = F.when(F.col("lang") == "go", F.regexp_replace("path", r"[^/]*$", "")).otherwise(F.col("path"))
    bare = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*|(?m)^\s*#[^\n]*|\"(?:[^\"\\\\\n]|\\\\.)*\"|'(?:[^'\\\\\n]|\\\\.)*'", " ")
    words = files.where("lang is not null and lang <> 'python'").select(scope.alias("scope"), F.explode(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)"), 1)).alias("name"))
    counts = words.groupBy("scope", "name").agg(F.count("*").alias("n"))
    d = definitions(files).withColumn("scope", scope)
    own = d.groupBy("scope", "name").agg(F.count("*").alias("defined"), F.bool_and("private").alias("private")).where("private")
    lone = own.join(counts, ["scope", "name"]).where("n <= defined")
    hit = d.join(lone.select("scope", "name"), ["scope", "name"], "left_semi").where(~F.col("name").rlike(SELF_RUN))
    return hit.select("path", "line", "type", "name")


def _normal(path: Column) -> Column:
    """Path without ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def ts_files(files: DataFrame) -> DataFrame:
    """TypeScript and JavaScript files with the stem that imports name (``index`` files also by their folder)."""
    return files.where(F.col("lang").isin(*_TS)).select("path", "text", F.regexp_replace(F.regexp_replace("path", r"\.[jt]sx?$", ""), r"/index$", "").alias("stem"))


def ts_imports(files: DataFrame) -> DataFrame:
    """``path, name, target``: names that files take from relative modules; ``*`` for whole modules, side effects and re-exports of all."""
    t = ts_files(files)
    statement = r"(?s)(?:import|export)\s+(?:type\s+)?([\w$*{},\s]*?)\s*(?:from\s*)?[\"'](\.[^\"']*)[\"']"
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(statement), 1).alias("what"), F.regexp_extract_all("text", F.lit(statement), 2).alias("source"))
    rows = t.select("path", F.explode(zipped).alias("s")).select("path", "s.what", "s.source")
    calls = t.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?:require|import)\s*\(\s*[\"'](\.[^\"']*)[\"']"), 1)).alias("source")).select("path", F.lit("*").alias("what"), "source")
    every = rows.unionByName(calls)
    base = F.regexp_replace("path", r"[^/]*$", "")
    target = F.regexp_replace(F.regexp_replace(_normal(F.concat(base, F.col("source"))), r"\.[jt]sx?$", ""), r"/index$", "")
    inside = F.regexp_extract("what", r"\{([^}]*)\}", 1)
    named = F.transform(F.filter(F.split(inside, ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_extract(F.trim(x), r"^(?:type\s+)?([\w$]+)", 1))
    outer = F.trim(F.regexp_replace("what", r"\{[^}]*\}|,", " "))
    default = F.when(outer.contains("*") | ((outer == "") & (F.size(named) == 0)), F.array(F.lit("*"))).when(outer != "", F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    return every.select("path", F.explode(F.concat(named, default)).alias("name"), target.alias("target"))


def ts_exports(files: DataFrame) -> DataFrame:
    """``path, stem, name``: what files export by name or as default."""
    t = ts_files(files)
    direct = F.regexp_extract_all("text", F.lit(r"export\s+(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function\*?|class|interface|type|enum)\s+([\w$]+)"), 1)
    lists = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"export\s+(?:type\s+)?\{([^}]*)\}"), 1), lambda x: F.transform(F.filter(F.split(x, ","), lambda y: F.trim(y) != ""), lambda y: F.regexp_extract(F.trim(y), r"([\w$]+)$", 1))))
    default = F.when(F.col("text").rlike(r"export\s+default\b"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    return t.select("path", "stem", F.explode(F.array_distinct(F.concat(direct, lists, default))).alias("name"))


#: Files that programs start from or tools read by name.
TS_ENTRIES = r"(^|/)(index|main|app|server|cli|setup|[^/]*\.(test|spec|config|d|stories))\.[jt]sx?$|(^|/)(pages|app|api|tests?|__tests__|scripts|bin)/"


def ts_unused(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that no entry reaches (``path``), and exports of other files that nothing takes (``path, name``).

    Without any entry no file is called unused.
    """
    t, imports = ts_files(files), ts_imports(files)
    stems = t.select(F.col("path").alias("to"), F.col("stem").alias("target"))
    edges = imports.join(stems, "target").select(F.col("path").alias("src"), F.col("to").alias("dst")).distinct()
    roots = t.where(F.col("path").rlike(TS_ENTRIES)).select(F.col("path").alias("node"))
    if not roots.limit(1).count():
        dead = t.select("path").limit(0)
    else:
        dead = t.select("path").join(reachable(edges, roots).select(F.col("node").alias("path")), "path", "left_anti")
    whole = imports.where("name = '*'").select(F.col("target").alias("stem")).distinct()
    named = imports.select(F.col("target").alias("stem"), "name").distinct()
    exports = ts_exports(files).where(~F.col("path").rlike(TS_ENTRIES))
    unused = exports.join(whole, "stem", "left_anti").join(named, ["stem", "name"], "left_anti").join(dead, "path", "left_anti")
    return dead, unused.select("path", "name")
