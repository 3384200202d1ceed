"""Code rules as filters and joins over extracted facts; every rule gives rows of one findings shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.sources.files import module_name

COLUMNS = ["rule_id", "kind", "severity", "category", "name", "value", "threshold", "message", "file", "line"]

#: Thresholds of the metric rules.
DEFAULTS = {"complexity": 10, "cognitive": 15, "nesting": 3, "required_args": 5, "total_args": 10, "max_lines": 50, "methods": 20, "attributes": 15, "god_file_lines": 500, "god_file_definitions": 40, "god_file_top_level": 25, "duplicate_strings": 3, "returns": 5, "cbo": 4, "lcom4": 2}

#: Calls that are findings by themselves: rule, severity, and a keyword that must have a value.
DANGEROUS_CALLS = [
    ("eval", "SKY-D201", "HIGH", None),
    ("exec", "SKY-D202", "HIGH", None),
    ("os.system", "SKY-D203", "CRITICAL", None),
    ("pickle.load", "SKY-D204", "CRITICAL", None),
    ("pickle.loads", "SKY-D205", "CRITICAL", None),
    ("yaml.load", "SKY-D206", "HIGH", None),
    ("hashlib.md5", "SKY-D207", "MEDIUM", None),
    ("hashlib.sha1", "SKY-D208", "MEDIUM", None),
    ("subprocess.*", "SKY-D209", "HIGH", ("shell", "True")),
    ("requests.*", "SKY-D210", "HIGH", ("verify", "False")),
    ("ssl._create_unverified_context", "SKY-D210", "HIGH", None),
    ("marshal.loads", "SKY-D233", "CRITICAL", None),
    ("shelve.open", "SKY-D233", "HIGH", None),
    ("jsonpickle.decode", "SKY-D233", "CRITICAL", None),
    ("dill.loads", "SKY-D233", "CRITICAL", None),
    ("dill.load", "SKY-D233", "CRITICAL", None),
    ("*.exec_command", "SKY-D235", "HIGH", None),
    ("flask.Flask.run", "SKY-D346", "HIGH", ("debug", "True")),
    ("*.run", "SKY-D346", "HIGH", ("debug", "True")),
    ("logging.config.listen", "SKY-D347", "MEDIUM", None),
    ("tempfile.mktemp", "SKY-D348", "HIGH", None),
]
#: Weak random sources, and names whose values must not come from one.
WEAK_RANDOM = ["random.random", "random.randint", "random.randrange", "random.choice", "random.choices", "random.randbytes", "random.getrandbits"]
SENSITIVE_NAME = r"(?i)(token|secret|password|passwd|nonce|salt|session|csrf|otp|api_?key|auth)"

#: Sinks of outside data: rule, severity, and whether the first argument must be built text.
FLOW_SINKS = [
    (r"(^|\.)(execute|executemany|executescript)$", "SKY-D211", "CRITICAL", "built"),
    (r"(^|\.)(text|raw|RawSQL)$", "SKY-D217", "CRITICAL", "built"),
    (r"^(os\.system|os\.popen|commands\.getoutput|os\.exec\w+|os\.spawn\w+)$", "SKY-D212", "CRITICAL", "first"),
    (r"^subprocess\.(run|call|Popen|check_output|check_call|getoutput)$", "SKY-D212", "CRITICAL", "shell"),
    (r"^(open|io\.open|os\.(open|remove|unlink|rename|listdir)|shutil\.\w+|pathlib\.Path|(\w+\.)*send_file)$", "SKY-D215", "HIGH", "first"),
    (r"^(requests|httpx)\.(get|post|put|delete|patch|head|request)$|^urllib\.request\.(urlopen|Request)$", "SKY-D216", "CRITICAL", "first"),
    (r"(^|\.)(Markup|mark_safe)$", "SKY-D226", "CRITICAL", "first"),
    (r"(^|\.)render_template_string$", "SKY-D227", "HIGH", "first"),
    (r"(^|\.)(redirect|HttpResponseRedirect)$", "SKY-D230", "HIGH", "first"),
    (r"(^|\.)(HttpResponse|make_response)$", "SKY-D228", "HIGH", "built"),
    (r"(^|\.)(torch\.load|joblib\.load)$", "SKY-D265", "CRITICAL", "first"),
    (r"(^|\.)(completions\.create|messages\.create|generate_content)$", "SKY-D261", "HIGH", "any"),
]

#: Findings of single syntax patterns.
PATTERN_RULES = {
    "mutable_default": ("SKY-L001", "HIGH"),
    "bare_except": ("SKY-L002", "MEDIUM"),
    "constant_comparison": ("SKY-L003", "LOW"),
    "long_try": ("SKY-L004", "MEDIUM"),
    "unused_exception": ("SKY-L005", "LOW"),
    "empty_handler": ("SKY-L007", "MEDIUM"),
    "unfinished": ("SKY-L026", "MEDIUM"),
    "broad_trivial": ("SKY-L030", "MEDIUM"),
    "no_effect": ("SKY-L033", "MEDIUM"),
    "duplicate_branch": ("SKY-Q305", "MEDIUM"),
    "nested_loop": ("SKY-P403", "LOW"),
    "unreachable": ("SKY-UC001", "MEDIUM"),
    "await_in_loop": ("SKY-Q402", "MEDIUM"),
    "unclosed_resource": ("SKY-L008", "MEDIUM"),
    "error_disclosure": ("SKY-L017", "MEDIUM"),
}
#: Calls that block, and reads that take all at once.
BLOCKING_CALLS = ["time.sleep", "requests.get", "requests.post", "requests.put", "requests.delete", "requests.request", "urllib.request.urlopen", "subprocess.run", "subprocess.call", "subprocess.check_output", "os.system"]
NETWORK_CALLS = ["requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "requests.head", "requests.request", "urllib.request.urlopen"]
DEBUG_CALLS = {"breakpoint": "HIGH", "pdb.set_trace": "HIGH", "ipdb.set_trace": "HIGH", "print": "LOW", "pprint.pprint": "LOW"}


def as_findings(df: DataFrame, rule: Column | str, severity: Column | str, category: str, message: Column, kind: str = "code", value: Column | None = None, threshold: Column | float | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    limit = F.lit(None) if threshold is None else F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return df.select(lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("name"), (F.lit(None) if value is None else value).cast("double").alias("value"), limit.cast("double").alias("threshold"), message.alias("message"), F.col("file"), F.col("line"))


def say(template: str, *columns: str) -> Column:
    return F.format_string(template, *[F.col(c).cast("string") for c in columns])


def metric_rules(functions: DataFrame, classes: DataFrame, modules: DataFrame, files: DataFrame, limits: dict | None = None) -> DataFrame:
    """Complexity, nesting, length, argument and size rules, with their severity bands."""
    d = DEFAULTS | (limits or {})
    n = lambda k: F.col("nums")[k]
    simple = F.element_at(F.split("name", r"\."), -1)
    public = ~simple.startswith("_")
    c, g, x = n("complexity"), n("cognitive"), n("nesting")
    typed = F.col("attrs")["returns"].isNotNull()
    # one pass over functions and one over classes: rule, metric, limit, severity, what it counts, further condition
    of_functions = [
        ("SKY-Q301", c, d["complexity"], F.when(c < 15, "WARN").when(c < 25, "HIGH").otherwise("CRITICAL"), "cyclomatic complexity", None),
        ("SKY-Q306", g, d["cognitive"], F.when(g <= 30, "MEDIUM").when(g <= 50, "HIGH").otherwise("CRITICAL"), "cognitive complexity", None),
        ("SKY-Q302", x, d["nesting"], F.when(x <= d["nesting"] + 2, "MEDIUM").when(x <= d["nesting"] + 5, "HIGH").otherwise("CRITICAL"), "nesting depth", None),
        ("SKY-C303", n("required"), d["required_args"], F.lit("MEDIUM"), "required arguments", None),
        ("SKY-C303", n("args"), d["total_args"], F.lit("LOW"), "arguments", n("required") <= d["required_args"]),
        ("SKY-C304", n("length"), d["max_lines"], F.when(n("length") < 100, "MEDIUM").otherwise("HIGH"), "lines in function", None),
        ("SKY-L028", n("returns"), d["returns"], F.lit("MEDIUM"), "return statements", None),
        ("SKY-L029", n("boolean_args"), 1, F.lit("MEDIUM"), "boolean parameters", None),
        ("SKY-L006", n("value_returns"), 0, F.lit("MEDIUM"), "returns with a value among returns without", n("bare_returns") > 0),
        ("SKY-T101", n("untyped"), 0, F.lit("MEDIUM"), "public parameters without annotation", public),
        ("SKY-T102", (~typed).cast("double"), 0, F.lit("MEDIUM"), "public function without return annotation", public),
    ]
    tolerated = F.when(F.col("attrs")["data"] == "True", 6).otherwise(d["lcom4"])
    of_classes = [
        ("SKY-Q501", n("methods"), d["methods"], F.lit("MEDIUM"), "methods", None),
        ("SKY-Q501", n("attributes"), d["attributes"], F.lit("MEDIUM"), "attributes", n("methods") <= d["methods"]),
        ("SKY-Q702", n("lcom4"), d["lcom4"], F.when(n("lcom4") > 4, "HIGH").otherwise("MEDIUM"), "groups of unrelated methods", n("lcom4") > tolerated),
    ]
    out = [_over(functions, of_functions), _over(classes, of_classes)]
    sized = modules.join(files.select(F.col("path").alias("file"), "loc"), "file")
    over = [(F.col("loc"), d["god_file_lines"]), (n("definitions"), d["god_file_definitions"]), (n("top_level"), d["god_file_top_level"])]
    violations = sum(((v > lim).cast("int") for v, lim in over), F.lit(0))
    worst = F.greatest(*[v / float(lim) for v, lim in over])
    god = sized.where(violations > 0)
    out.append(as_findings(god, "SKY-Q502", F.when((worst >= 1.5) | (violations >= 2), "HIGH").otherwise("MEDIUM"), "quality", say("file of %s lines", "loc"), value=F.col("loc"), threshold=d["god_file_lines"]))
    empty = modules.where(n("statements") == 0)
    out.append(as_findings(empty, "SKY-E002", "LOW", "dead_code", F.lit("file without statements")))
    return union_all(out)


def _over(rows: DataFrame, checks: list[tuple]) -> DataFrame:
    """Findings of rows that exceed limits, all checks in one pass."""
    hits = []
    for rule, metric, limit, severity, what, also in checks:
        over = metric > limit if also is None else (metric > limit) & also
        message = F.format_string(f"{what}: %s", metric.cast("int").cast("string"))
        hits.append(F.when(over, F.struct(F.lit(rule).alias("r"), severity.alias("s"), metric.cast("double").alias("v"), F.lit(float(limit)).alias("t"), message.alias("m"))))
    found = rows.withColumn("_h", F.explode(F.array_compact(F.array(*hits))))
    return as_findings(found, F.col("_h.r"), F.col("_h.s"), "quality", F.col("_h.m"), value=F.col("_h.v"), threshold=F.col("_h.t"))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_rules(patterns: DataFrame) -> DataFrame:
    """Rules on single syntax patterns."""
    rule, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (r, s) in PATTERN_RULES.items():
        rule, severity = F.when(F.col("name") == k, r).otherwise(rule), F.when(F.col("name") == k, s).otherwise(severity)
    hit = patterns.withColumns({"_r": rule, "_s": severity}).where("_r is not null")
    return as_findings(hit.withColumn("name", F.col("scope")), F.col("_r"), F.col("_s"), "quality", F.concat(F.lit("pattern "), F.col("_r")))


def call_rules(calls: DataFrame) -> DataFrame:
    """Dangerous calls: a semi-join of calls with the rule dictionary, keyword conditions included."""
    checks = []
    for name, rule, severity, keyword in DANGEROUS_CALLS:
        fits = F.col("name").startswith(name[:-1]) if name.endswith(".*") else F.col("name").endswith(name[1:]) if name.startswith("*") else F.col("name") == name
        if keyword:
            fits = fits & (F.col("attrs")[f"kw:{keyword[0]}"] == keyword[1])
        if name == "yaml.load":
            fits = fits & ~F.coalesce(F.col("attrs")["kw:Loader"].rlike("Safe|Base"), F.lit(False))
        checks.append(F.when(fits, F.struct(F.lit(rule).alias("r"), F.lit(severity).alias("s"))))
    hit = calls.withColumn("_h", F.coalesce(*checks)).where("_h is not null")
    return as_findings(hit, F.col("_h.r"), F.col("_h.s"), "security", say("call of %s", "name"))


def random_rule(calls: DataFrame) -> DataFrame:
    """Weak random values in functions whose name says that they matter."""
    hit = calls.where(F.col("name").isin(*WEAK_RANDOM) & F.col("scope").rlike(SENSITIVE_NAME))
    return as_findings(hit, "SKY-D250", "MEDIUM", "security", say("weak random source %s", "name"))


def flow_rules(flows: DataFrame) -> DataFrame:
    """Outside data in sinks: flows joined with the sink table; the first sink that fits."""
    a = F.col("attrs")
    checks = []
    for pattern, rule, severity, need in FLOW_SINKS:
        fits = F.col("name").rlike(pattern) & (a["any"] == "True")
        if need == "built":
            fits = fits & (a["built"] == "True") & (a["first"] == "True")
        elif need == "first":
            fits = fits & (a["first"] == "True")
        elif need == "shell":
            fits = fits & (a["shell"] == "True")
        checks.append(F.when(fits, F.struct(F.lit(rule).alias("r"), F.lit(severity).alias("s"))))
    hit = flows.withColumn("_h", F.coalesce(*checks)).where("_h is not null")
    return as_findings(hit, F.col("_h.r"), F.col("_h.s"), "security", say("outside data reaches %s", "name"), kind="flow")


def behaviour_rules(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Blocking calls in async functions, network calls without timeout, debug leftovers, reads of whole files."""
    is_async = functions.where(F.col("attrs")["async"] == "True").select(F.col("name").alias("scope"), "file").distinct()
    blocking = calls.where(F.col("name").isin(*BLOCKING_CALLS)).join(is_async, ["scope", "file"], "left_semi")
    no_timeout = calls.where(F.col("name").isin(*NETWORK_CALLS) & F.col("attrs")["kw:timeout"].isNull())
    severity = F.lit(None).cast("string")
    for k, s in DEBUG_CALLS.items():
        severity = F.when(F.col("name") == k, s).otherwise(severity)
    debug = calls.withColumn("_s", severity).where("_s is not null")
    whole = calls.where(F.col("name").rlike(r"\.(read|readlines)$") & (F.col("nums")["args"] == 0))
    csv = calls.where((F.col("name") == "pandas.read_csv") & F.col("attrs")["kw:chunksize"].isNull())
    chmod = calls.where(F.col("name").rlike(r"(^os|\.)\.?chmod$") & F.col("attrs")["args"].rlike(r"(^|[ ,])(0o?[0-7]*[2367]|511|438|S_IWOTH)$|S_IWOTH"))
    return union_all([
        as_findings(blocking, "SKY-Q401", "HIGH", "quality", say("%s blocks an async function", "name")),
        as_findings(no_timeout, "SKY-L031", "MEDIUM", "quality", say("%s without timeout", "name")),
        as_findings(debug, "SKY-L009", F.col("_s"), "quality", say("debug leftover %s", "name")),
        as_findings(whole, "SKY-P401", "LOW", "performance", F.lit("whole file in memory")),
        as_findings(csv, "SKY-P402", "LOW", "performance", F.lit("whole table in memory")),
        as_findings(chmod, "SKY-L020", "HIGH", "security", F.lit("broad file permissions")),
    ])


def literal_rules(literals: DataFrame, patterns: DataFrame, least: int | None = None) -> DataFrame:
    """Repeated strings, credentials assigned to names, placeholder data."""
    least = DEFAULTS["duplicate_strings"] if least is None else least
    n = F.col("nums")["count"]
    repeated = literals.where((n >= least) & (F.length("name") >= 6))
    assigned = patterns.where("name = 'string_assignment'").select("file", "line", F.col("attrs")["variable"].alias("name"), F.col("attrs")["value"].alias("v"))
    credential = assigned.where(F.col("name").rlike(SENSITIVE_NAME) & (F.length("v") >= 8) & ~F.col("v").rlike(r"(?i)^(<.*>|\$\{.*|your[-_ ].*|changeme|example.*|x+|\*+)$") & ~F.col("v").rlike(r"\s"))
    secret = assigned.withColumn("_s", scalar.secret_severity(F.col("v"))).where("_s is not null")
    mock = assigned.where(F.col("v").rlike(r"(?i)\b(lorem ipsum|john[. ]?doe|foo@bar|test@test|example\.com|dummy|placeholder)\b"))
    return union_all([
        as_findings(repeated, "SKY-L027", F.when(n >= 6, "MEDIUM").otherwise("LOW"), "quality", say("string %s is repeated", "name"), value=n, threshold=least),
        as_findings(credential, "SKY-L014", "HIGH", "security", say("credential in %s", "name")),
        as_findings(secret, "SKY-S101", F.col("_s"), "secrets", say("secret in %s", "name")),
        as_findings(mock, "SKY-L032", "MEDIUM", "quality", say("placeholder data in %s", "name")),
    ])


def coupling_rule(class_uses: DataFrame, classes: DataFrame, limit: int | None = None) -> DataFrame:
    """Classes that use many other classes of the project: distinct per class."""
    limit = DEFAULTS["cbo"] if limit is None else limit
    known = classes.select(F.col("name").alias("target"), F.element_at(F.split("name", r"\."), -1).alias("simple")).distinct()
    uses = class_uses.select("file", "line", F.col("scope").alias("cls"), F.element_at(F.split("name", r"\."), -1).alias("simple"))
    counted = uses.join(known, "simple").where("cls <> target").groupBy("cls", "file").agg(F.countDistinct("target").alias("ce"), F.min("line").alias("line"))
    hit = counted.where(F.col("ce") > limit).withColumnRenamed("cls", "name")
    return as_findings(hit, "SKY-Q701", F.when(F.col("ce") > 8, "HIGH").otherwise("MEDIUM"), "architecture", say("uses %s classes", "ce"), value=F.col("ce"), threshold=limit)


def phantom_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls of names of project modules that these do not define: an anti-join with the definitions."""
    modules = definitions.select(F.regexp_extract("scope", r"^(.*)$", 1).alias("m")).distinct()
    parent = F.regexp_replace("name", r"\.[^.]+$", "")
    inside = calls.withColumn("m", parent).join(modules, "m", "left_semi").drop("m")
    known = definitions.select("name").union(imports.select(F.concat_ws(".", "scope", "name").alias("name"))).distinct()
    hit = inside.join(known, "name", "left_anti").where(F.col("name").contains("."))
    return as_findings(hit, "SKY-L012", "CRITICAL", "ai_defects", say("%s does not exist", "name"))


def signature_mismatches(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of project functions with more positional arguments than these have, or fewer than they need."""
    f = functions.where("attrs['type'] = 'function'").select("name", F.col("nums")["args"].alias("most"), F.col("nums")["required"].alias("least"))
    keywords = F.size(F.filter(F.map_keys("attrs"), lambda k: k.startswith("kw:")))
    own = F.concat_ws(".", module_name(F.col("file")), "name")
    named = calls.where("attrs['args'] is null or attrs['args'] not rlike '(^|, )[*]'").where("attrs['kw:**'] is null").withColumn("name", F.explode(F.array_distinct(F.array(F.col("name"), own))))
    c = named.join(f, "name").withColumn("given", F.col("nums")["args"])
    hit = c.where((F.col("given") > F.col("most")) | (F.col("given") + keywords < F.col("least")))
    return as_findings(hit, "SKY-D224", "HIGH", "ai_defects", say("%s is called with other arguments than it takes", "name"), value=F.col("given"), threshold=F.col("most"))


def lock_order(locks: DataFrame) -> DataFrame:
    """Pairs of locks that are taken in both orders: a self-join of the nesting pairs."""
    a, b = locks.alias("a"), locks.select("name", "target").distinct().alias("b")
    hit = a.join(b, (F.col("a.name") == F.col("b.target")) & (F.col("a.target") == F.col("b.name"))).select("a.*").dropDuplicates(["file", "line", "name", "target"])
    return as_findings(hit, "SKY-Q403", "HIGH", "quality", say("%s and %s are taken in both orders", "name", "target"))


def shared_state(global_writes: DataFrame, calls: DataFrame) -> DataFrame:
    """Module state that a thread's target writes."""
    targets = calls.where(F.col("name").isin("threading.Thread", "threading.Timer") | F.col("name").endswith(".submit"))
    names = targets.select("file", F.explode(F.concat(F.array_compact(F.array(F.col("attrs")["kw:target"])), F.slice("items", 1, 1))).alias("t")).where("t <> ''")
    hit = global_writes.withColumn("t", F.element_at(F.split("scope", r"\."), -1)).join(names.distinct(), ["file", "t"], "left_semi")
    return as_findings(hit, "SKY-Q404", "MEDIUM", "quality", say("%s is written by a thread", "name"))


def opaque_names(definitions: DataFrame) -> DataFrame:
    """Functions and classes whose names say nothing: one letter, consonants only, or a numbered placeholder."""
    simple = F.element_at(F.split("name", r"\."), -1)
    hit = definitions.where("attrs['type'] in ('function', 'class', 'method')").where(simple.rlike(r"^([a-zA-Z]|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{4,}|(foo|bar|baz|tmp|temp|data|func|thing|stuff|do_it)\d*)$"))
    return as_findings(hit, "SKY-Q806", "LOW", "quality", say("opaque name %s", "name"))


def stale_mocks(calls: DataFrame, definitions: DataFrame, strings: DataFrame) -> DataFrame:
    """Patched names of project modules that these do not define."""
    patched = calls.where(F.col("name").rlike(r"(^|\.)(patch|setattr)$")).select("file", "line").distinct()
    named = strings.join(patched, ["file", "line"], "left_semi").where(F.col("name").rlike(r"^\w+(\.\w+)+$"))
    modules = definitions.select(F.col("scope").alias("m")).distinct()
    inside = named.withColumn("m", F.regexp_replace("name", r"\.[^.]+$", "")).join(modules, "m", "left_semi").drop("m")
    return as_findings(inside.join(definitions.select("name").distinct(), "name", "left_anti"), "SKY-L024", "HIGH", "ai_defects", say("patched name %s does not exist", "name"))


def undefined_config(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """Environment names that the code reads and no configuration file declares (``declared``: ``name``)."""
    reads = calls.where(F.col("name").isin("os.getenv", "os.environ.get") & (F.col("nums")["args"] == 1))
    key = reads.withColumn("name", F.col("attrs")["first_text"]).where("name is not null")
    return as_findings(key.join(declared.select("name").distinct(), "name", "left_anti"), "SKY-L016", "MEDIUM", "quality", say("%s is read and never declared", "name"))


#: Commands that a repository of a language should run somewhere.
POLICIES = [
    ("SKY-R101", "python", r"\b(mypy|pyright|pytype|basedpyright)\b"),
    ("SKY-R102", "python", r"\b(ruff|flake8|pylint)\b"),
    ("SKY-R104", "python", r"(^|/)\.pre-commit-config\.ya?ml$"),
    ("SKY-R105", "typescript", r"\btsc\b"),
]


def policy_rules(files: DataFrame) -> DataFrame:
    """Repositories (one per table) that have files of a language and no command of a policy, in text or file name."""
    flags = []
    for rule, lang, pattern in POLICIES:
        flags += [F.bool_or(F.col("lang") == lang).alias(f"has_{rule}"), F.bool_or(F.col("text").rlike(pattern) & F.col("path").rlike(r"(\.ya?ml|\.toml|\.cfg|\.ini|package\.json|Makefile)$") | F.col("path").rlike(pattern)).alias(f"ok_{rule}")]
    one = files.agg(*flags)
    missing = F.array(*[F.when(F.col(f"has_{r}") & ~F.coalesce(F.col(f"ok_{r}"), F.lit(False)), r) for r, _, _ in POLICIES])
    rows = one.select(F.explode(F.array_compact(missing)).alias("r")).withColumns({"name": F.lit("repository"), "file": F.lit("."), "line": F.lit(1)})
    return as_findings(rows, F.col("r"), "MEDIUM", "quality", say("policy %s is not met", "r"))


def custom_rules(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules from data: ``{id, severity, kind: call|function|class|flow, name: glob, max: {metric: limit}}``."""
    out = []
    for r in rules:
        df = facts.where(F.col("kind") == r["kind"])
        if r.get("name"):
            df = df.where(F.rlike("name", scalar.glob_to_regex(F.lit(r["name"]))))
        for metric, limit in r.get("max", {}).items():
            df = df.where(F.col("nums")[metric] > limit)
        out.append(as_findings(df, r["id"], r.get("severity", "MEDIUM"), "custom", F.lit(r.get("message", r["id"])), kind=r["kind"]))
    return union_all(out)
