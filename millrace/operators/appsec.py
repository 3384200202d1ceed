"""Security and framework rules that need more than one fact: arguments, decorators, defaults, data flows, file imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators.rules import SENSITIVE_NAME, WEAK_RANDOM, as_findings, say, union_all
from millrace.operators.textscan import first_pattern
from millrace.sources.python_facts import MODEL_CALLS, of_kind

MODEL_CALL = r"(^|\.)(" + "|".join(c[1:].replace(".", r"\.") for c in MODEL_CALLS) + ")$"

#: Calls judged by their arguments: rule, severity, pattern of the name, pattern that some ``keyword=value`` must fit, pattern that none may fit.
ARGUMENT_RULES = [
    ("SKY-D231", "HIGH", r"(^|\.)(CORS|CORSMiddleware|cross_origin|add_middleware)$", r"^(origins|allow_origins|resources|allow_origin_regex)=.*\*", None),
    ("SKY-D232", "CRITICAL", r"(^|\.)jwt\.decode$", r"^(verify=False|options=.*verify_signature\W+False|algorithms=.*[\"'](?i:none)[\"'])", None),
    ("SKY-D234", "HIGH", r".", r"^\*\*=.*request\.(json|form|data|POST|GET|args|values|get_json)", None),
    ("SKY-D267", "MEDIUM", MODEL_CALL, None, r"^(max_tokens|max_output_tokens|max_completion_tokens|generation_config)="),
    ("SKY-D326", "HIGH", r"(\.extractall|^shutil\.unpack_archive)$", None, r"^(filter|members)="),
    ("SKY-D345", "HIGH", r"(^|\.)(from_pretrained|hf_hub_download|snapshot_download|load_dataset)$", None, r"^revision=(?![\"'](main|master)[\"'])"),
    ("SKY-L011", "HIGH", r".", r"^(verify|verify_ssl|ssl_verify|check_hostname|validate_certs|csrf_enabled|csrf_protect)=False$", None),
    ("SKY-P404", "MEDIUM", r"\.query(\.(options|join|order_by))*\.all$", None, None),
]
#: Assignments that turn a safeguard off, as ``variable=value``.
UNSAFE_SETTINGS = r"^(WTF_CSRF_ENABLED=False|SESSION_COOKIE_SECURE=False|CSRF_COOKIE_SECURE=False|SECURE_SSL_REDIRECT=False|check_hostname=False|verify_mode=ssl\.CERT_NONE|DEBUG=True|ALLOWED_HOSTS=\[.*'\*'.*\])$"
UNSAFE_DECORATORS = r"(^|\.)(csrf_exempt|login_exempt|no_auth)$"
#: What guards a route, a webhook, a file.
ROUTE_GUARD = r"(?i)(login_required|permission|requires?_|auth|current_user|security|depends|jwt|token)"
WEBHOOK_GUARD = r"(?i)(compare_digest|construct_event|verify|validate|signature|hmac)"
LINK_GUARD = r"(is_symlink|lstat|islink|realpath|resolve|O_NOFOLLOW|is_relative_to|commonpath)"
#: Calls with which a tool of an agent may do anything, and sinks that answers of models must not reach.
PRIVILEGED = r"^(os\.system|os\.popen|subprocess\.\w+|eval|exec|shutil\.rmtree|os\.remove|os\.unlink)$"
ANSWER_SINKS = r"(^(eval|exec|os\.system|os\.popen|subprocess\.\w+)$|\.(execute|executescript)$|(^|\.)(Markup|mark_safe|render_template_string)$)"


def keyword_list(facts: DataFrame) -> Column:
    """Keywords of a call as ``name=value`` texts."""
    entries = F.filter(F.map_entries("attrs"), lambda e: e["key"].startswith("kw:"))
    return F.transform(entries, lambda e: F.concat(F.substring(e["key"], F.lit(4), F.length(e["key"])), F.lit("="), e["value"]))


def _some(pattern: str) -> Column:
    """Whether a keyword in ``_kw`` fits."""
    return F.exists("_kw", lambda k: k.rlike(pattern))


def argument_rules(calls: DataFrame) -> DataFrame:
    """Calls that break a rule by the arguments they have or lack; a call can break several."""
    hits = []
    for rule, severity, name, must, never in ARGUMENT_RULES:
        fits = F.col("name").rlike(name)
        if must:
            fits = fits & _some(must)
        if never:
            fits = fits & ~_some(never)
        hits.append(F.when(fits, F.struct(F.lit(rule).alias("r"), F.lit(severity).alias("s"))))
    found = calls.withColumn("_kw", keyword_list(calls)).withColumn("_h", F.explode(F.array_compact(F.array(*hits))))
    return as_findings(found, F.col("_h.r"), F.col("_h.s"), "security", say("arguments of %s", "name"))


def setting_rules(assignments: DataFrame, decorators: DataFrame) -> DataFrame:
    """Safeguards that an assignment or a decorator turns off, and security values from a weak random source."""
    setting = assignments.where(F.concat_ws("=", "name", F.col("attrs")["value"]).rlike(UNSAFE_SETTINGS))
    weak = assignments.where(F.col("name").rlike(SENSITIVE_NAME) & F.col("target").isin(*WEAK_RANDOM))
    return union_all([
        as_findings(setting, "SKY-L011", "HIGH", "security", say("%s is off", "name")),
        as_findings(decorators.where(F.col("name").rlike(UNSAFE_DECORATORS)), "SKY-L011", "HIGH", "security", say("%s takes a safeguard away", "name")),
        as_findings(weak, "SKY-L013", "HIGH", "security", say("%s comes from a weak random source", "name")),
    ])


def answer_rules(flows: DataFrame) -> DataFrame:
    """Answers of models in dangerous sinks, and secrets in calls of models."""
    has = lambda label: F.array_contains(F.split(F.col("attrs")["labels"], ","), label)
    answers = flows.where(has("llm") & F.col("name").rlike(ANSWER_SINKS))
    secrets = flows.where(has("secret") & F.col("name").rlike(MODEL_CALL))
    return as_findings(answers, "SKY-D262", "CRITICAL", "security", say("a model's answer reaches %s", "name"), kind="flow").unionByName(as_findings(secrets, "SKY-D263", "HIGH", "security", say("a secret is sent by %s", "name"), kind="flow"))


def link_rules(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """Files opened by an outside path, in functions that check no link: writing, reading."""
    a = F.col("attrs")
    guarded = calls.where(F.col("name").rlike(LINK_GUARD)).select("file", "scope").distinct()
    opened = flows.where(F.col("name").isin("open", "io.open") & (a["first"] == "True") | F.col("name").rlike(r"\.(write_text|write_bytes|read_text|read_bytes)$") & (a["receiver"] == "True"))
    writes = F.col("name").rlike(r"\.write_") | F.coalesce(a["mode"].rlike("[wax+]"), F.lit(False))
    free = opened.join(guarded, ["file", "scope"], "left_anti")
    return as_findings(free, F.when(writes, "SKY-D324").otherwise("SKY-D325"), F.when(writes, "HIGH").otherwise("MEDIUM"), "security", say("%s follows links of an outside path", "name"), kind="flow")


def tool_rules(functions: DataFrame, decorators: DataFrame, defaults: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Servers and tools for agents: poisoned descriptions, open transports, wide resources, secrets in defaults, privileges."""
    a = F.col("attrs")
    served = imports.where(F.col("target").rlike(r"^(mcp|fastmcp)(\.|$)")).select("file").distinct()
    kw = calls.join(served, "file", "left_semi").withColumn("_kw", keyword_list(calls))
    transport = kw.where(F.col("name").rlike(r"\.run$") & _some(r"^transport=[\"'](sse|http|streamable-http)[\"']") & ~_some("^auth"))
    exposed = kw.where(F.col("name").rlike(r"(FastMCP|\.run)$") & _some(r"^host=[\"']0\.0\.0\.0[\"']") & ~_some("^auth"))
    tools = decorators.where(F.col("name").rlike(r"(^|\.)(tool|function_tool)$")).select("file", F.col("scope").alias("fn"), a["kw:description"].alias("description")).distinct()
    described = functions.join(tools, (functions["file"] == tools["file"]) & (functions["name"] == tools["fn"])).select(functions["*"], "description")
    text = F.concat_ws(" ", a["doc"], F.col("description"))
    poisoned = described.where(first_pattern(scalar.strip_zero_width(text))[0].isNotNull() | (F.size(scalar.zero_width_chars(text)) > 0) | text.rlike(r"(?i)<(important|system|hidden)>"))
    wide = decorators.join(served, "file", "left_semi").where(F.col("name").rlike(r"\.resource$") & a["first_text"].rlike(r"^file:|\{[^}]*(path|file)[^}]*\}|\*"))
    kept = defaults.join(tools.select("file", F.col("fn").alias("scope")), ["file", "scope"], "left_semi")
    kept = kept.where(scalar.secret_severity(a["value"]).isNotNull() | F.col("name").rlike(SENSITIVE_NAME) & (F.length(a["value"]) >= 8))
    mighty = calls.join(tools.select("file", F.col("fn").alias("scope")), ["file", "scope"], "left_semi").where(F.col("name").rlike(PRIVILEGED))
    return union_all([
        as_findings(poisoned, "SKY-D240", "CRITICAL", "security", say("description of the tool %s gives orders", "name")),
        as_findings(transport, "SKY-D241", "HIGH", "security", say("%s serves without authentication", "name")),
        as_findings(wide, "SKY-D242", "HIGH", "security", say("resource of %s takes any path", "scope")),
        as_findings(exposed, "SKY-D243", "CRITICAL", "security", say("%s listens on all addresses", "name")),
        as_findings(kept, "SKY-D244", "CRITICAL", "security", say("secret in the default of %s", "name")),
        as_findings(mighty, "SKY-D264", "HIGH", "security", say("a tool may call %s", "name")),
    ])


def route_rules(functions: DataFrame, decorators: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Routes without response contract or guard, and webhooks that check no signature."""
    a = F.col("attrs")
    fn = functions.select("file", F.col("name").alias("scope"), a["signature"].alias("signature"), F.col("attrs")["returns"].alias("returns"), F.concat_ws(" ", "items").alias("decorated"))
    routes = decorators.where(F.col("name").rlike(r"\.(get|post|put|patch|delete|route)$")).join(fn, ["file", "scope"])
    routes = routes.withColumn("line", F.col("nums")["def_line"].cast("int"))
    fast = imports.where(F.col("target").rlike(r"^fastapi(\.|$)")).select("file").distinct()
    bare = routes.join(fast, "file", "left_semi").where(F.col("returns").isNull() & a["kw:response_model"].isNull() & a["kw:response_class"].isNull() & ~F.col("name").endswith(".route"))
    mutating = F.col("name").rlike(r"\.(post|put|patch|delete)$") | F.coalesce(a["kw:methods"].rlike("POST|PUT|PATCH|DELETE"), F.lit(False))
    checked = calls.where(F.col("name").rlike(ROUTE_GUARD)).select("file", "scope").distinct()
    open_routes = routes.where(mutating & ~F.col("signature").rlike(ROUTE_GUARD) & ~F.col("decorated").rlike(ROUTE_GUARD)).join(checked, ["file", "scope"], "left_anti")
    signed = calls.where(F.col("name").rlike(WEBHOOK_GUARD)).select("file", "scope").distinct()
    hooks = routes.where(F.coalesce(a["first_text"].rlike("(?i)webhook"), F.lit(False)) | F.col("scope").rlike(r"(?i)webhook[^.]*$")).join(signed, ["file", "scope"], "left_anti")
    one = lambda df: df.withColumn("name", F.col("scope")).dropDuplicates(["file", "scope"])
    return union_all([
        as_findings(one(bare), "SKY-F101", "LOW", "framework", say("route %s declares no response", "name")),
        as_findings(one(open_routes), "SKY-F102", "MEDIUM", "framework", say("route %s changes data without a guard", "name")),
        as_findings(one(hooks), "SKY-D282", "HIGH", "security", say("webhook %s checks no signature", "name")),
    ])


def phantom_decorators(decorators: DataFrame, definitions: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Decorators from modules of the project that these do not define."""
    known = definitions.select("name").union(imports.select(F.concat_ws(".", "scope", "name").alias("name"))).distinct()
    inside = decorators.withColumn("m", F.regexp_replace("name", r"\.[^.]+$", "")).join(modules.select(F.col("name").alias("m")), "m", "left_semi").drop("m")
    hit = inside.where(F.col("name").contains(".")).join(known, "name", "left_anti")
    return as_findings(hit, "SKY-L023", "CRITICAL", "ai_defects", say("decorator %s does not exist", "name"))


def scan(facts: DataFrame) -> DataFrame:
    """All rules of this module over a table of facts."""
    calls, functions, decorators, flows = (of_kind(facts, k) for k in ("call", "function", "decorator", "flow"))
    definitions, imports = of_kind(facts, "definition"), of_kind(facts, "import")
    return union_all([
        argument_rules(calls),
        setting_rules(of_kind(facts, "assignment"), decorators),
        answer_rules(flows),
        link_rules(flows, calls),
        tool_rules(functions, decorators, of_kind(facts, "default"), calls, imports),
        route_rules(functions, decorators, calls, imports),
        phantom_decorators(decorators, definitions.where("attrs['type'] <> 'import'"), imports, of_kind(facts, "module")),
    ])
