"""Inventory of model calls in code, and the checks that guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.score import defense_score, ops_score

#: Providers by call.
PROVIDERS = [("openai", r"(^|\.)openai\.|chat\.completions\.create$|responses\.create$"), ("anthropic", r"(^|\.)anthropic\.|messages\.create$"), ("google", r"generativeai|generate_content$"), ("langchain", r"(^|\.)langchain"), ("litellm", r"(^|\.)litellm\.completion"), ("huggingface", r"transformers\.pipeline$|InferenceClient")]
#: Checks: name, severity, category, and what evidence in the function passes it.
CHECKS = [
    ("no-dangerous-sink", "critical", "defense", "not sink"),
    ("untrusted-input-to-prompt", "critical", "defense", "not tainted or delimiter"),
    ("tool-scope", "critical", "defense", "not tools or scoped"),
    ("tool-schema-present", "critical", "defense", "not tools or schema"),
    ("output-validation", "high", "defense", "validated"),
    ("output-pii-filter", "high", "defense", "pii"),
    ("prompt-delimiter", "high", "defense", "delimiter"),
    ("rag-context-isolation", "high", "defense", "not rag or delimiter"),
    ("rate-limiting", "medium", "ops", "rate"),
    ("cost-controls", "medium", "ops", "capped"),
    ("logging-present", "medium", "ops", "logged"),
    ("model-pinned", "medium", "defense", "pinned"),
    ("input-length-limit", "low", "defense", "limited"),
]
#: Evidence by the names of calls in the same function.
EVIDENCE = {
    "sink": r"^(eval|exec|os\.system)$|subprocess\.", "validated": r"(json\.loads|model_validate|parse_obj|validate|jsonschema)", "pii": r"(?i)(redact|anonymi[sz]e|mask_pii|presidio|scrub)", "delimiter": r"(?i)(escape|delimit|wrap_user|quote|xml_tag)",
    "rag": r"(?i)(similarity_search|retriev|vectorstore|query_index)", "rate": r"(?i)(rate_?limit|throttle|limiter)", "logged": r"(?i)(^|\.)(logging|logger|log|structlog)\.", "limited": r"(?i)(truncate|^len$|max_length|clip)", "scoped": r"(?i)(allowed_tools|tool_scope|permission)",
}


def integrations(calls: DataFrame) -> DataFrame:
    """Model calls: ``file, scope, line, provider`` with the call's keywords."""
    provider = F.lit(None).cast("string")
    for name, pattern in reversed(PROVIDERS):
        provider = F.when(F.col("name").rlike(pattern), name).otherwise(provider)
    return calls.withColumn("provider", provider).where("provider is not null and name rlike '(create|generate_content|completion|pipeline|invoke|run|predict|chat)$'")


def checks(found: DataFrame, calls: DataFrame, flows: DataFrame) -> DataFrame:
    """``file, scope, line, plugin, severity, category, passed``: all checks for every model call, from the calls around it."""
    flags = calls.groupBy("file", "scope").agg(*[F.bool_or(F.col("name").rlike(p)).alias(k) for k, p in EVIDENCE.items()])
    tainted = flows.select("file", "scope", "line").distinct().withColumn("tainted", F.lit(True))
    a = F.col("attrs")
    base = found.select(
        "file", "scope", "line", "provider", F.coalesce(a["kw:model"].rlike(r"\d{4}|-\d+\.\d+-|@"), F.lit(False)).alias("pinned"), (a["kw:max_tokens"].isNotNull() | a["kw:max_output_tokens"].isNotNull() | a["kw:max_completion_tokens"].isNotNull()).alias("capped"),
        a["kw:tools"].isNotNull().alias("tools"), F.coalesce(a["kw:tools"].rlike("(?i)(schema|parameters)"), F.lit(False)).alias("schema"),
    )
    joined = base.join(flags, ["file", "scope"], "left").join(tainted, ["file", "scope", "line"], "left").fillna(False)
    rows = F.array(*[F.struct(F.lit(n).alias("plugin"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.expr(e).alias("passed")) for n, s, c, e in CHECKS])
    return joined.select("file", "scope", "line", "provider", F.explode(rows).alias("x")).select("file", "scope", "line", "provider", "x.*")


def posture(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defence and operations scores over all checks (one row each, none without checks)."""
    whole = results.withColumn("scope", F.lit("project"))
    return defense_score(whole.where("category = 'defense'"), ["scope"]), ops_score(whole.where("category = 'ops'"), ["scope"])
