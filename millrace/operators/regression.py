"""Changes that weaken a project: security controls, permissions and interfaces before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.deps import added_lines
from millrace.operators.patterns import matches

#: Controls whose removal is reported: name, pattern, and whether an added line of the hunk makes up for it.
CONTROLS = [
    ("auth_decorator", r"@(\w+\.)*(login_required|requires_auth|permission_required|jwt_required|authenticated)", False),
    ("validation_decorator", r"@(\w+\.)*(validate\w*|validator)", False),
    ("validation_call", r"\b(validate|sanitize|escape|clean)\w*\(", True),
    ("csrf", r"(?i)csrf", True),
    ("rate_limit", r"(?i)rate_?limit|limiter\.", True),
    ("audit_log", r"(?i)audit_?log", True),
    ("encryption", r"(?i)\b(encrypt|fernet|aes)\w*\(", True),
    ("permission_check", r"(?i)has_perm|check_permission|is_authorized|can_access", True),
]
#: Pairs of a safe removed line and an unsafe added one.
SWAPS = [("tls_verification", r"verify\s*=\s*True|CERT_REQUIRED", r"verify\s*=\s*False|CERT_NONE"), ("hash_strength", r"sha(256|384|512)|bcrypt|argon2|scrypt", r"\b(md5|sha1)\b"), ("debug_mode", r"(?i)debug\s*=\s*False", r"(?i)debug\s*=\s*True")]


def security_regressions(diff: DataFrame, by: list[str], order: str) -> DataFrame:
    """``control`` per hunk of a unified diff: removed controls that nothing in the hunk restores, and swaps for weaker ones."""
    body = added_lines(diff, by, order)
    count = lambda side, p: F.count_if((F.col("side") == side) & F.col("text").rlike(p))
    aggs, tests = [], []
    for k, (name, pattern, restored) in enumerate(CONTROLS):
        aggs += [count("-", pattern).alias(f"r{k}"), count("+", pattern).alias(f"a{k}")]
        gone = F.col(f"r{k}") > (F.col(f"a{k}") if restored else 0)
        tests.append(F.when(gone, F.lit(name)))
    for k, (name, safe, unsafe) in enumerate(SWAPS):
        aggs += [count("-", safe).alias(f"s{k}"), count("+", unsafe).alias(f"u{k}")]
        tests.append(F.when((F.col(f"s{k}") > 0) & (F.col(f"u{k}") > 0), F.lit(name)))
    agg = body.groupBy(*by, "hunk").agg(*aggs)
    return agg.select(*by, "hunk", F.explode(F.array_compact(F.array(*tests))).alias("control")).withColumns({"rule_id": F.lit("SKY-L021"), "severity": F.lit("HIGH")})


def surface_drift(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Entries of an interface (commands, routes, permissions) as ``added``, ``removed`` or ``changed``: a full outer join."""
    b, a = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("_b")), after.select(*key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change is not null").drop("_a", "_b")


def permission_expansion(before: DataFrame, after: DataFrame) -> DataFrame:
    """Workflow permissions (``path, permission, level``) that a change raises: none, read, write."""
    rank = lambda c: F.when(F.col(c) == "write", 2).when(F.col(c) == "read", 1).otherwise(0)
    return surface_drift(before, after, ["path", "permission"], "level").where(rank("after") > rank("before")).withColumns({"rule_id": F.lit("SKY-A103"), "severity": F.lit("HIGH")})


def unguarded_routes(routes: DataFrame, contract: DataFrame) -> DataFrame:
    """Routes that a contract (``prefix, guard``) wants guarded and whose decorators lack the guard."""
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.char_length("route")), lambda n: F.left(F.col("route"), n)))
    pairs = routes.select("route").where("route is not null").distinct().select("route", starts.alias("prefix"))
    joined = routes.join(pairs.join(contract.select("prefix").distinct(), "prefix", "left_semi"), "route").join(contract, "prefix")
    return joined.where(~F.array_contains("decorators", F.col("guard"))).withColumns({"rule_id": F.lit("SKY-A105"), "severity": F.lit("HIGH")})


def untested_changes(changed: DataFrame, risky: DataFrame) -> DataFrame:
    """High-risk changed files (``file``, rule table ``pattern``) of a change without any test file."""
    tests = changed.agg(F.coalesce(F.bool_or(F.col("file").rlike(r"(^|/)tests?/|(^|/)test_|_test\.")), F.lit(False)).alias("tested"))
    hit = changed.join(matches(changed, "file", risky, "pattern").select("file").distinct(), "file", "left_semi")
    return hit.join(tests.where("not tested"), F.lit(True)).select("file").withColumns({"rule_id": F.lit("SKY-A102"), "severity": F.lit("LOW")})
