"""Scores, grades and gates as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.findings import lookup

#: Caps by worst severity and penalties by severity.
SEVERITY_CAPS = {"CRITICAL": 55, "HIGH": 79, "MEDIUM": 100, "LOW": 100}
SEVERITY_PENALTIES = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 3, "LOW": 1}
#: Lowest score of each letter.
LETTERS = [("A+", 97), ("A", 93), ("A-", 90), ("B+", 87), ("B", 83), ("B-", 80), ("C+", 77), ("C", 73), ("C-", 70), ("D+", 67), ("D", 63), ("D-", 60)]
#: Dead symbols per thousand lines, and the score there.
DEAD_DENSITY = [(0, 100), (5, 85), (15, 55), (30, 20), (50, 0)]
#: Weights of the grade's categories.
CATEGORY_WEIGHTS = {"security": 0.30, "quality": 0.25, "dead_code": 0.15, "ai_defects": 0.10, "dependencies": 0.10, "secrets": 0.10}
#: Debt weights.
DEBT_SEVERITY = {"CRITICAL": 20, "HIGH": 12, "MEDIUM": 7, "WARN": 5, "LOW": 3, "INFO": 1}
DEBT_DIMENSION = {"architecture": 1.25, "modularity": 1.15, "complexity": 1.0, "maintainability": 0.9, "dead_code": 0.65}
DEBT_BONUS = {"CRITICAL": 4.0, "HIGH": 3.0, "MEDIUM": 2.0, "WARN": 1.0, "LOW": 0.5, "INFO": 0.0}
DEFENSE_WEIGHTS = {"critical": 8, "high": 5, "medium": 3, "low": 1}


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def letter(score: Column) -> Column:
    out = F.lit("F")
    for name, low in reversed(LETTERS):
        out = F.when(clamp(score) >= low, name).otherwise(out)
    return out


def severity_score(findings: DataFrame, by: list[str], loc: str | None = None) -> DataFrame:
    """Score per group: from the worst severity's cap, less a penalty a finding, per thousand lines if ``loc`` names a column of lines.

    Unknown and null severities count as LOW.  Groups without findings are not here; they score 100.
    """
    known = F.upper(F.coalesce("severity", F.lit("LOW")))
    sev = F.when(known.isin(*SEVERITY_CAPS), known).otherwise("LOW")
    counts = [F.count_if(sev == s).alias(s) for s in SEVERITY_CAPS]
    extra = [F.max(loc).alias("_loc")] if loc else []
    agg = findings.groupBy(*by).agg(*counts, *extra)
    start = F.lit(100)
    for s in reversed(list(SEVERITY_CAPS)):
        start = F.when(F.col(s) > 0, SEVERITY_CAPS[s]).otherwise(start)
    penalty = sum((F.col(s) * p for s, p in SEVERITY_PENALTIES.items()), F.lit(0)).cast("double")
    scale = F.when(F.col("_loc") > 0, 1000.0 / F.col("_loc")).otherwise(1.0) if loc else F.lit(1.0)
    score = clamp(F.bround(start - penalty * scale)).cast("int")
    return agg.select(*by, *SEVERITY_CAPS, score.alias("score"), letter(score).alias("grade"))


def dead_density_score(density: Column) -> Column:
    """Piecewise linear in dead symbols per thousand lines."""
    out = F.lit(0.0)
    for (d0, s0), (d1, s1) in reversed(list(zip(DEAD_DENSITY, DEAD_DENSITY[1:], strict=False))):
        out = F.when(density <= d1, s0 + (density - d0) / (d1 - d0) * (s1 - s0)).otherwise(out)
    return F.bround(F.when(density <= 0, 100.0).otherwise(out)).cast("int")


def secrets_score(n: Column) -> Column:
    return F.when(n == 0, 100).otherwise(F.greatest(F.lit(0), 69 - (n - 1) * 20)).cast("int")


def overall_grade(scores: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean over the categories present (``category, score, n_critical``), capped at 79 with a critical security finding."""
    weight = lookup(F.col("category"), CATEGORY_WEIGHTS)
    agg = scores.where(F.col("category").isin(*CATEGORY_WEIGHTS)).groupBy(*by).agg(
        (F.sum(F.col("score") * weight) / F.sum(weight)).alias("mean"), F.max((F.col("category") == "security") & (F.col("n_critical") > 0)).alias("critical")
    )
    score = F.bround("mean")
    score = clamp(F.when(F.col("critical"), F.least(score, F.lit(79.0))).otherwise(score)).cast("int")
    return agg.select(*by, score.alias("score"), letter(score).alias("grade"))


def lines_of_code(files: DataFrame, comment: str = "#") -> DataFrame:
    """``path, loc``: lines that are neither blank nor all comment (shebang-like ``##!`` counts)."""
    lines = F.transform(F.split("text", "\r?\n"), F.trim)
    code = F.filter(lines, lambda x: (x != "") & (~x.startswith(comment) | x.startswith(f"{comment * 2}!")))
    return files.select("path", F.size(code).alias("loc"))


def debt_points(signals: DataFrame) -> Column:
    """Severity weight x dimension weight x (1 + excess over the threshold, at most 2)."""
    base = F.coalesce(lookup(F.upper("severity"), DEBT_SEVERITY), F.lit(1))
    dimension = F.coalesce(lookup(F.col("dimension"), DEBT_DIMENSION), F.lit(1.0))
    over = (F.col("threshold") > 0) & (F.col("metric_value") > F.col("threshold"))
    excess = F.when(over, F.least((F.col("metric_value") - F.col("threshold")) / F.col("threshold"), F.lit(2.0))).otherwise(0.0)
    return F.bround(base * dimension * (1.0 + excess), 2)


def debt_hotspots(signals: DataFrame) -> DataFrame:
    """Per file: points, two more for each further dimension, the dimension with most points (then by name) and priority."""
    scored = signals.withColumn("points", debt_points(signals))
    per_dim = scored.groupBy("file", "dimension").agg(F.sum("points").alias("p"), F.count("*").alias("n"), F.max(F.struct(F.coalesce(lookup(F.upper("severity"), DEBT_SEVERITY), F.lit(1)).alias("w"), F.upper("severity").alias("s"))).alias("worst"))
    out = per_dim.groupBy("file").agg(F.sum("p").alias("points"), F.sum("n").alias("signal_count"), F.count("*").alias("dimension_count"), F.max(F.struct("p", "dimension")).alias("d"), F.max("worst").alias("worst"))
    score = F.bround(F.col("points") + (F.col("dimension_count") - 1) * 2, 2)
    out = out.select("file", score.alias("score"), "signal_count", "dimension_count", F.col("d.dimension").alias("primary_dimension"), F.col("worst.s").alias("worst_severity"))
    return out.withColumn("priority_score", debt_priority(out))


def debt_priority(hotspots: DataFrame) -> Column:
    """Score plus bonuses for change, baseline status and strongest severity."""
    cols = set(hotspots.columns)
    points = F.col("score") + F.coalesce(lookup(F.col("worst_severity"), DEBT_BONUS), F.lit(0.0))
    if "changed" in cols:
        points = points + F.when(F.col("changed"), 5.0).otherwise(0.0)
    if "baseline_status" in cols:
        points = points + F.coalesce(lookup(F.col("baseline_status"), {"worsened": 8.0, "new": 6.0, "improved": -2.0}), F.lit(0.0))
    return F.bround(F.greatest(points, F.lit(0.0)), 2)


def debt_score(hotspots: DataFrame, total_loc: int = 0) -> DataFrame:
    """One row: points, normaliser, score and rating of the project."""
    agg = hotspots.agg(F.count("*").alias("hotspot_count"), F.coalesce(F.sum("signal_count"), F.lit(0)).alias("signal_count"), F.bround(F.coalesce(F.sum("score"), F.lit(0.0)), 2).alias("total_points"))
    norm = F.greatest(F.lit(1.0), F.lit(total_loc / 250.0)) if total_loc > 0 else F.greatest(F.lit(1.0), F.col("hotspot_count").cast("double"))
    score = clamp(F.bround(100 - F.col("total_points") / norm)).cast("int")
    rating = F.when(score >= 90, "LOW").when(score >= 75, "MODERATE").when(score >= 50, "HIGH").otherwise("CRITICAL")
    return agg.select("*", F.bround(norm, 2).alias("normalizer"), score.alias("score_pct"), rating.alias("risk_rating"))


def debt_status(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``key, status, delta``: new, worsened, improved, unchanged or resolved against a baseline (``key, score``)."""
    c, b = current.select("key", F.col("score").alias("now")), baseline.select("key", F.col("score").alias("then"))
    delta = F.bround(F.col("now") - F.col("then"), 2)
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").when(delta > 1.0, "worsened").when(delta < -1.0, "improved").otherwise("unchanged")
    return c.join(b, "key", "full_outer").select("key", status.alias("status"), F.when(F.col("then").isNull(), F.bround("now", 2)).otherwise(delta).alias("delta"))


def defense_score(checks: DataFrame, by: list[str]) -> DataFrame:
    """Weighted share of passed checks (``severity, passed``) and rating; nothing to check is SECURE at 100."""
    weight = F.coalesce(lookup(F.lower("severity"), DEFENSE_WEIGHTS), F.lit(0))
    agg = checks.groupBy(*by).agg(F.sum(weight).alias("weighted_max"), F.sum(F.when(F.col("passed"), weight).otherwise(0)).alias("weighted_score"), F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    pct = F.when(F.col("weighted_max") > 0, F.bround(F.col("weighted_score") / F.col("weighted_max") * 100)).otherwise(100.0).cast("int")
    rating = F.when(pct < 25, "CRITICAL").when(pct < 50, "HIGH").when(pct < 75, "MEDIUM").when(pct < 90, "LOW").otherwise("SECURE")
    return agg.select("*", pct.alias("score_pct"), rating.alias("risk_rating"))


def ops_score(checks: DataFrame, by: list[str]) -> DataFrame:
    agg = checks.groupBy(*by).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    pct = F.bround(F.col("passed") / F.col("total") * 100).cast("int")
    return agg.select("*", pct.alias("score_pct"), F.when(pct >= 80, "EXCELLENT").when(pct >= 60, "GOOD").when(pct >= 40, "FAIR").otherwise("POOR").alias("rating"))


def control_coverage(checks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per control of a framework (``control, plugin``): checks, passes and status; a control without checks is ``not_covered``."""
    joined = mapping.join(checks.select("plugin", "passed"), "plugin", "left")
    agg = joined.groupBy("control").agg(F.count("passed").alias("checks"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))
    status = F.when(F.col("checks") == 0, "not_covered").when(F.col("checks") == F.col("passed"), "covered").when(F.col("passed") > 0, "partial").otherwise("uncovered")
    return agg.withColumn("status", status)


#: Findings allowed before the gate fails.
GATE_LIMITS = {"critical": 0, "high": 5, "security": 10, "reliability": 0, "quality": 10, "secrets": 0, "dependencies": 0}
#: Advisory rules that the gate does not count.
ADVISORY = ["SKY-Q802", "SKY-Q803"]


def gate(findings: DataFrame, by: list[str], limits: dict[str, int] | None = None, strict: bool = False) -> DataFrame:
    """Pass or fail with reasons.  Incomplete analysis (``complete`` false on any row) fails first; strict fails on any finding."""
    limits = GATE_LIMITS if limits is None else limits
    counted = findings.where(~F.coalesce(F.col("rule_id").isin(*ADVISORY), F.lit(False)))
    is_severity = {"critical", "high"}
    agg = counted.groupBy(*by).agg(
        F.min(F.coalesce("complete", F.lit(True))).alias("complete"), F.count("*").alias("total"),
        *[F.count_if((F.upper("severity") == k.upper()) if k in is_severity else (F.col("category") == k)).alias(k) for k in limits],
    )
    reasons = [F.when(~F.col("complete"), "incomplete analysis")]
    reasons += [F.when(F.col(k) > n, F.concat(F.lit(f"{k} "), F.col(k).cast("string"), F.lit(f" > {n}"))) for k, n in limits.items()]
    if strict:
        reasons.append(F.when(F.col("total") > 0, "strict"))
    out = agg.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("passed", F.size("reasons") == 0)


def detection_scores(labels: DataFrame, by: list[str], budget: float = 1.0, elapsed: float = 1.0) -> DataFrame:
    """Precision, recall, F1, absence guard and overall score from ``truth`` and ``predicted`` booleans; empty denominators count as 1."""
    t, p = F.col("truth"), F.col("predicted")
    agg = labels.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    precision, recall, absence = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    latency = min(budget / elapsed, 1.0) if elapsed > 0 else 1.0
    out = agg.withColumns({"precision": precision, "recall": recall, "absence": absence})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.when(F.col("precision") + F.col("recall") == 0, 1.0).otherwise(F.col("precision") + F.col("recall")))
    return out.withColumns({"f1": f1, "overall": (F.col("recall") * 0.4 + F.col("precision") * 0.3 + F.col("absence") * 0.2 + F.lit(latency * 0.1)) * 100})


def classify_evidence(events: DataFrame, by: str = "symbol_key") -> DataFrame:
    """Fold evidence events to one class: validated pass, then validated fail, any sign of life, uncertain, else likely dead."""
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))
    flags = events.groupBy(by).agg(has("validation_passed").alias("ok"), has("validation_failed").alias("bad"), has(*ALIVE).alias("alive"), has(*UNCERTAIN).alias("unsure"))
    label = F.when(F.col("ok"), "safe_to_remove").when(F.col("bad"), "alive").when(F.col("alive"), "alive").when(F.col("unsure"), "uncertain").otherwise("likely_dead")
    return flags.select(by, label.alias("classification"))


#: Kinds of evidence that show use, and those that leave it open.
ALIVE = ["static_reference", "import_reference", "entrypoint", "framework_registration", "runtime_trace", "coverage_hit", "exported", "reachable_from_root"]
UNCERTAIN = ["dynamic_access", "string_reference", "heuristic_reference", "incomplete_search"]


def badge(score: Column, grade: Column) -> Column:
    """A small SVG with the grade."""
    colour = F.when(score >= 90, "#4c1").when(score >= 80, "#97ca00").when(score >= 70, "#dfb317").when(score >= 60, "#fe7d37").otherwise("#e05d44")
    return F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="90" height="20"><rect width="90" height="20" fill="%s"/><text x="8" y="14" fill="#fff">grade %s (%s)</text></svg>', colour, grade, score.cast("string"))
