"""Library entry points: analyse a tree, verify a change, list what is incomplete."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import findings as ops
from millrace.operators import intervals, score
from millrace.plans.analyze import Analysis, analyze
from millrace.sources.files import source_files


def analyze_path(spark: SparkSession, path: str | list[str], threshold: int = 60, limits: dict | None = None) -> Analysis:
    """Analyse all source files under a path (or several)."""
    return analyze(source_files(spark, path), limits, threshold)


def report(analysis: Analysis, most: int | None = None) -> str:
    """The analysis as JSON: summary, grades, incomplete files, and all findings (or the first ``most``) by severity, file and line."""
    order = [ops.severity_rank(F.col("severity")).desc(), "file", "line", "rule_id"]
    first = lambda df: df if most is None else df.limit(most)
    rows = first(analysis.findings.orderBy(*order))
    body = {
        "summary": {r["category"]: r["n"] for r in analysis.findings.groupBy("category").agg(F.count("*").alias("n")).collect()},
        "grades": {r["category"]: {"score": r["score"], "grade": r["grade"]} for r in analysis.grade().collect()},
        "incomplete": [r.asDict() for r in first(analysis.incomplete().orderBy("file")).collect()],
        "findings": [r.asDict() for r in rows.collect()],
    }
    return json.dumps(body, sort_keys=True)


def verify_change(analysis: Analysis, ranges: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Findings on changed lines (``file, start, end``), without those of a baseline (``fingerprint``)."""
    f = analysis.findings.withColumns({"start": F.col("line"), "end": F.col("line")})
    changed = intervals.overlap_semi(f, ranges, "file").drop("start", "end").withColumn("fingerprint", ops.fingerprint("rule_id", "file", "name", "message"))
    return changed if baseline is None else ops.new_vs_baseline(changed, baseline)


def gate(analysis: Analysis, strict: bool = False, allow_incomplete: bool = True) -> DataFrame:
    """One row: whether the findings pass the gate, and why not.  Unless ``allow_incomplete``, files that could not be analysed fail it."""
    f = ops.without_advisory(analysis.findings.where("kind <> 'dead_code'")).withColumns({"project": F.lit("project"), "complete": F.lit(True)})
    if not allow_incomplete:
        f = f.withColumn("complete", F.lit(analysis.incomplete().limit(1).count() == 0))
    return score.gate(f, ["project"], strict=strict)
