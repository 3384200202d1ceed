"""Who wrote what: agents' line ranges joined with findings and integrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import path_suffixes
from millrace.operators.intervals import merge_ranges

#: Marks of agents in commit messages and author addresses.
AGENT_MARKS = [("copilot", r"(?i)copilot"), ("cursor", r"(?i)cursor(agent)?"), ("aider", r"(?i)\baider\b"), ("devin", r"(?i)devin-ai"), ("codex", r"(?i)\bcodex\b"), ("gemini", r"(?i)gemini-code-assist|gemini cli")]


def detect_agents(commits: DataFrame) -> DataFrame:
    """Add ``agent`` to commits (``message, author``): the first mark that fits, null for none."""
    text = F.concat_ws("\n", "author", "message")
    agent = F.lit(None).cast("string")
    for name, pattern in reversed(AGENT_MARKS):
        agent = F.when(text.rlike(pattern), name).otherwise(agent)
    return commits.withColumn("agent", agent)


def agent_ranges(lines: DataFrame) -> DataFrame:
    """``file, agent, start, end``: runs of touching lines per file and agent, from ``file, agent, start, end``."""
    return merge_ranges(lines, ["file", "agent"]).drop("n")


def annotate(findings: DataFrame, provenance: DataFrame) -> DataFrame:
    """Findings with ``agent`` and ``ai_authored``: by file (exact, else a whole-component suffix of it) and, where known, line range."""
    p = provenance.select(F.col("file").alias("_file"), F.col("agent").alias("_agent"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    places = findings.select("file", "line").distinct()
    keyed = places.select("line", F.explode(path_suffixes(F.col("file"))).alias("_file"), F.col("file"))
    inside = F.col("_s").isNull() | F.col("line").isNull() | F.col("line").between(F.col("_s"), F.col("_e"))
    hits = keyed.join(p, "_file").where(inside)
    best = hits.groupBy(F.col("file").alias("_f"), F.col("line").alias("_l")).agg(F.max(F.struct(F.length("_file").alias("l"), "_agent")).alias("b")).select("_f", "_l", F.col("b._agent").alias("agent"))
    joined = findings.join(best, (F.col("file") == F.col("_f")) & F.col("line").eqNullSafe(F.col("_l")), "left").drop("_f", "_l")
    return joined.withColumn("ai_authored", F.col("agent").isNotNull())


def risk_intersections(findings: DataFrame, provenance: DataFrame, integrations: DataFrame) -> DataFrame:
    """Files that agents wrote, that call a model and that have findings: ``file, agents, integrations, findings, risk``."""
    a = provenance.groupBy("file").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    i = integrations.groupBy("file").agg(F.count("*").alias("integrations"))
    n = findings.groupBy("file").agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("severe"))
    joined = a.join(i, "file", "left").join(n, "file", "left").fillna(0, ["integrations", "findings", "severe"]).where("integrations > 0 or findings > 0")
    risk = F.when((F.col("integrations") > 0) & (F.col("severe") > 0), "HIGH").when((F.col("integrations") > 0) & (F.col("findings") > 0), "MEDIUM").otherwise("LOW")
    return joined.withColumn("risk", risk).drop("severe")
