"""Assertions over agent behaviour: three-valued, missing evidence is incomplete and never a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.findings import lookup

#: Statuses in order of precedence.
STATUS_RANK = {"pass": 0, "incomplete": 1, "fail": 2}

#: Kinds of assertion, over observation columns ``answer``, ``tools``, ``sources`` and ``refused``.
KINDS = "contains excludes required_tool allowed_tools forbidden_tools exact_sequence max_calls refusal required_source".split()


def evaluate(assertions: DataFrame, observations: DataFrame) -> DataFrame:
    """Status of every assertion.

    ``assertions``: ``scenario, kind, text, tools, number``; ``observations``: ``scenario, answer, tools,
    sources, refused``, any of which may be null (not observed).
    """
    o = observations.select("scenario", "answer", F.col("tools").alias("seen"), "sources", "refused")
    joined = assertions.join(o, "scenario", "left")
    answer, seen, text = F.col("answer"), F.col("seen"), F.col("text")
    holds = (
        F.when(F.col("kind") == "contains", F.lower(answer).contains(F.lower(text)))
        .when(F.col("kind") == "excludes", ~F.lower(answer).contains(F.lower(text)))
        .when(F.col("kind") == "required_tool", F.array_contains(seen, text))
        .when(F.col("kind") == "allowed_tools", F.size(F.array_except(seen, F.col("tools"))) == 0)
        .when(F.col("kind") == "forbidden_tools", F.size(F.array_intersect(seen, F.col("tools"))) == 0)
        .when(F.col("kind") == "exact_sequence", seen == F.col("tools"))
        .when(F.col("kind") == "max_calls", F.size(seen) <= F.col("number"))
        .when(F.col("kind") == "refusal", F.col("refused"))
        .when(F.col("kind") == "required_source", F.array_contains("sources", text))
    )
    needs = F.when(F.col("kind").isin("contains", "excludes"), answer.isNull()).when(F.col("kind") == "refusal", F.col("refused").isNull()).when(F.col("kind") == "required_source", F.col("sources").isNull()).otherwise(seen.isNull())
    status = F.when(needs | holds.isNull(), "incomplete").when(holds, "pass").otherwise("fail")
    return joined.select("scenario", "kind", status.alias("status"))


def combine(statuses: DataFrame, by: str, subjects: DataFrame | None = None) -> DataFrame:
    """Worst status per subject: fail, then incomplete, then pass; a subject without assertions passes."""
    worst = statuses.groupBy(by).agg(F.max(lookup(F.col("status"), STATUS_RANK)).alias("r"), F.count("*").alias("assertions"))
    if subjects is not None:
        worst = subjects.select(by).distinct().join(worst, by, "left")
    rank = F.coalesce("r", F.lit(0))
    return worst.select(by, F.when(rank == 2, "fail").when(rank == 1, "incomplete").otherwise("pass").alias("status"), F.coalesce("assertions", F.lit(0)).alias("assertions"))


def verification_coverage(expected: DataFrame, completed: DataFrame, by: list[str]) -> DataFrame:
    """Expected checks with their outcome; one that was not completed is incomplete."""
    done = completed.select(*by, "passed")
    status = F.when(F.col("passed").isNull(), "incomplete").when(F.col("passed"), "pass").otherwise("fail")
    return expected.join(done, by, "left").withColumn("status", status).drop("passed")
