"""What users add: rules, visitors, words, checks; the code graph; the trace cache."""

import ast

from pyspark.sql import functions as F

from millrace.extend import Extensions
from millrace.operators import context, rules
from millrace.plans.analyze import analyze
from millrace.sources import sinks
from millrace.sources.files import from_texts

FILES = {"a.py": "import os\n\n\ndef f(x):\n    legacy_call(x)\n    send(x, checked=False)\n    while True:\n        pass\n"}


def loops(node, path):
    """A visitor: loops that never end."""
    if isinstance(node, ast.While) and isinstance(node.test, ast.Constant):
        yield "endless", "while", {"value": node.test.value}


def no_loops(facts):
    return rules.as_findings(facts.where("kind = 'endless'"), "X-1", "HIGH", "custom", F.lit("endless loop"))


def test_rules_visitors_and_words(spark):
    mine = Extensions(rules=[no_loops], visitors=[loops], words=[("calls", "legacy_call", "X-2", "LOW"), ("switches", "checked", "X-3", "MEDIUM")])
    found = analyze(from_texts(spark, FILES), extensions=mine).findings
    assert {(r["rule_id"], r["line"]) for r in found.where("rule_id like 'X-%'").collect()} == {("X-1", 7), ("X-2", 5), ("X-3", 6)}
    assert Extensions().findings(found.limit(0).select(F.col("rule_id").alias("kind"), "name", "file", "line")).count() == 0


def test_added_checks(spark):
    evidence = spark.createDataFrame([("a.py", True), ("b.py", False)], "file string, signed boolean")
    results, score = Extensions(checks=[("signed-prompts", "high", "defense", "signed")]).posture(evidence)
    assert {(r["file"], r["plugin"], r["passed"]) for r in results.collect()} == {("a.py", "signed-prompts", True), ("b.py", "signed-prompts", False)}
    assert score.count() == 1


def test_graph_traces_and_ranks(spark):
    calls = spark.createDataFrame([("m", "a"), ("a", "b"), ("m", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "caller string, callee string")
    dangers = spark.createDataFrame([("c", "R", 3), ("y", "R", 4), ("m", "R", 1)], "scope string, rule_id string, line int")
    got = {r["scope"]: r["trace"] for r in context.threat_traces(dangers, calls, spark.createDataFrame([("m",)], "node string")).collect()}
    assert got == {"c": ["m", "b", "c"], "m": ["m"]}
    graph = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("kind"))
    near = context.neighbourhood(graph, spark.createDataFrame([("c",)], "node string"), 2)
    assert {r["node"]: r["steps"] for r in near.collect()} == {"c": 0, "b": 1, "a": 1, "m": 2}
    candidates = spark.createDataFrame([("_p", "function", 90), ("q", "method", 90), ("r", "function", 60), ("s", "function", 90)], "simple_name string, type string, confidence int")
    assert [r["simple_name"] for r in candidates.orderBy(context.rescue_priority(candidates)).collect()] == ["s", "r", "q", "_p"]


def test_trace_cache(spark, tmp_path):
    first = spark.createDataFrame([("a.py", "f", 1)], "file string, function string, line int")
    again = spark.createDataFrame([("b.py", "g", 2)], "file string, function string, line int")
    path = f"file://{tmp_path}/traces"
    assert [r["file"] for r in sinks.cache_trace(first, path, "s1").collect()] == ["a.py"]
    assert [r["file"] for r in sinks.cache_trace(again, path, "s1").collect()] == ["a.py"]
    assert [r["file"] for r in sinks.cache_trace(again, path, "s2").collect()] == ["b.py"]
