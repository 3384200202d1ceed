"""Provenance, guardrails, regressions, concurrency rules and the library entry points."""

import json

from pyspark.sql import functions as F

from millrace import api
from millrace.operators import defend, provenance, regression, rules
from millrace.plans.analyze import analyze
from millrace.sources import files as sources
from millrace.sources.python_facts import extract, of_kind

CODE = {
    "app/llm.py": '''
import json, logging
from openai import OpenAI

client = OpenAI()


def ask(question):
    logging.info("asking")
    out = client.chat.completions.create(model="m-2024-05-13", max_tokens=10, messages=question)
    return json.loads(out)


def tool(question):
    return eval(client.chat.completions.create(model="latest", tools=[1], messages=question))
''',
    "app/threads.py": '''
import threading

COUNT = 0
a_lock = threading.Lock()
b_lock = threading.Lock()


def work():
    global COUNT
    with a_lock:
        with b_lock:
            COUNT += 1


def other():
    with b_lock, a_lock:
        pass


def go():
    threading.Thread(target=work).start()
    f = open("x")
    g = open("y")
    g.close()
    with open("z") as h:
        pass


def xq():
    try:
        pass
    except ValueError as e:
        return str(e)
''',
    "tests/test_a.py": 'from unittest import mock\n\n\ndef test_a():\n    with mock.patch("app.threads.gone"), mock.patch("app.threads.work"):\n        pass\n',
}


def test_more_rules(spark):
    a = analyze(sources.from_texts(spark, CODE))
    got = {(r["rule_id"], r["file"], r["line"]) for r in a.findings.collect()}
    present = [("SKY-Q403", "app/threads.py", 12), ("SKY-Q403", "app/threads.py", 17), ("SKY-Q404", "app/threads.py", 10), ("SKY-L008", "app/threads.py", 23), ("SKY-L017", "app/threads.py", 33), ("SKY-L024", "tests/test_a.py", 5), ("SKY-R101", ".", 1)]
    assert [x for x in present if x not in got] == []
    assert not any(r == "SKY-L008" and line in (24, 26) for r, _, line in got)
    assert sum(r == "SKY-L024" for r, _, _ in got) == 1
    names = {r["name"]: r["rule_id"] for r in rules.opaque_names(of_kind(a.facts, "definition")).collect()}
    assert set(names) == set()


def test_guardrails(spark):
    facts = extract(sources.from_texts(spark, CODE))
    calls = of_kind(facts, "call")
    found = defend.integrations(calls)
    assert sorted((r["scope"], r["provider"]) for r in found.collect()) == [("app.llm.ask", "openai"), ("app.llm.tool", "openai")]
    results = defend.checks(found, calls, of_kind(facts, "flow"))
    by = {(r["scope"].split(".")[-1], r["plugin"]): r["passed"] for r in results.collect()}
    assert len(by) == 26
    assert {k: by["ask", k] for k in ("model-pinned", "cost-controls", "logging-present", "output-validation", "no-dangerous-sink", "tool-scope")} == dict.fromkeys(("model-pinned", "cost-controls", "logging-present", "output-validation", "no-dangerous-sink", "tool-scope"), True)
    assert {k: by["tool", k] for k in ("model-pinned", "no-dangerous-sink", "tool-scope", "tool-schema-present", "untrusted-input-to-prompt")} == dict.fromkeys(("model-pinned", "no-dangerous-sink", "tool-scope", "tool-schema-present", "untrusted-input-to-prompt"), False)
    defence, ops = defend.posture(results)
    assert defence.first()["total"] == 20 and ops.first()["total"] == 6


def test_provenance(spark):
    commits = spark.createDataFrame([("fix\n\nCo-authored-by: Copilot", "a@x"), ("plain", "b@x"), ("x", "devin-ai@bot")], "message string, author string")
    assert [r["agent"] for r in provenance.detect_agents(commits).collect()] == ["copilot", None, "devin"]
    lines = spark.createDataFrame([("src/a.py", "x", 1, 3), ("src/a.py", "x", 4, 6), ("src/a.py", "x", 9, 9)], "file string, agent string, start int, end int")
    ranges = provenance.agent_ranges(lines)
    assert sorted((r["start"], r["end"]) for r in ranges.collect()) == [(1, 6), (9, 9)]
    f = spark.createDataFrame([("repo/src/a.py", 5, "HIGH"), ("repo/src/a.py", 7, "LOW"), ("b.py", 1, "LOW")], "file string, line int, severity string")
    assert {(r["file"], r["line"]): r["agent"] for r in provenance.annotate(f, ranges).collect()} == {("repo/src/a.py", 5): "x", ("repo/src/a.py", 7): None, ("b.py", 1): None}
    i = spark.createDataFrame([("src/a.py",)], "file string")
    risk = provenance.risk_intersections(f.withColumn("file", F.regexp_replace("file", "^repo/", "")), ranges, i).collect()
    assert [(r["file"], r["risk"], r["findings"]) for r in risk] == [("src/a.py", "HIGH", 2)]


def test_regressions(spark):
    diff = ["@@ -1 +1 @@", "-@login_required", " def f():", "@@ -5 +5 @@", "-    validate(x)", "+    validate(y)", "@@ -9 +9 @@", "-    get(u, verify=True)", "+    get(u, verify=False)"]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(diff)], "diff string, k int, line string")
    assert sorted((r["hunk"], r["control"]) for r in regression.security_regressions(lines, ["diff"], "k").collect()) == [(1, "auth_decorator"), (3, "tls_verification")]
    b = spark.createDataFrame([("w", "contents", "read"), ("w", "issues", "write"), ("w", "x", "read")], "path string, permission string, level string")
    a = spark.createDataFrame([("w", "contents", "write"), ("w", "issues", "read"), ("w", "packages", "read")], "path string, permission string, level string")
    assert {(r["permission"], r["change"]) for r in regression.surface_drift(b, a, ["path", "permission"], "level").collect()} == {("contents", "changed"), ("issues", "changed"), ("packages", "added"), ("x", "removed")}
    assert {r["permission"] for r in regression.permission_expansion(b, a).collect()} == {"contents", "packages"}
    routes = spark.createDataFrame([("/admin/x", ["app.route"]), ("/admin/y", ["app.route", "login_required"]), ("/z", [])], "route string, decorators array<string>")
    contract = spark.createDataFrame([("/admin", "login_required")], "prefix string, guard string")
    assert [r["route"] for r in regression.unguarded_routes(routes, contract).collect()] == ["/admin/x"]
    changed = spark.createDataFrame([("src/auth.py",), ("docs/x.md",)], "file string")
    risky = spark.createDataFrame([("auth",)], "pattern string")
    assert [r["file"] for r in regression.untested_changes(changed, risky).collect()] == ["src/auth.py"]
    assert regression.untested_changes(changed.union(spark.createDataFrame([("tests/test_x.py",)], "file string")), risky).count() == 0


def test_library_entry_points(spark, tmp_path):
    for path, text in CODE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    a = api.analyze_path(spark, str(tmp_path))
    body = json.loads(api.report(a))
    assert body["summary"]["security"] >= 1 and body["incomplete"] == [] and body["findings"][0]["severity"] == "CRITICAL" or body["findings"][0]["severity"] == "HIGH"
    ranges = spark.createDataFrame([("app/threads.py", 20, 24)], "file string, start int, end int")
    change = api.verify_change(a, ranges)
    assert {r["line"] for r in change.collect()} <= set(range(20, 25)) and change.count() > 0
    assert api.verify_change(a, ranges, change).count() == 0
    assert api.gate(a, strict=True).first()["passed"] is False
