"""Source files to findings: labelled cases with what must and must not be reported."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.plans.analyze import analyze, module_edges
from millrace.sources import files as sources
from millrace.sources import sinks
from millrace.sources.python_facts import extract, facts_of, of_kind

PROJECT = {
    "pkg/__init__.py": "from .core import public\n__all__ = ['public']\n",
    "pkg/core.py": '''
import os
import json
from pkg.base import Base


def public(a, unused):
    return helper(a)


def helper(x):
    return os.path.join(x)


def lonely():
    return chained()


def chained():
    return 1


def kept():  # noqa
    return 2


class Child(Base):
    def hook(self):
        return self.inner()

    def inner(self):
        return 3

    def never(self):
        return 4


class Ghost:
    def method(self):
        return 5


def _private():
    return Child()
''',
    "pkg/base.py": "class Base:\n    def hook(self):\n        raise NotImplementedError\n\n\ndef drive(b: Base):\n    return b.hook()\n",
    "pkg/__main__.py": "from pkg.base import drive\nfrom pkg.core import Child\n\ndrive(Child())\n",
    "tests/test_core.py": "def test_it():\n    assert True\n",
    "web/app.ts": "export const x = 1",
    "pkg/broken.py": "def (",
}

SECURITY = {
    "s/a.py": '''
import hashlib, os, pickle, random, subprocess, yaml
import requests
from flask import request, redirect


def view(cursor):
    q = request.args.get("q")
    cursor.execute(f"select {q}")
    cursor.execute("select ?", (q,))
    n = int(q)
    os.system("ls " + str(n))
    os.system("ls " + q)
    clean = os.path.basename(q)
    open(clean)
    open(q)
    return redirect(q)


def tools(path):
    subprocess.run(path, shell=True)
    subprocess.run(["ls"], check=True)
    yaml.load(path, Loader=yaml.SafeLoader)
    yaml.load(path)
    requests.get(path, verify=False)
    return pickle.loads(path), hashlib.md5(path)


def make_token():
    return random.random()


async def slow():
    import time
    time.sleep(1)


API_KEY = "9f8a7b6c5d4e3f2a"
''',
}


@pytest.fixture(scope="module")
def project(spark):
    return analyze(sources.from_texts(spark, PROJECT))


def test_dead_code_labels(project):
    dead = {r["def_key"]: r["decision"] for r in project.dead.collect()}
    present = ["pkg.core.lonely", "pkg.core.chained", "pkg.core.Child.never", "pkg.core.Ghost", "pkg.core._private", "pkg/core.py:json", "pkg.core.public.unused"]
    absent = ["pkg.core.public", "pkg.core.helper", "pkg.core.Child", "pkg.core.Child.hook", "pkg.core.Child.inner", "pkg.base.Base", "pkg.base.drive", "pkg.core.kept", "tests.test_core.test_it", "pkg/core.py:os", "pkg.core.public.a"]
    assert {k: dead[k] for k in present} == {k: "reported" for k in present}
    assert [k for k in absent if dead[k] == "reported"] == []
    assert dead["pkg.core.Ghost.method"] == "in_reported_class"


def test_incomplete_is_not_clean(project):
    assert {(r["file"], r["reason"]) for r in project.incomplete().collect()} == {("web/app.ts", "unsupported language"), ("pkg/broken.py", "SyntaxError")}
    assert {r["lang"]: r["status"] for r in sources.language_counts(project.files).collect()} == {"python": "complete", "typescript": "incomplete"}


def test_security_labels(spark):
    a = analyze(sources.from_texts(spark, SECURITY))
    got = {(r["rule_id"], r["line"]) for r in a.findings.where("category in ('security', 'secrets')").collect()}
    lines = SECURITY["s/a.py"].split("\n")
    at = lambda text: next(k + 1 for k, x in enumerate(lines) if text in x)
    present = [("SKY-D211", 'f"select'), ("SKY-D212", '"ls " + q)'), ("SKY-D215", "open(q)"), ("SKY-D230", "redirect(q)"), ("SKY-D212", "subprocess.run(path"), ("SKY-D209", "subprocess.run(path"), ("SKY-D206", "yaml.load(path)"), ("SKY-D210", "verify=False"), ("SKY-D205", "pickle.loads"), ("SKY-D207", "pickle.loads"), ("SKY-D250", "random.random"), ("SKY-L014", "API_KEY")]
    absent = [("SKY-D211", "select ?"), ("SKY-D212", "str(n)"), ("SKY-D215", "open(clean)"), ("SKY-D209", '["ls"]'), ("SKY-D206", "SafeLoader")]
    assert [x for x in present if (x[0], at(x[1])) not in got] == []
    assert [x for x in absent if (x[0], at(x[1])) in got] == []
    assert ("SKY-Q401", at("time.sleep")) in {(r["rule_id"], r["line"]) for r in a.findings.collect()}


def test_cognitive_complexity_examples():
    """Operands less one, no deeper nesting for else-if, nested functions from level 0, handlers and conditional expressions."""
    at = lambda text: {r[3]: r[7]["cognitive"] for r in facts_of("m.py", "m", text) if r[0] == "function"}["m.f"]
    assert at("def f(a, b, c):\n    if a and b and c:\n        return 1\n") == 3
    assert at("def f(a, b):\n    if a:\n        return 1\n    elif b:\n        return 2\n    else:\n        return 3\n") == 3
    assert at("def f(a):\n    for x in a:\n        if x:\n            while x:\n                x = 0\n") == 1 + 2 + 3
    assert at("def f(a):\n    for x in a:\n        def g():\n            if x:\n                return 1\n") == 1 + 1
    assert at("def f(a):\n    try:\n        a = 1\n    except ValueError:\n        if a:\n            a = 2\n    return 1 if a else 2\n") == 1 + 2 + 1


def test_cohesion_examples():
    at = {r[3]: r[7] for r in facts_of("m.py", "m", "class A:\n    def a(self):\n        return self.x\n    def b(self):\n        return self.x + self.y\n    def c(self):\n        return self.z\n") if r[0] == "class"}["m.A"]
    assert (at["lcom4"], at["lcom1"], at["lcom5"]) == (2, 2 - 1, (3 - 4 / 3) / 2)


def test_metrics():
    text = '''
def f(a, b, c=1, *, d):
    if a and b or c:
        for x in d:
            while x:
                pass
    elif b:
        return [y for y in d if y]
    else:
        try:
            return 1
        except ValueError:
            pass
    return lambda: 1 if a else 2
'''
    rows = {r[3]: r for r in facts_of("m.py", "m", text) if r[0] == "function"}
    n = rows["m.f"][7]
    assert (n["complexity"], n["nesting"], n["args"], n["required"], n["returns"]) == (1 + 1 + 1 + 1 + 1 + 1 + 1 + 2 + 1, 3, 4, 2, 3)
    kinds = {r[3] for r in facts_of("m.py", "m", "def g(a=[]):\n    try:\n        x = 1\n    except:\n        pass\n    return 1\n    x == None\n") if r[0] == "pattern"}
    assert kinds == {"mutable_default", "bare_except", "empty_handler", "unreachable", "constant_comparison", "no_effect"}
    cls = next(r for r in facts_of("m.py", "m", "class A:\n    def a(self): return self.x\n    def b(self): return self.x\n    def c(self): return self.y\n    def d(self): return self.c()\n") if r[0] == "class")
    assert (cls[7]["methods"], cls[7]["attributes"], cls[7]["lcom4"]) == (4, 2, 2)


def test_metric_rules_and_custom_rules(spark):
    long = "def big(a, b, c, d, e, f):\n" + "".join(f"    if a == {k}:\n        b += {k}\n" for k in range(30)) + "    return b\n"
    f = sources.from_texts(spark, {"m.py": long, "empty.py": '"""doc"""\n'})
    facts = extract(f)
    got = {(r["rule_id"], r["severity"], r["value"]) for r in rules.metric_rules(of_kind(facts, "function"), of_kind(facts, "class"), of_kind(facts, "module"), f).collect()}
    assert {("SKY-Q301", "CRITICAL", 31.0), ("SKY-Q306", "MEDIUM", 30.0), ("SKY-C303", "MEDIUM", 6.0), ("SKY-C304", "MEDIUM", 62.0), ("SKY-E002", "LOW", None)} <= got
    custom = rules.custom_rules(facts, [{"id": "MY-1", "severity": "HIGH", "kind": "function", "name": "m.b*", "max": {"complexity": 20}}])
    assert [(r["rule_id"], r["name"]) for r in custom.collect()] == [("MY-1", "m.big")]


def test_wrong_calls(spark):
    f = sources.from_texts(spark, {"a.py": "import b\nb.g(1, 2)\nb.g()\nb.g(x=1)\nb.nothing()\n", "b.py": "def g(x): return x\n"})
    facts = extract(f)
    calls, functions = of_kind(facts, "call"), of_kind(facts, "function")
    assert sorted(r["line"] for r in rules.signature_mismatches(calls, functions).collect()) == [2, 3]
    defs = of_kind(facts, "definition").where("attrs['type'] <> 'import'")
    assert [r["name"] for r in rules.phantom_calls(calls, defs, of_kind(facts, "import")).collect()] == ["b.nothing"]
    assert [tuple(r) for r in module_edges(facts).collect()] == [("a", "b")]


def test_sources_from_disk(spark, tmp_path):
    for path, text in {"src/a.py": "x = 1\n# c\n\n", "src/.venv/b.py": "y = 1", "src/build/keep.py": "z = 1", "src/t/test_a.py": "# t\n", "src/n.md": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r["path"]: (r["lang"], r["module"], r["loc"], r["role"]) for r in sources.source_files(spark, [str(tmp_path / "src"), str(tmp_path / "src")], include=["build"]).collect()}
    assert got == {"a.py": ("python", "a", 1, "source"), "build/keep.py": ("python", "build.keep", 1, "source"), "t/test_a.py": ("python", "t.test_a", 0, "test"), "n.md": (None, "n.md", 1, "source")}
    (tmp_path / "trace.json").write_text(json.dumps({"calls": [{"file": "a.py", "function": "f", "line": 3}]}))
    assert [tuple(r) for r in sources.trace_calls(spark, str(tmp_path / "trace.json")).collect()] == [("a.py", "f", 3)]
    bits = spark.createDataFrame([("a.py", bytearray([0b00000110, 0b1]))], "file string, numbits binary")
    assert sorted(r["line"] for r in sources.coverage_lines(bits).collect()) == [1, 2, 8]


def test_sinks(spark, tmp_path, project):
    f = project.findings.where("rule_id in ('SKY-U002', 'SKY-T102')")
    report = json.loads(sinks.sarif(f).first()["sarif"])
    results = report["runs"][0]["results"]
    assert report["version"] == "2.1.0" and len(results) == f.count() and results[0]["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1
    (tmp_path / "r.sarif").write_text(json.dumps(report))
    back = sources.external_reports(spark, str(tmp_path / "r.sarif"))
    assert back.count() == f.count() and {r["rule_id"] for r in back.collect()} == {"SKY-U002", "SKY-T102"}
    assert all(r["annotation"].startswith("::") for r in sinks.annotations(f).collect())
    sinks.save_baseline(f, str(tmp_path / "baseline"))
    assert spark.read.parquet(str(tmp_path / "baseline")).count() == f.select("rule_id", "file", "name", "message").distinct().count()
    one, two = (sinks.attestation(x, project.files).first() for x in (f, f.repartition(3)))
    assert one == two and len(one["findings_sha256"]) == 64


def test_grade_of_project(project):
    assert {r["category"]: r["grade"] for r in project.grade().collect()}["dead_code"] in {"A+", "A", "A-", "B+"}
    assert project.findings.where(F.col("rule_id").isNull()).count() == 0
