"""Outside data across functions."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import taint
from millrace.plans.analyze import analyze
from millrace.session import release_staged
from millrace.sources.files import from_texts
from millrace.sources.python_facts import extract

LIB = """
import os, shlex


def read():
    return inner()


def inner():
    return input()


def run(cmd):
    deep(cmd)


def deep(c):
    os.system(c)


def clean(v):
    return shlex.quote(v)


def echo(v):
    return v.strip()


def named(a, b='x', *, c='y'):
    os.system(c)


class Box:
    def __init__(self, v):
        os.popen(v)

    def go(self, v):
        self.put(w=v)

    def put(self, w):
        os.system(w)
"""

CASES = {
    "a": ("run(read())", {"lib.deep"}),
    "b": ("run(clean(read()))", set()),
    "c": ("x = echo(read())\n    y = echo('safe')\n    os.system(y)", set()),
    "d": ("os.system(echo(read()))", {"m.d"}),
    "e": ("os.popen(m.again(3))", {"m.e"}),
    "f": ("for k in range(3):\n        os.system(z) if k else None\n        z = input()", {"m.f"}),
    "g": ("named(1, c=read())", {"lib.named"}),
    "h": ("named(read(), 'b')", set()),
    "i": ("Box(read())", {"lib.Box.__init__"}),
    "j": ("Box('x').go(read())", {"lib.Box.put"}),
    "k": ("x = read()\n    x = 'clean'\n    run(x)", set()),
    "l": ("os.system(unknown(read()))", {"m.l"}),
    "n": ("run(int(read()))", set()),
}
AGAIN = "\n\ndef again(n):\n    if n:\n        return again(n - 1)\n    return input()\n\n\ndef spin(x):\n    return spin(x)\n"


@pytest.fixture(scope="module")
def facts(spark):
    body = "import os, m\nfrom lib import *\nfrom lib import read, run, clean, echo, named, Box\n"
    for name, (code, _) in CASES.items():
        body += f"\n\ndef {name}():\n    {code}\n"
    return extract(from_texts(spark, {"lib.py": LIB, "m.py": body + AGAIN})).cache()


def test_flows(facts):
    sinks = facts.where("kind = 'value_call'").select("file", "line", "name", F.col("scope").alias("inside"))
    found = taint.find_flows(taint.python_program(facts)).select("fn", "start", "sink.*", "way").join(sinks, ["file", "line", "name"]).collect()
    by = {name: {r["inside"] for r in found if f"m.{name}" in r["way"]} for name in CASES}
    assert by == {name: want for name, (_, want) in CASES.items()}
    way = next(r["way"] for r in found if r["inside"] == "lib.deep" and "m.a" in r["way"])
    assert way == ["lib.inner", "lib.read", "m.a", "lib.run", "lib.deep"]
    release_staged()


def test_findings_and_empty_programs(spark, facts):
    rows = taint.taint_findings(facts).collect()
    assert {r["rule_id"] for r in rows} == {"SKY-D212"} and all(" by " in r["message"] for r in rows)
    assert len({(r["file"], r["line"]) for r in rows}) == len(rows)
    assert taint.taint_findings(facts.where("false")).count() == 0
    release_staged()


def test_a_call_of_a_helper_does_not_taint_another(spark):
    """Repeated rows, and one helper between a thousand callers of which one has a source."""
    body = "import os\n\n\ndef same(x):\n    return x\n"
    for k in range(300):
        body += f"\n\ndef f{k}():\n    os.system(same({'input()' if k == 7 else repr(str(k))}))\n"
    facts = extract(from_texts(spark, {"m.py": body}))
    found = taint.find_flows(taint.python_program(facts.unionByName(facts))).collect()
    assert [r["fn"] for r in found] == ["m.f7"]
    release_staged()


def test_analysis_reports_them(spark):
    found = analyze(from_texts(spark, {"m.py": "import os\n\n\ndef get():\n    return input()\n\n\ndef main():\n    os.system(get())\n\n\nmain()\n"}))
    assert [(r["rule_id"], r["line"]) for r in found.findings.where("rule_id = 'SKY-D212'").collect()] == [("SKY-D212", 9)]
