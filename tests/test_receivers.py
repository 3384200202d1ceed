"""Receivers: which classes reach a call, and what that tells of dead methods."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import receivers, resolve
from millrace.session import release_staged
from millrace.sources.files import from_texts
from millrace.sources.python_facts import extract

SOURCES = {
    "lib.py": """
class A:
    def run(self):
        return 1


class B:
    def run(self):
        return 2


class C(A):
    def stop(self):
        return 3


class D(B):
    def run(self):
        return 4


def make():
    return C()


def start(x):
    x.run()


def both(flag):
    a = A()
    if flag:
        a = D()
    a.run()


def chain():
    return make().stop()


def swap():
    b = B()
    b = A()
    b.run()


def loop(n):
    x = A() if n else D()
    for _ in range(n):
        x = loop(n - 1)
        x.run()
    return x
""",
    "app.py": "import lib\n\n\ndef go():\n    lib.start(lib.make())\n    lib.start(x=lib.D())\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return extract(from_texts(spark, SOURCES)).cache()


def test_methods_by_class(facts):
    got = {(r["cls"], r["simple"]): r["callee"] for r in receivers.method_table(facts).collect()}
    assert got == {("lib.A", "run"): "lib.A.run", ("lib.B", "run"): "lib.B.run", ("lib.C", "run"): "lib.A.run", ("lib.C", "stop"): "lib.C.stop", ("lib.D", "run"): "lib.D.run"}


def test_receivers(facts):
    found = {}
    for r in receivers.receiver_methods(facts).collect():
        found.setdefault(r["fn"], set()).add((r["cls"], r["callee"]))
    assert found == {
        "lib.start": {("lib.C", "lib.A.run"), ("lib.D", "lib.D.run")}, "lib.both": {("lib.A", "lib.A.run"), ("lib.D", "lib.D.run")}, "lib.chain": {("lib.C", "lib.C.stop")},
        "lib.swap": {("lib.A", "lib.A.run")}, "lib.loop": {("lib.A", "lib.A.run"), ("lib.D", "lib.D.run")},
    }
    assert receivers.receiver_methods(facts.where("false")).count() == 0
    release_staged()


def test_sure_receivers_keep_one_class_alive(spark):
    """``a.step()`` keeps the class that reaches ``a``; a receiver that may be anything keeps all, as before."""
    classes = "class A:\n    def step(self):\n        return 1\n\n\nclass B:\n    def step(self):\n        return 2\n\n\nB()\n"
    decided = lambda use: {r["name"]: r["decision"] for r in resolve.dead_code(extract(from_texts(spark, {"lib.py": classes, "app.py": use}))).where("type = 'method'").collect()}
    assert decided("from lib import A\n\n\ndef go():\n    a = A()\n    a.step()\n\n\ngo()\n") == {"lib.A.step": "alive", "lib.B.step": "reported"}
    assert decided("def go(a):\n    a.step()\n\n\ngo(1)\n") == {"lib.A.step": "alive", "lib.B.step": "alive"}
    assert decided("from lib import A\n\n\ndef go(x):\n    a = A()\n    if x:\n        a = x\n    a.step()\n\n\ngo(1)\n") == {"lib.A.step": "alive", "lib.B.step": "alive"}
    assert decided("from lib import A\n\n\ndef go(f):\n    a = A()\n    f(a.step)\n    a.step()\n\n\ngo(1)\n")["lib.A.step"] == "alive"
    release_staged()
