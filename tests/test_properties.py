"""Properties of the plain functions that run inside tasks."""

import ast

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators.clones import fragments_of, similarity
from millrace.sources.python_facts import COLUMNS, cognitive, cyclomatic, facts_of, nesting

SNIPPETS = st.lists(
    st.sampled_from(["x = 1", "if a:\n    b()", "for i in y:\n    if i:\n        z(i)", "try:\n    q()\nexcept:\n    pass", "def g(a=[]):\n    return a", "class C(B):\n    def m(self):\n        return self.x", "import os, json as j", "from .a import b", "while 1:\n    break", "with open('f') as f:\n    f.read()", "return_ = lambda v: v if v else None", "async def h():\n    await k()"]),
    max_size=8,
).map("\n".join)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text_gives_rows_of_the_schema(text):
    rows = facts_of("a.py", "a", text)
    assert rows and all(len(r) == len(COLUMNS) for r in rows)
    assert fragments_of("a.py", text) == fragments_of("a.py", text)


@settings(max_examples=60, deadline=None)
@given(SNIPPETS)
def test_metrics_grow_with_nesting(code):
    tree = ast.parse(code)
    wrapped = ast.parse("if outer:\n" + "\n".join("    " + x for x in code.split("\n")) if code else "if outer:\n    pass")
    assert nesting(wrapped.body) >= nesting(tree.body)
    assert cognitive(wrapped.body) >= cognitive(tree.body) + 1
    fn = ast.parse("def f():\n" + "\n".join("    " + x for x in (code or "pass").split("\n"))).body[0]
    assert cyclomatic(fn) >= 1
    assert {r[0] for r in facts_of("a.py", "a", code)} >= {"module"}


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_similarity_is_one_for_equals_and_bounded(a, b):
    assert similarity(a, a, 0.9) == 1.0
    assert 0.0 <= similarity(a, b, 0.5) <= 1.0
