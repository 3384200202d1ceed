"""Patterns by literals, held against every pair tried one by one."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions.scalar import glob_to_regex
from millrace.operators import patterns

REGEXES = [
    "^handle_\\w*$", "^\\w*_view$", "^abc?d$", "^ab*$", "^a{2}b$", "^(ab|cd)$", "foo|^bar$", "(?i)^ABC$", "^[ab]c$", "^[abc$", "^a\\.b$", "\\d$", "^a", "b$", "ab", "^.*b.*$", "^$", "^\\w*$", "^ab\\+c", "^abc+$", "ab?$", "^.b$", "^(abc)?d$",
    "^x" + "y" * 50 + ".*$", "^.*" + "z" * 40 + "$", "a.*b$", "^a+b$",
]


def _brute(names, regexes):
    return {(n, p) for n in names for p in regexes if re.search(p, n, re.ASCII)}


def test_against_every_pair(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("abcd._x") for _ in range(rng.randint(0, 6))) for _ in range(400)} | {"handle_x", "my_view", "ABC", "abc", "ab+c", "x" + "y" * 60, "z" * 41, "y" * 50, "é", "1"}
    regexes = [p for p in REGEXES if p != "^[abc$"]
    globs = {"".join(rng.choice("abc.*?") for _ in range(rng.randint(0, 5))) for _ in range(150)}
    globs = {r["g"]: r["r"] for r in spark.createDataFrame([(g,) for g in globs], "g string").select("g", glob_to_regex(F.col("g")).alias("r")).collect()}
    every = regexes + list(globs.values())
    n = spark.createDataFrame([(x,) for x in [*names, None, "abc"]], "name string")
    p = spark.createDataFrame([(x,) for x in [*every, None, "^a"]], "pattern string")
    got = patterns.matches(n, "name", p, "pattern")
    rows = [tuple(r) for r in got.collect()]
    assert not set(rows) ^ _brute(names, every)
    assert len(rows) == len(set(rows))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert patterns.matches(n, "name", p.limit(0), "pattern").count() == 0 == patterns.matches(n.limit(0), "name", p, "pattern").count()
