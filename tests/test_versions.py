"""Versions and ranges: against the packaging library, and against semantic versioning's own order."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import versions
from millrace.operators import deps

PEP = "1.0.dev1 1.0a1.dev1 1.0a1 1.0a1.post1 1.0a2 1.0b1 1.0rc1.dev2 1.0rc1 1.0 1.0+abc 1.0+abc.5 1.0+5 1.0.post1.dev1 1.0.post1 1.0.1 1.1 1.9 1.10 1.10.1 2 10 1!0.1".split()
SEM = "0.0.1-0 0.0.1 1.0.0-1 1.0.0-2 1.0.0-10 1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 1.0.0 1.0.1-x 1.0.1 1.2.0 1.10.0 2.0.0-rc.1 2.0.0 10.0.0".split()


def keys(spark, values, key):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(2)
    return [r["k"] for r in df.select("i", key(F.col("v")).alias("k")).orderBy("i").collect()]


@pytest.mark.parametrize("order, key", [(PEP, versions.pep440_key), (SEM, versions.semver_key)])
def test_precedence(spark, order, key):
    found = keys(spark, order, key)
    assert None not in found and found == sorted(found) and len(set(found)) == len(found)


def test_equal_spellings(spark):
    for same in (["1", "1.0", "v1.0.0", " 1.0 "], ["1.0rc1", "1.0-rc.1", "1.0c1", "1.0.pre1", "1.0_preview_1"], ["1.0.post2", "1.0-2", "1.0.r2", "1.0-rev2"], ["1.0a", "1.0.alpha0"], ["1.0+a.b", "1.0+A-b"]):
        assert len(set(keys(spark, same, versions.pep440_key))) == 1
    assert len(set(keys(spark, ["1.2.0", "1.2", "v1.2.0", "1.2.0+build.7"], versions.semver_key))) == 1
    assert keys(spark, [None, "", "abc", "1..2", "1.0.0-", "latest"], versions.semver_key) == [None] * 6
    assert keys(spark, [None, "", "abc", "1.0x", "1.0+"], versions.pep440_key) == [None] * 5


def test_pep440_against_packaging(spark):
    from packaging.version import Version

    rng = random.Random(3)
    part = lambda: rng.choice(["0", "1", "2", "10", "007", "99999999999999999999"])
    made = [
        rng.choice(["", "1!"]) + ".".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", f"a{part()}", f"rc{part()}", f"b{part()}"]) + rng.choice(["", "", f".post{part()}"]) + rng.choice(["", "", f".dev{part()}"]) + rng.choice(["", "", "+x", "+1.x", "+2"])
        for _ in range(250)
    ]
    found = keys(spark, made, versions.pep440_key)
    real = [Version(v) for v in made]
    for (a, x), (b, y) in itertools.combinations(zip(found, real), 2):
        assert (a < b, a == b) == (x < y, x == y), (x, y)


def test_pep440_ranges_against_packaging(spark):
    from packaging.specifiers import SpecifierSet
    from packaging.version import Version

    tried = [v for v in PEP if "+" not in v] + "1.0.2 1.4 1.4.1 1.4.2 1.4.9 1.5 1.5.0 1.5.post1 1.6 1.99 2.0rc1 2.0 2.0.1 3.0".split()
    specs = ["", ">=1,<2,!=1.5", "~=1.4", "~=1.4.2", "==1.*", "!=1.*", "==1.5", "==1.4.*,!=1.4.1", ">1.0", ">1.0.post1", "<2", "<2.0rc1", "<=1.0", ">=1.0rc1,<1.1", "!=1.4.*,!=1.5,>1", "<1,>2", "===1.5", "==1!0.1", "~=1.0rc1", ">=1.0.dev1"]
    df = spark.createDataFrame([(s,) for s in specs], "s string").select("s", F.explode_outer(versions.pep440_intervals(F.col("s"))).alias("x")).select("s", "x.*")
    held = {}
    for r in df.collect():
        held.setdefault(r["s"], []).append((r["low"], r["high"]))
    found = keys(spark, tried, versions.pep440_key)
    for s in specs:
        want = {v for v in tried if SpecifierSet(s).contains(Version(v), prereleases=True) or s == "===1.5" and Version(v) == Version("1.5")}
        got = {v for v, k in zip(tried, found) if any(low is not None and low <= k < high for low, high in held[s])}
        assert got == want, (s, got ^ want)
    assert spark.createDataFrame([("latest",), (">=x",), (None,)], "s string").select(versions.pep440_intervals(F.col("s")).alias("x")).where("x is not null").count() == 0


def test_npm_ranges(spark):
    cases = {
        "^1.2.3": ("1.2.3 1.2.4 1.9.0", "1.2.2 1.2.3-rc.1 2.0.0 2.0.0-rc.1"), "^0.2.3": ("0.2.3 0.2.9", "0.3.0 0.2.2 1.0.0"), "^0.0.3": ("0.0.3", "0.0.4 0.1.0"), "^1.2": ("1.2.0 1.9.9", "2.0.0 1.1.9"), "^0": ("0.0.0 0.9.1", "1.0.0"), "^1.x": ("1.0.0 1.9.9", "2.0.0"), "^0.0": ("0.0.0 0.0.9", "0.1.0"),
        "~1.2.3": ("1.2.3 1.2.9", "1.3.0 1.2.2"), "~1.2": ("1.2.0 1.2.9", "1.3.0"), "~1": ("1.0.0 1.9.0", "2.0.0 0.9.9"), "1.x": ("1.0.0 1.5.5", "2.0.0 0.9.0"), "1.2.x": ("1.2.0 1.2.7", "1.3.0"), "*": ("0.0.0 9.9.9", ""), "": ("1.0.0", ""), "1.2.3": ("1.2.3", "1.2.4 1.2.2"),
        ">=1.2 <2 || 3.x": ("1.2.0 1.9.9 3.0.0 3.9.0", "1.1.9 2.0.0 4.0.0"), ">1.2": ("1.3.0", "1.2.9 1.2.0"), "<=1.2": ("1.2.9 0.1.0", "1.3.0"), "<1.2": ("1.1.9", "1.2.0"), "1.2 - 2.3": ("1.2.0 2.3.9", "2.4.0 1.1.9"), "1.2.3 - 2.3.4": ("1.2.3 2.3.4", "2.3.5 1.2.2"), ">= 1.2.3 < 1.3": ("1.2.3 1.2.9", "1.3.0"),
        "=1.2.3-rc.1": ("1.2.3-rc.1", "1.2.3 1.2.3-rc.2"), ">2.0.0-rc.1": ("2.0.0-rc.2 2.0.0", "2.0.0-rc.1 2.0.0-beta"), "<1 >2": ("", "0.5.0 1.5.0 3.0.0"),
    }
    rows = [(spec, v, inside) for spec, sides in cases.items() for inside, side in zip((True, False), sides) for v in side.split()]
    df = spark.createDataFrame(rows, "spec string, v string, want boolean").withColumns({"k": versions.semver_key(F.col("v")), "x": versions.npm_intervals(F.col("spec"))})
    wrong = df.where("x is null or exists(x, i -> i.low <= k and k < i.high) <> want").collect()
    assert not wrong
    assert spark.createDataFrame([("latest",), ("git+https://x",), ("file:../y",), (None,)], "s string").where(versions.npm_intervals(F.col("s")).isNotNull()).count() == 0


def test_pre_releases_are_not_fixed(spark):
    """A release candidate of the fixed version has what was fixed."""
    d = spark.createDataFrame([(1, "npm", "a", "2.0.0-rc.1"), (2, "npm", "a", "2.0.0"), (3, "PyPI", "b", "==2.0rc1"), (4, "PyPI", "b", "==2.0.post1"), (5, "npm", "a", "^1.2"), (6, "PyPI", "b", ">=2"), (7, "npm", "a", "latest"), (8, "PyPI", "b", ">=1.0,!=1.5"), (9, "npm", "zzz", "*")], "id long, eco string, name string, spec string")
    a = spark.createDataFrame([("npm", "a", "A1", None, "2.0.0", 9.8, None), ("PyPI", "b", "B1", "1.0", "2.0", None, "high"), ("PyPI", "b", "B2", "1.5", "1.5.1", 5.0, None)], "eco string, name string, advisory string, introduced string, fixed string, cvss double, label string")
    assert {(r["id"], r["advisory"]) for r in deps.vulnerable(d, a).collect()} == {(1, "A1"), (3, "B1")}
    got = {(r["id"], r["advisory"], r["certain"]) for r in deps.affected(d, a).collect()}
    assert got == {(1, "A1", True), (3, "B1", True), (5, "A1", True), (8, "B1", False), (8, "B2", False)}
    assert [r["id"] for r in deps.unreadable(d).collect()] == [7]
    assert deps.affected(d.where("false"), a).count() == 0 and deps.affected(d, a.where("false")).count() == 0
    assert spark.range(1).select(deps.compare_versions(F.lit("2.0.0-rc.1"), F.lit("2.0.0")).alias("c")).first()["c"] == -1
