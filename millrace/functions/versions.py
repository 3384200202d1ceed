"""Versions as strings that sort by precedence, and requirements as sets of intervals of such strings.

A key is built of Spark functions alone.  Numbers carry their length, every part ends with a mark below all that may follow, so
that no key begins another one; ``key + TOP`` is then the place just above a version, and all intervals are half open: ``low <= key < high``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above every key, and below: all versions are in between.
TOP, BOTTOM = "~", ""
#: Fixed values of PEP 440: letters of pre-releases by spelling, in order of precedence a, b, rc.
PRE = {"a": "a", "alpha": "a", "b": "b", "beta": "b", "c": "c", "rc": "c", "pre": "c", "preview": "c"}
PEP440 = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?(\d*))?"
    r"(?:(?:-(\d+))|(?:[-_.]?(post|rev|r)[-_.]?(\d*)))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
SEMVER = r"^\s*[v=]*\s*(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
INTERVALS = "array<struct<low:string,high:string>>"


def _number(digits: Column) -> Column:
    """Digits with their count first; no digits are 0."""
    t = F.regexp_replace(F.concat(F.lit("0"), digits), r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(t).cast("string"), 2, "0"), t)


def _release(dotted: Column) -> Column:
    """Numbers of a release without zeros at the end; what has more numbers is above."""
    short = F.regexp_replace(dotted, r"(\.0+)+$", "")
    return F.concat(F.array_join(F.transform(F.split(short, r"\."), lambda x: F.concat(F.lit("1"), _number(x))), ""), F.lit("0"))


def semver_key(version: Column) -> Column:
    """Key by semantic versioning: a pre-release is below its release, its numeric parts below others, build data does not count.

    Any count of numbers is taken, missing ones are 0, as is a leading ``v`` or ``=``.  Null for what is no version.
    """
    release, pre = F.regexp_extract(version, SEMVER, 1), F.regexp_extract(version, SEMVER, 2)
    part = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("1"), _number(x))).otherwise(F.concat(F.lit("2"), x, F.lit("\x01")))
    tail = F.when(pre == "", "m").otherwise(F.concat(F.lit("a"), F.array_join(F.transform(F.split(pre, r"\."), part), ""), F.lit("0")))
    return F.when(release != "", F.concat(_release(release), tail))


def _pep440(version: Column) -> dict[str, Column]:
    """Parts of a key by PEP 440."""
    low = F.lower(version)
    g = lambda k: F.regexp_extract(low, PEP440, k)
    pre, post, dev, local = g(3), F.concat(g(5), g(6)), g(8), g(10)
    letter = F.lit("c")
    for spelling, short in PRE.items():
        letter = F.when(pre == spelling, short).otherwise(letter)
    part = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("2"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit("\x01")))
    return {
        "valid": g(2) != "",
        "base": F.concat(_number(g(1)), _release(g(2))),
        "pre": F.when(pre != "", F.concat(F.lit("1"), letter, _number(g(4)))).when((post == "") & (dev != ""), "0").otherwise("2"),
        "post": F.when(post != "", F.concat(F.lit("1"), _number(F.concat(g(5), g(7))))).otherwise("0"),
        "dev": F.when(dev != "", F.concat(F.lit("0"), _number(g(9)))).otherwise("1"),
        "local": F.when(local != "", F.concat(F.lit("1"), F.array_join(F.transform(F.split(local, "[-_.]"), part), ""), F.lit("0"))).otherwise("0"),
        "is_pre": (pre != "") | (dev != ""),
        "is_post": post != "",
        "is_local": local != "",
    }


def pep440_key(version: Column) -> Column:
    """Key by PEP 440: epoch, release, then development, pre-, final and post-releases; local parts last.  Null for what is no version."""
    p = _pep440(version)
    return F.when(p["valid"], F.concat(p["base"], p["pre"], p["post"], p["dev"], p["local"]))


def version_order(version: Column, eco: Column) -> Column:
    """Key by the rules of an ecosystem: PEP 440 for ``PyPI``, else semantic versioning."""
    return F.when(eco == "PyPI", pep440_key(version)).otherwise(semver_key(version))


def _interval(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def _shifted(release: Column, keep: Column, add: int) -> Column:
    """The first ``keep`` numbers of a dotted release, the last of them raised by ``add``; missing numbers are 0."""
    numbers = F.transform(F.split(release, r"\."), lambda x: x.cast("decimal(38,0)"))
    at = lambda k: F.coalesce(F.try_element_at(numbers, k), F.lit(0).cast("decimal(38,0)"))
    return F.array_join(F.transform(F.sequence(F.lit(1), keep), lambda k: (at(k) + F.when(k == keep, add).otherwise(0)).cast("decimal(38,0)").cast("string")), ".")


def _pep440_term(term: Column) -> Column:
    """``out, low, high``: the interval of one clause, and whether it is to be left out."""
    shape = r"^\s*(===|==|!=|~=|<=|>=|<|>)\s*(\S+)\s*$"
    op, version = F.regexp_extract(term, shape, 1), F.regexp_extract(term, shape, 2)
    p = _pep440(F.regexp_replace(version, r"\.\*$", ""))
    public = F.concat(p["base"], p["pre"], p["post"], p["dev"])
    least, exact = F.concat(public, F.lit("0")), F.concat(public, p["local"])  # without a local part, and as it stands
    lowest = lambda dotted, epoch: F.concat(epoch, _release(dotted), F.lit("00"))  # noqa: E731  # below every development release
    shape2 = r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    epoch, release = _number(F.regexp_extract(version, shape2, 1)), F.regexp_extract(version, shape2, 2)
    count = F.size(F.split(release, r"\."))
    family = lambda keep: (lowest(_shifted(release, keep, 0), epoch), lowest(_shifted(release, keep, 1), epoch))
    whole, near = family(count), family(F.greatest(count - 1, F.lit(1)))
    star = version.endswith(".*")
    low = F.when(op.isin("==", "!=") & star, whole[0]).when(op == "===", exact).when(op.isin("==", "!="), F.when(p["is_local"], exact).otherwise(least)).when(op.isin("~=", ">="), least)
    # a later post-release or local build of the version itself is not above it, unless the version is one
    low = low.when(op == ">", F.when(p["is_post"] | p["is_pre"], F.concat(public, F.lit(TOP))).otherwise(F.concat(p["base"], p["pre"], F.lit(TOP)))).otherwise(BOTTOM)
    high = F.when(op.isin("==", "!=") & star, whole[1]).when((op == "===") | op.isin("==", "!=") & p["is_local"], F.concat(exact, F.lit(TOP))).when(op.isin("==", "!=", "<="), F.concat(public, F.lit(TOP))).when(op == "~=", near[1])
    # a pre-release of the version itself is not below it, unless the version is one
    high = high.when(op == "<", F.when(p["is_pre"] | p["is_post"], least).otherwise(F.concat(p["base"], F.lit("00")))).otherwise(TOP)
    return F.when(p["valid"] & (op != ""), F.struct((op == "!=").alias("out"), low.alias("low"), high.alias("high")))


def _overlap(terms: Column) -> Column:
    """The interval that all of ``terms`` hold."""
    return _interval(F.array_max(F.transform(terms, lambda t: t["low"])), F.array_min(F.transform(terms, lambda t: t["high"])))


def pep440_intervals(spec: Column) -> Column:
    """Intervals of a requirement such as ``>=1,<2,!=1.5`` or ``~=1.4``, in order; an empty one allows everything, one that can't be read is null.

    Pre-releases count where they lie inside (``===`` by precedence, not by spelling); that an installer passes over them unless told otherwise is not modelled.
    """
    return _pep440_set(_pep440_terms(spec))


def _pep440_terms(spec: Column) -> Column:
    return F.transform(F.filter(F.split(spec, ","), lambda t: F.trim(t) != ""), _pep440_term)


def _pep440_set(terms: Column) -> Column:
    everything = F.array(_interval(F.lit(BOTTOM), F.lit(TOP)))
    inside = F.filter(terms, lambda t: ~t["out"])
    start = F.when(F.size(inside) == 0, everything).otherwise(F.array(_overlap(inside)))
    cuts = F.filter(terms, lambda t: t["out"])
    cut = lambda found, t: F.flatten(F.transform(found, lambda x: F.array(_interval(x["low"], F.least(x["high"], t["low"])), _interval(F.greatest(x["low"], t["high"]), x["high"]))))
    full = lambda found: F.filter(found, lambda x: x["low"] < x["high"])
    out = F.aggregate(cuts, start.cast(INTERVALS), lambda found, t: full(cut(found, t)).cast(INTERVALS), full)
    return F.when(~F.exists(terms, lambda t: t.isNull()), F.array_sort(out))


def _npm_term(term: Column) -> Column:
    """``low, high`` of one comparator: ``^1.2``, ``~1.2.3``, ``1.x``, ``>=1``, ``1.2.3-rc.1``."""
    shape = r"^\s*(\^|~>?|>=|<=|>|<|=)?\s*v?((?:\d+|[xX*])(?:\.(?:\d+|[xX*])){0,2})(-[0-9A-Za-z.-]+)?(?:\+\S*)?\s*$"
    op, given, pre = (F.regexp_extract(term, shape, k) for k in (1, 2, 3))
    known = F.regexp_extract(given, r"^(\d+(?:\.\d+)*)", 1)
    count = F.when(known == "", 0).otherwise(F.size(F.split(known, r"\.")))
    # the least version, pre-releases included, of a dotted release: below its own release, where no pre-release is
    least = lambda dotted: F.concat(_release(dotted), F.lit("a"))
    bump = lambda keep: least(_shifted(known, F.greatest(keep, F.lit(1)), 1))
    exact = semver_key(F.concat(known, pre))
    full = count == 3
    low = F.when(op.isin("<", "<="), F.lit(BOTTOM)).when((op == ">") & ~full, bump(count)).when(op == ">", F.concat(exact, F.lit(TOP))).otherwise(exact)
    first = F.coalesce(F.array_position(F.transform(F.split(known, r"\."), lambda x: x.cast("decimal(38,0)") > 0), True), F.lit(0))
    caret = F.when(first > 0, bump(first.cast("int"))).otherwise(bump(count))
    high = (
        F.when(op.isin(">", ">="), F.lit(TOP)).when(op == "^", caret).when(op.startswith("~"), bump(F.least(count, F.lit(2)))).when(op == "<", F.when(full, exact).otherwise(least(known)))
        .when(~full, bump(count)).otherwise(F.concat(exact, F.lit(TOP)))
    )
    anything = F.when(op.isin("<", ">"), _interval(F.lit(TOP), F.lit(TOP))).otherwise(_interval(F.lit(BOTTOM), F.lit(TOP)))
    return F.when(given != "", F.when(count == 0, anything).otherwise(_interval(low, high)))


def npm_intervals(spec: Column) -> Column:
    """Intervals of a range such as ``^1.2 || >=3 <4``, ``1.2 - 2``, ``1.x`` or ``*``; one that can't be read (a url, a tag) is null.

    A pre-release counts where it lies inside of a comparator's bounds; npm's further rule, that it must be named, is not modelled.
    """
    return _npm_set(_npm_terms(spec))


def _npm_terms(spec: Column) -> Column:
    parts = F.split(spec, r"\|\|")
    spread = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^(\S+)\s+-\s+(\S+)$", ">=$1 <=$2"), r"(\^|~>?|[<>]=?|=)\s+", "$1"))
    return F.transform(spread, lambda x: F.transform(F.split(F.when(x == "", "*").otherwise(x), r"\s+"), _npm_term))


def _npm_set(terms: Column) -> Column:
    bad = F.exists(terms, lambda ts: F.exists(ts, lambda t: t.isNull()))
    return F.when(~bad, F.array_sort(F.filter(F.transform(terms, _overlap), lambda x: x["low"] < x["high"])))


def with_intervals(df: DataFrame, spec: str = "spec", eco: str = "eco", out: str = "_ranges") -> DataFrame:
    """Add the intervals of requirements as ``out``, by the rules of their ecosystem; elsewhere than on PyPI and npm a spec is one exact version.

    Null where a requirement can't be read.  Clauses are a column of their own first, so that each is read once.
    """
    key = semver_key(F.col(spec))
    one = F.when(key.isNotNull(), F.array(_interval(key, F.concat(key, F.lit(TOP)))))
    on = lambda name: F.when(F.col(eco) == name, F.col(spec))
    clauses = df.withColumns({"_pypi": _pep440_terms(on("PyPI")), "_npm": _npm_terms(on("npm"))})
    found = F.when(F.col(eco) == "PyPI", _pep440_set(F.col("_pypi"))).when(F.col(eco) == "npm", _npm_set(F.col("_npm"))).otherwise(one)
    return clauses.withColumn(out, found).drop("_pypi", "_npm")
