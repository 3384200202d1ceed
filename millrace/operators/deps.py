"""Dependency operators: manifests, undeclared and unused packages, versions, advisories, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import LABEL_SCORES, cvss_severity, dependency_name, exact_npm_version
from millrace.functions.versions import BOTTOM, TOP, semver_key, version_order, with_intervals
from millrace.operators.findings import lookup
from millrace.session import stage_table


def requirements(files: DataFrame) -> DataFrame:
    """``path, line, eco, name, spec`` of requirements files (``path, text``)."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("k", "raw"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(^|\s)#.*$", ""), ";.*$", ""))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
    ok = lines.withColumn("t", bare).where((F.col("t") != "") & ~F.col("t").startswith("-") & F.col("t").rlike(shape))
    return ok.select("path", (F.col("k") + 1).alias("line"), F.lit("PyPI").alias("eco"), dependency_name(F.regexp_extract("t", shape, 1)).alias("name"), F.regexp_replace(F.regexp_extract("t", shape, 2), r"\s+", "").alias("spec"))


def package_json(files: DataFrame) -> DataFrame:
    """``path, eco, name, spec`` of package.json files, runtime and development dependencies."""
    shape = "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>"
    parsed = files.select("path", F.from_json("text", shape).alias("j"))
    parts = [parsed.select("path", F.explode(f"j.{c}").alias("name", "spec")) for c in ("dependencies", "devDependencies", "optionalDependencies")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("path", F.lit("npm").alias("eco"), "name", "spec")


def go_mod(files: DataFrame) -> DataFrame:
    """``path, eco, name, spec`` of go.mod files."""
    lines = files.select("path", F.explode(F.split("text", "\r?\n")).alias("raw"))
    shape = r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+(v\d\S*)"
    return lines.where(F.col("raw").rlike(shape)).select("path", F.lit("Go").alias("eco"), F.regexp_extract("raw", shape, 1).alias("name"), F.regexp_extract("raw", shape, 2).alias("spec"))


def pyproject(files: DataFrame) -> DataFrame:
    """``path, eco, name, spec`` of the quoted requirements in pyproject.toml's dependency lists."""
    block = F.regexp_extract("text", r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\n?\]", 1)
    items = files.select("path", F.explode(F.regexp_extract_all(block, F.lit(r"[\"']([^\"']+)[\"']"), 1)).alias("t"))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)"
    return items.select("path", F.lit("PyPI").alias("eco"), dependency_name(F.regexp_extract("t", shape, 1)).alias("name"), F.trim(F.regexp_extract("t", shape, 2)).alias("spec"))


def undeclared(imports: DataFrame, declared: DataFrame, known: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Imported names that nothing declares, without standard or local ones (``known``)."""
    out = imports.join(declared.select(name).distinct(), name, "left_anti")
    return out if known is None else out.join(known.select(name).distinct(), name, "left_anti")


def unused(declared: DataFrame, imports: DataFrame, name: str = "name") -> DataFrame:
    """Declared names that nothing imports."""
    return declared.join(imports.select(name).distinct(), name, "left_anti")


def not_in_registry(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Dependencies with status: ``unknown_package``, ``unknown_version`` (an exact version the registry lacks) or ``ok``.

    ``registry``: ``eco, name, version``.  A dependency of an ecosystem that the registry does not cover is ``incomplete``.
    """
    exact = F.coalesce(exact_npm_version(F.col("spec")), F.regexp_extract("spec", r"^==\s*([0-9][^,\s]*)$", 1))
    d = deps.withColumn("version", F.when(exact != "", exact))
    covered = registry.select("eco").distinct().withColumn("_eco", F.lit(True))
    names = registry.select("eco", "name").distinct().withColumn("_name", F.lit(True))
    versions = registry.select("eco", "name", "version").distinct().withColumn("_version", F.lit(True))
    joined = d.join(covered, "eco", "left").join(names, ["eco", "name"], "left").join(versions, ["eco", "name", "version"], "left")
    status = F.when(F.col("_eco").isNull(), "incomplete").when(F.col("_name").isNull(), "unknown_package").when(F.col("version").isNotNull() & F.col("_version").isNull(), "unknown_version").otherwise("ok")
    return joined.withColumn("status", status).drop("_eco", "_name", "_version")


def compare_versions(a: Column, b: Column, eco: Column | None = None) -> Column:
    """-1, 0 or 1 by the precedence of the ecosystem's versions (semantic versioning without one), null if either is no version."""
    x, y = (semver_key(a), semver_key(b)) if eco is None else (version_order(a, eco), version_order(b, eco))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def advisory_intervals(advisories: DataFrame) -> DataFrame:
    """Advisories with ``_low, _high``: keys of ``[introduced, fixed)``; null ends are open.  One whose ends can't be read is taken to be open there."""
    low = F.coalesce(version_order(F.col("introduced"), F.col("eco")), F.lit(BOTTOM))
    return advisories.withColumns({"_low": low, "_high": F.coalesce(version_order(F.col("fixed"), F.col("eco")), F.lit(TOP))})


def _severity(found: DataFrame) -> DataFrame:
    score = F.coalesce(F.col("cvss"), lookup(F.upper("label"), LABEL_SCORES))
    return found.withColumn("severity", cvss_severity(score))


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with an advisory whose range ``[introduced, fixed)`` holds their exact version, by the ecosystem's precedence.

    ``advisories``: ``eco, name, advisory, introduced, fixed, cvss, label``; null ``fixed`` is open.
    Severity by CVSS score, else by label.
    """
    exact = F.coalesce(exact_npm_version(F.col("spec")), F.regexp_extract("spec", r"^==\s*([0-9][^,\s]*)$", 1))
    d = deps.withColumn("version", F.when(exact != "", exact)).withColumn("_key", version_order(F.col("version"), F.col("eco"))).where("_key is not null")
    joined = d.join(advisory_intervals(advisories), ["eco", "name"]).where("_low <= _key and _key < _high")
    return _severity(joined.drop("_key", "_low", "_high"))


def affected(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies whose requirement, exact or a range, allows a version that an advisory names: each pair once, with ``certain`` and ``severity``.

    ``certain``: every version that the requirement allows is affected.  Different requirements meet different advisories of their package once; intervals of keys that
    overlap are kept, and only such pairs are expanded into rows, so that the work grows with the result.  Requirements that can't be read are in :func:`unreadable`, never silently clean.
    """
    wanted, named = ["eco", "name", "spec"], ["eco", "name", "introduced", "fixed"]
    asked = stage_table(with_intervals(deps.select(*wanted).distinct()).where("_ranges is not null").withColumn("_ask", F.monotonically_increasing_id()), "asked")
    told = stage_table(advisory_intervals(advisories.select(*named).distinct()).withColumn("_tell", F.monotonically_increasing_id()), "told")
    joined = asked.join(told.drop("introduced", "fixed"), ["eco", "name"])
    meets = F.exists("_ranges", lambda x: (x["low"] < F.col("_high")) & (F.col("_low") < x["high"]))
    inside = F.forall("_ranges", lambda x: (F.col("_low") <= x["low"]) & (x["high"] <= F.col("_high")))
    pairs = stage_table(joined.where(meets).select("_ask", "_tell", inside.alias("certain")), "affected")
    # a null spec has no ranges, so equality is enough there; null ends of advisories are equal to each other
    mine = deps.join(asked.select(*wanted, "_ask"), wanted)
    # a row here may make many, which the size of a small table does not tell: all tasks take a share
    mine = mine.repartition(int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = told.select(*[F.col(c).alias(f"_{c}") for c in named], "_tell")
    theirs = advisories.join(t, (F.col("eco") == F.col("_eco")) & (F.col("name") == F.col("_name")) & F.col("introduced").eqNullSafe(F.col("_introduced")) & F.col("fixed").eqNullSafe(F.col("_fixed"))).drop("eco", "name", *[f"_{c}" for c in named])
    return _severity(mine.join(pairs, "_ask").join(theirs, "_tell")).select(*deps.columns, *[c for c in advisories.columns if c not in ("eco", "name")], "certain", "severity")


def unreadable(deps: DataFrame) -> DataFrame:
    """Dependencies whose requirement is no range of versions (a url, a tag)."""
    return with_intervals(deps).where("_ranges is null").drop("_ranges")


def reachability(findings: DataFrame, imports: DataFrame, covered: DataFrame) -> DataFrame:
    """Vulnerable packages as ``executed`` (a covered line imports them), ``imported`` or ``not_imported``."""
    used = imports.select("name").distinct().withColumn("_i", F.lit(True))
    ran = imports.join(covered, ["file", "line"]).select("name").distinct().withColumn("_r", F.lit(True))
    return findings.join(used, "name", "left").join(ran, "name", "left").withColumn("reachability", F.when(F.col("_r"), "executed").when(F.col("_i"), "imported").otherwise("not_imported")).drop("_i", "_r")


def added_lines(diff: DataFrame, by: list[str], order: str) -> DataFrame:
    """``side, hunk, text`` of a unified diff's added (``+``) and removed (``-``) lines, hunks numbered in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = diff.withColumn("hunk", F.count_if(F.col("line").startswith("@@")).over(w))
    body = numbered.where((F.col("line").startswith("+") & ~F.col("line").startswith("+++")) | (F.col("line").startswith("-") & ~F.col("line").startswith("---")))
    return body.select(*by, "hunk", F.substring("line", 1, 1).alias("side"), F.expr("substring(line, 2)").alias("text"))


def weakened_assertions(diff: DataFrame, by: list[str], order: str) -> DataFrame:
    """Hunks that remove more assertions than they add, or swap an exact check for a weaker one."""
    body = added_lines(diff, by, order)
    is_assert, weak = F.col("text").rlike(r"^\s*(assert\b|self\.assert|expect\()"), F.col("text").rlike(r"(is not None|assertTrue\(True|toBeTruthy|toBeDefined|assert True)")
    agg = body.groupBy(*by, "hunk").agg(F.count_if((F.col("side") == "-") & is_assert).alias("removed"), F.count_if((F.col("side") == "+") & is_assert).alias("added"), F.count_if((F.col("side") == "+") & is_assert & weak).alias("weak"))
    return agg.where("removed > added or (removed > 0 and weak > 0)")
