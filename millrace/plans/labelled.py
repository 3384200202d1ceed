"""Queries over the labelled corpus: each family's rules against its marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import appsec, clones, configscan, defend, deps, langscan, resolve, rules, textscan
from millrace.plans import cases
from millrace.session import stage_table
from millrace.sources.files import from_texts
from millrace.sources.python_facts import extract, of_kind


def _by_path(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("file"), "line", "rule_id")


def _calls(files: DataFrame, facts: DataFrame) -> DataFrame:
    calls = of_kind(facts, "call")
    return rules.call_rules(calls).unionByName(rules.random_rule(calls))


def _metrics(files: DataFrame, facts: DataFrame) -> DataFrame:
    return rules.metric_rules(of_kind(facts, "function"), of_kind(facts, "class"), of_kind(facts, "module"), files)


def _project(files: DataFrame, facts: DataFrame) -> DataFrame:
    calls, definitions, imports = (of_kind(facts, k) for k in ("call", "definition", "import"))
    classes, functions = of_kind(facts, "class"), of_kind(facts, "function")
    own = definitions.where("attrs['type'] <> 'import'")
    declared = files.sparkSession.createDataFrame([("DECLARED_NAME",)], "name string")
    return rules.union_all([
        rules.coupling_rule(of_kind(facts, "class_use"), classes), rules.phantom_calls(calls, own, imports), rules.signature_mismatches(calls, functions), rules.lock_order(of_kind(facts, "lock")),
        rules.shared_state(of_kind(facts, "global_write"), calls), rules.opaque_names(own), rules.stale_mocks(calls, own, of_kind(facts, "string")), rules.undefined_config(calls, declared),
    ])


def _text(files: DataFrame, facts: DataFrame) -> DataFrame:
    text = files.select("path", "text")
    found = textscan.scan_lines(text.where("path like '%.py'")).unionByName(textscan.scan_bidi(text)).unionByName(textscan.scan_injection(text.where("path like '%.md'")).select("path", "line", "rule_id", "severity"))
    return _by_path(found)


#: Rules by kind of dead definition.
UNUSED = {"function": "SKY-U001", "method": "SKY-U001", "import": "SKY-U002", "variable": "SKY-U003", "class": "SKY-U004", "parameter": "SKY-U006"}


def _dead(files: DataFrame, facts: DataFrame) -> DataFrame:
    facts = stage_table(facts, "facts")
    rule = F.create_map(*[F.lit(x) for pair in UNUSED.items() for x in pair])[F.col("type")]
    return resolve.dead_code(facts, files=files).where("decision = 'reported'").select("file", "line", rule.alias("rule_id"))


#: Rules of each family, over its files and their facts.
RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "calls": _calls,
    "flows": lambda files, facts: rules.flow_rules(of_kind(facts, "flow")),
    "appsec": lambda files, facts: appsec.scan(facts),
    "metrics": _metrics,
    "patterns": lambda files, facts: rules.pattern_rules(of_kind(facts, "pattern")),
    "behaviour": lambda files, facts: rules.behaviour_rules(of_kind(facts, "call"), of_kind(facts, "function")),
    "literals": lambda files, facts: rules.literal_rules(of_kind(facts, "literal"), of_kind(facts, "pattern")),
    "project": _project,
    "config": lambda files, facts: _by_path(configscan.scan_config(files.select("path", "text"))),
    "languages": lambda files, facts: _by_path(langscan.scan_languages(files)),
    "other_dead": lambda files, facts: langscan.unused_private(files).select(F.col("path").alias("file"), "line", F.when(F.col("type") == "class", "SKY-U004").otherwise("SKY-U001").alias("rule_id")),
    "text": _text,
    "dead": _dead,
}


def _query(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = from_texts(spark, cases.sources(family))
        return RULES[family](files, extract(files)).select("file", F.col("line").cast("int").alias("line"), "rule_id").distinct()

    run.__name__ = f"rules_{family}"
    return run


def dead_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, reasons and evidence for the names that the corpus states."""
    files = stage_table(from_texts(spark, cases.sources("dead")), "files")
    decided = resolve.dead_code(stage_table(extract(files), "facts"), files=files).where(F.col("type") != "import")
    stated = decided.where(F.col("name").isin(*[d[0] for d in cases.DECISIONS]))
    return stated.select("name", "decision", F.coalesce("rescue", F.lit("")).alias("rescue"), F.coalesce(F.try_element_at("evidence", F.lit(1)), F.lit("")).alias("evidence"))


def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(list(cases.MANIFESTS.items()), "path string, text string")
    of = lambda name: files.where(F.col("path") == name)
    parts = [deps.requirements(of("requirements.txt")).drop("line"), deps.package_json(of("package.json")), deps.go_mod(of("go.mod")), deps.pyproject(of("pyproject.toml"))]
    return rules.union_all([p.select("path", "eco", "name", "spec") for p in parts])


def clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of copies with their type, and the group that joins them."""
    fragments = stage_table(clones.extract_fragments(from_texts(spark, cases.sources("clones")).select("path", "text")), "fragments")
    pairs = stage_table(clones.clone_pairs(fragments), "pairs")
    group = clones.clone_groups(pairs).select(F.explode("members").alias("a"), "size")
    return pairs.join(group, "a").select("a", "b", "clone_type", F.col("size").cast("string").alias("size"))


def guardrail_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that model calls pass."""
    facts = stage_table(extract(from_texts(spark, cases.sources("defend"))), "facts")
    calls, flows = of_kind(facts, "call"), of_kind(facts, "flow").where("attrs['any'] = 'True'")
    return defend.checks(defend.integrations(calls), calls, flows).where("passed").select("file", "plugin")


QUERIES = {f"rules_{family}": _query(family) for family in RULES} | {f.__name__: f for f in (dead_decisions, manifest_dependencies, clone_pairs, guardrail_checks)}
ORACLES = {f"rules_{family}": cases.expected_sql(family) for family in RULES} | {
    "dead_decisions": cases.decisions_sql(),
    "manifest_dependencies": cases.values_sql(cases.DECLARED, "path, eco, name, spec"),
    "clone_pairs": cases.values_sql([(f"clones/{x}.py:{m:07}", f"clones/{y}.py:{n:07}", t, 3) for x, m, y, n, t in (("a", 1, "b", 4, "type1"), ("a", 1, "c", 1, "type2"), ("b", 4, "c", 1, "type2"))], "a, b, clone_type, size"),
    "guardrail_checks": cases.values_sql([(file, plugin) for file, found in cases.PASSED.items() for plugin in found.split()], "file, plugin"),
}
