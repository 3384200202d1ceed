"""The whole analysis: source files to facts, facts to findings, findings to scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.extend import Extensions
from millrace.operators import appsec, configscan, graph, langscan, resolve, rules, score, taint, textscan, tokenflow
from millrace.session import stage_table
from millrace.sources import files as sources
from millrace.sources.python_facts import extract, of_kind
from millrace.sources.tokens import LANGUAGES, tokens


@dataclass
class Analysis:
    """Tables of one analysis, all lazy but the staged facts."""

    files: DataFrame
    facts: DataFrame
    findings: DataFrame
    dead: DataFrame

    def grade(self) -> DataFrame:
        """Score and grade per category."""
        return score.severity_score(self.findings, ["category"])

    def incomplete(self) -> DataFrame:
        """Files of code whose facts could not be extracted: unsupported languages and syntax errors.  Never counted as clean."""
        broken = of_kind(self.facts, "error").select("file", F.col("name").alias("reason"))
        other = self.files.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*sources.SUPPORTED)).select(F.col("path").alias("file"), F.lit("unsupported language").alias("reason"))
        return broken.unionByName(other)


def inline_ignores(files: DataFrame) -> DataFrame:
    """``file, line, rule_id`` of ignore comments; a comment without rule ids covers all (null)."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("k", "text"))
    hit = lines.where(F.col("text").rlike(r"#.*(pragma:\s*no\s+\w+|noqa|lint:\s*ignore)"))
    ids = F.regexp_extract_all("text", F.lit(r"(SKY-[A-Z]+\d+)"), 1)
    return hit.select("file", (F.col("k") + 1).alias("line"), F.explode(F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(None).cast("string")))).alias("rule_id"))


def module_edges(facts: DataFrame) -> DataFrame:
    """``src, dst`` of imports between modules of the project, by the longest module name that the import starts with."""
    modules = of_kind(facts, "module").select(F.col("name").alias("dst"))
    imports = of_kind(facts, "import").select(F.col("scope").alias("src"), "target").distinct()
    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    hit = imports.select("src", "target", F.explode(prefixes).alias("dst")).join(modules, "dst")
    longest = hit.groupBy("src", "target").agg(F.max(F.struct(F.length("dst").alias("l"), "dst")).alias("d"))
    return longest.select("src", F.col("d.dst").alias("dst")).where("src <> dst").distinct()


def architecture(facts: DataFrame) -> DataFrame:
    """Instability, distance and inversion findings of the module graph."""
    edges = module_edges(facts)
    counts = of_kind(facts, "class").groupBy(F.col("scope").alias("module")).agg((F.sum(F.col("nums")["abstract"]) / F.count("*")).alias("abstractness"))
    metrics = graph.coupling(edges, counts)
    files = of_kind(facts, "module").select(F.col("name").alias("module"), "file", "line")
    far = metrics.where("distance > 0.5 and ca + ce > 0").join(files, "module").select(F.col("module").alias("name"), "file", "line", "distance")
    inverted = graph.dependency_inversions(edges, metrics).join(files, F.col("src") == F.col("module")).select(F.col("src").alias("name"), "file", "line", "severity", F.col("dst"))
    return rules.as_findings(far, "SKY-Q802", F.when(F.col("distance") > 0.7, "HIGH").otherwise("MEDIUM"), "architecture", F.lit("far from the main sequence"), value=F.col("distance"), threshold=0.5).unionByName(
        rules.as_findings(inverted, "SKY-Q804", F.col("severity"), "architecture", rules.say("stable module depends on %s", "dst"))
    )


def analyze(files: DataFrame, limits: dict | None = None, threshold: int = resolve.THRESHOLD, extensions: Extensions | None = None) -> Analysis:
    """All findings of a ``SOURCE_FILES`` table.

    Facts are extracted once and staged; each rule is a query over them.  Lines with an ignore
    comment give no findings.  ``extensions``: rules, visitors and words of the user's own.
    """
    files = stage_table(files, "files")
    facts = extract(files)
    facts = stage_table(facts if extensions is None else facts.unionByName(extensions.facts(files)), "facts")
    ignores = inline_ignores(files)
    calls, functions, classes = (of_kind(facts, k) for k in ("call", "function", "class"))
    dead = stage_table(resolve.dead_code(facts, threshold, ignores.where("rule_id is null"), files), "dead")
    kinds = {"function": "SKY-U001", "method": "SKY-U001", "import": "SKY-U002", "class": "SKY-U004", "variable": "SKY-U003", "parameter": "SKY-U006"}
    rule = F.lit(None).cast("string")
    for k, r in kinds.items():
        rule = F.when(F.col("type") == k, r).otherwise(rule)
    unused = rules.as_findings(dead.where("decision = 'reported'"), rule, "INFO", "dead_code", rules.say("unused %s %s", "type", "name"), kind="dead_code", value=F.col("confidence"), threshold=threshold)
    text = files.where("lang is not null").select("path", "text")
    from_text = textscan.scan_lines(text).unionByName(textscan.scan_bidi(text)).unionByName(textscan.scan_injection(text).select("path", "line", "rule_id", "severity")).unionByName(configscan.scan_config(files.select("path", "text"))).unionByName(langscan.scan_languages(files))
    from_text = from_text.where("rule_id <> 'SKY-L009'").withColumnRenamed("path", "file").withColumn("name", F.col("file"))
    lost, spare = langscan.ts_unused(files)
    ts = lost.select("path", F.lit("SKY-E003").alias("r"), F.col("path").alias("name")).unionByName(spare.select("path", F.lit("SKY-E004").alias("r"), "name")).withColumnRenamed("path", "file").withColumn("line", F.lit(1))
    unnamed = langscan.unused_private(files).withColumnRenamed("path", "file")
    flows = rules.flow_rules(of_kind(facts, "flow"))
    # what a function's own parameters tell is said already; this adds what only its callers and callees tell
    across = taint.taint_findings(facts).join(flows.select("file", "line", "rule_id").distinct(), ["file", "line", "rule_id"], "left_anti").select(*rules.COLUMNS)
    other = files.where(F.col("lang").isin(*LANGUAGES))
    if other.limit(1).count():
        told = from_text.select("file", "line", "rule_id").distinct()
        across = across.unionByName(tokenflow.flow_findings(tokens(other)).join(told, ["file", "line", "rule_id"], "left_anti").select(*rules.COLUMNS))
    found = rules.union_all([
        across,
        rules.as_findings(unnamed, F.when(F.col("type") == "class", "SKY-U004").otherwise("SKY-U001"), "INFO", "dead_code", rules.say("unused %s %s", "type", "name"), kind="dead_code"),
        rules.as_findings(ts, F.col("r"), "LOW", "dead_code", rules.say("%s is not used", "name")),
        rules.metric_rules(functions, classes, of_kind(facts, "module"), files, limits),
        rules.pattern_rules(of_kind(facts, "pattern")), rules.call_rules(calls), rules.random_rule(calls), flows, rules.behaviour_rules(calls, functions),
        rules.literal_rules(of_kind(facts, "literal"), of_kind(facts, "pattern")), rules.coupling_rule(of_kind(facts, "class_use"), classes), rules.signature_mismatches(calls, functions),
        rules.lock_order(of_kind(facts, "lock")), rules.shared_state(of_kind(facts, "global_write"), calls), rules.opaque_names(of_kind(facts, "definition")), rules.stale_mocks(calls, of_kind(facts, "definition"), of_kind(facts, "string")), rules.policy_rules(files),
        rules.as_findings(from_text, F.col("rule_id"), F.col("severity"), "security", F.col("rule_id"), kind="text"), architecture(facts), unused, appsec.scan(facts),
    ])
    if extensions is not None:
        found = found.unionByName(extensions.findings(facts))
    kept = found.join(ignores.where("rule_id is null").select("file", "line"), ["file", "line"], "left_anti").join(ignores.where("rule_id is not null"), ["file", "line", "rule_id"], "left_anti")
    return Analysis(files, facts, stage_table(kept.select(*rules.COLUMNS), "findings"), dead)
