"""Operators over findings: filters, baselines, rollups, ranking, deduplication, comparison."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import normalize_message
from millrace.operators.intervals import overlap_semi
from millrace.schema import SEVERITY_RANK


def lookup(key: Column, values: dict, default=None) -> Column:
    """``values[key]`` as a CASE expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(F.upper(severity), SEVERITY_RANK), F.lit(0))


def display_filter(findings: DataFrame, severity: str | None = None, categories: Iterable[str] | None = None, file_part: str | None = None) -> DataFrame:
    """Keep findings by category, file substring and least severity.

    The severity applies to a category only if one of its findings (after the file filter) has a severity.
    """
    out = findings
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if file_part:
        out = out.where(F.col("file").contains(file_part))
    if severity and SEVERITY_RANK.get(severity.upper(), 0) > 0:
        rated = out.groupBy("category").agg(F.max(F.col("severity").isNotNull()).alias("rated"))
        keep = ~F.col("rated") | (severity_rank(F.col("severity")) >= SEVERITY_RANK[severity.upper()])
        out = out.join(rated, out["category"].eqNullSafe(rated["category"])).where(keep).drop("rated", rated["category"])
    return out


#: Rules that are evaluated with others.
PREREQUISITES = {"GPU000": ["GPU001", "GPU002", "GPU003"]}


def select_rules(findings: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Findings of the named rules (case aside) and of the prerequisites these bring in."""
    wanted = {r.upper() for r in rules}
    for needed, by in PREREQUISITES.items():
        if wanted & {f"SKY-{r}" for r in by}:
            wanted.add(f"SKY-{needed}")
    return findings.where(F.upper("rule_id").isin(*sorted(wanted)))


def drop_inline_ignored(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Without findings on a line that an ignore comment covers, for all rules (null ``rule_id``) or the given one."""
    every = ignores.where("rule_id is null").select("file", "line")
    single = ignores.where("rule_id is not null").select("file", "line", "rule_id")
    return findings.join(every, ["file", "line"], "left_anti").join(single, ["file", "line", "rule_id"], "left_anti")


def drop_ignored_rules(findings: DataFrame, ignored: Iterable[str]) -> DataFrame:
    return findings.where(~F.col("rule_id").isin(*ignored))


#: Advisory rules, whose findings are shown but never fail a gate.
ADVISORY = ["SKY-Q802", "SKY-Q803"]


def without_advisory(findings: DataFrame, rules: Iterable[str] = ADVISORY) -> DataFrame:
    """Findings that count for the gate."""
    return findings.where(~F.coalesce(F.col("rule_id").isin(*rules), F.lit(False)))


def select_for_cleanup(findings: DataFrame, types: Iterable[str], least_confidence: int) -> DataFrame:
    """Dead definitions of these types with at least this confidence."""
    return findings.where(F.col("type").isin(*types) & (F.col("confidence") >= least_confidence))


def snooze_expired(until: Column, now: Column) -> Column:
    """Whether a snooze has run out; one without an end never does."""
    return F.coalesce(until.cast("timestamp") < now.cast("timestamp"), F.lit(False))


def fingerprint(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def new_vs_baseline(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Findings whose fingerprint the baseline does not have."""
    return findings.join(baseline.select(key), key, "left_anti")


def lifecycle(current: DataFrame, previous: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``key, event``: ``new`` for fingerprints that came, ``resolved`` for those that went."""
    now, then = current.select(key).distinct(), previous.select(key).distinct()
    return now.join(then, key, "left_anti").withColumn("event", F.lit("new")).unionByName(then.join(now, key, "left_anti").withColumn("event", F.lit("resolved")))


def directory_rollup(findings: DataFrame, categories: Iterable[str], directory: Column | None = None) -> DataFrame:
    """Per directory: findings, distinct files, findings by category, histograms of rules and severities; most findings first."""
    place = F.regexp_replace("file", r"/?[^/]*$", "") if directory is None else directory
    named = findings.withColumn("directory", F.when(place == "", ".").otherwise(place))
    totals = named.groupBy("directory").agg(F.count("*").alias("total"), F.countDistinct("file").alias("files"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories])

    def histogram(of: str) -> DataFrame:
        counts = named.where(F.col(of).isNotNull()).groupBy("directory", of).agg(F.count("*").alias("n"))
        return counts.groupBy("directory").agg(F.map_from_entries(F.collect_list(F.struct(of, "n"))).alias(f"by_{of}"))

    return totals.join(histogram("rule_id"), "directory", "left").join(histogram("severity"), "directory", "left").orderBy(F.col("total").desc(), "directory")


#: Hundreds of points by severity, one hundred for any other.
ACTION_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "WARN": 3, "LOW": 2}


def action_score(f: DataFrame) -> Column:
    """Priority of a finding from severity, novelty, change, category and confidence."""
    debt = F.coalesce(F.col("category") == "debt", F.lit(False))
    bonus = lambda flag, points: F.when(F.coalesce(F.col(flag), F.lit(False)) & ~debt, points).otherwise(0)
    return (
        F.coalesce(lookup(F.upper("severity"), ACTION_RANK), F.lit(1)) * 100
        + bonus("is_new_vs_baseline", 220)
        + bonus("is_new_since_last_scan", 140)
        + bonus("is_changed", 160)
        + F.when(F.col("category").isin("security", "secrets"), 60).otherwise(0)
        + F.when(debt, F.coalesce("priority_score", F.lit(0.0)) * 3).otherwise(0)
        - F.when(F.col("category") == "dead_code", 75).otherwise(0)
        + F.when(F.col("confidence").isNotNull(), F.least("confidence", F.lit(100))).otherwise(0)
    ).cast("double")


def rank_actions(findings: DataFrame, k: int | None = None) -> DataFrame:
    """Findings that are neither dismissed nor snoozed, by score, priority, file, line, title; the first ``k`` if given."""
    open_ones = findings.where(~F.coalesce("is_dismissed", F.lit(False)) & ~F.coalesce("is_snoozed", F.lit(False)))
    scored = open_ones.withColumn("score", action_score(findings))
    ordered = scored.orderBy(F.col("score").desc(), F.coalesce("priority_score", F.lit(0.0)).desc(), "file", "line", "title")
    return ordered if k is None else ordered.limit(k)


def cap_per_group(findings: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` findings of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _islands(rows: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """Add ``_island``: rows of a group share it if a chain of lines no more than ``tolerance`` apart joins them."""
    w = Window.partitionBy(*by).orderBy("line")
    gap = F.col("line") - F.lag("line").over(w) > tolerance
    marked = rows.withColumn("_fresh", F.coalesce(gap, F.lit(True)).cast("int"))
    return marked.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def dedupe_near_lines(findings: DataFrame, tolerance: int = 2, prefix: int = 50) -> DataFrame:
    """Drop findings within ``tolerance`` lines of an earlier kept one with one file and message start.

    First wins, in the order of ``seq``; which are kept depends on all kept before, but never across a gap of
    more than ``tolerance`` lines.  So a group (file and normalised message start) is cut at its gaps; a finding alone between gaps is kept as it is,
    others are walked in order, one island at a time.
    """
    given = findings.schema
    keyed = findings.withColumns({"_key": F.substring(normalize_message(F.coalesce("message", F.lit(""))), 1, prefix), "_line": F.col("line"), "line": F.coalesce("line", F.lit(0))})
    by = ["file", "_key", "_island"]
    cut = _islands(keyed, by[:2], tolerance).withColumn("line", F.col("_line")).drop("_line").withColumn("_n", F.count("*").over(Window.partitionBy(*by)))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", kind="stable")
        kept, keep = set(), []
        for line in part["line"].fillna(0).astype(int):
            keep.append(not any(line + d in kept for d in range(-tolerance, tolerance + 1)))
            if keep[-1]:
                kept.add(line)
        return part[keep]

    walked = cut.where("_n > 1").groupBy(*by).applyInPandas(walk, cut.schema)
    return cut.where("_n = 1").unionByName(walked).select(*given.names)


def merge_findings(static: DataFrame, other: DataFrame, tolerance: int = 5, least_ratio: float = 0.5) -> DataFrame:
    """Greedy merge by file: each static finding takes the first free other one that is near and alike.

    Alike: one category, or similar messages, or one rule-id start of three.  Returns
    ``seq, source`` with ``both``, ``static`` or ``other``; ``match_seq`` names the partner.

    Files are cut where two lines of either side are further apart than ``tolerance``, as no pair crosses such a gap; only pieces that hold findings
    of both sides are walked, and there a finding meets only those on near lines.
    """
    cols = ["seq", "file", "line", "category", "message", "rule_id"]

    def alike(a, b) -> bool:
        if a.category and b.category and a.category.lower() == b.category.lower():
            return True
        if a.norm and b.norm and SequenceMatcher(None, a.norm, b.norm).ratio() >= least_ratio:
            return True
        return bool(a.rule_id and b.rule_id and a.rule_id.lower()[:3] == b.rule_id.lower()[:3])

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(part.sort_values("seq", kind="stable").itertuples(index=False))
        free: dict[int, list] = {}
        for b in rows:
            if b.side == 1:
                free.setdefault(int(b.line), []).append(b)
        out = []
        for a in rows:
            if a.side == 0:
                near = sorted((b.seq, k, int(b.line)) for line in range(int(a.line) - tolerance, int(a.line) + tolerance + 1) for k, b in enumerate(free.get(line, ())))
                hit = next(((line, k) for _, k, line in near if alike(a, free[line][k])), None)
                out.append((a.seq, "static" if hit is None else "both", None if hit is None else free[hit[0]].pop(hit[1]).seq))
        out += [(b.seq, "other", None) for left in free.values() for b in left]
        return pd.DataFrame({"seq": [x[0] for x in out], "source": [x[1] for x in out], "match_seq": pd.Series([x[2] for x in out], dtype="Int64")})

    ready = lambda d, side: d.select(*cols).withColumns({"line": F.coalesce("line", F.lit(0)), "norm": normalize_message(F.coalesce("message", F.lit(""))), "side": F.lit(side)}).drop("message")
    cut = _islands(ready(static, 0).unionByName(ready(other, 1)), ["file"], tolerance)
    w = Window.partitionBy("file", "_island")
    cut = cut.withColumn("_both", F.min("side").over(w) < F.max("side").over(w))
    schema = f"seq {static.schema['seq'].dataType.simpleString()}, source string, match_seq long"
    alone = cut.where("not _both").select("seq", F.when(F.col("side") == 0, "static").otherwise("other").alias("source"), F.lit(None).cast("long").alias("match_seq"))
    return alone.unionByName(cut.where("_both").groupBy("file", "_island").applyInPandas(walk, schema))


def cross_reference(external: DataFrame, dead: DataFrame, findings: DataFrame, tolerance: int = 5) -> DataFrame:
    """Label external findings: ``in_dead_code`` if in a dead definition's lines, else ``corroborated`` if one of ours is near, else ``unique``."""
    places = external.select("file", F.col("line").alias("start"), F.col("line").alias("end")).where("file is not null and line is not null").distinct()
    within = overlap_semi(places, dead.select("file", F.col("line").alias("start"), F.col("end_line").alias("end")), "file").select("file", F.col("start").alias("line")).withColumn("_dead", F.lit(True))
    near = near_places(external, findings, tolerance).withColumn("_near", F.lit(True))
    label = F.when(F.col("_dead"), "in_dead_code").when(F.col("_near"), "corroborated").otherwise("unique")
    return external.join(within, ["file", "line"], "left").join(near, ["file", "line"], "left").withColumn("label", label).select(*external.columns, "label")


def near_places(findings: DataFrame, others: DataFrame, tolerance: int) -> DataFrame:
    """``file, line`` of findings at most ``tolerance`` lines from one of the others, each place once.

    Lines are cut into buckets of ``tolerance + 1``: all of one bucket are near each other, and of the next ones the
    last and the first line tell.  So a bucket is one row, and no pairs are made, however many findings a file has.
    """
    wide = tolerance + 1
    bucket = F.floor(F.col("line") / wide)
    places = findings.where("file is not null and line is not null").select("file", "line").distinct()
    ends = others.where("file is not null and line is not null").groupBy("file", bucket.alias("at")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    asked = places.select("file", "line", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("at"))
    hit = asked.join(ends, ["file", "at"]).where((F.col("lo") <= F.col("line") + tolerance) & (F.col("hi") >= F.col("line") - tolerance))
    return hit.select("file", "line").distinct()


def provenance_stats(findings: DataFrame) -> DataFrame:
    """Findings by agent, severity and category and in total, with the share that agents wrote (one decimal)."""
    counted = findings.groupingSets([["agent"], ["severity"], ["category"], []], "agent", "severity", "category")
    out = counted.agg(F.count("*").alias("n"), F.count_if("ai_authored").alias("n_ai"), F.grouping_id().alias("level"))
    return out.withColumn("ai_share", F.bround(F.col("n_ai") * 100.0 / F.col("n"), 1))


def compare_scanners(ours: DataFrame, theirs: DataFrame, tolerance: int = 3) -> DataFrame:
    """Shadow comparison: findings both have, only we have, only they have, by category."""
    near_theirs, near_ours = near_places(ours, theirs, tolerance), near_places(theirs, ours, tolerance)
    part = lambda d, how, near, label: d.join(near, ["file", "line"], how).groupBy("category").agg(F.count("*").alias("n")).withColumn("status", F.lit(label))
    return part(ours, "left_semi", near_theirs, "both").unionByName(part(ours, "left_anti", near_theirs, "only_ours")).unionByName(part(theirs, "left_anti", near_ours, "only_theirs"))


def triage_confidence(observations: DataFrame) -> DataFrame:
    """Verdict per pattern with the most observations, confidence n / (n + 1) from 0.5."""
    counts = observations.groupBy("pattern", "verdict").agg(F.count("*").alias("n"))
    best = counts.groupBy("pattern").agg(F.max(F.struct("n", "verdict")).alias("b"))
    return best.select("pattern", F.col("b.verdict").alias("verdict"), (F.col("b.n") / (F.col("b.n") + 1.0)).alias("confidence"))
