"""Interval operators: overlap, stabbing, merging, bands and path suffixes.

Spark has no interval join.  Lines are cut into buckets of a fixed width; an interval meets
the buckets that it covers, so that the join is an equi-join, and the exact predicate follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a line bucket; levels of ever wider ones for long spans, each so many times as wide as the one before.
BUCKET = 64
LEVELS, WIDER = 8, 8
#: Starts of ranges that are merged in one task before the islands of a group are.
MERGE_BUCKET = 1 << 16


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlap_semi(left: DataFrame, right: DataFrame, key: str, width: int = BUCKET) -> DataFrame:
    """Rows of ``left`` (``key, start, end``) that share a line with an interval of ``right`` of the same key; both ends inclusive."""
    l = left.select(key, "start", "end").distinct().withColumn("_b", _buckets(F.col("start"), F.col("end"), width))  # noqa: E741
    r = right.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")).distinct().withColumn("_b", _buckets(F.col("_s"), F.col("_e"), width))
    hit = l.join(r, (l[key] == r[key]) & (l["_b"] == r["_b"]) & (l["start"] <= r["_e"]) & (r["_s"] <= l["end"]), "left_semi")
    return left.join(hit.select(key, "start", "end").distinct(), [key, "start", "end"], "left_semi").select(*left.columns)


def narrowest_enclosing(points: DataFrame, spans: DataFrame, key: str, width: int = BUCKET, order: list | None = None) -> DataFrame:
    """Each point (``key, point_id, at``) with the smallest span (``key, span_id, start, end``) around it, ties by ``order`` or ``span_id``; points in no span are left out.

    A span lies in at most ``WIDER + 1`` buckets of the level that suits its length; a point looks at all levels.
    """
    wide = lambda level: F.lit(float(width)) * F.pow(F.lit(float(WIDER)), level)
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(F.col("end") - F.col("start") <= width * WIDER ** (k + 1), k).otherwise(level)
    s = spans.withColumn("_l", level).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / wide(F.col("_l"))), F.floor(F.greatest("start", "end") / wide(F.col("_l"))))))
    p = points.withColumn("_l", F.explode(F.array(*map(F.lit, range(LEVELS))))).withColumn("_b", F.floor(F.col("at") / wide(F.col("_l"))))
    hit = p.join(s, [key, "_l", "_b"]).drop("_l").where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    w = Window.partitionBy(key, "point_id").orderBy(F.col("end") - F.col("start"), *(order or ["span_id"]))
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_b")


def merge_ranges(ranges: DataFrame, by: list[str], touch: int = 1) -> DataFrame:
    """Union of inclusive ranges per group; those that overlap or touch become one."""
    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + touch), 1).otherwise(0))
        island = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")

    # first within buckets of starts, so that one task never sorts all ranges of a hot group
    counted = ranges.groupBy(*by, "start", "end").agg(F.count("*").alias("n")).withColumn("_b", F.floor(F.col("start") / MERGE_BUCKET))
    return merged(merged(counted, [*by, "_b"]).drop("_b"), by)


def band_join(left: DataFrame, right: DataFrame, key: str, at: str, other: str, before: int, after: int) -> DataFrame:
    """Pairs of one key with ``at - before <= other <= at + after``."""
    width = max(1, before + after + 1)
    l = left.withColumn("_b", _buckets(F.col(at) - before, F.col(at) + after, width))  # noqa: E741
    r = right.withColumn("_b", F.floor(F.col(other) / width))
    hit = l.join(r, [key, "_b"]).where((F.col(other) >= F.col(at) - before) & (F.col(other) <= F.col(at) + after))
    return hit.drop("_b")


def gap_dedupe(rows: DataFrame, by: list[str], at: str, gap, order: list | None = None) -> DataFrame:
    """Drop rows at most ``gap`` after the row before them in their group."""
    w = Window.partitionBy(*by).orderBy(at, *(order or []))
    return rows.withColumn("_prev", F.lag(at).over(w)).where(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") > gap)).drop("_prev")


def suffix_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of paths of which one is a whole-component suffix of the other; a path that fits several is left out."""
    from millrace.functions.scalar import path_suffixes

    l, r = left.select(a).distinct(), right.select(b).distinct()  # noqa: E741
    long_left = l.withColumn("_k", F.explode(path_suffixes(F.col(a)))).join(r.withColumn("_k", F.col(b)), "_k").select(a, b)
    long_right = r.withColumn("_k", F.explode(path_suffixes(F.col(b)))).join(l.withColumn("_k", F.col(a)), "_k").select(a, b)
    pairs = long_left.union(long_right).distinct()
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(a))).where("_n = 1").drop("_n")


def diff_ranges(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """``file, start, end`` of the added sides of a unified diff's hunks; lines in ``order`` within ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", r"^\+\+\+ (\S+)", 1), "^b/", ""))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.withColumn("file", F.last(named, ignorenulls=True).over(w)).where(F.col("line").rlike(hunk) & (F.col("file") != "/dev/null"))
    n = F.regexp_extract("line", hunk, 2)
    start, count = F.regexp_extract("line", hunk, 1).cast("int"), F.when(n == "", 1).otherwise(F.try_to_number(n, F.lit("999999999")).cast("int"))
    return rows.select(*by, "file", start.alias("start"), (start + count - 1).alias("end")).where("end >= start")
