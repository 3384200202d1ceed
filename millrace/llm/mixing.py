"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source is a queue of shuffled documents.  A document's virtual finish time is
the cumulative words of its source up to and including it, divided by the source's
target.  All queues are merged in order of virtual time and cut at the total budget,
so every source runs out of its share at the same virtual time, 1.0.  A source whose
target exceeds its own size passes through its queue again, up to ``max_repeats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stage_table

#: Cells of the shuffled order that each source is cut into before running sums.
CELLS = 4096
#: Steps of virtual time in each of the two histogram levels that find the cut.
TICKS = 1024
#: Virtual time of the first histogram; the next begin where it ends and are that much longer.
FIRST_TIME = 4


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share_percent: int = 150, max_repeats: int = 2) -> DataFrame:
    """Water-fill ``share_percent`` of all words over sources by weight.

    ``sizes``: one row a source (``source``, ``source_size``).  Sources in code-point
    order, null last, take ``weights`` in turn; no target exceeds ``max_repeats`` times
    the source's size, and what a capped source leaves is shared again by weight.  In
    the order of cap/weight the capped sources come first, so one running sum finds
    the water level.  The table has one row a source, however many documents there are.
    Returns ``source, source_size, target``; an empty table gives none.
    """
    cap = max_repeats * 100
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.withColumn("w", F.element_at(ring, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    level = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # in hundredths of a word, so that every figure is a whole number
    left = F.sum("source_size").over(everything) * share_percent - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap
    filled = weighed.withColumn("left", left).withColumn("rest", F.sum("w").over(after))
    capped = F.col("source_size") * cap * F.col("rest") <= F.col("left") * F.col("w")
    filled = filled.withColumn("free", ~capped)
    # the level is that of the first source that its cap does not hold: the one with the largest rest
    first = F.max(F.when(F.col("free"), F.struct("rest", "left"))).over(everything)
    shared = F.try_divide((F.col("w") * first["left"]).cast("double"), (first["rest"] * 100).cast("double"))
    target = F.when(F.col("free"), shared).otherwise((F.col("source_size") * max_repeats).cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int], share_percent: int = 150, max_repeats: int = 2) -> DataFrame:
    """Mix ``docs`` (``doc_id, text, source``) to target weights.

    Returns ``doc_id, source, size, source_size, target, taken, content``: ``taken`` counts
    words with repeats, 0 for documents that stay out.  Null and empty texts have size 0
    and are never taken; a null source is a source of its own; repeated rows are
    rows of their own (full ties are interchangeable); an empty table gives no rows;
    other columns are ignored.  Documents are taken whole; a source therefore ends within one
    document of its target.  The order within a source is that of md5(doc_id) (of the text's hash
    where there is no id), so that reruns agree.

    Running sums never put a source in one task: a source is cut into ``CELLS`` cells
    of its shuffled order, cells are summed first, and only rows of one cell are sorted
    together.  The cut is found from two histograms of virtual time, then exactly
    within one tick.
    """
    # documents without id are spread by their texts, so that they are not one cell
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64("text").cast("string"))))
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        key.alias("k"),
        F.xxhash64("text").alias("content"),
        F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("cell"),
    )
    sized = stage_table(sized, "mix-sizes")
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share_percent, max_repeats)
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    t, c, d = targets.alias("t"), cells.alias("c"), sized.alias("d")
    cells = c.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.source_size", "t.target").alias("c")
    queued = d.join(cells, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.cell") == F.col("c.cell"))).select("d.*", "c.before", "c.source_size", "c.target")
    within = Window.partitionBy("source", "cell").orderBy("k", "doc_id", "content").rowsBetween(Window.unboundedPreceding, 0)
    queued = stage_table(queued.withColumn("cum", F.col("before") + F.sum("size").over(within)).drop("before", "cell"), "mix-queue")

    finish = [F.try_divide((F.col("cum") + r * F.col("source_size")).cast("double"), F.col("target")) for r in range(max_repeats)]
    items = queued.where("size > 0").select("size", F.explode(F.array(*finish)).alias("finish"))
    total = cells.agg(F.sum("cell_size").alias("n")).first()["n"] or 0
    limit = _finish_limit(items, total * share_percent // 100)
    taken = sum((F.when(f <= limit, F.col("size")).otherwise(F.lit(0)) for f in finish), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"), "content")


def _finish_limit(items: DataFrame, budget: int) -> float:
    """The latest finish time up to which the merged queue is within budget.

    ``items``: one row a document and round.  Equal finish times stand or fall together.
    The range sort is done by ticks of virtual time: histograms until one exceeds the budget (as a
    rule the first; later ones only if a document is much larger than its source's target), then two more, each within the
    critical tick of the last, of at most ``FIRST_TIME * TICKS`` rows; then a running sum
    over the finish times of a single tick.
    """
    lo, width, spent, level = 0.0, 1.0 / TICKS, 0, 0
    while level < 3:
        top = lo + width * TICKS * (1 if level else FIRST_TIME)
        here = items.where((F.col("finish") > lo) & (F.col("finish") <= top))
        tick = F.ceil((F.col("finish") - F.lit(lo)) / F.lit(width))
        found = here.groupBy(tick.alias("tick")).agg(F.sum("size").alias("n"))
        counts = sorted((r["tick"], r["n"]) for r in found.collect())  # bounded by the number of ticks
        for at, n in counts:
            if spent + n > budget:
                lo, width, level = lo + (at - 1) * width, width / TICKS, level + 1
                break
            spent += n
        else:
            if level or not items.where(F.col("finish") > top).limit(1).count():
                return top
            lo, width = top, width * FIRST_TIME
    last = items.where((F.col("finish") > lo) & (F.col("finish") <= lo + width * TICKS)).groupBy("finish").agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0))
    found = last.withColumn("run", run + F.lit(spent)).where(F.col("run") <= budget).agg(F.max("finish").alias("limit")).first()["limit"]
    return lo if found is None else found
