"""Chat formatting: collapse cumulative snapshots of conversations, then render (DataFrame functions only).

A turn's prefix hash is the running sum, within its conversation, of hashes of (position,
role, text).  A conversation whose last prefix hash is an inner prefix hash of another one
is a snapshot that the longer one contains; an anti-join leaves the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stage_table

#: Turn marks of the chat template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text, last, h1, h2``: position of each turn, whether it is the last, and its prefix hash (two sums of 60 bits).

    Turns are in the order of ``turn``, then role and text, nulls first; a repeated row is one turn.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumns({"pos": F.row_number().over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    part = lambda c: F.coalesce(F.sha2(c, 256), F.lit("null"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.col("pos").cast("string"), part("role"), part("text")), 256))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(19,0)")).over(running)
    return rows.withColumns({"h1": total(1), "h2": total(16)}).drop("h")


def format_chats(turns: DataFrame) -> DataFrame:
    """Render every maximal conversation of ``turns`` (``conv_id, turn, role, text``).

    Returns ``conv_id, n_turns, text, n_chars``.  A conversation that is a proper prefix of another is
    dropped; of equal conversations the one with the smallest ``conv_id`` (null first) stays.
    Null roles render as ``unknown``, null texts as empty; template marks inside texts are broken up;
    other columns are ignored; an empty table gives no rows.
    """
    hashed = stage_table(prefix_hashes(turns), "chat-turns")
    inner = hashed.where("not last").select("pos", "h1", "h2").distinct()
    whole = hashed.where("last").select("conv_id", "pos", "h1", "h2")
    maximal = whole.join(inner, ["pos", "h1", "h2"], "left_anti").groupBy("pos", "h1", "h2")
    kept = maximal.agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")).alias("k")).select(F.col("k.conv_id").alias("kept_id"))
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")
    turn = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), safe, F.lit(f"{TURN_END}\n"))
    lines = hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["kept_id"]), "left_semi").select("conv_id", F.struct("pos", turn.alias("line")).alias("t"))
    chats = lines.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "").alias("text"))
    return chats.withColumn("n_chars", F.char_length("text").cast("long"))
