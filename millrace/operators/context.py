"""The code as a graph for readers: edges of all kinds, chains of calls that lead to a danger, files worth reading first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.findings import severity_rank
from millrace.session import drop_staged, stage_table


def code_graph(facts: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``src, dst, kind``: what contains, calls (``caller, callee``), imports (``src, dst``) and inherits what."""
    contains = facts.where("kind = 'definition' and attrs['type'] <> 'import'").select(F.col("scope").alias("src"), F.col("name").alias("dst"), F.lit("contains").alias("kind"))
    bases = facts.where("kind = 'inherits'").select(F.col("scope").alias("src"), F.col("name").alias("dst"), F.lit("inherits").alias("kind"))
    called = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("kind"))
    return contains.unionByName(bases).unionByName(called).unionByName(imports.select("src", "dst", F.lit("imports").alias("kind"))).distinct()


def neighbourhood(graph: DataFrame, nodes: DataFrame, steps: int = 1) -> DataFrame:
    """``node, steps``: what is at most so many edges from the given nodes, in either direction."""
    both = graph.select("src", "dst").union(graph.select("dst", "src")).distinct()
    out = nodes.select("node", F.lit(0).alias("steps"))
    for k in range(1, steps + 1):
        next_to = out.where(F.col("steps") == k - 1).join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(k).alias("steps"))
        out = out.unionByName(next_to).groupBy("node").agg(F.min("steps").alias("steps"))
    return out


def threat_traces(dangers: DataFrame, calls: DataFrame, entries: DataFrame) -> DataFrame:
    """``scope, rule_id, line, trace``: for each danger (``scope`` is its function) a shortest chain of calls from an entry, least by name.

    ``calls``: ``caller, callee``; ``entries``: ``node``.  Every function is reached once, in the round of its distance, so
    that chains never multiply; a danger that no entry leads to has no row.
    """
    links = stage_table(calls.select("caller", "callee").where("caller <> callee").distinct(), "trace-calls")
    front = stage_table(entries.select("node").distinct().withColumn("trace", F.array("node")), "traces")
    reached = [front]
    while front.limit(1).count():
        seen = reached[0].select("node")
        for part in reached[1:]:
            seen = seen.union(part.select("node"))
        step = front.join(links, F.col("node") == F.col("caller")).select(F.col("callee").alias("node"), F.concat("trace", F.array("callee")).alias("trace"))
        front = stage_table(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("trace").alias("trace")), "traces")
        reached.append(front)
    every = reached[0]
    for part in reached[1:]:
        every = every.unionByName(part)
    out = stage_table(dangers.join(every.withColumnRenamed("node", "scope"), "scope").select("scope", "rule_id", "line", "trace"), "threats")
    drop_staged(links, *reached)
    return out


#: Points of a file for every signal that it gives.
SIGNALS = {"changed": 50.0, "entry": 20.0, "severe": 10.0, "finding": 2.0, "imported": 1.0}


def rank_files(files: DataFrame, findings: DataFrame, imports: DataFrame, changed: DataFrame, k: int | None = None) -> DataFrame:
    """``path, score``: files by signals: change, being an entry, findings, severe findings, importers; by path where equal; the first ``k`` if given.

    ``imports``: ``src, dst`` of paths.
    """
    severe = severity_rank(F.col("severity")) >= severity_rank(F.lit("HIGH"))
    found = findings.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n"), F.count_if(severe).alias("s"))
    importers = imports.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("i"))
    signal = lambda name, value: F.coalesce(value, F.lit(0)).cast("double") * SIGNALS[name]
    entry = F.col("path").rlike(r"(^|/)(__main__|main|app|manage|index|server|cli)\.\w+$").cast("int")
    joined = files.select("path").join(found, "path", "left").join(importers, "path", "left").join(changed.select("path").distinct().withColumn("c", F.lit(1)), "path", "left")
    score = signal("changed", F.col("c")) + signal("entry", entry) + signal("severe", F.col("s")) + signal("finding", F.col("n")) + signal("imported", F.col("i"))
    ranked = joined.select("path", score.alias("score")).orderBy(F.col("score").desc(), "path")
    return ranked if k is None else ranked.limit(k)


def rescue_priority(candidates: DataFrame) -> Column:
    """Which candidates a search should look at first: public before private names, functions and classes before methods, confident ones first."""
    private = F.col("simple_name").startswith("_").cast("int")
    kind = F.when(F.col("type").isin("function", "class"), 0).otherwise(1)
    return private * 2000 + kind * 1000 + (100 - F.col("confidence"))
