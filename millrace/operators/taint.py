"""Outside data across functions: where values go within each function, joined over calls until nothing new is found.

A function is summed up by what its parameters reach (its return, an argument of a call) and by the sources that its return
may hold.  A call's result carries an argument's value only if the called function's summary says so, so that a value that goes into one
call of a helper never comes out of another one, and a helper that cleans cleans for all its callers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rules import FLOW_SINKS, as_findings
from millrace.session import drop_staged, stage_table
from millrace.sources.python_facts import of_kind


@dataclass
class Program:
    """Tables of a program's values.

    ``moves``: ``fn, origin, target``, within a function; origins begin with ``p:`` (parameter), ``s:`` (source), ``c:`` (a call's
    result) or ``v:`` (a variable as one place assigns it, which is a target too), other targets are ``ret`` or an argument.  ``binds``: ``fn, target, result, callee, param``, an argument that becomes a parameter of a known function.
    ``results``: ``fn, result, callee``, a call of a known function.  ``passes``: ``fn, target, result``, an argument of an unknown function, which its result may hold, or a variable twice.
    ``sinks``: ``fn, target, sink``.
    """

    moves: DataFrame
    binds: DataFrame
    results: DataFrame
    passes: DataFrame
    sinks: DataFrame


def python_program(facts: DataFrame, sinks: Sequence[tuple[str, str, str, str]] = FLOW_SINKS) -> Program:
    """Tables of Python facts; ``sinks``: pattern of the called name, rule, severity and what it needs (see ``FLOW_SINKS``)."""
    moves = of_kind(facts, "value").select(F.col("scope").alias("fn"), F.col("name").alias("origin"), "target").distinct()
    calls = of_kind(facts, "value_call").select(F.col("scope").alias("fn"), F.col("target").alias("result"), "name", "file", "line", "attrs", "items")
    params = of_kind(facts, "parameter").select(F.col("scope").alias("callee"), F.col("name").alias("param"), F.col("nums")["position"].cast("int").alias("position")).distinct()
    known = of_kind(facts, "function").select(F.col("name").alias("callee")).distinct()
    results = calls.select("fn", "result", F.explode("items").alias("callee")).distinct().join(known, "callee")
    arguments = moves.where("target <> 'ret'").select("fn", "target").distinct()
    parts = F.split("target", ":")
    arguments = arguments.select("fn", "target", F.concat_ws(":", F.lit("c"), parts[1], parts[2]).alias("result"), parts[3].alias("at"))
    place = F.when(F.col("at").rlike(r"^\d+$"), F.col("at").cast("int"))
    bound = arguments.withColumn("place", place).join(results, ["fn", "result"]).join(params, "callee").where((F.col("place") == F.col("position")) | (F.col("at") == F.col("param")))
    passes = arguments.join(results.select("fn", "result").distinct(), ["fn", "result"], "left_anti").join(calls.where("attrs['cleans'] = 'False'").select("fn", "result").distinct(), ["fn", "result"], "left_semi")
    rule = F.lit(None).cast("struct<rule:string,severity:string,first:boolean>")
    for pattern, name, severity, need in reversed(sinks):
        a = F.col("attrs")
        fits = F.col("name").rlike(pattern) & {"built": a["built"] == "True", "shell": a["shell"] == "True"}.get(need, F.lit(True))
        rule = F.when(fits, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(need != "any").alias("first"))).otherwise(rule)
    hot = calls.withColumn("r", rule).where("r is not null")
    at = arguments.join(hot, ["fn", "result"]).where("at = '0' or not r.first and at <> 'self'")
    ends = at.select("fn", "target", F.struct(F.col("r.rule").alias("rule"), F.col("r.severity").alias("severity"), "name", "file", "line").alias("sink"))
    return Program(moves, bound.select("fn", "target", "result", "callee", "param").distinct(), results.select("fn", "result", "callee"), passes.select("fn", "target", "result"), ends)


def _least(df: DataFrame, *by: str) -> DataFrame:
    """One row a key: the shortest way, of equals the first."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min(F.struct(F.size("way").alias("_n"), *rest)).alias("_m")).select(*by, *[F.col(f"_m.{c}").alias(c) for c in rest])


def _step(callee: str = "callee") -> Column:
    return F.concat("way", F.array(callee))


def find_flows(program: Program) -> DataFrame:
    """Sinks that outside data reaches: ``fn, start, sink, way``, one row a sink and the function that holds the source.

    ``fn``: where the source is read, or where a called function's return brings it in; ``start``: the source; ``way``: functions entered or left
    on a shortest way, in order.  A fixpoint by levels: each round joins only what the last one found, drops what is
    known, and writes what is new; rounds are as many as calls on the longest way.  Recursion ends, as nothing new comes of it.  An empty program has no rows; repeated rows count once.
    """
    p = Program(*(stage_table(t, "taint") for t in (program.moves, program.binds, program.results, program.passes, program.sinks)))
    begun = p.moves.where("origin like 'p:%' or origin like 's:%'").select("fn", F.col("origin").alias("start"), F.col("origin").alias("node")).distinct()
    front = stage_table(begun.withColumn("way", F.array("fn")), "taint")
    nodes, ends, spent = front, None, [front]
    while front.limit(1).count():
        moved = front.join(p.moves, (front["fn"] == p.moves["fn"]) & (front["node"] == p.moves["origin"])).select(front["fn"], "start", "target", "way")
        fresh = _least(moved, "fn", "start", "target")
        fresh = stage_table(fresh if ends is None else fresh.join(ends.select("fn", "start", "target"), ["fn", "start", "target"], "left_anti"), "taint")
        before, ends = ends, fresh if ends is None else ends.unionByName(fresh)
        spent.append(fresh)
        back = lambda t: t.where("target = 'ret'").select(F.col("fn").alias("callee"), F.col("start").alias("_start"), F.col("way").alias("_way"))
        into = lambda t: t.join(p.binds, ["fn", "target"])
        through = lambda a, r: a.join(r, (a["callee"] == r["callee"]) & (F.concat(F.lit("p:"), a["param"]) == r["_start"])).select("fn", "start", F.col("result").alias("node"), F.concat("way", "_way").alias("way"))
        steps = [fresh.join(p.passes, ["fn", "target"]).select("fn", "start", F.col("result").alias("node"), "way"), through(into(fresh), back(ends))]
        if before is not None:
            # what is new is the smaller side: it meets the arguments bound to it first, then all that reached them
            new = back(fresh).withColumnRenamed("callee", "_callee")
            bound = p.binds.join(new, (F.col("callee") == F.col("_callee")) & (F.concat(F.lit("p:"), "param") == F.col("_start"))).select("fn", "target", F.col("result").alias("node"), "_way")
            steps.append(before.join(bound, ["fn", "target"]).select("fn", "start", "node", F.concat("way", "_way").alias("way")))
        brought = back(fresh).where("_start like 's:%'").join(p.results, "callee")
        steps.append(brought.select("fn", F.col("_start").alias("start"), F.col("result").alias("node"), F.concat("_way", F.array("fn")).alias("way")))
        found = steps[0]
        for s in steps[1:]:
            found = found.unionByName(s)
        front = stage_table(_least(found, "fn", "start", "node").join(nodes.select("fn", "start", "node"), ["fn", "start", "node"], "left_anti"), "taint")
        nodes = nodes.unionByName(front)
        spent.append(front)
    if ends is None:
        ends = begun.select("fn", "start", F.col("node").alias("target"), F.array("fn").alias("way")).limit(0)
    ends = stage_table(ends, "taint")
    drop_staged(*spent)
    # from sinks back to callers: a parameter that reaches a sink makes every argument bound to it one
    reached = stage_table(_least(ends.join(p.sinks, ["fn", "target"]).select("fn", "start", "sink", "way"), "fn", "start", "sink"), "taint")
    front, spent = reached, []
    into = ends.join(p.binds, ["fn", "target"]).select("fn", "start", "way", "callee", F.concat(F.lit("p:"), "param").alias("_start"))
    while front.limit(1).count():
        inner = front.select(F.col("fn").alias("callee"), F.col("start").alias("_start"), "sink", F.col("way").alias("_way"))
        above = into.join(inner, ["callee", "_start"]).select("fn", "start", "sink", F.concat("way", "_way").alias("way"))
        front = stage_table(_least(above, "fn", "start", "sink").join(reached.select("fn", "start", "sink"), ["fn", "start", "sink"], "left_anti"), "taint")
        reached = reached.unionByName(front)
        spent.append(front)
    out = reached.where("start like 's:%'")
    return out.select("fn", F.expr("substring(start, 3)").alias("start"), "sink", "way")


def taint_findings(facts: DataFrame) -> DataFrame:
    """Findings at sinks that outside data reaches over calls, with the way in the message; one a sink, the shortest way."""
    flows = find_flows(python_program(facts)).where("size(way) > 1")
    one = flows.groupBy("sink").agg(F.min(F.struct(F.size("way").alias("n"), "start", "way")).alias("m"))
    flat = one.select("sink.*", F.col("m.start").alias("start"), F.array_join("m.way", " > ").alias("way"))
    return as_findings(flat, F.col("rule"), F.col("severity"), "security", F.format_string("%s reaches %s by %s", "start", "name", "way"), kind="flow")
