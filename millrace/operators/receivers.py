"""Which classes a value may be an instance of, by inclusion constraints, and so which methods a call reaches.

Where a class is called an instance begins; assignments, arguments, parameters and returns include each other's sets; a call on a receiver adds the
methods of the classes that reach it, and their parameters and returns, until nothing is new.  Sets are rows ``(function, value, class)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.taint import python_program
from millrace.session import drop_staged, stage_table
from millrace.sources.python_facts import of_kind


def method_table(facts: DataFrame) -> DataFrame:
    """``cls, simple, callee``: the method that each class has under each name, its own or that of the nearest classes above it.

    A frontier of (class, name) walks down from bases to classes that have no method of that name; a class with several bases may have several.
    """
    classes = of_kind(facts, "class").select(F.col("name").alias("cls"), "file").distinct()
    own = of_kind(facts, "function").where("attrs['type'] = 'method'").select(F.col("scope").alias("cls"), F.element_at(F.split("name", r"\."), -1).alias("simple"), F.col("name").alias("callee")).distinct()
    module = F.regexp_replace("scope", r"\.[^.]+$", "")
    named = of_kind(facts, "inherits").select(F.col("scope").alias("sub"), F.explode(F.array(F.col("name"), F.concat_ws(".", module, "name"))).alias("cls")).distinct()
    above = stage_table(named.join(classes.select("cls"), "cls").where("sub <> cls").select("sub", "cls"), "inherits")
    found = stage_table(own, "methods")
    front, spent = found, []
    while front.limit(1).count():
        down = front.join(above, "cls").select(F.col("sub").alias("cls"), "simple", "callee").distinct()
        front = stage_table(down.join(found.select("cls", "simple").distinct(), ["cls", "simple"], "left_anti"), "methods")
        spent.append(front)
        found = found.unionByName(front)
    return found


def receiver_methods(facts: DataFrame) -> DataFrame:
    """``fn, result, line, cls, callee``: for every call on a value, the classes that reach it and the method that each has; one row a pair.

    A semi-naive fixpoint: a round joins what the last one added, drops what is known, and writes the rest.  Not told apart are a function's
    callers (what one passes in comes back to all), nor kept are instances in containers and attributes: calls on them have no row, so a
    call without rows is one whose receiver is not known, not one that reaches nothing.  No facts give no rows.
    """
    p = python_program(facts)
    moves, binds, results = (stage_table(t, "receivers") for t in (p.moves, p.binds, p.results))
    calls = of_kind(facts, "value_call").select(F.col("scope").alias("fn"), F.col("target").alias("result"), F.element_at(F.split("name", r"\."), -1).alias("simple"), "line", "items").distinct()
    calls = stage_table(calls, "receivers")
    classes = of_kind(facts, "class").select(F.col("name").alias("cls")).distinct()
    methods = stage_table(method_table(facts), "receivers")
    params = stage_table(of_kind(facts, "parameter").select(F.col("scope").alias("callee"), F.col("name").alias("param"), F.col("nums")["position"].cast("int").alias("position")).distinct(), "receivers")
    parts = F.split("target", ":")
    arguments = moves.where("target <> 'ret'").select("fn", "target", F.concat_ws(":", F.lit("c"), parts[1], parts[2]).alias("result"), parts[3].alias("at")).distinct()
    made = calls.select("fn", F.col("result").alias("node"), F.explode("items").alias("cls")).join(classes, "cls").select("fn", "node", "cls").distinct()
    front = stage_table(made, "receivers")
    nodes, ends, edges, spent = front, None, None, [front]
    while front.limit(1).count():
        moved = front.join(moves, (front["fn"] == moves["fn"]) & (front["node"] == moves["origin"])).select(front["fn"], "target", "cls").distinct()
        fresh = stage_table(moved if ends is None else moved.join(ends, ["fn", "target", "cls"], "left_anti"), "receivers")
        before, ends = ends, fresh if ends is None else ends.unionByName(fresh)
        # instances that reach a receiver make the call one of their class's method
        on = fresh.where("target like '%:self'").select("fn", F.concat_ws(":", F.lit("c"), parts[1], parts[2]).alias("result"), "cls")
        reached = on.join(calls.select("fn", "result", "simple", "line"), ["fn", "result"]).join(methods, ["cls", "simple"]).select("fn", "result", "line", "cls", "callee").distinct()
        new_edges = stage_table(reached, "receivers")
        edges = new_edges if edges is None else edges.unionByName(new_edges)
        spent += [fresh, new_edges]
        place = F.when(F.col("at").rlike(r"^\d+$"), F.col("at").cast("int"))
        bound = lambda e: arguments.join(e.select("fn", "result", "callee").distinct(), ["fn", "result"]).join(params, "callee").where((place == F.col("position")) | (F.col("at") == F.col("param"))).select("fn", "target", "callee", "param")
        returned = lambda e: e.select("fn", "result", "callee").distinct()
        enter = lambda t, b: t.join(b, ["fn", "target"]).select(F.col("callee").alias("fn"), F.concat(F.lit("p:"), "param").alias("node"), "cls")
        leave = lambda t, r: t.where("target = 'ret'").select(F.col("fn").alias("callee"), "cls").join(r, "callee").select("fn", F.col("result").alias("node"), "cls")
        known = binds.select("fn", "target", "callee", "param").unionByName(bound(edges))
        steps = [enter(fresh, known), leave(fresh, results.select("fn", "result", "callee").unionByName(returned(edges)))]
        if before is not None:
            steps += [enter(before, bound(new_edges)), leave(before, returned(new_edges))]
        found = steps[0]
        for s in steps[1:]:
            found = found.unionByName(s)
        front = stage_table(found.distinct().join(nodes, ["fn", "node", "cls"], "left_anti"), "receivers")
        nodes = nodes.unionByName(front)
        spent.append(front)
    if edges is None:
        return made.select("fn", F.col("node").alias("result"), F.lit(0).alias("line"), "cls", F.col("cls").alias("callee")).limit(0)
    out = stage_table(edges.distinct(), "receivers")
    drop_staged(*spent, moves, binds, results, calls, methods, params)
    return out


def sure_receivers(facts: DataFrame) -> DataFrame:
    """``file, scope, ref, calls, callee``: methods that the dotted name ``ref`` calls in a function, where all its receivers are made there of known classes.

    Only what one function tells counts: a parameter, or the return of a call, may be anything.  ``calls`` is how often the name is called.
    """
    calls = of_kind(facts, "value_call").select("file", F.col("scope").alias("fn"), F.col("target").alias("result"), F.col("name").alias("ref"), "items").where("ref like '%.%'")
    made = of_kind(facts, "value_call").select(F.col("scope").alias("fn"), F.col("target").alias("origin"), F.explode("items").alias("cls")).join(of_kind(facts, "class").select(F.col("name").alias("cls")).distinct(), "cls").distinct()
    parts = F.split("target", ":")
    held = of_kind(facts, "value").where("target like '%:self'").select(F.col("scope").alias("fn"), F.col("name").alias("origin"), F.concat_ws(":", F.lit("c"), parts[1], parts[2]).alias("result")).distinct()
    typed = held.join(made, ["fn", "origin"], "left").groupBy("fn", "result").agg(F.bool_and(F.col("cls").isNotNull()).alias("sure"), F.collect_set("cls").alias("classes"))
    named = calls.join(typed, ["fn", "result"], "left").groupBy("file", "fn", "ref").agg(F.count("*").alias("calls"), F.bool_and(F.coalesce("sure", F.lit(False))).alias("sure"), F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"))
    of_class = named.where("sure").select("file", F.col("fn").alias("scope"), "ref", "calls", F.explode("classes").alias("cls"), F.element_at(F.split("ref", r"\."), -1).alias("simple"))
    return of_class.join(method_table(facts), ["cls", "simple"]).select("file", "scope", "ref", "calls", "callee").distinct()
