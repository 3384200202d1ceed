"""Graph operators over edge tables: components, reachability, closure, cores, cycles, dead code.

All loops are driven by row counts of a frontier; every round's table is checkpointed, so
plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import drop_staged, stage_table


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the least node id) for every node of an undirected edge table.

    Alternates large-star and small-star steps (Kiveris et al., 2014): the number of
    rounds grows with the logarithm of the longest path, not with its length.  Null ends are ignored;
    self-loops make a node known.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    nodes = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    links = stage_table(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    while True:
        # large star: every neighbour above a node goes to the node's least neighbour (itself included)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every neighbour below a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        done, links = links, stage_table(small.where("a <> b").distinct(), "components")
        drop_staged(done)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    out = nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    out.reads = links  # for drop_staged, once the result is written
    return out


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", root: str = "node") -> DataFrame:
    """``node, depth``: nodes that paths lead to from ``roots`` (which are at depth 0)."""
    links = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null").distinct()
    seen = stage_table(roots.select(F.col(root).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)), "reach")
    front, depth = seen, 0
    while front.limit(1).count():
        depth += 1
        step = front.join(links, F.col("node") == F.col("_s")).select(F.col("_d").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stage_table(step.withColumn("depth", F.lit(depth)), "reach")
        seen = seen.unionByName(front)
    return seen


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root reaches; none if there are no roots."""
    if not roots.limit(1).count():
        return nodes.select("node").limit(0)
    return nodes.select("node").join(reachable(edges, roots).select("node"), "node", "left_anti")


def has_path(edges: DataFrame, source, target) -> bool:
    """Whether ``target`` can be reached from ``source`` by at least no step."""
    spark = edges.sparkSession
    roots = spark.createDataFrame([(source,)], ["node"])
    return bool(reachable(edges, roots).where(F.col("node") == target).limit(1).count())


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All pairs ``src, dst`` with a path of one step or more, by doubling: as many rounds as the longest path has digits in base 2."""
    paths = stage_table(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct(), "closure")
    n = paths.count()
    while True:
        two = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        done, paths = paths, stage_table(paths.union(two).distinct(), "closure")
        drop_staged(done)
        now = paths.count()
        if now == n:
            return paths
        n = now


#: Steps that a round takes in one plan before it is written: fewer writes for long paths, plans that stay short.
STEPS_A_ROUND = 3


def _trimmed(edges: DataFrame, label: str) -> DataFrame:
    """Edges without those into nodes that none leaves or out of nodes that none enters, until no such node is left: what can be on a cycle, written."""
    now, size, last = edges, -1, None
    while True:
        for _ in range(STEPS_A_ROUND):
            ends, starts = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
            now = now.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")
        now = stage_table(now, label)
        if last is not None:
            drop_staged(last)
        before, last, size = size, now, now.count()
        if size == 0 or size == before:
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes on cycles: nodes that reach each other; the least node names a component.

    Colouring (Orzan, 2004): every node takes the least node that leads to it as
    its colour; a node of its own colour heads a component, which holds the nodes of that colour that lead back to it.  The
    components found are taken out, with nodes that no edge enters or leaves (before the first colours too, so that a graph
    without cycles is never coloured), and the rest is coloured anew.  Tables have a row a
    node or edge, never a pair of nodes that only a path joins.
    """
    whole = stage_table(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "core")
    alone = whole.where("src = dst").select(F.col("src").alias("node"))
    core = _trimmed(whole, "core")
    found = []
    while core.limit(1).count():
        first = core.select(F.col("dst").alias("node"), F.least("src", "dst").alias("c")).union(core.select("src", "src"))
        colours = stage_table(first.groupBy("node").agg(F.min("c").alias("c")), "colours")
        moved = 1
        while moved:
            after = colours.withColumn("moved", F.lit(False))
            for _ in range(STEPS_A_ROUND):
                given = core.join(after.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c2"))
                after = after.join(given, "node", "left").select("node", F.least("c", "c2").alias("c"), (F.col("moved") | F.coalesce(F.col("c2") < F.col("c"), F.lit(False))).alias("moved"))
            after = stage_table(after, "colours")
            moved = after.where("moved").limit(1).count()
            drop_staged(colours)
            colours = after.select("node", "c")
            colours.staged_at = after.staged_at
        own = core.join(colours.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colours.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = stage_table(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "colour-edges")
        members = reachable(back, colours.where("node = c"))
        part = stage_table(members.select("node").join(colours, "node").select("node", F.col("c").alias("component")), "strong")
        found.append(part)
        gone = part.select("node")
        rest = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        drop_staged(back, colours)
        core = _trimmed(rest, "core")
    out = core.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    for part in found:
        out = out.unionByName(part)
    several = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return out.join(several, "component", "left_semi").union(out.join(several, "component", "left_anti").join(alone, "node", "left_semi")).select("node", "component")


def simple_cycles(edges: DataFrame) -> DataFrame:
    """``nodes`` of simple cycles of any length, from their least node; cycles with one node set count once.

    Paths grow by an edge a round until none is left; they are simple, so none outlasts its strong component.
    """
    core = strong_components(edges)
    inside = edges.select("src", "dst").distinct().join(core.select(F.col("node").alias("src"), F.col("component").alias("c")), "src").join(core.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").where("c = c2").select("src", "dst")
    inside = stage_table(inside, "cycles")
    paths = stage_table(inside.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("nodes")), "cycles-paths")
    found = paths.where("start = at").select("nodes")
    while True:
        paths = paths.where("at > start").where(~F.array_contains("nodes", F.col("at")))
        paths = paths.join(inside, F.col("at") == F.col("src")).where("dst >= start").select("start", F.col("dst").alias("at"), F.concat("nodes", F.array("src")).alias("nodes"))
        paths = stage_table(paths, "cycles-paths")
        if not paths.limit(1).count():
            break
        found = found.union(paths.where("start = at").select("nodes"))
    once = found.groupBy(F.array_sort("nodes").alias("_k")).agg(F.min("nodes").alias("nodes"))
    return once.select("nodes", F.size("nodes").alias("length"), F.when(F.size("nodes") > 3, "HIGH").when(F.size("nodes") > 2, "MEDIUM").otherwise("LOW").alias("severity"))


def break_points(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """For each cycle the node with the least (edges in - edges out), the first of equals."""
    degree = edges.select(F.col("src").alias("node"), F.lit(-1).alias("d")).union(edges.select(F.col("dst").alias("node"), F.lit(1).alias("d"))).groupBy("node").agg(F.sum("d").alias("d"))
    spread = cycles.select("nodes", F.posexplode("nodes").alias("pos", "node")).join(degree, "node")
    return spread.groupBy("nodes").agg(F.min(F.struct("d", "pos", "node")).alias("b")).select("nodes", F.col("b.node").alias("break_point"))


def core_infrastructure(cycles: DataFrame, least: int = 2) -> DataFrame:
    """Nodes in at least ``least`` cycles."""
    return cycles.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("cycles")).where(F.col("cycles") >= least)


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Nodes of the undirected k-core: nodes of less degree go until none is left."""
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    both = stage_table(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "kcore")
    while True:
        weak = stage_table(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") < k).select("a"), "kcore-weak")
        if not weak.limit(1).count():
            return both.select(F.col("a").alias("node")).distinct()
        done, both = both, stage_table(both.join(weak, "a", "left_anti").join(weak.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "kcore")
        drop_staged(done, weak)


def coupling(edges: DataFrame, abstractness: DataFrame | None = None) -> DataFrame:
    """Afferent and efferent coupling, instability, distance from the main sequence and zone of every module.

    ``abstractness``: ``module, abstractness`` (0 where absent).
    """
    links = edges.where("src <> dst").select("src", "dst").distinct()
    ca = links.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("ca"))
    ce = links.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("ce"))
    out = ca.join(ce, "module", "full_outer").select("module", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    out = out.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / F.greatest(F.col("ca") + F.col("ce"), F.lit(1))).otherwise(0.0))
    out = out.join(abstractness, "module", "left") if abstractness is not None else out.withColumn("abstractness", F.lit(0.0))
    a = F.coalesce("abstractness", F.lit(0.0))
    out = out.withColumn("abstractness", a).withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))
    zone = (
        F.when((F.col("abstractness") <= 0.3) & (F.col("instability") <= 0.3), "zone_of_pain")
        .when((F.col("abstractness") >= 0.7) & (F.col("instability") >= 0.7), "zone_of_uselessness")
        .when(F.col("distance") <= 0.3, "main_sequence")
        .otherwise("off_sequence")
    )
    return out.withColumn("zone", zone)


def package_rollup(metrics: DataFrame) -> DataFrame:
    """Per package (all but the last dotted part): modules, pooled coupling and mean abstractness."""
    package = F.regexp_replace("module", r"\.?[^.]*$", "")
    pooled = metrics.groupBy(package.alias("package")).agg(F.count("*").alias("modules"), F.sum("ca").alias("ca"), F.sum("ce").alias("ce"), F.avg("abstractness").alias("abstractness"))
    return pooled.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / F.greatest(F.col("ca") + F.col("ce"), F.lit(1))).otherwise(0.0))


def dependency_inversions(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Edges from stable modules (instability < 0.3) to unstable ones (> 0.7); HIGH from under 0.1."""
    m = metrics.select("module", "instability")
    joined = edges.select("src", "dst").distinct().join(m.select(F.col("module").alias("src"), F.col("instability").alias("i_src")), "src").join(m.select(F.col("module").alias("dst"), F.col("instability").alias("i_dst")), "dst")
    return joined.where("i_src < 0.3 and i_dst > 0.7").withColumn("severity", F.when(F.col("i_src") < 0.1, "HIGH").otherwise("MEDIUM"))


def layer_violations(edges: DataFrame, layers: DataFrame, allow: DataFrame, deny: DataFrame, strict: bool = False) -> DataFrame:
    """Edges between layers that policy forbids: unknown layers (strict only) MEDIUM, denied pairs HIGH, pairs off an allow list HIGH.

    ``layers``: ``module, layer``; ``allow`` and ``deny``: ``src_layer, dst_layer``.  A layer without allow rows may use all.
    """
    l = layers.select("module", "layer")  # noqa: E741
    e = edges.select("src", "dst").distinct().join(l.select(F.col("module").alias("src"), F.col("layer").alias("src_layer")), "src", "left").join(l.select(F.col("module").alias("dst"), F.col("layer").alias("dst_layer")), "dst", "left")
    e = e.join(deny.select("src_layer", "dst_layer").distinct().withColumn("denied", F.lit(True)), ["src_layer", "dst_layer"], "left")
    e = e.join(allow.select("src_layer", "dst_layer").distinct().withColumn("allowed", F.lit(True)), ["src_layer", "dst_layer"], "left")
    e = e.join(allow.select("src_layer").distinct().withColumn("listed", F.lit(True)), "src_layer", "left")
    known = F.col("src_layer").isNotNull() & F.col("dst_layer").isNotNull()
    reason = F.when(~known & F.lit(strict), "unknown_layer").when(~known, None).when(F.col("src_layer") == F.col("dst_layer"), None).when(F.col("denied"), "denied").when(F.col("listed") & F.col("allowed").isNull(), "not_allowed")
    out = e.withColumn("reason", reason).where("reason is not null")
    return out.select("src", "dst", "src_layer", "dst_layer", "reason", F.when(F.col("reason") == "unknown_layer", "MEDIUM").otherwise("HIGH").alias("severity"))


#: Stand-ins for characters that a prefix means literally.
_STAR, _MARK = "\u0001", "\u0002"


def map_layers(modules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each module's layer by its most specific pattern (most dots, then longest, then by layer name)."""
    from pyspark.sql import Window

    from millrace.functions.scalar import glob_to_regex
    from millrace.operators.patterns import matches

    as_globs = F.array(F.col("pattern"), F.concat(F.replace(F.replace("pattern", F.lit("*"), F.lit(_STAR)), F.lit("?"), F.lit(_MARK)), F.lit(".*")))
    regex = F.replace(F.replace(glob_to_regex(F.col("glob")), F.lit(_STAR), F.lit(r"\*")), F.lit(_MARK), F.lit(r"\?"))
    globs = patterns.select("pattern", "layer", F.explode(as_globs).alias("glob")).select("pattern", "layer", regex.alias("_regex"))
    hit = modules.join(matches(modules, "module", globs, "_regex"), "module").join(globs, "_regex")
    dots = F.size(F.split("pattern", r"\."))
    w = Window.partitionBy("module").orderBy(dots.desc(), F.length("pattern").desc(), "layer")
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("module", "layer")


def transitive_dead(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Least fixpoint of death: ``def_key, round``.

    ``definitions``: ``def_key, is_exported, references`` and optionally ``owner``; ``calls``: ``caller, callee``.
    Unexported definitions without references are dead; one whose callers are all dead (or
    in a dead owner) and are at least as many as its references dies in a later round.
    """
    defs = definitions if "owner" in definitions.columns else definitions.withColumn("owner", F.lit(None).cast("string"))
    defs = stage_table(defs.select("def_key", "is_exported", "references", "owner"), "dead-defs")
    links = stage_table(calls.select("caller", "callee").where("caller is not null and callee is not null and caller <> callee").distinct().join(defs.select(F.col("def_key").alias("caller"), F.col("owner").alias("caller_owner")), "caller", "left"), "dead-calls")
    dead = stage_table(defs.where("not is_exported and references = 0").select("def_key", F.lit(0).alias("round")), "dead")
    for k in count(1):
        gone = dead.select(F.col("def_key").alias("_k"))
        state = links.join(gone.withColumn("_a", F.lit(True)), F.col("caller") == F.col("_k"), "left").drop("_k").join(gone.withColumn("_o", F.lit(True)), F.col("caller_owner") == F.col("_k"), "left").drop("_k")
        lost = F.coalesce("_a", "_o", F.lit(False))
        per = state.groupBy(F.col("callee").alias("def_key")).agg(F.bool_and(lost).alias("all_dead"), F.count("*").alias("callers")).where("all_dead")
        fresh = defs.where("not is_exported").join(per, "def_key").where("references <= callers").join(dead.select("def_key"), "def_key", "left_anti")
        fresh = stage_table(fresh.select("def_key", F.lit(k).alias("round")), "dead")
        if not fresh.limit(1).count():
            break
        dead = dead.unionByName(fresh)
    return dead


def impacted_files(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """Files whose analysis a change invalidates: the changed ones and all that import them, directly or not (``src`` imports ``dst``)."""
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, changed.select(F.col("file").alias("node"))).withColumnRenamed("node", "file")
