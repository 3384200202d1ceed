"""Dead code: references to definitions, exports, reachability, confidence, decisions.

Stages run in a fixed order, as each works on what those before have counted; confidence is
set before references are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import glob_to_regex
from millrace.operators.graph import closure, reachable, transitive_dead
from millrace.operators.patterns import matches
from millrace.operators.receivers import sure_receivers
from millrace.session import stage_table
from millrace.sources.files import module_name

#: Points off the confidence of 100.
PENALTIES = {"private_name": 10, "dunder_or_magic": 100, "in_init_file": 15, "dynamic_module": 10, "test_related": 100, "framework_magic": 40}
#: Confidence from which a definition is reported.
THRESHOLD = 60
#: Names that run a program, and prefixes of methods that frameworks call.
ENTRY_NAMES = ["main", "cli", "run", "app", "create_app"]
CALLED_BY_NAME = r"^(visit_|leave_|transform_|do_(GET|POST|PUT|DELETE|HEAD|PATCH|OPTIONS)$|handle_(starttag|endtag|data|comment)$|on_|watch_|compose$|formatTime$|format$|http_error_)"
FRAMEWORK_DECORATORS = r"(^|\.)(route|get|post|put|delete|patch|command|group|task|fixture|hook|receiver|register|event|on_event|errorhandler|before_request|after_request|validator|field_validator|root_validator|property|setter|cached_property|staticmethod|overload|abstractmethod|listens_for|websocket|middleware|callback)$"


def definitions(facts: DataFrame) -> DataFrame:
    """Definitions with their key: imports by file and name, all else by name alone, where the last file wins."""
    a = F.col("attrs")
    d = facts.where("kind = 'definition'").select(
        "file", "name", "scope", "line", "end_line", F.col("items").alias("decorators"), a["type"].alias("type"), a["owner"].alias("owner"), F.coalesce(a["exported"] == "True", F.lit(False)).alias("is_exported"),
        F.coalesce(a["closure"] == "True", F.lit(False)).alias("is_closure"), a["used"].alias("used"), "target",
    )
    d = d.withColumns({
        "simple_name": F.element_at(F.split("name", r"\."), -1),
        "def_key": F.when(F.col("type") == "import", F.concat_ws(":", "file", "name")).otherwise(F.col("name")),
        "in_init": F.col("file").endswith("__init__.py"),
    })
    w = Window.partitionBy("def_key").orderBy(F.col("file").desc(), F.col("line").desc())
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def confidence(defs: DataFrame, dynamic_modules: DataFrame | None = None, base: int = 100) -> DataFrame:
    """Add ``confidence``: points off for private names, package files, dynamic modules, tests and framework decorators."""
    simple, file = F.col("simple_name"), F.col("file")
    points = F.lit(base)
    points = points - F.when(simple.startswith("_") & ~simple.startswith("__"), PENALTIES["private_name"]).otherwise(0)
    points = points - F.when(F.col("in_init") & F.col("type").isin("function", "class"), PENALTIES["in_init_file"]).otherwise(0)
    d = defs
    if dynamic_modules is not None:
        d = d.join(dynamic_modules.select(F.col("module").alias("_m")).distinct().withColumn("_dyn", F.lit(True)), F.substring_index("scope", ".", 1) == F.col("_m"), "left").drop("_m")
        points = points - F.when(F.col("_dyn"), PENALTIES["dynamic_module"]).otherwise(0)
    test_file = file.rlike(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$")
    points = F.when(F.exists("decorators", lambda x: x.rlike(FRAMEWORK_DECORATORS)), F.least(points, F.lit(PENALTIES["framework_magic"]))).otherwise(points)
    zero = simple.rlike("^__.*__$") | (test_file & simple.rlike("^(test_|Test)")) | ((F.col("type") == "import") & F.col("name").startswith("__future__."))
    zero = zero | ((F.col("type") == "method") & simple.rlike(CALLED_BY_NAME))
    return d.withColumn("confidence", F.when(zero, 0).otherwise(F.greatest(points, F.lit(0)))).drop("_dyn")


def match_references(refs: DataFrame, defs: DataFrame, sure: DataFrame | None = None) -> DataFrame:
    """``def_key, n``: references credited to each definition.

    ``refs``: a bag of ``ref, file, scope``.  What a name begins with and what a dotted name ends in are
    looked for apart; each goes to the candidates of the first stage that has any: (1) the import of that name in the file and what it stands for, the full
    name, (3) the name in the own module or an enclosing scope; (4) a method of the own class for ``self.x``, (5) the only definition of
    that simple name in the file, (6) the only one anywhere, for dotted references, (7) all methods
    of that name, where the receiver of an attribute is not known.  ``sure`` (see :func:`millrace.operators.receivers.sure_receivers`): methods of
    receivers whose classes are known, which go with stage 4.
    """
    bag = refs.where("ref is not null").groupBy("ref", "file", "scope").agg(F.count("*").alias("n")).withColumn("rid", F.xxhash64("ref", "file", "scope"))
    bag = stage_table(bag, "refs")
    d = defs.select("def_key", "name", "simple_name", "file", "scope", "type")
    own = d.where("type <> 'import'")
    parts = F.split("ref", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    spread = bag.select("rid", "file", "scope", "ref", F.explode(prefixes).alias("prefix"))

    def stage(k: int, df: DataFrame) -> DataFrame:
        return df.select("rid", "def_key", F.lit(k).alias("stage"))

    imports = d.where("type = 'import'").select("def_key", F.col("name").alias("prefix"), "file")
    s1 = stage(1, spread.join(imports, ["prefix", "file"]))
    s1b = stage(1, spread.join(own.select("def_key", F.col("name").alias("prefix")), "prefix").where(F.col("prefix").contains(".")))
    scopes = F.split("scope", r"\.")
    enclosing = F.transform(F.sequence(F.lit(1), F.size(scopes)), lambda k: F.array_join(F.slice(scopes, F.lit(1), k), "."))
    first = F.substring_index("ref", ".", 1)
    near = bag.select("rid", F.explode(enclosing).alias("outer"), first.alias("simple_name")).withColumn("name", F.concat_ws(".", "outer", "simple_name"))
    s3 = stage(3, near.join(own.select("def_key", "name"), "name"))
    # what a dotted name ends in, unless the whole name is known or begins outside the project
    roots = own.select(F.substring_index("name", ".", 1).alias("root")).distinct()
    outside = spread.join(imports, ["prefix", "file"]).join(roots, F.substring_index("prefix", ".", 1) == F.col("root"), "left_anti").select("rid")
    whole = bag.join(own.select(F.col("name").alias("ref")), "ref").select("rid")
    ends = bag.where(F.col("ref").contains(".")).join(outside.union(whole).distinct(), "rid", "left_anti")
    tail = ends.select("rid", "file", F.element_at(parts, -1).alias("simple_name"))
    own_class = ends.where("ref rlike '^(self|cls)[.]'").select("rid", F.element_at(parts, 2).alias("simple_name"), F.regexp_replace("scope", r"\.[^.]+$", "").alias("cls"))
    s4 = stage(4, own_class.join(own.select("def_key", "simple_name", F.col("scope").alias("cls")), ["simple_name", "cls"]))
    if sure is not None:  # a name that is also passed on without a call may be called anywhere
        exact = ends.join(sure, ["file", "scope", "ref"]).where(F.col("n") == F.col("calls"))
        s4 = s4.union(stage(4, exact.select("rid", F.col("callee").alias("name")).join(own.select("def_key", "name"), "name")))
    in_file = own.withColumn("_c", F.count("*").over(Window.partitionBy("simple_name", "file"))).where("_c = 1 and type in ('method', 'function', 'class', 'variable')")
    s5 = stage(5, tail.join(in_file.select("def_key", "simple_name", "file"), ["simple_name", "file"]))
    anywhere = own.withColumn("_c", F.count("*").over(Window.partitionBy("simple_name"))).where("_c = 1 and type in ('method', 'function', 'class')")
    s6 = stage(6, tail.join(anywhere.select("def_key", "simple_name"), "simple_name"))
    s7 = stage(7, tail.join(own.where("type = 'method'").select("def_key", "simple_name"), "simple_name"))
    starts, finishes = s1.union(s1b).union(s3), s4.union(s5).union(s6).union(s7)
    least = lambda df: df.withColumn("_s", F.min("stage").over(Window.partitionBy("rid"))).where("stage = _s").select("rid", "def_key")
    best = least(starts).union(least(finishes)).distinct()
    return best.join(bag.select("rid", "n"), "rid").groupBy("def_key").agg(F.sum("n").alias("n"))


def hierarchy_references(defs: DataFrame, inherits: DataFrame) -> DataFrame:
    """``def_key``: methods that override a referenced method of a base class, at any distance."""
    classes = defs.where("type = 'class'").select(F.col("name").alias("cls"), F.col("simple_name").alias("simple"))
    named = inherits.select(F.col("scope").alias("sub"), F.element_at(F.split("name", r"\."), -1).alias("simple")).join(classes, "simple").select(F.col("sub").alias("src"), F.col("cls").alias("dst"))
    above = closure(named)
    methods = defs.where("type = 'method'").select("def_key", "simple_name", "owner", "references")
    live = methods.where("references > 0").select(F.col("owner").alias("dst"), "simple_name")
    return methods.join(above, methods["owner"] == above["src"]).join(live, ["dst", "simple_name"]).select("def_key").distinct()


#: Names that other files hold: event handlers in markup, and ``package.module:function`` entry points.
HANDLER = r"(?i)\bon[a-z]+\s*=\s*[\"']\s*#?(?:return\s+)?([A-Za-z_$][\w$]*)"
ENTRY_POINT = r"[\"']([A-Za-z_][\w.]*:[A-Za-z_][\w.]*)[\"']"


def outside_references(files: DataFrame) -> DataFrame:
    """``ref, file, scope``: names that markup, forms and project files refer to (stage 0)."""
    markup = files.where(F.col("path").rlike(r"(?i)\.(html?|xhtml|fxml|jinja2?|j2|vue)$")).select("path", F.explode(F.regexp_extract_all("text", F.lit(HANDLER), 1)).alias("ref"))
    markup = markup.withColumn("ref", F.concat(F.lit("."), F.col("ref")))  # a name whose owner is not known
    project = files.where(F.col("path").rlike(r"(^|/)(pyproject\.toml|setup\.(cfg|py)|entry_points\.txt)$")).select("path", F.explode(F.regexp_extract_all("text", F.lit(ENTRY_POINT), 1)).alias("ref"))
    return markup.unionByName(project).select(F.replace("ref", F.lit(":"), F.lit(".")).alias("ref"), F.col("path").alias("file"), F.lit("").alias("scope"))


def argument_methods(facts: DataFrame, defs: DataFrame) -> DataFrame:
    """``def_key``: methods called on a parameter, of the classes whose instances are passed in its place (stage 2)."""
    on = facts.where("kind = 'param_call'").select(F.col("scope").alias("fn"), F.col("nums")["position"].cast("int").alias("position"), F.col("target").alias("simple_name")).distinct()
    passed = facts.where("kind = 'call'").select("name", "file", F.posexplode("items").alias("position", "cls")).where("cls <> ''")
    module = module_name(F.col("file"))
    local = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.concat_ws(".", module, c))))
    passed = passed.withColumn("fn", local("name")).withColumn("owner", local("cls")).select("fn", "position", "owner").distinct()
    methods = defs.where("type = 'method'").select("def_key", "simple_name", "owner")
    return on.join(passed, ["fn", "position"]).join(methods, ["owner", "simple_name"]).select("def_key").distinct()


def rescues(facts: DataFrame, defs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``def_key, rescue``: definitions that are alive for a reason no reference shows (stage 3).

    Fallbacks of optional imports; methods that override those of a protocol or abstract class of the project or of a base outside
    it; methods of classes that are registered (a decorator or call named ``register``); what ``getattr`` finds by a name made at run time; definitions that a string names in full;
    public methods that the documentation names with their class.
    """
    simple = F.element_at(F.split("name", r"\."), -1)
    found = [facts.where("kind = 'fallback'").select(F.col("name").alias("def_key"), F.lit("optional import").alias("rescue"))]
    classes = facts.where("kind = 'class'").select("name", simple.alias("simple"), (F.col("nums")["abstract"] > 0).alias("abstract"))
    methods = defs.where("type = 'method'").select("def_key", "owner", "simple_name")
    inherits = facts.where("kind = 'inherits'").select(F.col("scope").alias("owner"), simple.alias("simple"))
    abstract = classes.where("abstract").select(F.col("name").alias("base"), "simple").join(methods.select(F.col("owner").alias("base"), "simple_name"), "base").select("simple", "simple_name").distinct()
    found.append(methods.join(inherits, "owner").join(abstract, ["simple", "simple_name"]).select("def_key", F.lit("protocol").alias("rescue")))
    by_decorator = facts.where("kind = 'definition' and attrs['type'] = 'class'").where(F.exists("items", lambda d: d.rlike(r"(?i)(^|[._])register"))).select(F.col("name").alias("owner"))
    by_call = facts.where("kind = 'call'").where(F.col("name").rlike(r"(?i)(^|[._])register\w*$")).select("file", F.explode("items").alias("cls")).where("cls <> ''")
    by_call = by_call.select(F.explode(F.array(F.col("cls"), F.concat_ws(".", module_name(F.col("file")), "cls"))).alias("owner"))
    registered = by_decorator.unionByName(by_call).distinct()
    found.append(methods.where("simple_name not like '\\\\_%'").join(registered, "owner", "left_semi").select("def_key", F.lit("registered class").alias("rescue")))
    patterns = facts.where("kind = 'dynamic_pattern'").select(F.col("name").alias("_pattern")).distinct()
    callables = defs.where("type in ('function', 'method', 'class')")
    made = matches(callables, "simple_name", patterns, "_pattern").select("simple_name").distinct()
    found.append(callables.join(made, "simple_name", "left_semi").select("def_key", F.lit("name made at run time").alias("rescue")))
    named = facts.where("kind = 'string'").select(F.col("name").alias("def_key")).where("def_key like '%.%'").distinct()
    found.append(defs.where("type <> 'import'").join(named, "def_key", "left_semi").select("def_key", F.lit("named by a string").alias("rescue")))
    if files is not None:
        docs = files.where(F.col("path").rlike(r"(?i)(^|/)(readme[^/]*|docs?/.*)$|\.(md|rst)$")).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]\w*\.[a-z]\w*)"), 1)).alias("said")).distinct()
        public = methods.where("simple_name not like '\\\\_%'").withColumn("said", F.concat_ws(".", F.element_at(F.split("owner", r"\."), -1), "simple_name"))
        found.append(public.join(docs, "said", "left_semi").select("def_key", F.lit("documented").alias("rescue")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("def_key").agg(F.min("rescue").alias("rescue"))


#: Places that a search quotes as evidence.
EVIDENCE = 3


def verify_by_text(candidates: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """``def_key, verdict, evidence``: candidates whose simple name stands as a word where no parser looked (stage 11).

    ``rescued``: in a file that is not source code (a template, a configuration), or as a string of its own in source code;
    ``abstained``: in a source file that could not be parsed.  ``evidence`` quotes the first places.  All files are
    searched, by an equi-join of words with names.
    """
    broken = facts.where("kind = 'error'").select(F.col("file").alias("path")).distinct().withColumn("_broken", F.lit(True))
    other = files.join(broken, "path", "left").where(F.col("_broken") | F.col("lang").isNull()).where(~F.col("path").rlike(r"(?i)\.(md|rst|txt)$"))
    lines = other.select("path", "_broken", F.posexplode(F.split("text", "\r?\n")).alias("k", "text"))
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w{2,})"), 1))).alias("simple_name"), F.when(F.col("_broken"), "abstained").otherwise("rescued").alias("verdict"), F.concat_ws(":", "path", (F.col("k") + 1).cast("string")).alias("at"))
    strings = facts.where("kind = 'string'").select(F.element_at(F.split("name", r"\."), -1).alias("simple_name"), F.lit("rescued").alias("verdict"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("at"))
    hits = candidates.select("def_key", "simple_name").join(words.unionByName(strings), "simple_name")
    best = hits.groupBy("def_key").agg(F.max("verdict").alias("verdict"), F.array_sort(F.collect_set("at")).alias("evidence"))
    return best.select("def_key", "verdict", F.slice("evidence", 1, EVIDENCE).alias("evidence"))


def whitelisted(defs: DataFrame, entries: DataFrame, today: str | None = None) -> DataFrame:
    """``def_key`` of definitions whose full or simple name a shell pattern of ``entries`` (``pattern``, ``until`` a date or null) fits and has not run out."""
    day = F.current_date() if today is None else F.lit(today).cast("date")
    live = entries.where(F.col("until").isNull() | (F.col("until").cast("date") >= day)).select(glob_to_regex(F.col("pattern")).alias("_glob"))
    said = defs.select("def_key", F.explode(F.array_distinct(F.array("name", "simple_name"))).alias("said"))
    return said.join(matches(said, "said", live, "_glob").select("said").distinct(), "said", "left_semi").select("def_key").distinct()


def count_references(facts: DataFrame, defs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Definitions with ``references`` after all stages that count them: references, also from other files, imports of what they stand for, overrides, exports' methods."""
    refs = facts.where("kind in ('ref', 'dynamic')").select(F.col("name").alias("ref"), "file", "scope")
    refs = refs if files is None else refs.unionByName(outside_references(files))
    own = match_references(refs, defs, sure_receivers(facts))
    resolved = defs.where("type = 'import'").groupBy(F.col("target").alias("def_key")).agg(F.count("*").alias("n"))
    total = own.unionByName(resolved).groupBy("def_key").agg(F.sum("n").alias("n"))
    counted = defs.join(total, "def_key", "left").withColumn("references", F.coalesce("n", F.lit(0)).cast("int")).drop("n")
    used = F.when((F.col("type") == "parameter") & (F.col("used") == "True"), F.greatest("references", F.lit(1)))
    counted = stage_table(counted.withColumn("references", F.coalesce(used, F.col("references"))), "counted")
    over = hierarchy_references(counted, facts.where("kind = 'inherits'"))
    counted = counted.join(over.withColumn("_o", F.lit(1)), "def_key", "left").withColumn("references", F.col("references") + F.coalesce("_o", F.lit(0))).drop("_o")
    exported = counted.where("type = 'class' and is_exported").select(F.col("name").alias("owner")).distinct()
    public = counted.where("type = 'method' and simple_name not like '\\\\_%'").join(exported, "owner", "left_semi").select("def_key").withColumn("_e", F.lit(True))
    return counted.join(public, "def_key", "left").withColumn("is_exported", F.col("is_exported") | F.coalesce("_e", F.lit(False))).drop("_e")


def call_edges(facts: DataFrame, defs: DataFrame) -> DataFrame:
    """``caller, callee`` between functions and methods of the project, by the stages of reference matching."""
    calls = facts.where("kind = 'call'").select(F.col("name").alias("ref"), F.col("scope").alias("caller"), "file")
    own = defs.where("type in ('function', 'method', 'class')").select("def_key", "name", "simple_name", "file", "scope")
    exact = calls.join(own, calls["ref"] == own["name"]).select("caller", F.col("def_key").alias("callee"))
    module = F.regexp_replace(F.regexp_replace(F.col("file"), r"(/__init__)?\.py$", ""), "/", ".")
    local = calls.withColumn("name", F.concat_ws(".", module, "ref")).join(own.select("name", "def_key"), "name").select("caller", F.col("def_key").alias("callee"))
    cls = F.regexp_replace("caller", r"\.[^.]+$", "")
    own_class = calls.where("ref rlike '^(self|cls)[.]'").withColumn("name", F.concat_ws(".", cls, F.substring_index("ref", ".", -1))).join(own.select("name", "def_key"), "name").select("caller", F.col("def_key").alias("callee"))
    only = own.withColumn("_c", F.count("*").over(Window.partitionBy("simple_name"))).where("_c = 1").select("simple_name", "def_key")
    loose = calls.where(F.col("ref").contains(".")).withColumn("simple_name", F.substring_index("ref", ".", -1)).join(only, "simple_name").select("caller", F.col("def_key").alias("callee"))
    return exact.union(local).union(own_class).union(loose).distinct()


def entry_reachable(defs: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """``def_key`` of functions and methods that calls reach from entry points: module bodies of programs, exports, tests, entry names."""
    f = defs.where("type in ('function', 'method')")
    roots = f.where(F.col("is_exported") | F.col("simple_name").startswith("test_") | F.col("simple_name").isin(*ENTRY_NAMES) | (F.col("references") > 0)).select(F.col("def_key").alias("node"))
    mains = modules.where("file like '%__main__.py'").select(F.col("name").alias("node"))
    return reachable(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), roots.union(mains)).select(F.col("node").alias("def_key"))


def dead_code(facts: DataFrame, threshold: int = THRESHOLD, ignores: DataFrame | None = None, files: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """All definitions with ``decision``: ``reported``, ``in_reported_class``, ``rescued``, ``abstained``, ``alive`` or ``low_confidence``.

    Confidence first, then references, overrides and exports, methods of passed objects and rescues, entry reachability, death that
    spreads (a definition whose callers are all dead is dead), tables of object mappers, and a search of all text that was not
    parsed.  Lines in ``ignores`` (``file, line``) and names in ``whitelist`` (``pattern, until``) are never reported; without ``files`` no other file is searched.
    """
    defs = stage_table(confidence(definitions(facts)), "defs")
    counted = count_references(facts, defs, files)
    alive = rescues(facts, defs, files).unionByName(argument_methods(facts, defs).withColumn("rescue", F.lit("passed object")))
    if whitelist is not None:
        alive = alive.unionByName(whitelisted(defs, whitelist).withColumn("rescue", F.lit("whitelist")))
    alive = alive.groupBy("def_key").agg(F.min("rescue").alias("rescue"))
    counted = counted.join(alive, "def_key", "left").withColumn("references", F.col("references") + F.col("rescue").isNotNull().cast("int"))
    mapped = facts.where("kind = 'class'").where(F.col("attrs")["orm"] == "True").select(F.col("name").alias("_orm")).distinct()
    counted = counted.join(mapped, F.col("name") == F.col("_orm"), "left").withColumn("confidence", F.when(F.col("_orm").isNotNull(), 0).otherwise(F.col("confidence"))).drop("_orm")
    counted = stage_table(counted, "counted")
    edges = stage_table(call_edges(facts, counted), "edges")
    reached = entry_reachable(counted, edges, facts.where("kind = 'module'"))
    bump = reached.join(counted.where("references = 0 and not is_exported and type in ('function', 'method')").select("def_key"), "def_key", "left_semi")
    counted = counted.join(bump.distinct().withColumn("_r", F.lit(1)), "def_key", "left").withColumn("references", F.col("references") + F.coalesce("_r", F.lit(0))).drop("_r")
    counted = stage_table(counted, "reached")
    graph_defs = counted.where("type in ('function', 'method', 'class') and confidence > 0")
    spread = transitive_dead(graph_defs, edges).where("round > 0").select("def_key").withColumn("_d", F.lit(True))
    counted = counted.join(spread, "def_key", "left").withColumn("references", F.when(F.col("_d"), 0).otherwise(F.col("references"))).drop("_d")
    dead = (F.col("references") == 0) & ~F.col("is_exported") & (F.col("confidence") > 0)
    if ignores is not None:
        counted = counted.join(ignores.select("file", "line").distinct().withColumn("_i", F.lit(True)), ["file", "line"], "left")
        dead = dead & F.col("_i").isNull()
    counted = counted.withColumn("_dead", dead & (F.col("confidence") >= threshold))
    gone = counted.where("_dead and type = 'class'").select(F.col("name").alias("_c")).distinct()
    joined = counted.join(gone, F.col("owner") == F.col("_c"), "left")
    decision = F.when(F.col("_dead") & F.col("_c").isNotNull(), "in_reported_class").when(F.col("_dead"), "reported").when(dead, "low_confidence").otherwise("alive")
    decided = joined.withColumn("decision", decision).drop("_dead", "_c", "_i")
    if files is None:
        return decided.withColumn("evidence", F.array().cast("array<string>"))
    decided = stage_table(decided, "decided")
    said = verify_by_text(decided.where("decision = 'reported' and type in ('function', 'class', 'method')"), files, facts)
    return decided.join(said, "def_key", "left").withColumn("decision", F.coalesce("verdict", "decision")).drop("verdict")
