"""Functions, assignments, calls and flows of TypeScript, JavaScript, Java and Go, from token rows.

Scopes are intervals of token numbers; a use of a variable takes the values of the assignments that can reach it; calls are joined with the functions
they name.  What comes out is the program that :mod:`millrace.operators.taint` works on, so that outside data is followed over variables, calls and returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import taint
from millrace.operators.rules import COLUMNS, as_findings
from millrace.session import stage_table

_TS, _JAVA, _GO = ["typescript", "javascript"], ["java"], ["go"]
#: What brings outside data in: languages, pattern of the dotted name, whether it is called.
SOURCES = [
    (_TS, r"^(this\.)?(req|request|ctx\.request|ctx|event)\.(query|body|params|headers|cookies|queryStringParameters)(\.|$)|^process\.argv|^(window\.)?location\.(search|hash|href)|^document\.(URL|referrer)", False),
    (_TS, r"^(prompt|req\.(param|get|header))$|searchParams\.get$|^(req|request)\.(query|body|params)\.get$", True),
    (_JAVA, r"(^|\.)(getParameter|getParameterValues|getHeader|getQueryString|getCookies|getInputStream|getReader|nextLine|getenv)$", True),
    (_GO, r"^\w+\.(FormValue|PostFormValue|UserAgent|Referer)$|\.URL\.Query\(\)\.Get$|\.Header\.Get$|^os\.Getenv$", True),
    (_GO, r"^\w+\.(URL\.(Path|RawQuery)|Body|Form|PostForm)(\.|$)|^os\.Args$", False),
]
#: What outside data must not reach: languages, pattern of the called name, rule, severity, places of arguments that count (none: all).
SINKS = [
    (_TS, r"^(child_process\.)?(exec|execSync|spawn|spawnSync|execFile)$|\.(execSync|spawnSync)$", "SKY-D212", "CRITICAL", []),
    (_TS, r"^(eval|new Function)$", "SKY-D201", "HIGH", []),
    (_TS, r"\.(query|execute|raw|\$queryRawUnsafe|\$executeRawUnsafe)$", "SKY-D211", "CRITICAL", [0]),
    (_TS, r"^(fetch|axios|got|request)$|^(axios|http|https|got)\.(get|post|put|request)$", "SKY-D216", "CRITICAL", [0]),
    (_TS, r"(^|\.)(readFile|readFileSync|writeFile|writeFileSync|createReadStream|unlink|unlinkSync|sendFile)$", "SKY-D215", "HIGH", [0]),
    (_TS, r"\.redirect$", "SKY-D230", "HIGH", []),
    (_TS, r"^document\.(write|writeln)$|\.insertAdjacentHTML$", "SKY-D226", "CRITICAL", []),
    (_JAVA, r"Runtime\.getRuntime\(\)\.exec$|^new ProcessBuilder$", "SKY-D203", "CRITICAL", []),
    (_JAVA, r"\.(executeQuery|executeUpdate|execute|createQuery|createNativeQuery|prepareStatement|queryForObject)$", "SKY-D211", "CRITICAL", [0]),
    (_JAVA, r"^new (java\.io\.)?File(InputStream|Reader|OutputStream|Writer)?$|^Paths\.get$", "SKY-D215", "HIGH", []),
    (_JAVA, r"\.sendRedirect$", "SKY-D230", "HIGH", [0]),
    (_JAVA, r"^new (java\.net\.)?URL$", "SKY-D216", "CRITICAL", [0]),
    (_GO, r"^exec\.(Command|CommandContext)$", "SKY-D212", "CRITICAL", []),
    (_GO, r"\.(Query|QueryRow|Exec|QueryContext|QueryRowContext|ExecContext)$", "SKY-D211", "CRITICAL", [0, 1]),
    (_GO, r"^http\.(Get|Post|Head|PostForm)$", "SKY-D216", "CRITICAL", [0]),
    (_GO, r"^(os|ioutil)\.(Open|OpenFile|ReadFile|WriteFile|Create|Remove|RemoveAll)$", "SKY-D215", "HIGH", [0]),
    (_GO, r"^http\.Redirect$", "SKY-D230", "HIGH", [2]),
]
#: Fields whose assignment is a sink.
FIELD_SINKS = [(_TS, r"\.(innerHTML|outerHTML)$", "SKY-D226", "CRITICAL")]
#: Calls whose result holds nothing of their arguments that could harm.
CLEANERS = [
    (_TS, r"^(parseInt|parseFloat|Number|Boolean|encodeURIComponent|encodeURI|escapeHtml|path\.basename)$|(^|\.)(sanitize|escape|escapeId|quote|test|includes|indexOf|startsWith|endsWith)$"),
    (_JAVA, r"(^|\.)(parseInt|parseLong|valueOf|encodeForHTML|encodeForSQL|escapeHtml4?|equals|contains|startsWith|matches|length|size|isEmpty)$"),
    (_GO, r"^(strconv\.\w+|url\.(QueryEscape|PathEscape)|html\.EscapeString|template\.HTMLEscapeString|filepath\.Base|len|strings\.(Contains|HasPrefix|HasSuffix|EqualFold))$"),
]
_CONTROL = ["if", "for", "while", "switch", "catch", "synchronized", "with", "function", "func", "async", "try"]


def _any(table: list[tuple], name: str) -> Column:
    """Whether a row of fixed values fits language and name."""
    out = F.lit(False)
    for langs, pattern, *_ in table:
        out = out | F.col("lang").isin(*langs) & F.col(name).rlike(pattern)
    return out


def functions(tokens: DataFrame) -> DataFrame:
    """``path, lang, fn, name, head, head_end, lo, hi, line, arrow``: bodies with parameters; ``name`` is null for functions without one, ``fn`` names path, name and line."""
    bodies = tokens.where("kind in ('body', 'arrow') and head >= 0").select("path", "lang", F.col("k").alias("lo"), F.col("mate").alias("hi"), "head", F.col("line"), (F.col("kind") == "arrow").alias("arrow"))
    heads = tokens.where("text = '(' or kind = 'name'").select("path", F.col("k").alias("head"), F.when(F.col("kind") == "name", F.col("k")).otherwise(F.col("mate")).alias("head_end"), F.col("before"), F.col("assigned"), F.col("kind").alias("head_kind"))
    both = bodies.join(heads, ["path", "head"])
    both = both.where(~F.col("before").isin("if", "for", "while", "switch", "catch", "synchronized", "with", "try", "try"))
    called = F.when((F.col("head_kind") == "open") & F.col("before").rlike(r"^[A-Za-z_$][\w$.]*$") & ~F.col("before").isin(*_CONTROL), F.col("before"))
    name = F.coalesce(called, F.when(F.col("before").isin("=", "async", "function", "func", ":="), F.col("assigned")))
    out = both.withColumn("name", F.element_at(F.split(name, r"\."), -1))
    return out.select("path", "lang", F.concat_ws(":", "path", "name", F.col("line").cast("string")).alias("fn"), "name", "head", "head_end", "lo", "hi", "line", "arrow")


def scoped(tokens: DataFrame, fns: DataFrame) -> DataFrame:
    """Tokens with ``fn, fn_lo, fn_hi, fn_arrow`` of the innermost named function whose body holds them; the file's own code is ``path:``.

    Bodies are nested, so the innermost one at a token is the last that began at the running depth of bodies: two windows, no join on ranges.
    """
    named = fns.where("name is not null")
    step = lambda at, by: named.select("path", F.col(at).alias("k"), F.lit(by).alias("step"), *(F.when(F.lit(by > 0), F.col(c)).alias(c) for c in ("fn", "lo", "hi", "arrow")))
    marks = step("lo", 1).unionByName(step("hi", -1)).withColumn("order", F.when(F.col("step") > 0, 1).otherwise(3))
    rows = tokens.select("path", "k", F.struct(*[c for c in tokens.columns if c not in ("path", "k")]).alias("t")).withColumn("order", F.lit(2))
    every = rows.unionByName(marks, allowMissingColumns=True)
    by = ["k", "order", F.coalesce("step", F.lit(0)), F.coalesce("hi", F.lit(0)).desc()]
    depth = every.withColumn("depth", F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("path").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("path", "depth").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.when(F.col("depth") > 0, F.last(F.when(F.col("step") > 0, F.struct("fn", "lo", "hi", "arrow")), ignorenulls=True).over(w)[c])
    found = depth.select("path", "k", "t", *(last(c).alias(f"in_{c}") for c in ("fn", "lo", "hi", "arrow"))).where("t is not null")
    return found.select(
        "path", "k", "t.*", F.coalesce("in_fn", F.concat("path", F.lit(":"))).alias("fn"), F.coalesce("in_lo", F.lit(-1)).alias("fn_lo"), F.coalesce("in_hi", F.lit(2**31 - 1)).alias("fn_hi"), F.coalesce("in_arrow", F.lit(False)).alias("fn_arrow"),
    )


def parameters(tokens: DataFrame, fns: DataFrame) -> DataFrame:
    """``path, fn, name, position, lo, hi, named, at`` of every function's parameters: in Java the last name of a part, else the first; destructured ones are left out."""
    inside = tokens.where("kind = 'name' and name is not null").select("path", F.col("up").alias("head"), "part", "k", F.col("text").alias("param"))
    pick = F.when(F.col("lang") == "java", F.max(F.struct("k", "param"))).otherwise(F.min(F.struct("k", "param")))
    listed = fns.join(inside, ["path", "head"]).groupBy("path", "lang", "fn", F.col("name").alias("own"), "lo", "hi", "head", "part").agg(pick.alias("p"))
    alone = fns.where("head = head_end").join(tokens.select("path", F.col("k").alias("head"), F.col("text").alias("param")), ["path", "head"])
    alone = alone.select("path", "lang", "fn", F.col("name").alias("own"), "lo", "hi", "head", F.lit(0).alias("part"), F.struct(F.col("head").alias("k"), "param").alias("p"))
    return listed.unionByName(alone).select("path", "fn", F.col("p.param").alias("name"), F.col("part").alias("position"), "lo", "hi", F.col("own").isNotNull().alias("named"), F.col("p.k").alias("at"))


def reaching(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Uses (``path, fn, root, k, eq, loop``) with the ``origin`` of each assignment (``path, fn, root, at, lo, hi, declares, weak, loop, origin``) that can reach them.

    An assignment whose block holds the use, and that comes before it, hides all earlier ones; one in a branch does not.  In a loop, later
    ones reach too, unless one within the loop before the use hides them.  A declaration counts within its block alone.  The work is mentions times assignments of one name in one function.
    """
    d = defs.select("path", "fn", "root", "at", F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"), "declares", "weak", F.col("loop").alias("d_loop"), "origin")
    pairs = uses.join(d, ["path", "fn", "root"])
    holds = (F.col("d_lo") < F.col("k")) & (F.col("k") <= F.col("d_hi"))
    before = (F.col("at") < F.col("k")) & (F.col("at") != F.col("eq"))
    pairs = pairs.where(holds | ~F.col("declares"))
    hides = F.coalesce(F.max(F.when(before & holds & ~F.col("weak"), F.col("at"))).over(Window.partitionBy("path", "k", "target")), F.lit(-1))
    around = (F.col("loop") >= 0) & (F.col("loop") == F.col("d_loop")) & ~before & (F.col("hidden") < F.col("loop"))
    return pairs.withColumn("hidden", hides).where(before & (F.col("at") >= F.col("hidden")) | around).select(*uses.columns, "origin")


def program(tokens: DataFrame) -> taint.Program:
    """The tables of values of ``TOKENS`` rows: functions are named by path, name and line.

    A call goes to the functions of its last name in its own file, else (Go) in its folder, else to those of the project if that name has one only.
    Functions without a name belong to the one around them, their parameters hide its variables.  Fields are not told apart: a dotted name has the value of its first part.
    """
    tokens = stage_table(tokens, "tokens")
    fns = stage_table(functions(tokens), "functions")
    heads = fns.select("path", F.col("head").alias("up"))
    # only names and assignments have values: nothing else goes through the windows, and no column that is not asked for below
    valued = tokens.where("kind = 'assign' or kind = 'name' and name is not null").drop("part", "stmt", "mate", "head", "assigned")
    valued = valued.join(heads.distinct(), ["path", "up"], "left_anti").join(fns.where("head <> head_end").select("path", (F.col("head") - 1).alias("k")).distinct(), ["path", "k"], "left_anti")
    t = stage_table(scoped(valued, fns), "scoped")
    # what takes the value at a token: an argument of a call, a variable, the return
    own = lambda c: F.when(F.col(c) > F.col("fn_lo"), F.col(c)).otherwise(-1)
    call, eq = own("call"), own("eq")
    back = F.col("ret") | F.col("fn_arrow")
    target = F.when(call >= 0, F.concat_ws(":", F.lit("a"), call.cast("string"), F.col("arg").cast("string"))).when(eq >= 0, F.concat(F.lit("v:"), eq.cast("string"))).when(back, F.lit("ret"))
    names = t.where("kind = 'name' and name is not null").withColumn("target", target)
    is_call = F.col("after") == "("
    calls = names.where(is_call).withColumn("result", F.col("k") + 1)
    calls = calls.withColumn("target", F.when(F.col("chain") >= 0, F.concat(F.lit("a:"), F.col("chain").cast("string"), F.lit(":self"))).otherwise(F.col("target")))
    calls = stage_table(calls.select("path", "lang", "fn", "line", "k", "name", "text", "result", "target", "eq", "loop", _any([s for s in SOURCES if s[2]], "name").alias("source")), "calls")
    result = lambda c: F.concat_ws(":", F.lit("c"), F.col(c).cast("string"))
    # variables
    root = F.substring_index("text", ".", 1)
    plain = names.where(~is_call & ~F.col("text").startswith(".") & ~F.col("after").isin(":=", "=>", "of") & ~((F.col("after") == "=") & F.col("target").isNull()) & ~((F.col("after") == ":") & F.col("before").isin("{", ",")) & (F.col("before") != "new"))
    used = plain.where("target is not null").select("path", "lang", "fn", "k", "name", "eq", "loop", "target", root.alias("root"))
    receivers = calls.where("text like '%.%' and text not like '.%'").select("path", "lang", "fn", "k", "name", "eq", "loop", F.concat(F.lit("a:"), F.col("result").cast("string"), F.lit(":self")).alias("target"), root.alias("root"))
    uses = used.unionByName(receivers)
    assigns = t.where("kind = 'assign'").select("path", "lang", "fn", F.col("k").alias("at"), "lo", "hi", "loop", "declares", "weak", "line", F.explode("names").alias("to"))
    params = stage_table(parameters(tokens, fns), "parameters")
    inner = params.where("not named").withColumn("k", F.col("lo"))
    holder = scoped(inner.select("path", "k", "name", "lo", "hi"), fns).select("path", "fn", F.col("name").alias("root"), F.col("k").alias("at"), "lo", "hi", F.lit(-1).alias("loop"), F.lit(True).alias("declares"), F.lit(False).alias("weak"), F.lit("none").alias("origin"))
    given = params.where("named").select("path", "fn", F.col("name").alias("root"), F.col("lo").alias("at"), "lo", "hi", F.lit(-1).alias("loop"), F.lit(True).alias("declares"), F.lit(False).alias("weak"), F.concat(F.lit("p:"), "name").alias("origin"))
    set_ = assigns.select("path", "fn", F.substring_index("to", ".", 1).alias("root"), "at", "lo", "hi", "loop", "declares", (F.col("weak") | F.col("to").contains(".")).alias("weak"), F.concat(F.lit("v:"), F.col("at").cast("string")).alias("origin"))
    values = reaching(uses, set_.unionByName(given).unionByName(holder)).where("origin <> 'none'")
    outside = uses.where(_any([s for s in SOURCES if not s[2]], "name")).withColumn("origin", F.concat(F.lit("s:"), "name"))
    results_of = calls.where("target is not null").select("fn", F.when(F.col("source"), F.concat(F.lit("s:"), "name")).otherwise(result("result")).alias("origin"), "target")
    moves = stage_table(values.select("fn", "origin", "target").unionByName(outside.select("fn", "origin", "target")).unionByName(results_of).distinct(), "moves")
    # calls of known functions
    simple = F.element_at(F.split(F.regexp_replace("text", "^new ", ""), r"\."), -1)
    asked = calls.where("not source").select("path", "lang", "fn", "result", simple.alias("called"), F.regexp_replace("path", "[^/]*$", "").alias("folder"))
    whole = fns.where("name is not null").select("path", "lang", F.col("fn").alias("callee"), F.col("name").alias("called"), F.regexp_replace("path", "[^/]*$", "").alias("folder"))
    here = asked.join(whole.select("path", "called", "callee"), ["path", "called"]).select("fn", "result", "callee")
    left = asked.join(here.select("fn", "result").distinct(), ["fn", "result"], "left_anti")
    near = left.where("lang = 'go'").join(whole.where("lang = 'go'").select("folder", "called", "callee"), ["folder", "called"]).select("fn", "result", "callee")
    left = left.join(near.select("fn", "result").distinct(), ["fn", "result"], "left_anti")
    family = F.when(F.col("lang") == "javascript", "typescript").otherwise(F.col("lang"))
    only = whole.groupBy(family.alias("family"), "called").agg(F.count("*").alias("n"), F.min("callee").alias("callee")).where("n = 1")
    far = left.withColumn("family", family).join(only, ["family", "called"]).select("fn", "result", "callee")
    known = stage_table(here.unionByName(near).unionByName(far).distinct().select("fn", result("result").alias("result"), "callee"), "known")
    parts = F.split("target", ":")
    arguments = moves.where("target like 'a:%'").select("fn", "target").distinct().select("fn", "target", F.concat(F.lit("c:"), parts[1]).alias("result"), parts[2].alias("at"))
    binds = arguments.where("at <> 'self'").join(known, ["fn", "result"]).join(params.where("named").select(F.col("fn").alias("callee"), F.col("position").cast("string").alias("at"), F.col("name").alias("param")), ["callee", "at"])
    facts = calls.select("fn", result("result").alias("result"), "lang", "name", "line", "path", _any(CLEANERS, "name").alias("cleans"))
    passes = arguments.join(known.select("fn", "result").distinct(), ["fn", "result"], "left_anti").join(facts.where("not cleans").select("fn", "result"), ["fn", "result"]).select("fn", "target", "result")
    variables = assigns.select("fn", F.concat(F.lit("v:"), F.col("at").cast("string")).alias("target")).distinct().withColumn("result", F.col("target"))
    # sinks
    rule = F.lit(None).cast("struct<rule:string,severity:string,places:array<int>>")
    for langs, pattern, name, severity, places in reversed(SINKS):
        hit = F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.array(*map(F.lit, places)).cast("array<int>").alias("places"))
        rule = F.when(F.col("lang").isin(*langs) & F.col("name").rlike(pattern), hit).otherwise(rule)
    hot = arguments.join(facts.withColumn("r", rule).where("r is not null"), ["fn", "result"]).where("at <> 'self' and (size(r.places) = 0 or array_contains(r.places, cast(at as int)))")
    sinks = hot.select("fn", "target", F.struct(F.col("r.rule").alias("rule"), F.col("r.severity").alias("severity"), "name", F.col("path").alias("file"), "line").alias("sink"))
    for langs, pattern, name, severity in FIELD_SINKS:
        field = assigns.where(F.col("lang").isin(*langs) & F.col("to").rlike(pattern))
        sinks = sinks.unionByName(field.select("fn", F.concat(F.lit("v:"), F.col("at").cast("string")).alias("target"), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("to").alias("name"), F.col("path").alias("file"), "line").alias("sink")))
    return taint.Program(moves, binds.select("fn", "target", "result", "callee", "param").distinct(), known.select("fn", "result", "callee"), passes.unionByName(variables).distinct(), sinks.distinct())


def flow_findings(tokens: DataFrame) -> DataFrame:
    """Findings at sinks that outside data reaches, one a sink, with the shortest way; an empty table has none."""
    flows = taint.find_flows(program(tokens))
    one = flows.groupBy("sink").agg(F.min(F.struct(F.size("way").alias("n"), "start", "way")).alias("m"))
    flat = one.select("sink.*", F.col("m.start").alias("start"), F.array_join(F.array_distinct("m.way"), " > ").alias("way"))
    return as_findings(flat, F.col("rule"), F.col("severity"), "security", F.format_string("%s reaches %s by %s", "start", "name", "way"), kind="flow").select(*COLUMNS)
