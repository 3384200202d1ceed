"""Queries over source code that table rows are rendered into, so that findings follow from the rows and SQL computes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import taint
from millrace.plans.bridge import query_registry
from millrace.session import stage_path, stage_table, table
from millrace.sources.files import describe
from millrace.sources.python_facts import extract

QUERIES, ORACLES, query = query_registry()

#: Rows a rendered module holds.
ROWS_A_FILE = 50


def rendered(rows: DataFrame, key: str, text: Column, head: str = "", name: str = "m", suffix: str = ".py", tail: str = "") -> DataFrame:
    """Source files of ``ROWS_A_FILE`` rows each, in order of the integer ``key``: every row's text one after the other."""
    cell = F.floor(F.col(key) / ROWS_A_FILE)
    parts = rows.select(cell.alias("cell"), F.struct(F.col(key).alias("key"), text.alias("text")).alias("part"))
    # a small table renders into much code, which its size does not tell: every task gets cells
    parts = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    whole = parts.groupBy("cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n").alias("body"))
    out = whole.select(F.concat(F.lit(name), F.col("cell").cast("string"), F.lit(suffix)).alias("path"), F.concat(F.lit(head), F.col("body"), F.lit("\n" + tail)).alias("text"))
    return describe(out.withColumns({"bytes": F.octet_length("text").cast("long"), "sha256": F.sha2("text", 256)}))


def _pick(k: Column, *texts: str) -> Column:
    """One of the texts by ``k`` modulo their count."""
    return F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))


#: Part ``k`` is a function that calls function ``(k // 3 * 2 + k % 7) % n``; what it does with its parameter goes by ``k % 9``.
_CALLED = "(k // 3 * 2 + k % 7) % n"


@query(f"""
WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n FROM part),
f AS (SELECT k, {_CALLED} AS g, k % 9 AS t FROM (SELECT p_partkey AS k FROM part), n),
ret(k) AS (SELECT k FROM f WHERE t = 4 UNION SELECT f.k FROM f JOIN ret ON f.g = ret.k WHERE t IN (0, 8)),
sink(k, s) AS (SELECT k, k FROM f WHERE t = 3 UNION SELECT f.k, s FROM f JOIN sink ON f.g = sink.k WHERE t IN (0, 7, 8)),
src(k) AS (
  SELECT f.k FROM f JOIN ret ON f.g = ret.k WHERE t = 1 UNION SELECT f.k FROM f JOIN src ON f.g = src.k WHERE t IN (0, 1, 7, 8)),
hit AS (
  SELECT s FROM f JOIN sink ON f.g = sink.k WHERE t = 1
  UNION SELECT f.k FROM f JOIN src ON f.g = src.k WHERE t IN (5, 6) UNION SELECT f.k FROM f JOIN ret ON f.g = ret.k WHERE t = 6 UNION SELECT s FROM f JOIN sink ON f.g = sink.k WHERE t = 6)
SELECT DISTINCT 'f' || s AS function, 'm' || s // 50 || '.py' AS file FROM hit
""")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose shell command outside data reaches, over any calls: passed on, returned, cleaned on the way or not."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    sized = parts.crossJoin(F.broadcast(parts.agg(F.count("*").alias("n"))))  # one row
    k = F.col("k")
    g = (F.floor(k / 3) * 2 + k % 7) % F.col("n")
    called = F.concat(F.lit("m"), F.floor(g / ROWS_A_FILE).cast("string"), F.lit(".f"), g.cast("string"))
    shape = _pick(
        k, "    return G(x)", "    y = input()\n    return G(y)", "    G('safe')\n    return shlex.quote(x)", "    os.system(x)\n    return 'done'", "    return x.strip()", "    os.system(G('safe'))",
        "    z = G(input())\n    os.system(z)", "    G(x)\n    return G('safe')", "    for i in range(3):\n        w = G(x)\n    return w",
    )
    text = F.concat(F.lit("def f"), k.cast("string"), F.lit("(x):\n"), F.replace(shape, F.lit("G("), F.concat(called, F.lit("("))))
    files = rendered(sized, "k", text, "import os, shlex, m0\n")
    facts = stage_table(extract(files), "facts")
    found = taint.find_flows(taint.python_program(facts))
    inside = facts.where("kind = 'value_call'").select(F.struct("file", "line").alias("at"), F.element_at(F.split("scope", r"\."), -1).alias("function"), "name")
    return found.select(F.struct("sink.file", "sink.line").alias("at")).join(inside.where("name = 'os.system'"), "at").select("function", F.col("at.file").alias("file")).distinct()


#: Part ``k`` is a job of workflow ``k // 3``: what it holds goes by ``k % 7``, and whether it may ask for a token by its size.
@query("""
WITH j AS (
  SELECT p_partkey // 3 AS w, p_partkey % 7 AS t, p_size % 4 = 0 AS token, p_size % 4 = 1 AS own, p_partkey % 5 = 0 AS environment, p_partkey AS k FROM part),
f AS (SELECT w, w % 4 = 0 AS top FROM j GROUP BY w),
x AS (SELECT j.*, top, token OR top AND NOT own AS may FROM j JOIN f USING (w))
SELECT '.github/workflows/w' || w || '.yml' AS path, 'job' || k AS job, 'SKY-' || r AS rule_id
FROM (
  SELECT w, k, 'D310' AS r FROM x WHERE t IN (0, 5) AND may
  UNION ALL SELECT w, k, 'D299' FROM x WHERE t = 1 AND NOT environment
  UNION ALL SELECT w, k, 'D308' FROM x WHERE t = 2)
""")
def config_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows whose rules take two places of one job: a token and a script, a secret and a deployment, a cache and a publication."""
    from millrace.operators import configscan

    k, size = F.col("p_partkey"), F.col("p_size")
    steps = _pick(
        k, "      - run: ./build.sh\n", "      - run: echo deploy\n        env:\n          K: ${{ secrets.K }}\n", "      - uses: actions/cache@PIN\n      - run: npm publish\n", "      - run: npm publish\n",
        "      - uses: actions/cache@PIN\n", "      - name: make it\n        run: make all\n", "      - run: echo ${{ secrets.K }}\n",
    )
    settings = F.when(size % 4 == 0, "    permissions:\n      id-token: write\n").when(size % 4 == 1, "    permissions:\n      contents: read\n").otherwise("")
    place = F.when(k % 5 == 0, "    environment: live\n").otherwise("")
    text = F.concat(F.lit("  job"), k.cast("string"), F.lit(":\n"), settings, place, F.lit("    steps:\n"), F.replace(steps, F.lit("PIN"), F.lit("0" * 40)))
    w = F.floor(k / 3)
    jobs = table(spark, sf_dir, "part").select(w.alias("w"), F.struct(k.alias("key"), text.alias("text")).alias("part"))
    files = jobs.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "").alias("body"))
    head = F.when(F.col("w") % 4 == 0, "name: w\non: push\npermissions:\n  id-token: write\njobs:\n").otherwise("name: w\non: push\njobs:\n")
    files = stage_table(files.select(F.concat(F.lit(".github/workflows/w"), F.col("w").cast("string"), F.lit(".yml")).alias("path"), F.concat(head, F.col("body")).alias("text")), "workflows")
    jobs = stage_table(configscan.job_lines(files), "jobs")
    hits = configscan.scan_config(files, jobs).where(F.col("rule_id").isin("SKY-D299", "SKY-D308", "SKY-D310"))
    # jobs are as many as parts, which the size of their files does not tell: no broadcast
    held = hits.join(jobs.hint("merge"), "path").where((F.col("line") > F.col("start")) & (F.col("line") <= F.col("end")))
    return held.select("path", "job", "rule_id").distinct()


# Rules over rendered code ---------------------------------------------------------------------

#: Statements that a rendered function may hold, and the rule that reports each, or none.
CALL_LINES = [
    ("eval(x)", "D201"), ("os.system('ls')", "D203"), ("pickle.loads(x)", "D205"), ("hashlib.md5(x)", "D207"), ("subprocess.run('ls', shell=True)", "D209"), ("requests.get('https://a', verify=False)", "D210"), ("yaml.safe_load(x)", None),
    ("hashlib.sha256(x)", None), ("marshal.loads(x)", "D233"), ("tempfile.mktemp()", "D348"), ("literal_eval(x)", None),
]
FLOW_LINES = [
    ("os.popen(x)", "D212"), ("os.popen(shlex.quote(x))", None), ("open(x)", "D215"), ("c.execute('select ' + x)", "D211"), ("c.execute('select ?', x)", None), ("requests.get(x)", "D216"), ("y = x; os.popen(y)", "D212"), ("x = 1; os.popen(x)", None),
    ("c.execute(f'select {x}')", "D211"), ("os.popen(int(x))", None), ("requests.get('https://a', x)", None), ("y = request.args.get('a'); os.popen(y)", "D212"),
]
HEAD = "import hashlib, marshal, os, pickle, requests, shlex, subprocess, tempfile, yaml\nfrom ast import literal_eval\nfrom flask import request\n\n"


def _rendered_functions(spark: SparkSession, sf_dir: str, lines: list[tuple[str, str | None]]) -> DataFrame:
    """Parts as functions of three lines and a blank one, whose second line goes by the part's size and key."""
    k = F.col("p_partkey")
    body = _pick(k + F.col("p_size"), *[text for text, _ in lines])
    text = F.concat(F.lit("def f"), k.cast("string"), F.lit("(x, c):\n    "), body, F.lit("\n    return x\n"))
    return rendered(table(spark, sf_dir, "part"), "p_partkey", text, HEAD)


def _lines_sql(lines: list[tuple[str, str | None]]) -> str:
    rules = " ".join(f"WHEN {i} THEN 'SKY-{rule}'" for i, (_, rule) in enumerate(lines) if rule)
    return f"""
WITH p AS (
  SELECT p_partkey // {ROWS_A_FILE} AS cell, row_number() OVER (PARTITION BY p_partkey // {ROWS_A_FILE} ORDER BY p_partkey) AS pos,
    CASE (p_partkey + p_size) % {len(lines)} {rules} END AS rule_id
  FROM part)
SELECT 'm' || cell || '.py' AS file, ({HEAD.count(chr(10))} + 4 * (pos - 1) + 2)::INTEGER AS line, rule_id FROM p WHERE rule_id IS NOT NULL
"""


@query(_lines_sql(CALL_LINES))
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangerous calls in code that parts are rendered into."""
    from millrace.operators import rules
    from millrace.sources.python_facts import of_kind

    facts = extract(_rendered_functions(spark, sf_dir, CALL_LINES))
    return rules.call_rules(of_kind(facts, "call")).select("file", "line", "rule_id")


@query(_lines_sql(FLOW_LINES))
def code_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside data in sinks, through locals, cleaned or overwritten on the way, in code that parts are rendered into."""
    from millrace.operators import rules
    from millrace.sources.python_facts import of_kind

    facts = extract(_rendered_functions(spark, sf_dir, FLOW_LINES))
    return rules.flow_rules(of_kind(facts, "flow")).select("file", "line", "rule_id")


@query(f"""
WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part),
f AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 > 0 AND p_partkey < n THEN least(n, p_partkey + 1 + p_size) END AS g, p_partkey % 7 = 0 AS root FROM part, n),
live(k) AS (SELECT k FROM f WHERE root UNION SELECT f.g FROM f JOIN live USING (k) WHERE f.g IS NOT NULL)
SELECT 'm' || k // {ROWS_A_FILE} || '.py' AS file, 'm' || k // {ROWS_A_FILE} || '.work' || k AS name FROM f ANTI JOIN live USING (k)
""")
def code_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that nothing alive calls, over modules, in code that parts are rendered into: every seventh is called by its module."""
    from millrace.operators import resolve

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sized = parts.crossJoin(F.broadcast(parts.agg(F.max("p_partkey").alias("n"))))  # one row
    k, g = F.col("p_partkey"), F.least(F.col("n"), F.col("p_partkey") + 1 + F.col("p_size"))
    target = F.concat(F.lit("m"), F.floor(g / ROWS_A_FILE).cast("string"))
    called = F.concat(F.lit("    import "), target, F.lit("\n    "), target, F.lit(".work"), g.cast("string"), F.lit("()\n"))
    body = F.when((F.col("p_size") % 3 > 0) & (k < F.col("n")), called).otherwise(F.lit("    print('done')\n"))
    text = F.concat(F.lit("def work"), k.cast("string"), F.lit("():\n"), body, F.when(k % 7 == 0, F.concat(F.lit("\nwork"), k.cast("string"), F.lit("()\n"))).otherwise(""))
    files = stage_table(rendered(sized, "p_partkey", text), "code")
    facts = stage_table(extract(files), "facts")
    return resolve.dead_code(facts, files=files).where("decision = 'reported' and type = 'function'").select("file", "name")


#: Part ``k`` is a function that calls ``(k // 3 * 2 + k % 7) % n``; ``k % 5`` tells what it does with its parameter and names a class.
@query(f"""
WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n FROM part),
f AS (SELECT k, {_CALLED} AS g, k % 5 AS t, k % 11 % 4 AS c FROM (SELECT p_partkey AS k FROM part), n),
param(k, c) AS (SELECT g, c FROM f WHERE t = 3 UNION SELECT f.g, param.c FROM f JOIN param USING (k) WHERE t IN (1, 4)),
ret(k, c) AS (
  SELECT k, c FROM f WHERE t = 0 UNION SELECT k, param.c FROM f JOIN param USING (k) WHERE t IN (2, 3)
  UNION SELECT f.k, ret.c FROM f JOIN ret ON f.g = ret.k WHERE t = 1)
SELECT 'f' || k AS function, 'c.C' || c AS cls, CASE WHEN c = 3 THEN 'c.C1.run' ELSE 'c.C' || c || '.run' END AS method
FROM (SELECT k, param.c FROM f JOIN param USING (k) WHERE t = 2 UNION SELECT f.k, ret.c FROM f JOIN ret ON f.g = ret.k WHERE t = 4)
""")
def receiver_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that calls on parameters and on returned values reach, by the classes of the instances passed around."""
    from millrace.operators import receivers

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    sized = parts.crossJoin(F.broadcast(parts.agg(F.count("*").alias("n"))))  # one row
    k = F.col("k")
    g = (F.floor(k / 3) * 2 + k % 7) % F.col("n")
    called = F.concat(F.lit("m"), F.floor(g / ROWS_A_FILE).cast("string"), F.lit(".f"), g.cast("string"))
    made = F.concat(F.lit("c.C"), (k % 11 % 4).cast("string"), F.lit("()"))
    shape = _pick(k, "    return NEW", "    return G(x)", "    x.run()\n    return x", "    y = NEW\n    G(y)\n    return x", "    G(x).run()")
    text = F.concat(F.lit("def f"), k.cast("string"), F.lit("(x):\n"), F.replace(F.replace(shape, F.lit("G("), F.concat(called, F.lit("("))), F.lit("NEW"), made))
    classes = "\n".join(f"class C{i}{'(C1)' if i == 3 else ''}:\n    {'limit = 3' if i == 3 else 'def run(self):' + chr(10) + '        return 1'}\n" for i in range(4))
    files = rendered(sized, "k", text, "import c, m0\n").unionByName(describe(spark.createDataFrame([("c.py", classes)], "path string, text string").withColumns({"bytes": F.octet_length("text").cast("long"), "sha256": F.sha2("text", 256)})))
    facts = stage_table(extract(files), "facts")
    found = receivers.receiver_methods(facts)
    return found.select(F.element_at(F.split("fn", r"\."), -1).alias("function"), "cls", F.col("callee").alias("method")).distinct()


#: Shapes of a function in three languages: ``G`` is the function it calls, ``IN`` outside data, ``RUN`` a command, ``CLEAN`` what makes it harmless, ``VAR`` a declaration.
_SHAPES = [
    "return G(x);", "VAR y = IN; return G(y);", "G('safe'); return CLEAN(x);", "RUN(x); return 'done';", "return x.trim();", "RUN(G('safe')); return 'done';", "VAR z = G(IN); RUN(z); return 'done';", "G(x); return G('safe');",
    "VAR w = 'a'; FOR { w = G(x); } return w;", "VAR v = IN; v = 'safe'; RUN(v); return 'done';", "VAR v = 'safe'; IF { v = IN; } RUN(v); return 'done';",
]
#: By language: suffix, head and tail of a file, function around a shape, and what the words of shapes stand for.
_TONGUES = [
    (".ts", "import { exec } from 'child_process'\n", "", "export function fK(x: string): string {\n  // RUN(IN)\n  BODY\n}", {"IN": "process.argv[2]", "RUN": "exec", "CLEAN": "encodeURIComponent", "VAR": "let", "FOR": "for (const i of [1, 2])", "IF": "if (x > 'a')"}),
    (".java", "class M {\n", "}\n", "  static String fK(final String x) {\n    /* RUN(IN) */\n    BODY\n  }", {"IN": 'request.getParameter("a")', "RUN": "Runtime.getRuntime().exec", "CLEAN": "Integer.parseInt", "VAR": "String", "FOR": "while (x != null)", "IF": "if (x.isEmpty())", "'": '"'}),
    (".go", 'package m\n\nimport "os/exec"\n', "", "func fK(x string) string {\n\t// RUN(IN)\n\tBODY\n}", {"IN": 'os.Getenv("A")', "RUN": "exec.Command", "CLEAN": "url.QueryEscape", "VAR y =": "y :=", "VAR z =": "z :=", "VAR w =": "w :=", "VAR v =": "v :=", "FOR": "for i := range xs", "IF": "if x != \"\"", "'": '"', "x.trim()": "strings.TrimSpace(x)", "; ": "\n\t", "{ ": "{\n\t", "} ": "}\n\t", ";": ""}),
]


@query(f"""
WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n FROM part),
f AS (SELECT k, {_CALLED} AS g, k % 11 AS t, k // {ROWS_A_FILE} % 3 = ({_CALLED}) // {ROWS_A_FILE} % 3 AS known FROM (SELECT p_partkey AS k FROM part), n),
ret(k) AS (SELECT k FROM f WHERE t = 4 OR t IN (0, 8) AND NOT known UNION SELECT f.k FROM f JOIN ret ON f.g = ret.k WHERE t IN (0, 8) AND known),
sink(k, s) AS (SELECT k, k FROM f WHERE t = 3 UNION SELECT f.k, s FROM f JOIN sink ON f.g = sink.k WHERE t IN (0, 7, 8) AND known),
src(k) AS (
  SELECT f.k FROM f LEFT JOIN ret ON f.g = ret.k WHERE t = 1 AND (NOT known OR ret.k IS NOT NULL) UNION SELECT f.k FROM f JOIN src ON f.g = src.k WHERE t IN (0, 1, 7, 8) AND known),
hit AS (
  SELECT s FROM f JOIN sink ON f.g = sink.k WHERE t IN (1, 6) AND known UNION SELECT f.k FROM f JOIN src ON f.g = src.k WHERE t IN (5, 6) AND known
  UNION SELECT f.k FROM f JOIN ret ON f.g = ret.k WHERE t = 6 AND known UNION SELECT k FROM f WHERE t = 6 AND NOT known OR t = 10)
SELECT DISTINCT 'f' || s AS function, 'm' || s // {ROWS_A_FILE} || CASE s // {ROWS_A_FILE} % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.java' ELSE '.go' END AS file FROM hit
""")
def token_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of TypeScript, Java and Go whose command outside data reaches, over variables, branches, loops and calls of the same language."""
    from millrace.operators import tokenflow
    from millrace.sources.tokens import tokens

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    sized = parts.crossJoin(F.broadcast(parts.agg(F.count("*").alias("n"))))  # one row
    k, files = F.col("k"), None
    g = (F.floor(k / 3) * 2 + k % 7) % F.col("n")
    for i, (suffix, head, tail, around, words) in enumerate(_TONGUES):
        shapes = []
        for shape in _SHAPES:
            text = around.replace("BODY", shape)
            for word, stands in words.items():
                text = text.replace(word, stands)
            shapes.append(text)
        text = F.replace(F.replace(_pick(k, *shapes), F.lit("fK("), F.concat(F.lit("f"), k.cast("string"), F.lit("("))), F.lit("G("), F.concat(F.lit("f"), g.cast("string"), F.lit("(")))
        part = rendered(sized.where(F.floor(k / ROWS_A_FILE) % 3 == i), "k", text, head, suffix=suffix, tail=tail)
        files = part if files is None else files.unionByName(part)
    values = tokenflow.program(tokens(stage_table(files, "code")))
    found = taint.find_flows(values).select("sink").distinct().join(values.sinks.select("fn", "sink"), "sink")
    return found.select(F.split("fn", ":")[1].alias("function"), F.col("sink.file").alias("file")).distinct()


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part),
g AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name[:6] || '%' WHEN 1 THEN '%' || p_name[-5:] ELSE '%' || p_name[3:6] || '%' END AS pattern FROM part)
SELECT replace(pattern, '%', '*') AS pattern, count(*) AS n FROM g JOIN n ON name LIKE pattern GROUP BY pattern
""")
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that fit each of the patterns made of parts: beginnings, ends and pieces of names."""
    from millrace.functions.scalar import glob_to_regex
    from millrace.operators.patterns import matches

    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    star, name, by = F.lit("*"), F.col("name"), F.col("p_partkey") % 3
    glob = F.when(by == 0, F.concat(F.left(name, F.lit(6)), star)).when(by == 1, F.concat(star, F.right(name, F.lit(5)))).otherwise(F.concat(star, F.substring(name, 3, 4), star))
    globs = names.select(glob.alias("pattern")).distinct().withColumn("regex", glob_to_regex(F.col("pattern")))
    return matches(names, "name", globs, "regex").join(globs, "regex").groupBy("pattern").agg(F.count("*").alias("n"))


@query(f"""
WITH p AS (SELECT p_partkey AS k, p_size = 7 AS edited, p_partkey // {ROWS_A_FILE} AS cell FROM part),
c AS (SELECT cell, bool_or(edited) AS again FROM p GROUP BY cell)
SELECT CASE WHEN edited THEN 'g' ELSE 'f' END || k AS function, CASE WHEN again THEN 2 ELSE 1 END AS run, (SELECT count(*) FROM c WHERE again) AS parsed FROM p JOIN c USING (cell)
""")
def incremental_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions, some renamed before a second run: the run that parsed each function's file, and how many files the second one parsed."""
    from millrace.sources.fact_store import facts_of

    k, edited, store = F.col("p_partkey").cast("string"), F.col("p_size") == 7, stage_path(spark, "store")
    parts = table(spark, sf_dir, "part")
    text = lambda name: F.concat(F.lit("def "), name, k, F.lit("(x):\n    return x\n"))
    first = facts_of(rendered(parts, "p_partkey", text(F.lit("f"))), store)
    second = facts_of(rendered(parts, "p_partkey", text(F.when(edited, "g").otherwise("f"))), store)
    runs = first.facts.select("run").distinct().withColumn("n", F.lit(1))
    functions = second.facts.where("kind = 'function'").join(runs, "run", "left")
    return functions.select(F.element_at(F.split("name", r"\."), -1).alias("function"), F.coalesce("n", F.lit(2)).alias("run"), F.lit(second.parsed).cast("long").alias("parsed"))
