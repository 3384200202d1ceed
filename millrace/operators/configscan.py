"""Scanners of configuration files, line by line and file by file: workflows, Dockerfiles, compose files, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.textscan import guard_commands
from millrace.sources.yaml_nodes import config_nodes

#: Kinds of configuration by path.
KINDS = {
    "github_actions": r"(^|/)\.github/workflows/[^/]+\.ya?ml$",
    "gitlab_ci": r"(^|/)\.gitlab-ci\.ya?ml$",
    "dockerfile": r"(^|/)(Dockerfile[^/]*|[^/]*\.dockerfile)$",
    "compose": r"(^|/)(docker-)?compose[^/]*\.ya?ml$",
    "systemd": r"\.service$",
}
SECRET_NAME = r"(?i)(password|passwd|secret|token|api_?key|private_?key)"
#: Rules on single lines: kind, rule, severity, pattern that must fit, pattern that must not.
LINE_RULES = [
    ("github_actions", "SKY-D290", "HIGH", r"^\s*-?\s*(pull_request_target|workflow_run)\s*:?", None),
    ("github_actions", "SKY-D291", "HIGH", r"permissions:\s*write-all", None),
    ("github_actions", "SKY-D292", "MEDIUM", r"^\s*-?\s*uses:\s*[^.\s][^@\s]*(@(?![0-9a-f]{40}\b)\S+)?\s*(#.*)?$", r"@[0-9a-f]{40}\b|docker://"),
    ("github_actions", "SKY-D293", "MEDIUM", r"persist-credentials:\s*true", None),
    ("github_actions", "SKY-D294", "HIGH", r"\$\{\{\s*github\.(event\.(issue|pull_request|comment|review|head_commit)[^}]*\.(title|body|message|ref|name|label)|head_ref)", r"^\s*\w[\w-]*:\s*\$\{\{"),
    ("github_actions", "SKY-D295", "HIGH", r"runs-on:.*self-hosted", None),
    ("github_actions", "SKY-D296", "MEDIUM", r"^\s*(image|container):\s*[\"']?[\w./-]+(:[\w.-]+)?[\"']?\s*$", r"@sha256:"),
    ("github_actions", "SKY-D297", "HIGH", r"secrets:\s*inherit", None),
    ("github_actions", "SKY-D298", "MEDIUM", r"toJSON\(\s*secrets\s*\)", None),
    ("github_actions", "SKY-D303", "MEDIUM", r"if:.*contains\(\s*['\"][^'\"]*['\"]\s*,", None),
    ("github_actions", "SKY-D304", "MEDIUM", r"if:.*github\.actor\s*==\s*['\"][\w-]+\[bot\]", None),
    ("github_actions", "SKY-D306", "HIGH", r"ACTIONS_ALLOW_UNSECURE_COMMANDS:\s*['\"]?true", None),
    ("github_actions", "SKY-D300", "HIGH", r"\$\{\{.*(github\.event|inputs|steps)\..*\}\}.*>>\s*[\"']?\$\{?GITHUB_(ENV|PATH)", None),
    ("github_actions", "SKY-D301", "HIGH", r"^\s*password:\s*[\"']?[^\s\"'$]", None),
    ("github_actions", "SKY-D305", "MEDIUM", r"^\s*-?\s*if:\s*[|>]", None),
    ("github_actions", "SKY-D309", "HIGH", r"^( {2})?\w+:\s*\$\{\{\s*secrets\.", None),
    ("github_actions", "SKY-D312", "MEDIUM", r"\b(npm\s+(ci|install)|yarn\s+install|pnpm\s+install)\b", r"--ignore-scripts"),
    ("gitlab_ci", "SKY-D316", "HIGH", r"(?i)^\s*\w*(password|secret|token|api_?key)\w*:\s*[\"']?[^\s\"'$\[{]", None),
    ("gitlab_ci", "SKY-D323", "MEDIUM", r"^\s*token:\s*[\"']?\$\w+", None),
    ("gitlab_ci", "SKY-D314", "HIGH", r"^\s*image:\s*[\"']?[\w./-]+(:(latest|[\w.-]+))?[\"']?\s*$", r"@sha256:"),
    ("gitlab_ci", "SKY-D315", "HIGH", r"^\s*-?\s*remote:\s*[\"']?https?://", None),
    ("gitlab_ci", "SKY-D317", "HIGH", r"\beval\b.*\$(CI_COMMIT|CI_MERGE_REQUEST)", None),
    ("gitlab_ci", "SKY-D318", "HIGH", r"DOCKER_TLS_CERTDIR:\s*[\"']{2}", None),
    ("gitlab_ci", "SKY-D322", "MEDIUM", r"^\s*-\s*[\"']?\$\w+.*#?\s*$", r"script"),
    ("dockerfile", "SKY-D342", "HIGH", r"(?i)^\s*ADD\s+.*https?://", r"--checksum="),
    ("dockerfile", "SKY-D343", "HIGH", r"(?i)^\s*(ARG|ENV)\s+\w*(password|passwd|secret|token|api_?key)\w*[=\s]+[^\s$]+", None),
    ("compose", "SKY-D330", "HIGH", r"^\s*privileged:\s*true", None),
    ("compose", "SKY-D331", "HIGH", r"^\s*-\s*[\"']?/dev/", None),
    ("compose", "SKY-D332", "MEDIUM", r"^\s*network_mode:\s*[\"']?host", None),
    ("systemd", "SKY-D334", "HIGH", r"^\s*ExecStart\s*=\s*[-@+!]*(/tmp|/var/tmp|/home|/dev/shm)/", None),
    ("systemd", "SKY-D336", "HIGH", r"^\s*(CapabilityBoundingSet|AmbientCapabilities)\s*=.*(CAP_SYS_ADMIN|CAP_SYS_PTRACE|CAP_NET_ADMIN|~\s*$)", None),
]
#: Rules on files that lack a line: kind, rule, severity, pattern that some line should fit, pattern that makes the rule apply.
ABSENCE_RULES = [
    ("github_actions", "SKY-D291", "MEDIUM", r"^\s*permissions:", r"^\s*jobs:"),
    ("github_actions", "SKY-D307", "MEDIUM", r"^name:", r"^\s*jobs:"),
    ("github_actions", "SKY-D313", "MEDIUM", r"timeout-minutes:", r"(id-token:\s*write|contents:\s*write|packages:\s*write)"),
    ("gitlab_ci", "SKY-D321", "MEDIUM", r"^\s*timeout:", r"^\s*(id_tokens|environment):"),
    ("systemd", "SKY-D333", "HIGH", r"^\s*(User|DynamicUser)\s*=\s*(?!root\b)\S", r"^\s*ExecStart\s*="),
    ("systemd", "SKY-D335", "MEDIUM", r"^\s*(ProtectSystem|NoNewPrivileges|PrivateTmp|ProtectHome)\s*=", r"^\s*ExecStart\s*="),
]

#: Rules on a line of a job that has another line too: kind, rule, severity, pattern of the line, of the other, and of one that takes the job out.
#: Lines outside of all jobs count for every job, but the other line for those only that have no ``OVERRIDES`` of their own.
PAIR_RULES = [
    ("github_actions", "SKY-D299", "HIGH", r"\$\{\{\s*secrets\.(?!GITHUB_TOKEN)\w+", r"(?i)\b(deploy|release|publish)\b", r"^\s*environment:"),
    ("github_actions", "SKY-D302", "HIGH", r"uses:\s*actions/create-github-app-token", r"^\s*jobs:", r"^\s*permission-\w+:"),
    ("github_actions", "SKY-D308", "HIGH", r"(uses:\s*actions/cache|^\s*cache:\s*\w)", r"(npm\s+publish|twine\s+upload|gh-action-pypi-publish|^\s*release:)", None),
    ("github_actions", "SKY-D310", "HIGH", r"run:\s*(\./|bash\s|sh\s|make\b|npm\s+run)", r"id-token:\s*write", None),
    ("github_actions", "SKY-D311", "MEDIUM", r"uses:\s*actions/upload-artifact", r"^\s*path:\s*[\"']?(\.|\*\*?|\$\{\{\s*github\.workspace\s*\}\})/?[\"']?\s*$", None),
    ("gitlab_ci", "SKY-D319", "HIGH", r"^\s*-\s*[\"']?(\./|bash\s|sh\s|make\b|npm\s+run)", r"^\s*id_tokens:", None),
    ("gitlab_ci", "SKY-D320", "HIGH", r"^\s*cache:", r"(CI_COMMIT_TAG|^\s*release:|only:\s*\[?\s*tags)", None),
]


#: Keys that make a job's own settings take the place of the file's, by rule.
OVERRIDES = {"SKY-D310": r"^\s+permissions:", "SKY-D319": r"^\s+id_tokens:"}
#: Keys of a pipeline file that are no jobs.
GITLAB_KEYS = ["default", "include", "stages", "variables", "workflow", "image", "services", "cache", "before_script", "after_script", "spec", "pages_defaults"]


def job_lines(files: DataFrame) -> DataFrame:
    """``path, job, start, end``: lines of the jobs of workflow and pipeline files (``path, text``)."""
    yaml = files.where(F.col("path").rlike(KINDS["github_actions"]) | F.col("path").rlike(KINDS["gitlab_ci"]))
    nodes = config_nodes(yaml).where("kind = 'key'")
    github = F.col("path").rlike(KINDS["github_actions"]) & (F.col("depth") == 1) & (F.col("trail")[0] == "jobs")
    gitlab = F.col("path").rlike(KINDS["gitlab_ci"]) & (F.col("depth") == 0) & ~F.col("key").isin(GITLAB_KEYS)
    return nodes.where(github | gitlab).select("path", F.col("key").alias("job"), F.col("line").alias("start"), F.col("end_line").alias("end"))


def _bits(patterns: list[str | None]) -> Column:
    """A line's text against a list of patterns: bit ``i`` is whether pattern ``i`` fits."""
    out = F.lit(0)
    for i, pattern in enumerate(patterns):
        out = out.bitwiseOR(F.when(F.col("text").rlike(pattern), 1 << i).otherwise(0)) if pattern else out
    return out


def _paired(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Hits of ``PAIR_RULES``: a file's lines dealt to its jobs, each job judged by its own lines and those outside of any.

    Files are told apart by one shuffle on ``path``; what a unit's lines hold is bits, one a rule.  Jobs are not broadcast: their number grows with the files, and a
    plan takes the size of parsed files for that of the compressed ones.
    """
    many = jobs.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("start", "end", "job"))).alias("_jobs"))
    paired = lines.where(F.col("config").isin(*{kind for kind, *_ in PAIR_RULES}))
    kinds = [F.col("config") == kind for kind, *_ in PAIR_RULES]
    at = F.lit(0)
    for i, (_, _, _, fits, _, _) in enumerate(PAIR_RULES):
        at = at.bitwiseOR(F.when(kinds[i] & F.col("text").rlike(fits), 1 << i).otherwise(0))
    told = paired.select("path", "line", at.alias("at"), _bits([r[4] for r in PAIR_RULES]).alias("also"), _bits([r[5] for r in PAIR_RULES]).alias("off"), _bits([OVERRIDES.get(r[1]) for r in PAIR_RULES]).alias("own"))
    mine = F.filter("_jobs", lambda j: (j["start"] <= F.col("line")) & (F.col("line") <= j["end"]))
    dealt = told.join(many.hint("merge"), "path", "left").withColumn("_job", F.try_element_at(mine, F.lit(1))).withColumns({"job": F.col("_job.job"), "alone": F.col("_jobs").isNull()})
    # a job without a telling line is judged too, by its first
    dealt = dealt.where((F.col("at").bitwiseOR(F.col("also")).bitwiseOR(F.col("off")).bitwiseOR(F.col("own")) != 0) | (F.col("line") == F.col("_job.start"))).drop("_jobs", "_job")
    unit, file = Window.partitionBy("path", "job"), Window.partitionBy("path")
    held = dealt.withColumns({"around": F.bit_or(F.when(F.col("job").isNull(), F.col("also"))).over(file), **{f"u_{c}": F.bit_or(c).over(unit) for c in ("also", "off", "own")}})
    also = F.when(F.col("job").isNull(), F.col("u_also")).otherwise(F.col("u_also").bitwiseOR(F.coalesce("around", F.lit(0)).bitwiseAND(F.bitwise_not("u_own"))))
    judged = held.withColumn("ok", also.bitwiseAND(F.bitwise_not("u_off")))
    whole = judged.withColumn("any", F.coalesce(F.bit_or(F.when(F.col("job").isNotNull(), F.col("ok"))).over(file), F.lit(0)))
    hit = F.col("at").bitwiseAND(F.when(F.col("job").isNotNull() | F.col("alone"), F.col("ok")).otherwise(F.col("any")))
    hits = [F.when(hit.bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))) for i, (_, rule, severity, *_) in enumerate(PAIR_RULES)]
    return whole.where(F.col("at") != 0).select("path", "line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line", "h.rule_id", "h.severity")


def config_lines(files: DataFrame) -> DataFrame:
    """``path, config, line, text`` of configuration files (``path, text``)."""
    kind = F.lit(None).cast("string")
    for k, pattern in KINDS.items():
        kind = F.when(F.col("path").rlike(pattern), k).otherwise(kind)
    known = files.select("path", "text", kind.alias("config")).where("config is not null")
    return known.select("path", "config", F.posexplode(F.split("text", "\r?\n")).alias("k", "text")).select("path", "config", (F.col("k") + 1).alias("line"), "text")


def scan_config(files: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """``rule_id, severity, path, line`` of all configuration rules, shell commands in run lines included.

    ``jobs``: the files' :func:`job_lines`, if they are at hand (else they are parsed here).
    """
    lines = config_lines(files)
    hits = []
    for kind, rule, severity, fits, unless in LINE_RULES:
        ok = (F.col("config") == kind) & F.col("text").rlike(fits)
        ok = ok & ~F.col("text").rlike(unless) if unless else ok
        hits.append(F.when(ok, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))))
    single = lines.select("path", "line", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("path", "line", "h.rule_id", "h.severity")
    flags = [F.bool_or(F.col("text").rlike(p)).alias(f"{w}{i}") for i, (_, _, _, has, applies) in enumerate(ABSENCE_RULES) for w, p in (("has", has), ("app", applies))]
    per_file = lines.groupBy("path", "config").agg(*flags)
    missing = F.array(*[F.when((F.col("config") == kind) & F.col(f"app{i}") & ~F.col(f"has{i}"), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))) for i, (kind, rule, severity, _, _) in enumerate(ABSENCE_RULES)])
    absent = per_file.select("path", F.lit(1).alias("line"), F.explode(F.filter(missing, lambda h: h.isNotNull())).alias("h")).select("path", "line", "h.rule_id", "h.severity")
    paired = _paired(lines, job_lines(files) if jobs is None else jobs)
    commands = lines.where(F.col("text").rlike(r"^\s*(-?\s*run:|RUN\s|-\s|ExecStart)") | ~F.col("config").isin("compose"))
    guarded = guard_commands(commands, "text").select("path", "line", "rule_id", "severity")
    return single.unionByName(absent).unionByName(paired).unionByName(guarded).distinct()


def exposure(ingress: DataFrame, services: DataFrame, workloads: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes that the outside reaches without a guard: ingress to service to workload to route.

    ``ingress``: ``host, service``; ``services``: ``service, selector``; ``workloads``: ``workload, selector, image, command``;
    ``routes``: ``image, route, guarded``.  A link that fits more than one partner is left out: no claim is made.
    """
    only = lambda df, key: df.withColumn("_c", F.count("*").over(Window.partitionBy(key))).where("_c = 1").drop("_c")
    chain = ingress.join(only(services, "service"), "service").join(only(workloads, "selector"), "selector").join(routes, "image")
    rule = F.when(F.col("command").rlike(r"flask\s+run.*--debug|FLASK_DEBUG=1"), "SKY-DEP002").when(F.col("command").rlike(r"--reload"), "SKY-DEP003").when(~F.col("guarded"), "SKY-DEP001")
    return chain.withColumn("rule_id", rule).where("rule_id is not null").select("rule_id", "host", "service", "workload", "route")


def gpu_compatibility(images: DataFrame, targets: DataFrame) -> DataFrame:
    """Images (``image, min_driver, archs``, and ``engine_arch`` where an engine is built in) against targets (``target, driver, arch``).

    GPU000: the image says nothing of its driver or architectures, or a target nothing of its own; GPU001: driver too old;
    GPU002: architecture missing; GPU003: an engine built for another architecture.
    """
    from millrace.operators.deps import compare_versions

    engine = F.col("engine_arch") if "engine_arch" in images.columns else F.lit(None).cast("string")
    unknown = F.col("min_driver").isNull() | F.col("archs").isNull() | F.col("driver").isNull() | F.col("arch").isNull()
    found = {
        "SKY-GPU001": compare_versions(F.col("driver"), F.col("min_driver")) < 0,
        "SKY-GPU002": ~F.array_contains("archs", F.col("arch")),
        "SKY-GPU003": F.col("engine") != F.col("arch"),
    }
    any_found = unknown
    for condition in found.values():
        any_found = any_found | F.coalesce(condition, F.lit(False))
    pairs = images.select("image", "min_driver", "archs", engine.alias("engine")).join(targets.select("target", "driver", "arch"), any_found)
    rules = F.when(unknown, F.array(F.lit("SKY-GPU000"))).otherwise(F.array_compact(F.array(*[F.when(condition, rule) for rule, condition in found.items()])))
    return pairs.select("image", "target", F.explode(rules).alias("rule_id"))
