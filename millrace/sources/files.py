"""Source trees and other inputs as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tree import read_tree

#: Languages by suffix, and folders that are never read.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "go": "go", "kt": "kotlin", "php": "php", "rs": "rust", "dart": "dart", "cs": "csharp", "sh": "shell"}
EXCLUDED = ["__pycache__", ".git", ".venv", "venv", "node_modules", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache", "htmlcov", ".eggs"]
#: Languages whose facts are extracted; files of others are listed as unsupported, never as clean.
SUPPORTED = ["python"]


def excluded(path: Column, folders: Iterable[str] = EXCLUDED) -> Column:
    """Whether a folder of the path is excluded, by name or shell pattern."""
    parts = [f.replace(".", r"\.").replace("*", "[^/]*") for f in folders]
    return path.rlike(rf"(^|/)({'|'.join(parts)})(/|$)")


def module_name(path: Column) -> Column:
    """Dotted module of a relative Python path; a package's ``__init__`` is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), "/__init__$|^__init__$", ""), "/", ".")


def file_role(path: Column) -> Column:
    return F.when(path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$"), "test").when(path.rlike(r"(^|/)docs?/"), "docs").when(path.rlike(r"(^|/)(examples?|benchmarks?|scripts?)/"), "support").otherwise("source")


def source_files(spark: SparkSession, roots: str | list[str], include: Iterable[str] = (), exclude: Iterable[str] = EXCLUDED, ignore: str = "git") -> DataFrame:
    """All files under the roots as ``SOURCE_FILES``, code or not; excluded folders are left out unless ``include`` names them.

    A file that several roots hold counts once, with the path below the first of them.  Paths are relative to their root.
    Binary files have a null text.  See :func:`millrace.sources.tree.read_tree`.
    """
    roots = [roots] if isinstance(roots, str) else list(dict.fromkeys(roots))
    found = read_tree(spark, roots, exclude, include, ignore)
    if len(roots) > 1:
        absolute = F.concat_ws("/", F.regexp_replace("root", "^file:(//)?|/+$", ""), "path")
        order = F.create_map(*[x for k, r in enumerate(roots) for x in (F.lit(r), F.lit(k))])
        first = found.withColumns({"full": absolute, "rank": order[F.col("root")]})
        found = first.withColumn("least", F.min("rank").over(Window.partitionBy("full"))).where("rank = least").dropDuplicates(["full"])
    return describe(found)


def describe(files: DataFrame) -> DataFrame:
    """Add language, module, lines of code and role to ``path, text, bytes, sha256``."""
    suffix = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    lang = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        lang = F.when(suffix == k, v).otherwise(lang)
    code = F.filter(F.split("text", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    return files.select("path", lang.alias("lang"), module_name(F.col("path")).alias("module"), "text", "bytes", "sha256", F.size(code).alias("loc"), file_role(F.col("path")).alias("role"))


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Source files given as path to text (for tests and single files)."""
    rows = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, text string")
    return describe(rows.withColumns({"bytes": F.octet_length("text").cast("long"), "sha256": F.sha2("text", 256)}))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language and whether their facts are extracted."""
    return files.groupBy("lang").agg(F.count("*").alias("files")).withColumn("status", F.when(F.col("lang").isin(*SUPPORTED), "complete").otherwise("incomplete"))


def trace_calls(spark: SparkSession, path: str) -> DataFrame:
    """``file, function, line`` of a JSON call trace (``{"calls": [...]}``)."""
    return spark.read.schema("calls array<struct<file:string,function:string,line:int>>").option("multiLine", "true").json(path).select(F.explode("calls").alias("c")).select("c.*")


def coverage_lines(bitmaps: DataFrame) -> DataFrame:
    """``file, line`` of coverage bitmaps (``file, numbits BINARY``): bit ``b`` of byte ``k`` is line ``8 k + b``."""
    byte = bitmaps.select("file", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("numbits")), lambda k: F.conv(F.hex(F.substring(F.col("numbits"), k, F.lit(1))), 16, 10).cast("int"))).alias("k", "byte"))
    bits = byte.select("file", "k", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    return bits.where(F.shiftright("byte", 0).bitwiseAND(F.expr("shiftleft(1, b)")) != 0).select("file", (F.col("k") * 8 + F.col("b")).alias("line"))


def external_reports(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a SARIF report: ``rule_id, severity, message, file, line``."""
    shape = "runs array<struct<tool:struct<driver:struct<name:string>>,results array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
    raw = spark.read.schema(shape.replace("results array", "results:array")).option("multiLine", "true").json(path)
    run = raw.select(F.explode("runs").alias("r")).select(F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    level = F.when(F.col("x.level") == "error", "HIGH").when(F.col("x.level") == "warning", "MEDIUM").otherwise("LOW")
    place = F.element_at("x.locations", 1)["physicalLocation"]
    return run.select("tool", F.col("x.ruleId").alias("rule_id"), level.alias("severity"), F.col("x.message.text").alias("message"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"))
