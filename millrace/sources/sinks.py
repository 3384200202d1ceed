"""Results in the formats that others read: JSON, SARIF, annotations, baselines, attestations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.findings import fingerprint
from millrace.session import drop_staged, small_batches, stage_table

#: The SARIF schema that reports name.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"


def _sarif_result() -> Column:
    """A finding as a result of a report."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    return F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))


def sarif(findings: DataFrame, tool: str = "millrace") -> DataFrame:
    """One row, ``sarif``: a report of all findings, sorted by file, line and rule; for as many as one task holds (else :func:`write_sarif`)."""
    result = _sarif_result()
    ordered = F.array_sort(F.collect_list(F.struct("file", "line", "rule_id", result.alias("result"))))
    one = findings.agg(F.transform(ordered, lambda x: x["result"]).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver"))
    run = F.array(F.struct(driver.alias("tool"), "results"))
    return one.select(F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), run.alias("runs"))).alias("sarif"))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, one a finding."""
    kind = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("notice")
    safe = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return findings.select(F.format_string("::%s file=%s,line=%d,title=%s::%s", kind, F.col("file"), F.col("line"), F.col("rule_id"), safe).alias("annotation"))


def save_baseline(findings: DataFrame, path: str) -> None:
    """Replace the baseline at ``path`` by the fingerprints of these findings."""
    findings.select(fingerprint("rule_id", "file", "name", "message").alias("fingerprint")).distinct().write.mode("overwrite").parquet(path)


def append_history(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").parquet(path)


def cache_trace(calls: DataFrame, path: str, signature: str) -> DataFrame:
    """Keep a trace (``file, function, line``) under the signature of the code it ran on, and read it back; one that is there is not written again."""
    place = f"{path}/signature={signature}"
    hadoop = calls.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if not hadoop.getFileSystem(calls.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        calls.write.parquet(place)
    return calls.sparkSession.read.schema(calls.schema).parquet(place)


def _digest(rows: DataFrame, columns: list[str], digest: str, count: str) -> DataFrame:
    """One row: SHA-256 of the JSON array of the rows' ``columns``, sorted by them, and their number.

    All tasks sort (by ranges) and render; what they render is staged as chunks of a batch each.  The digest of one string is a chain, so one
    task has to read the chunks in order: it holds a batch of them at once, never the string.
    """
    spark = rows.sparkSession
    small_batches(spark)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"at": [batch["at"].iloc[0]], "text": [",".join(batch["text"])], "n": [len(batch)]})

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for text, more in zip(batch["text"], batch["n"], strict=True):
                if more:
                    state.update(("," + text if n else text).encode())
                    n += more
        state.update(b"]")
        yield pd.DataFrame({"digest": [state.hexdigest()], "n": [n]})

    placed = rows.select(*columns).orderBy(*columns).select(F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*columns)).alias("text"))
    staged = stage_table(placed.mapInPandas(chunks, "at long, text string, n long"), "attested")
    start = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))  # so that no rows have a digest too
    one = staged.unionByName(start).repartitionByRange(1, "at").sortWithinPartitions("at").select("text", "n")
    return one.mapInPandas(chained, "digest string, n long").select(F.col("digest").alias(digest), F.col("n").alias(count))


def attestation(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: digests of the sorted findings and of the sorted files."""
    return _digest(findings, ["rule_id", "file", "line", "severity"], "findings_sha256", "findings").join(_digest(files, ["path", "sha256"], "files_sha256", "files"))


def write_sarif(findings: DataFrame, path: str, tool: str = "millrace") -> None:
    """Write the report of :func:`sarif`, one result a line, as text files in a new folder ``path``: read one after the other by name, they are the report.

    Results are sorted by ranges and written by all tasks; no task or driver holds the report.  The first result alone has no comma before it, as
    positions in the sorted table tell.  Of no findings a report without results is written.
    """
    spark = findings.sparkSession
    rows = findings.select("file", "line", "rule_id", F.to_json(_sarif_result()).alias("text"))
    # a group of parts that Spark reads back need not come in order, so each row keeps its place
    placed = stage_table(rows.orderBy("file", "line", "rule_id", "text").withColumn("at", F.monotonically_increasing_id()), "report")
    first = placed.agg(F.min("at").alias("m")).first()["m"]
    ids = findings.agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))  # as many as there are rules
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver"))
    run = F.array(F.struct(driver.alias("tool"), F.array().cast("array<string>").alias("results")))
    frame = ids.select(F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), run.alias("runs"))).alias("text"))
    head = frame.select(F.expr("left(text, char_length(text) - 4)").alias("text"))
    body = placed.orderBy("at").select(F.concat(F.when(F.col("at") == F.lit(first), "").otherwise(","), "text").alias("text"))
    tail = spark.range(0, 1, 1, 1).select(F.lit("]}]}").alias("text"))
    head.coalesce(1).union(body).union(tail).write.text(path)
    drop_staged(placed)


def join_parts(findings: DataFrame, path: str, target: str) -> None:
    """Make one file of a folder's parts, in order of their names, a buffer at a time; an existing ``target`` is replaced."""
    context = findings.sparkSession.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop, context._jsc.hadoopConfiguration()
    source, goal = hadoop.fs.Path(path), hadoop.fs.Path(target)
    out = goal.getFileSystem(conf).create(goal, True)
    try:
        system = source.getFileSystem(conf)
        for name in sorted(s.getPath().getName() for s in system.listStatus(source) if s.getPath().getName().startswith("part-")):
            stream = system.open(hadoop.fs.Path(source, name))
            hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    finally:
        out.close()


#: Leading hex digits of a row's digest by which digests are joined, level by level.
MERKLE_LEVELS = (6, 4, 2, 0)


def merkle(rows: DataFrame, *columns: str) -> DataFrame:
    """One row, ``root, rows``: a digest of a table's rows, whatever their order; repeated rows count.

    A leaf is the SHA-256 of a row's values as JSON.  Leaves that share six leading digits are sorted and hashed into one node, nodes that share four, two and none
    likewise: a task holds the leaves of one node (a 16,777,216th of all) or 256 nodes.  An empty table has the digest of the empty text.
    """
    level = rows.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("rows"))
    level = level.select(F.col("digest").alias("place"), F.concat_ws(":", "digest", F.col("rows").cast("string")).alias("digest"), "rows")
    for n in MERKLE_LEVELS:
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), ","), 256)
        some = level.groupBy(F.left("place", F.lit(n)).alias("_p")) if n else level
        level = some.agg(joined.alias("digest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).withColumn("place", F.col("_p") if n else F.lit("")).select("place", "digest", "rows")
    return level.select(F.col("digest").alias("root"), "rows")
