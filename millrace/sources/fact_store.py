"""Facts kept between runs: a file whose path and text were seen before is not parsed again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import stage_table
from millrace.sources.python_facts import extract


@dataclass
class Stored:
    """What a run has: ``facts`` of all its files with ``run``, the run that parsed them, and ``parsed``, how many files this one parsed."""

    facts: DataFrame
    parsed: int


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def facts_of(files: DataFrame, store: str) -> Stored:
    """Facts of ``SOURCE_FILES``, from the folder ``store`` where it has them; new ones are added to it.

    Facts name their file, so the key is a digest of path, module and text; a path has one text.  Facts are appended under a run's name first, the keys they belong to
    after them: facts of a run that died have no keys and are never read, and two runs at once may parse a file twice, of which the first by name is read.
    Reads are pruned to the leading digits of keys (``cell``) that the files have.  Nothing is deleted: :func:`compact` writes a store that holds given files alone.  Files without facts count as parsed.
    Null paths and texts are left out; repeated rows count once.
    """
    spark = files.sparkSession
    keyed = files.where("path is not null and text is not null").withColumn("key", F.sha2(F.concat_ws("\n", "path", "module", "text"), 256)).dropDuplicates(["key"]).withColumn("cell", F.left("key", F.lit(1)))
    keyed = stage_table(keyed, "keyed")
    new, run = keyed, uuid.uuid4().hex
    if _exists(spark, f"{store}/keys"):
        new = keyed.join(spark.read.parquet(f"{store}/keys").select("key"), "key", "left_anti")
    new = stage_table(new, "new")
    parsed = new.count()
    if parsed:
        owner = new.select(F.col("path").alias("file"), "key", "cell")
        facts = extract(new.drop("key", "cell")).join(owner, "file")
        facts.withColumn("run", F.lit(run)).write.mode("append").partitionBy("cell").parquet(f"{store}/facts")
        new.select("key", F.lit(run).alias("run"), "cell").write.mode("append").partitionBy("cell").parquet(f"{store}/keys")
    if not _exists(spark, f"{store}/keys"):
        return Stored(extract(keyed.limit(0)).withColumn("run", F.lit(run)), 0)
    known = spark.read.parquet(f"{store}/keys").groupBy("cell", "key").agg(F.min("run").alias("run"))
    mine = known.join(keyed.select("cell", "key"), ["cell", "key"], "left_semi")
    return Stored(spark.read.parquet(f"{store}/facts").join(mine, ["cell", "key", "run"]).drop("cell", "key"), parsed)


def compact(files: DataFrame, store: str, target: str) -> None:
    """Write a new store at ``target`` with the facts of these files alone."""
    spark = files.sparkSession
    key = files.select(F.sha2(F.concat_ws("\n", "path", "module", "text"), 256).alias("key")).distinct()
    known = spark.read.parquet(f"{store}/keys").groupBy("cell", "key").agg(F.min("run").alias("run")).join(key, "key", "left_semi")
    known = stage_table(known, "known")
    spark.read.parquet(f"{store}/facts").join(known, ["cell", "key", "run"]).write.partitionBy("cell").parquet(f"{target}/facts")
    known.select("key", "run", "cell").write.partitionBy("cell").parquet(f"{target}/keys")
