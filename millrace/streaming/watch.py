"""Watching a source as a stream: lifecycle events of fingerprints, windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.findings import fingerprint, lifecycle
from millrace.session import stage_path


def stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Table ``name`` of a data folder as a stream, be it one Parquet file or a folder of them."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _run(query) -> None:
    query.awaitTermination()


def hourly_counts(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Events by type and hour, by a stream that takes what is there and ends (watermark of one day)."""
    out = stage_path(spark, "watch-counts")
    counts = stream(spark, folder, name, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, _: int) -> None:
        batch.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n").write.mode("overwrite").parquet(out)

    _run(counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", stage_path(spark, "watch-state")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


class Watcher:
    """State of a watched project between batches: the fingerprints of the last scan, as a table per batch.

    Each batch is a scan; its fingerprints are compared both ways with those before.  The state is
    addressed by batch number, so that a batch that is run again writes the same rows.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or stage_path(spark, f"watch-{uuid.uuid4().hex[:8]}")

    def process(self, findings: DataFrame, batch: int) -> DataFrame:
        """``fingerprint, event, batch`` of this scan against the last one; an empty batch changes nothing."""
        spark = self.spark
        now = findings.select("fingerprint").distinct()
        empty = spark.createDataFrame([], "fingerprint string")
        previous = spark.read.parquet(f"{self.path}/state/batch={batch - 1}") if batch else empty
        if not now.limit(1).count():
            now = previous
        now.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        now = spark.read.parquet(f"{self.path}/state/batch={batch}")
        events = lifecycle(now, previous).withColumn("batch", F.lit(batch).cast("long"))
        events.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch}")
        return spark.read.parquet(f"{self.path}/events/batch={batch}").withColumn("batch", F.lit(batch).cast("long"))

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events").select("fingerprint", "event", F.col("batch").cast("long").alias("batch"))


def lifecycle_events(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """New and resolved fingerprints (user and type) over the batches of a file stream."""
    watcher = Watcher(spark)

    def scan(batch: DataFrame, number: int) -> None:
        watcher.process(batch.select(fingerprint("user_id", "event_type").alias("fingerprint")), number)

    _run(stream(spark, folder, name, schema).writeStream.foreachBatch(scan).option("checkpointLocation", stage_path(spark, "watch-state")).trigger(availableNow=True).start())
    return watcher.events()


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``path, change``: added, changed or removed files by content signature (``path, sha256``)."""
    p, c = previous.select("path", F.col("sha256").alias("before")), current.select("path", F.col("sha256").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return c.join(p, "path", "full_outer").select("path", change.alias("change")).where("change is not null")
