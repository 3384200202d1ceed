"""Session helpers shared by every operator: local sessions, tables, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own settings)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder, read through Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of long texts hold at most ``rows`` rows, if the session still has Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of a query when it ends, not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may do without the setting: there a local folder is
    chosen, and set, so that later calls agree.  On a cluster a missing setting is an error, as
    executors would write to separate disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables of this driver that a result may still read, by path: the Hadoop configuration that reaches them.
_live: dict[str, object] = {}


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table in the shared folder, which :func:`release_staged` deletes if nothing did before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _live[path] = spark.sparkContext._jsc.hadoopConfiguration()
    return path


def stage_table(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, never a recomputation of
    everything before, and gives later stages exact sizes to plan with.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(path: str) -> None:
    conf = _live.pop(path, None)
    if conf is not None:
        found = SparkContext._gateway.jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(conf).delete(found, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stage_table` returned and nothing reads any more."""
    for df in tables:
        _delete(df.staged_at)


def staged_paths() -> list[str]:
    """Tables of this driver that have not been deleted."""
    return sorted(_live)


def release_staged(keep: Iterable[str] = ()) -> None:
    """Delete all tables this driver has staged, but for the paths in ``keep``: to be called when the results that read them are written.

    Results are lazy, so an operator deletes what only it reads, and leaves the tables its result reads to this; it also
    runs when the driver ends.
    """
    for path in set(_live) - set(keep):
        try:
            _delete(path)
        except Exception:  # a gateway that is gone, or a folder that cannot be reached, must not fail the driver's end
            _live.pop(path, None)


atexit.register(release_staged)
