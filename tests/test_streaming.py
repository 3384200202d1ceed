"""Watching as a stream."""

from pyspark.sql import functions as F

from millrace.streaming import watch


def test_lifecycle_over_batches(spark, tmp_path):
    scans = [["a", "b"], ["b", "c"], [], ["c"]]
    w = watch.Watcher(spark, str(tmp_path / "w"))
    for k, scan in enumerate(scans):
        w.process(spark.createDataFrame([(x,) for x in scan], "fingerprint string"), k)
    w.process(spark.createDataFrame([("c",)], "fingerprint string"), 3)  # a batch that runs again
    assert {(r["batch"], r["fingerprint"], r["event"]) for r in w.events().collect()} == {(0, "a", "new"), (0, "b", "new"), (1, "c", "new"), (1, "a", "resolved"), (3, "b", "resolved")}


def test_stream_of_one_file_and_of_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "view", "2024-01-01 00:10:00"), (1, "view", "2024-01-01 00:50:00"), (2, "click", "2024-01-01 01:00:00")], "user_id long, event_type string, t string").select("user_id", "event_type", F.to_timestamp_ntz("t").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    part = next((tmp_path / "events.parquet").glob("part-*.parquet"))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "events.parquet").write_bytes(part.read_bytes())
    for folder in (tmp_path, tmp_path / "flat"):
        got = watch.hourly_counts(spark, str(folder), "events", rows.schema)
        assert sorted((r["event_type"], r["hour"].hour, r["n"]) for r in got.collect()) == [("click", 1, 1), ("view", 0, 2)]
        assert watch.lifecycle_events(spark, str(folder), "events", rows.schema).count() == 2


def test_changed_files(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "1")], "path string, sha256 string")
    assert {tuple(r) for r in watch.changed_files(a, b).collect()} == {("y", "changed"), ("z", "removed"), ("n", "added")}
