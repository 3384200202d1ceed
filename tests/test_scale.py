"""What must not grow with the input: broadcasts, frames of one task, pairs that are compared."""

from __future__ import annotations


def test_jobs_of_many_files_are_not_broadcast(spark):
    from millrace.operators import configscan
    from millrace.session import stage_table

    head = "name: w\non: push\npermissions:\n  id-token: write\njobs:\n"
    one = "  a:\n    steps:\n      - run: ./build.sh\n  b:\n    permissions:\n      contents: read\n    steps:\n      - run: ./build.sh\n"
    out = "on: push\nenv:\n  K: ${{ secrets.K }}\njobs:\n  a:\n    steps:\n      - run: ./deploy\n"
    files = spark.createDataFrame([(".github/workflows/a.yml", head + one), (".github/workflows/b.yml", out), (".github/workflows/c.yml", out + "    environment: live\n"), (".github/workflows/d.yml", "on: push\n- run: ./x\nid-token: write\n")], "path string, text string")
    hits = configscan.scan_config(stage_table(files, "files"))  # of a known size, as compressed files have
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    pairs = {(r["path"][-5:], r["line"], r["rule_id"]) for r in hits.where("rule_id in ('SKY-D299', 'SKY-D310')").collect()}
    assert pairs == {("a.yml", 8, "SKY-D310"), ("b.yml", 3, "SKY-D299"), ("d.yml", 2, "SKY-D310")}


def test_frames_of_facts_are_bounded(spark):
    """A batch of files has many facts: frames of them must not grow with the batch."""
    import pandas as pd

    from millrace.sources import frames, python_facts, yaml_nodes

    files = pd.DataFrame({"path": [f"m{i}.py" for i in range(600)], "module": [f"m{i}" for i in range(600)], "lang": "python", "text": ["def f(x):\n    g(x)\n    return x\n"] * 600})
    configs = pd.DataFrame({"path": [f"{i}.yml" for i in range(3000)], "text": ["a: 1\nb:\n  c: 2\n"] * 3000})
    for table, make in ((files, python_facts.extract), (configs, yaml_nodes.config_nodes)):
        seen = []
        real = pd.DataFrame

        class Frames:  # the operator's own function, run here on one batch
            def __init__(self, df):
                self.df = df

            def where(self, *_):
                return self

            select = where

            def mapInPandas(self, f, _):
                seen.extend(len(x) for x in f(iter([self.df])))

        make(Frames(real(table)))
        assert len(seen) > 1 and max(seen) <= frames.FRAME_ROWS
    rows = python_facts.extract(spark.createDataFrame(files)).groupBy("file").count().agg({"count": "min", "*": "count"}).first()
    assert rows["count(1)"] == 600 and rows["min(count)"] * 600 == sum(1 for t in files["text"] for _ in python_facts.facts_of("m.py", "m", t))


def test_attestation_collects_no_rows(spark):
    """Digests of sorted rows without a list of all rows in one group; nulls and no rows included."""
    import hashlib
    import json

    from millrace.sources import sinks

    rows = [("r", f"f{i * 7919 % 5000}", i % 9, "HIGH" if i % 5 else None) for i in range(5000)] + [("r", 'a"é', 1, "LOW")] * 2
    findings, files = spark.createDataFrame(rows, "rule_id string, file string, line int, severity string").repartition(7), spark.createDataFrame([], "path string, sha256 string")
    out = sinks.attestation(findings, files)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    text = ",".join(json.dumps({k: v for k, v in zip(("rule_id", "file", "line", "severity"), r, strict=True) if v is not None}, separators=(",", ":"), ensure_ascii=False) for r in ordered)
    got = out.first()
    assert (got["findings"], got["files"]) == (5002, 0)
    assert got["findings_sha256"] == hashlib.sha256(f"[{text}]".encode()).hexdigest() and got["files_sha256"] == hashlib.sha256(b"[]").hexdigest()


def test_equal_requirements_meet_equal_advisories_once(spark):
    from millrace.operators import deps
    from millrace.session import release_staged, staged_paths

    release_staged()
    d = spark.range(50).selectExpr("id", "'npm' eco", "'p' name", "'^1.2.0' spec")
    a = spark.range(40).selectExpr("id advisory", "'npm' eco", "'p' name", "'1.0.0' introduced", "cast(null as string) fixed", "5.0D cvss", "cast(null as string) label")
    out = deps.affected(d, a)
    assert out.select("id", "advisory").distinct().count() == out.where("certain").count() == out.count() == 2000
    compared = [p for p in staged_paths() if "/affected-" in p]
    assert [spark.read.parquet(p).count() for p in compared] == [1]
    release_staged()
