"""Reports in parts and digests of tables."""

import json

import pytest

from millrace.sources import sinks

SHAPE = "rule_id string, file string, line int, severity string, message string"


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_parts_are_the_report(spark, tmp_path, n):
    rows = [(f"SKY-{k % 7}", f"src/{k % 11}.py", k % 5, ["LOW", "MEDIUM", "HIGH", None][k % 4], f'say "{k // 3}",\n{{"ruleId":é') for k in range(n)]
    f = spark.createDataFrame(rows, SHAPE).repartition(7)
    sinks.write_sarif(f, str(tmp_path / "parts"))
    sinks.join_parts(f, str(tmp_path / "parts"), str(tmp_path / "r.sarif"))
    said, want = json.loads((tmp_path / "r.sarif").read_text()), json.loads(sinks.sarif(f).first()["sarif"])
    key = lambda r: json.dumps(r, sort_keys=True)
    assert {k: v for k, v in said.items() if k != "runs"} == {k: v for k, v in want.items() if k != "runs"} and said["runs"][0]["tool"] == want["runs"][0]["tool"]
    got = said["runs"][0]["results"]
    assert len(got) == n and sorted(map(key, got)) == sorted(map(key, want["runs"][0]["results"]))
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in got]
    assert places == sorted(places)


def test_merkle(spark):
    rows = [(f"SKY-{k % 7}", "a", k % 3, None, f"m{k // 2}") for k in range(300)]
    f = spark.createDataFrame(rows, SHAPE)
    root = lambda df: tuple(sinks.merkle(df, "rule_id", "line", "severity", "message").first())
    one = root(f)
    assert one == root(f.repartition(5).orderBy("message")) and one[1] == 300
    assert len({one, root(f.unionByName(f.limit(1))), root(f.limit(299)), root(f.limit(0))}) == 4 and root(f.limit(0))[1] == 0
