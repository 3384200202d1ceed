"""YAML files as nodes, and rules that are judged within one job."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import configscan
from millrace.sources import yaml_nodes

DOC = """
%YAML 1.2
---
# comment
name: "a # b"   # end
on: [push, {release: {types: [published]}}]
base: &base
  image: x
  env: {A: 1, 'B': two}
jobs:
  build:
    <<: *base
    image: y
    steps:
    - run: |
        echo "key: not a node"
        - nor this

      name: last
    -   uses: a@b
        with:
          path: 'it''s'
  other: *base
list:
- - 1
  - 2
- long
  text
multi: [a,
  b]
url: http://x:80/y
"""


def tree(rows):
    return {".".join(r["trail"]): r["value"] for r in rows}


def test_nodes(spark):
    df = spark.createDataFrame([("a.yml", DOC), ("b.yml", None), ("c.yml", ""), ("d.yml", "just text")], "path string, text string")
    rows = [r for r in yaml_nodes.config_nodes(df).collect() if r["path"] == "a.yml"]
    got = tree(rows)
    assert got["name"] == "a # b" and got["on.0"] == "push" and got["on.1.release.types.0"] == "published"
    assert got["jobs.build.image"] == "y" and got["jobs.build.env.A"] == "1" and got["jobs.build.env.B"] == "two" and "jobs.build.<<" not in got
    assert got["jobs.build.steps.0.run"] == 'echo "key: not a node"\n- nor this' and got["jobs.build.steps.0.name"] == "last"
    assert got["jobs.build.steps.1.uses"] == "a@b" and got["jobs.build.steps.1.with.path"] == "it's"
    assert got["jobs.other.image"] == "x" and got["list.0.1"] == "2" and got["list.1"] == "long text" and got["multi.1"] == "b" and got["url"] == "http://x:80/y"
    by = {r["pre"]: r for r in rows}
    assert all(r["parent"] is None or by[r["parent"]]["pre"] < r["pre"] <= by[r["parent"]]["post"] for r in rows)
    build = next(r for r in rows if r["trail"] == ["jobs", "build"])
    assert (build["line"], build["end_line"]) == (11, 22)


def test_inside_is_containment(spark):
    df = spark.createDataFrame([("a.yml", DOC)], "path string, text string")
    nodes = yaml_nodes.config_nodes(df)
    jobs = nodes.where("depth = 1 and trail[0] = 'jobs'").select("path", "pre", "post", F.col("key").alias("job"))
    got = {(r["job"], ".".join(r["trail"])) for r in yaml_nodes.inside(nodes, jobs).collect()}
    want = {(r["trail"][1], ".".join(r["trail"])) for r in nodes.where("depth > 1 and trail[0] = 'jobs'").collect()}
    assert got == want and len(got) > 8


def test_aliases_that_explode(spark):
    bomb = "a0: &a0 [x, x]\n" + "".join(f"a{k}: &a{k} [{', '.join([f'*a{k - 1}'] * 9)}]\n" for k in range(1, 9))
    rows = yaml_nodes.config_nodes(spark.createDataFrame([("b.yml", bomb), ("s.yml", "a: &a\n  b: *a\n")], "path string, text string")).collect()
    assert [r["kind"] for r in rows if r["path"] == "b.yml"] == ["error"]
    assert [r["key"] for r in rows if r["path"] == "s.yml"] == ["a", "b"]


PIN = "0123456789012345678901234567890123456789"
GITHUB = {
    "D310": (f"name: x\non: push\njobs:\n  one:\n    permissions:\n      id-token: write\n    steps:\n      - uses: a/b@{PIN}\n  two:\n    steps:\n      - run: ./build.sh\n", f"name: x\non: push\njobs:\n  one:\n    steps:\n      - uses: a/b@{PIN}\n  two:\n    permissions:\n      id-token: write\n    steps:\n      - run: ./build.sh\n"),
    "D299": ("name: x\njobs:\n  build:\n    env:\n      K: ${{ secrets.K }}\n  deploy:\n    environment: prod\n    steps:\n      - run: echo deploy\n", "name: x\njobs:\n  build:\n    environment: prod\n    steps:\n      - run: echo hi\n  deploy:\n    steps:\n      - run: echo deploy ${{ secrets.K }}\n"),
    "D308": (f"name: x\njobs:\n  build:\n    steps:\n      - uses: actions/cache@{PIN}\n  out:\n    steps:\n      - run: npm publish\n", f"name: x\njobs:\n  build:\n    steps:\n      - run: make\n  out:\n    steps:\n      - uses: actions/cache@{PIN}\n      - run: npm publish\n"),
}
GITLAB = {
    "D319": ("one:\n  id_tokens:\n    A:\n      aud: x\n  script:\n    - echo\ntwo:\n  script:\n    - ./build.sh\n", "one:\n  script:\n    - echo\ntwo:\n  id_tokens:\n    A:\n      aud: x\n  script:\n    - ./build.sh\n"),
    "D320": ("one:\n  cache:\n    key: a\n  script:\n    - echo\ntwo:\n  only: [tags]\n  script:\n    - echo\n", "one:\n  script:\n    - echo\ntwo:\n  cache:\n    key: a\n  only: [tags]\n  script:\n    - echo\n"),
}


@pytest.mark.parametrize("rule, good, bad, path", [(r, *t, ".github/workflows/w.yml") for r, t in GITHUB.items()] + [(r, *t, ".gitlab-ci.yml") for r, t in GITLAB.items()])
def test_rules_are_judged_within_one_job(spark, rule, good, bad, path):
    df = spark.createDataFrame([(f"good/{path}", good), (f"bad/{path}", bad)], "path string, text string")
    hit = {r["path"].split("/")[0] for r in configscan.scan_config(df).where(F.col("rule_id") == f"SKY-{rule}").collect()}
    assert hit == {"bad"}


def test_settings_of_the_file_hold_for_its_jobs(spark):
    """Permissions of the file reach the jobs that have none of their own; an anchored job counts where it is used."""
    top = "name: x\npermissions:\n  id-token: write\njobs:\n  own:\n    permissions:\n      contents: read\n    steps:\n      - run: ./a.sh\n  none:\n    steps:\n      - run: ./b.sh\n"
    found = configscan.scan_config(spark.createDataFrame([(".github/workflows/w.yml", top)], "path string, text string")).where("rule_id = 'SKY-D310'").collect()
    assert [r["line"] for r in found] == [12]
