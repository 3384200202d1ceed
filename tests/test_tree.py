"""The source tree reader: whole trees, git's view of them, and an analysis that needs files of any name."""

import hashlib
import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.sources import tree
from millrace.sources.files import source_files

needs_git = pytest.mark.skipif(shutil.which("git") is None, reason="compares with git")


def put(root, path, text="x = 1\n"):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_bytes(text if isinstance(text, bytes) else text.encode())


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


@pytest.mark.parametrize("names", ["pkg/__init__.py pkg/__main__.py pkg/_helpers.py pkg/_inner/deep.py pkg/core.py", "Dockerfile .github/workflows/ci.yml .gitlab-ci.yml x.service pyproject.toml AGENTS.md templates.html a.py"])
def test_whole_trees(spark, tmp_path, names):
    for name in names.split():
        put(tmp_path, name)
    assert paths(source_files(spark, str(tmp_path))) == sorted(names.split())
    assert paths(source_files(spark, f"file://{tmp_path}")) == sorted(names.split())


def test_contents(spark, tmp_path):
    put(tmp_path, "empty.py", "")
    put(tmp_path, "bin.dat", b"a\0b")
    put(tmp_path, "latin.txt", b"caf\xe9")
    put(tmp_path, "long.py", "# é\n" * 600_000)
    os.symlink(tmp_path / "long.py", tmp_path / "link.py")
    rows = {r["path"]: r for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["bin.dat", "empty.py", "latin.txt", "long.py"]
    assert rows["empty.py"]["text"] == "" and rows["bin.dat"]["text"] is None and rows["latin.txt"]["text"] == "caf�"
    assert len(rows["long.py"]["text"]) == 2_400_000 and rows["long.py"]["bytes"] == 3_000_000
    assert rows["bin.dat"]["sha256"] == hashlib.sha256(b"a\0b").hexdigest()
    assert tree.read_tree(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "none").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0
    assert paths(tree.read_tree(spark, str(tmp_path / "empty.py"))) == ["empty.py"]


def test_many_folders_and_roots(spark, tmp_path):
    """More folders than tasks, deeper than the driver lists; a file below two roots counts once."""
    want = [f"d{k}/e/f/g/h{k}/_x{k}.py" for k in range(600)] + [f"flat/{k}.py" for k in range(2500)]
    for name in want:
        put(tmp_path, name, "")
    assert paths(source_files(spark, str(tmp_path))) == sorted(want)
    assert source_files(spark, [str(tmp_path), str(tmp_path / "flat")]).count() == len(want)
    narrow = tree.read_tree(spark, str(tmp_path)).where(F.col("path").startswith("d7/"))
    assert paths(narrow) == ["d7/e/f/g/h7/_x7.py"]


def git(root, *args):
    return subprocess.run(["git", "-c", "core.excludesFile=/dev/null", "-c", "core.quotepath=off", "-C", str(root), *args], capture_output=True, text=True, check=True).stdout


def shown(root):
    return sorted(x for x in set(git(root, "ls-files", "-co", "--exclude-standard").splitlines()) if os.path.isfile(root / x) and not os.path.islink(root / x))


@needs_git
def test_gits_view(spark, tmp_path):
    """Random trees and ignore files: what git lists, in the index or not, below the top or not, in every version of the index."""
    rng = random.Random(4)
    names = ["a", "b", "_c", ".d", "log", "é"]
    lines = ["*.log", "!*.log", "/a", "b/", "!b/", "a/b", "**/log", "log/**", "a/**/b", "/*", "!/a/", "[ab]", "?", "_*", "# no", "", "!", "a/*.py", "!a.py", "\\#x", "é", "*.p[xy]"]
    for k in range(6):
        root = tmp_path / str(k)
        root.mkdir()
        git(root, "init", "-q")
        for _ in range(50):
            parts = [rng.choice(names) for _ in range(rng.randrange(4))]
            put(root, "/".join([*parts, rng.choice(names) + rng.choice([".py", ".log", ".txt"])]))
        for folder in ["", "a/", "a/b/", "log/"]:
            if not folder or (root / folder).is_dir():
                put(root, f"{folder}.gitignore", "\n".join(rng.choice(lines) for _ in range(4)) + "\n")
        if k % 2:
            put(root, ".git/info/exclude", rng.choice(lines) + "\n")
        git(root, "add", "-A")
        some = sorted(p for p in root.rglob("*.log") if ".git" not in p.parts)[:3]
        if some:
            git(root, "add", "-f", *map(str, some))
        for _ in range(15):
            put(root, "/".join([rng.choice(names), rng.choice(names), rng.choice(names) + ".log"]))
        git(root, "update-index", "--index-version", str(2 + k % 3))
        assert paths(tree.read_tree(spark, str(root))) == shown(root)
        below = root / "a"
        if below.is_dir():
            assert paths(tree.read_tree(spark, str(below))) == shown(below)
        tracked = set(git(root, "ls-files").splitlines())
        assert {r["path"] for r in tree.read_tree(spark, str(root)).where("tracked").collect()} == {p for p in shown(root) if p in tracked}


@needs_git
def test_choices(spark, tmp_path):
    for name in ["src/a.py", "node_modules/m/i.js", "node_modules/keep/k.js", "out/keep/o.js", "inner/x.py"]:
        put(tmp_path, name)
    put(tmp_path, ".gitignore", "out/\n")
    git(tmp_path, "init", "-q")
    git(tmp_path / "inner", "init", "-q")
    assert paths(source_files(spark, str(tmp_path))) == [".gitignore", "src/a.py"]
    assert paths(source_files(spark, str(tmp_path), include=["keep"])) == [".gitignore", "node_modules/keep/k.js", "out/keep/o.js", "src/a.py"]
    assert paths(source_files(spark, str(tmp_path), exclude=["s?c"], ignore="none")) == [".gitignore", "inner/x.py", "node_modules/keep/k.js", "node_modules/m/i.js", "out/keep/o.js"]


def test_written_trees(spark, tmp_path):
    rows = [("_a/.b", "x"), ("c", None), ("d/é.py", "ü\n")]
    assert tree.write_tree(spark.createDataFrame(rows, "path string, text string"), f"file://{tmp_path}/t") == 3
    assert sorted((r["path"], r["text"]) for r in tree.read_tree(spark, str(tmp_path / "t")).collect()) == [("_a/.b", "x"), ("c", ""), ("d/é.py", "ü\n")]
    with pytest.raises(Exception, match="not below the root"):
        tree.write_tree(spark.createDataFrame([("../x", "")], "path string, text string"), str(tmp_path / "t"))


def test_analysis_of_a_folder(spark, tmp_path):
    """Files that only their names tell: configuration is judged, entry points of the project keep their code alive."""
    put(tmp_path, "Dockerfile", "FROM python:3\nADD https://example.com/x.tar /x\n")
    put(tmp_path, ".github/workflows/ci.yml", "name: ci\non: pull_request\npermissions: write-all\njobs:\n  a:\n    runs-on: x\n    steps:\n      - uses: actions/checkout@main\n")
    put(tmp_path, "pyproject.toml", '[project]\nname = "pkg"\n[project.scripts]\npkg = "pkg.cli:main"\n')
    put(tmp_path, "pkg/__init__.py", "")
    put(tmp_path, "pkg/__main__.py", "from pkg._work import used\n\nif __name__ == '__main__':\n    used()\n")
    put(tmp_path, "pkg/_work.py", "def used():\n    return 1\n\n\ndef unused_helper():\n    return 2\n")
    put(tmp_path, "pkg/cli.py", "def main():\n    return 0\n")
    found = api.analyze_path(spark, str(tmp_path))
    rules = {(r["file"], r["rule_id"]) for r in found.findings.collect()}
    assert ("Dockerfile", "SKY-D342") in rules
    assert any(f == ".github/workflows/ci.yml" and r.startswith("SKY-D29") for f, r in rules)
    dead = {r["name"] for r in found.dead.where("decision = 'reported'").collect()}
    assert any(n.endswith("unused_helper") for n in dead) and not any(n.endswith(("used", "main")) and not n.endswith("unused") for n in dead)
