"""The driver's contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


def test_works_without_the_llm_folders(tmp_path):
    for name in ("millrace", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "millrace" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'directory_rollup' in q and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_queries_match_their_sql(spark):
    """Some of the first module's queries, and all of the labelled corpus and of the second module."""
    import duckdb

    from millrace.plans import bridge, labelled, more
    from millrace.session import release_staged

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    wrong = []
    for name in ["finding_filter", "directory_rollup", "severity_grade", "debt_hotspots", "merge_ranges", "narrowest_enclosing", "reachable", "kcore", "transitive_dead", "gate_reasons", "debt_baseline_status", "provenance_stats", "watch_new_resolved", "cycles_scc", "simple_cycles", "scanner_comparison", "diff_overlap_semi", "injection_scan", "base64_blobs", "homoglyphs", *labelled.QUERIES, *more.QUERIES]:
        queries, oracles = bridge.QUERIES | labelled.QUERIES | more.QUERIES, bridge.ORACLES | labelled.ORACLES | more.ORACLES
        got = queries[name](spark, str(DATA))
        want = db.sql(oracles[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        rows = sorted((repr([norm(r[c]) for c in cols]) for r in got.collect()))
        other = sorted(repr([norm(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
        if rows != other:
            wrong.append(name)
        release_staged()
    assert wrong == []
