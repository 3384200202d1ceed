"""Facts kept between runs equal those of a full run, whatever is edited."""

import random

from millrace.session import release_staged
from millrace.sources.fact_store import compact, facts_of
from millrace.sources.files import from_texts
from millrace.sources.python_facts import extract


def _rows(facts):
    columns = [c for c in facts.columns if c != "run"]
    return sorted(str(r) for r in facts.select(*sorted(columns)).collect())


def test_runs_parse_what_changed(spark, tmp_path):
    rng, store = random.Random(3), str(tmp_path / "store")
    texts = {f"p/m{k}.py": f"def f{k}(x):\n    return x + {k}\n" for k in range(12)} | {"p/empty.py": "", "p/bad.py": "def (:", "p/copy.py": "def f1(x):\n    return x + 1\n"}
    seen = set()
    for step in range(3):
        files = from_texts(spark, texts)
        got = facts_of(files.unionByName(files.limit(2)), store)
        assert got.parsed == len(set(texts.items()) - seen)
        assert _rows(got.facts) == _rows(extract(files))
        seen |= set(texts.items())
        for path in rng.sample(sorted(texts), 3):
            texts[path] = rng.choice(["import os\n", "x = 1\n", texts[path] + "\n\ny = 2\n", f"class C{step}:\n    pass\n"])
        texts.pop(rng.choice(sorted(texts)))
        texts[f"p/new{step}.py"] = "import sys\n"
    again = facts_of(files, store)
    assert again.parsed == 0 and _rows(again.facts) == _rows(extract(files))
    # facts of a run that died before its keys were written are not read
    spark.read.parquet(store + "/facts").limit(5).selectExpr("* except (run)", "'0' as run").write.mode("append").partitionBy("cell").parquet(store + "/facts")
    assert _rows(facts_of(files, store).facts) == _rows(extract(files))
    compact(files, store, str(tmp_path / "small"))
    small = facts_of(files, str(tmp_path / "small"))
    assert small.parsed == 0 and _rows(small.facts) == _rows(extract(files))
    assert facts_of(files.limit(0), str(tmp_path / "none")).facts.count() == 0
    release_staged()
