"""The pipeline against brute force, stage by stage on what the stage before kept."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality
from millrace.llm.queries import MIX_WEIGHTS
from millrace.llm.words import split_words
from tests.llm.test_ops import brute_classes, brute_hits, brute_passages, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder with good and bad documents, copies, a shared passage and a benchmark passage."""
    rng = random.Random(11)
    line = lambda: words(12, rng).capitalize() + "."
    good = ["\n".join(line() for _ in range(rng.randint(2, 6))) for _ in range(120)]
    bad = ["\n".join(" | ".join(words(8, rng).upper().split()) + " !!!" for _ in range(4)) for _ in range(60)]
    passage, leak = "\n".join(line() for _ in range(8)), line() + " " + line()
    texts = good + bad + good[:5] + [f"{line()}\n{passage}\n{line()}" for _ in range(4)] + [f"{line()}\n{leak}" for _ in range(3)] + [None, ""]
    texts += [" ".join(["changed", *t.split()[1:]]) for t in good[5:8]]
    rows = [(k, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(k, 1, 0) for k in range(120)] + [(k, 0, 0) for k in range(120, 180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, words(30, rng))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, [(1, leak)], passage, leak


def test_stages(spark, folder):
    path, rows, items, passage, leak = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("predicted", F.lit("clash"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "decontamination", "mix"]
    at = dict(corpus_pipeline.STAGES)
    keep = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])

    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = model.scores(*quality.line_features([r[1] or "" for r in rows]))
    want = [(r[0], r[1]) for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    kept = at["quality"](spark, docs, path)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert keep(kept) == want and sum(120 <= k < 180 for k, _ in want) == 0 and all(any(k == g for k, _ in want) for g in range(120))

    classes = brute_classes(want)
    want = [r for k, r in enumerate(want) if not (r[1] or "").strip() or classes[k][0] == r[0]]
    kept = at["near_duplicates"](spark, kept, path)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and keep(kept) == want

    flags = brute_passages([t for _, t in want], corpus_pipeline.PASSAGE_WORDS)
    kept = at["repeats"](spark, kept, path)
    found = {r["doc_id"]: r for r in kept.collect()}
    left = [[w for w, gone in zip(*f, strict=True) if not gone] for f in flags]
    assert len(found) == len(want) and all(split_words(found[k]["text"]) == x and found[k]["n_chars"] == len(found[k]["text"]) for (k, _), x in zip(want, left, strict=True))
    assert sum(any(f) for _, f in flags) >= 4 and not any(passage in (r["text"] or "") for r in found.values())

    before = keep(kept)
    hits = brute_hits([t for _, t in before], items)
    kept = at["decontamination"](spark, kept, path)
    assert keep(kept) == [r for r, h in zip(before, hits, strict=True) if not h[4]] and sum(h[4] for h in hits) >= 1

    mixed = at["mix"](spark, kept, path).collect()
    size = Counter({k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in keep(kept)})
    assert {r["doc_id"]: r["size"] for r in mixed} == dict(size)
    assert sum(r["taken"] for r in mixed) <= 1.5 * sum(size.values()) and len(MIX_WEIGHTS) == 3


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, rows, *_ = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert 100 < len(got) < len(rows) and sum(r["taken"] for r in got) > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
