"""Operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, htmltext, jaccard, mixing, quality, suffix, urlfilter, vectors, warc
from millrace.llm.queries import MIX_WEIGHTS, URL_RULES
from millrace.llm.words import split_words
from millrace.session import release_staged, stage_path, staged_paths

RNG = random.Random(7)
VOCABULARY = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "Sé") for b in ("ra", "ne", "si", "vo", "xu", "ß")]
CLASHES = dict(score=1.5, predicted=9, size=3, target="t", taken=1, source_size=2, content=b"c", key="k", spans="s", docs=1, values=b"v", id=4, grams="g", n_words=5, n_hit=6, held_out=True, raw=b"r", kept="k", tx=1, doc=2, cell=3, k=4)


def words(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """doc_id, text, source: ordinary, repeated, near copies, nulls, empties, short, long and periodic texts."""
    base, passage = words(120), words(90)
    near = base.split()
    near[60] = "changed"
    out = [(1, base, "a"), (2, base, "b"), (3, " ".join(near), "a"), (4, None, "b"), (5, "", None), (6, "", "a"), (7, "one", "a"), (8, "one", "b"), (9, "x" * 3000, "c"), (10, "!!! ... ---", "c")]
    out += [(11, f"{words(30)} {passage} {words(20)}", "a"), (12, f"{words(5)} {passage}", None), (13, f"{passage} {words(40)}", "b"), (14, words(20000), "a"), (14, words(15), "a"), (15, words(15), "c"), (15, None, "c")]
    out += [(16, "ab " * 900, "a"), (17, "\n".join(words(8) for _ in range(30)), "b"), (18, "\n\n\n", "b"), (None, words(30), "a"), (20, f"{passage}\n{passage}", "a")]
    out += [(100 + k, words(RNG.randrange(1, 60)), RNG.choice("abcd")) for k in range(60)]
    return [*out, out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(row):
    return tuple((x is None, str(x)) for x in row)


# 1 ----------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, empty):
    good = [(k, "\n".join(words(12).capitalize() + "." for _ in range(4)), 1) for k in range(200)]
    bad = [(k, "\n".join(" | ".join(words(6).upper().split()) + " !!!" for _ in range(4)), 0) for k in range(200, 400)]
    table = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    found = {r["doc_id"]: r for r in quality.score(table, model).withColumn("h", quality.held_out(F.col("doc_id"))).collect()}
    held = [x for x in good + bad if found[x[0]]["h"]]
    assert held and all(zlib.crc32(str(x[0]).encode()) % 3 == 1 for x in held)
    assert np.mean([found[x[0]]["predicted"] == x[2] for x in held]) > 0.95
    scored = quality.score(docs, model).select("doc_id", "score", "predicted").collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert quality.score(empty, model).count() == 0
    neutral = quality.train(empty, labels)
    assert {r["score"] for r in quality.score(docs, neutral).collect()} == {0.5}


def test_quality_is_fitted_to_whole_texts(spark):
    good = "\n".join("Some words of plain prose that end here." for _ in range(250))
    bad = good + "\n" + "\n".join("BUY | NOW | !!!" for _ in range(250))
    texts = [(k, t, y) for k, (t, y) in enumerate([(good, 1), (bad, 0)] * 6) if zlib.crc32(str(k).encode()) % 3 != 1]
    model = quality.train(spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in texts], "doc_id long, quality int"))
    parts = sorted((quality.line_features([t])[0].astype("<f4").tobytes(), y) for _, t, y in texts)
    x = [np.frombuffer(p, dtype="<f4").reshape(-1, quality.WIDTH) for p, _ in parts]
    whole = quality.fit(np.vstack(x).astype(float), np.array([len(p) for p in x]), np.array([y for _, y in parts]))
    assert np.allclose(model.weights, whole.weights) and np.allclose(model.moves, whole.moves)


def test_crf_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(1)
    chain = quality.Chain(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    counts = np.array([4, 1, 3])
    x = rng.normal(size=(8, quality.WIDTH)) / 5
    got, pairs = chain.marginals(x, counts)
    u, start = x @ chain.weights, 0
    for s, n in enumerate(counts):
        total, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            p = np.exp(sum(u[start + k] for k in range(n) if y[k]) + sum(chain.moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            good += p * np.array(y)
            for k in range(n - 1):
                both[y[k], y[k + 1]] += p
        assert np.allclose(got[start : start + n], good / total)
        assert np.allclose(pairs[s], both / total)
        start += n


# 2 ----------------------------------------------------------------------------------------------


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for verdict, at, below in URL_RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(below) and (best is None or len(at + below) > len(best[0])):
            best = (at + below, verdict)
    return host, path, best


def test_urls(spark):
    urls = ["http://a.ORG/x", "https://www.example.org/es/7?q", "http://example.org/en/1234", "http://example.org/en/2", "http://example.org", "http://q.com/fr/1#f", "http://q.com/de/", "http://notorg/x", "http://xexample.org/es/1", None, "", "no scheme", "://", "a://b://c/d", "http://backlinkspam.example.net/x", "http://pokerstar-slots.example.com/en/3", "http://adult-x.example.net/", "http://lakeside-hotels.example.net/en/5", "HTTP://É.Org/ü", "http://h\nost.org/a\nb?c"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit("x"), "action": F.lit(2)})
    got = sorted(urlfilter.filter_urls(df, URL_RULES).collect(), key=lambda r: r["page_id"])
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, best = judge(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0] if best else None)
        assert r["verdict"] == (best[1] if best else ("block" if r["score"] >= 0.5 else "allow"))
    by = {urls[r["page_id"]]: r["verdict"] for r in got}
    assert [by[u] for u in urls[14:18]] == ["block", "block", "block", "allow"]
    assert urlfilter.filter_urls(df.where("false"), URL_RULES).count() == 0


def test_url_model_learns_its_table_and_generalises():
    w, b = urlfilter.train(urlfilter.LABELLED_URLS)
    p = lambda u: w[urlfilter.grams(*urlfilter._cut(u))].sum() / np.sqrt(len(urlfilter.grams(*urlfilter._cut(u)))) + b
    assert np.mean([(p(u) >= 0) == y for u, y in urlfilter.LABELLED_URLS]) >= 0.97
    # names of which no word is in the table
    known = set(f"{urlfilter.BLOCKED_WORDS} {urlfilter.ORDINARY_WORDS}".split())
    bad = "onlinecasinos bettings jackpotcity lotteryland bannerads adtracking trackers phishkit crackedgames freeprizes torrentz spambots malwares".split()
    good = "gardening universities poets weatherstation museums bakeries mathforum lakehotels historians languages concerts gardenersworld cityhall rivers".split()
    assert not known & {*bad, *good}
    assert [p(f"{x}.org/") >= 0 for x in bad + good] == [True] * len(bad) + [False] * len(good)
    held = urlfilter.LABELLED_URLS[::4]
    w, b = urlfilter.train([x for k, x in enumerate(urlfilter.LABELLED_URLS) if k % 4])
    assert np.mean([(p(u) >= 0) == y for u, y in held]) >= 0.75


# 3 ----------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    return {k: (min((rows[m][0] for m in ms if rows[m][0] is not None), default=None), links[k], len(ms)) for ms in members.values() for k in ms}


def test_jaccard(docs, rows, empty):
    got = jaccard.join_similar(docs).select("doc_id", "class_id", "n_links", "class_size").collect()
    want = brute_classes(rows)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *want[k]) for k, r in enumerate(rows)), key=key)
    assert jaccard.join_similar(empty).count() == 0


def test_jaccard_large_family_and_stragglers(spark, monkeypatch):
    """A family of near copies in many small blocks, next to texts that share a band with it now and then."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
    rng = random.Random(3)
    base = words(80, rng).split()
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(80), rng.randrange(0, 5)):
            w[at] = f"w{k}{at}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, words(30, rng)) for k in range(20)]
    got = jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links", "class_size").collect()
    want = brute_classes(rows)
    assert sorted(map(tuple, got)) == sorted((r[0], *want[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("edits, block", [(2, 4), (12, 4), (30, 8)])
def test_jaccard_distances_settle_large_families(spark, monkeypatch, edits, block):
    """Near copies at all distances from the leader, copies of texts among them: counts are those of brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(edits)
    base = words(150, rng).split()
    rows = []
    for k in range(70):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(0, edits)):
            w[at] = f"w{at}{rng.randrange(2)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rng.choice(rows)[1]) for k in range(20)]
    got = jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links", "class_size").collect()
    want = brute_classes(rows)
    assert sorted(map(tuple, got)) == sorted((r[0], *want[k]) for k, r in enumerate(rows))


def test_jaccard_null_and_repeated_ids(spark):
    """Near texts whose ids are null or the same: every link counts, one text of a class is kept."""
    rng = random.Random(5)
    rows = []
    for ids in ([None, None, None], [None, 7, None], [8, 8, 8], [9, 9, None], [None, None]):
        base = words(90, rng).split()
        for k, i in enumerate(ids):
            rows.append((i, " ".join([*base[: 20 * k], f"n{k}", *base[20 * k + 1 :]])))
    rows += [rows[0], (None, words(40, rng)), (8, words(40, rng))]
    got = jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    links = got.select("doc_id", "class_id", "n_links", "class_size").collect()
    want = brute_classes(rows)
    assert sorted(map(tuple, links), key=key) == sorted(((r[0], *want[k]) for k, r in enumerate(rows)), key=key)
    assert got.where("keeper").select("doc_id", "tx").distinct().count() == 7  # one text of each of the five groups and two single texts


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))]
    for _ in range(200):
        keep = sets[0][rng.random(len(sets[0])) < 0.92]
        sets.append(np.union1d(keep, rng.integers(0, 1 << 63, 30).astype(np.uint64)))
    v = jaccard.minhash(sets)
    ok = jaccard.survivors(np.broadcast_to(v[0], (200, jaccard.VALUES)), v[1:])
    true = np.array([len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets[1:]])
    assert ok[true >= 0.8].all()
    other = jaccard.minhash([np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(50)])
    assert not jaccard.survivors(np.broadcast_to(v[0], (50, jaccard.VALUES)), other).any()
    assert [jaccard.least_matches(n) for n in (9, 63)] == sorted(jaccard.least_matches(n) for n in (9, 63))


# 4 ----------------------------------------------------------------------------------------------


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, MIX_WEIGHTS).collect()
    again = mixing.mix(docs.repartition(7), MIX_WEIGHTS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    total = sum(per.values())
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    weight = {s: MIX_WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # water filling, source by source
        left = 1.5 * total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * per[s]}
        target |= {s: 2.0 * per[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == per[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    largest = {s: max(size(t) for _, t, x in rows if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in names)
    assert sum(taken.values()) <= 1.5 * total
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, size(r[1])) for r in rows)
    assert mixing.mix(empty, MIX_WEIGHTS).count() == 0


def test_mixing_goes_on_until_the_budget_is_used(spark):
    """A document much larger than its source's target finishes late; what is cut is what plain fair queueing cuts."""
    rng = random.Random(3)
    sizes = [(k, f"s{k % 59:02}", rng.randint(20, 120)) for k in range(590)]
    sizes.append((999, "z", sum(n for _, _, n in sizes) // 3))
    df = spark.createDataFrame([(k, "w " * n, s) for k, s, n in sizes], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df, MIX_WEIGHTS).collect()}
    target = {r["source"]: r["target"] for r in got.values()}
    per, cum = Counter(), {}
    for k, s, n in sorted(sizes, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        per[s] += n
        cum[k] = per[s]
    finish = sorted((cum[k] + r * per[s], target[s], n, k) for k, s, n in sizes for r in (0, 1))
    finish = sorted(((c / t, n, k) for c, t, n, k in finish))
    budget, run, taken = sum(per.values()) * 150 // 100, 0, Counter()
    for f, n, k in finish:
        run += n
        if run > budget:
            break
        taken[k] += n
    assert finish[0][0] < 4 < max(f for f, _, k in finish) and {k: r["taken"] for k, r in got.items()} == {k: taken[k] for k in got}


def test_mixing_of_nothing(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string"), MIX_WEIGHTS).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2


# 5 ----------------------------------------------------------------------------------------------


def brute_repeats(texts, length=suffix.LENGTH):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0 if len(t) else np.zeros(0, dtype=bool)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) > 0).sum())
        rest = bytes(np.frombuffer(t, dtype=np.uint8)[~gone]) if len(t) else b""
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def test_suffix(docs, rows, empty):
    got = suffix.remove_repeats(docs)
    want = brute_repeats([(r[1] or "").encode() for r in rows])
    figures = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, figures), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
    assert any(w[1] for w in want) and "score" in got.columns
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_hot_groups_are_cut_finer(spark, monkeypatch):
    """One passage in many texts with other neighbours, at group sizes that force every round."""
    monkeypatch.setattr(suffix, "GROUP_ROWS", 4)
    monkeypatch.setattr(suffix, "SHARD_STARTS", 300)
    rng = random.Random(5)
    passage = words(85, rng)
    rows = [(k, f"{words(rng.randrange(3, 30), rng)} {passage[rng.randrange(0, 60):]} {words(rng.randrange(3, 30), rng)}") for k in range(40)]
    rows += [(50, "é" * 700), (51, "aß" * 500), (52, "aß" * 300 + words(90, rng))]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    want = brute_repeats([r[1].encode() for r in rows])
    assert sorted(map(tuple, got)) == sorted((r[0], *w) for r, w in zip(rows, want, strict=True))


def brute_passages(texts, size):
    """Per text the flags of words (``split_words``) that a run of ``size`` words covers which starts anywhere else too."""
    cut = [split_words(t) for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in cut for k in range(len(w) - size + 1))
    out = []
    for w in cut:
        flags = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                flags[k : k + size] = [True] * size
        out.append((w, flags))
    return out


def test_suffix_by_words(spark, docs, rows, empty, monkeypatch):
    """Runs of words: other case and punctuation, both edges, and passages shorter in bytes than 400."""
    monkeypatch.setattr(suffix, "GROUP_ROWS", 8)
    rng = random.Random(8)
    passage = words(51, rng).split()
    odd = [" ".join(passage), words(9, rng) + " " + ", ".join(passage).upper() + "!", " ".join(passage[1:]) + ". " + words(5, rng), " ".join(passage[:49]), "ä ö\nü " * 60, None, "", " .,; "]
    odd += [f"{words(rng.randrange(3, 30), rng)} {' '.join(passage[rng.randrange(0, 30):])}" for _ in range(30)]
    texts = odd + [r[1] for r in rows]
    got = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=50, by_words=True, passage_words=20)
    found = {r["doc_id"]: r for r in got.collect()}
    long, short = brute_passages(texts, 50), brute_passages(texts, 20)
    assert len(found) == len(texts) and any(len(w) > sum(f) > 0 for w, f in long)
    for k, ((w, flags), (_, fewer)) in enumerate(zip(long, short, strict=True)):
        assert split_words(found[k]["text"]) == [x for x, gone in zip(w, flags, strict=True) if not gone], k
        assert found[k]["n_passage_words"] == sum(fewer)
        assert found[k]["n_removed"] == found[k]["n_bytes"] - len(found[k]["text"].encode())
    assert len(" ".join(passage)) < 400 and found[0]["text"] == "" and found[3]["n_removed"] == 0
    assert suffix.remove_repeats(empty, length=50, by_words=True, passage_words=50).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(docs, length=8, by_words=True)


def test_operators_leave_no_tables_behind(spark, docs):
    """What an operator stages is deleted, but for what its result reads; the rest goes on release."""
    release_staged()
    assert suffix.remove_repeats(docs, passage_words=50).count() and len(staged_paths()) == 2
    jaccard.join_similar(docs).count()
    assert len(staged_paths()) == 2 + 2
    paths = [Path(p.removeprefix("file://")) for p in staged_paths()]
    assert all(p.exists() for p in paths)
    release_staged()
    assert not any(p.exists() for p in paths) and not staged_paths()


ALONE = """
import pickle, sys
import pandas as pd
functions, frames = pickle.load(open(sys.argv[1], "rb"))
assert "millrace" not in sys.modules
for f, frame in zip(functions, frames):
    print(sum(len(x) for x in f(iter([frame]))))
"""


def test_functions_travel_by_value(tmp_path):
    """Executors without the package run what is sent to them."""
    text = words(80)
    texts = pd.DataFrame({"doc_id": [1, 2], "tx": [1, 2], "text": [text, text + " more"]})
    sketched = next(jaccard._sketch(iter([texts])))
    raw = pd.DataFrame({"doc": [1, 2], "tx": [1, 2], "raw": [text.encode(), text.encode()]})
    values = pd.DataFrame({"id": [1, 2], "values": sketched["values"]})
    pairs = pd.DataFrame({"a": [1], "b": [2], "va": sketched["values"][:1], "vb": sketched["values"][1:].reset_index(drop=True)})
    bucket = pd.DataFrame({"bucket": [1, 1], "i": 0, "j": 0, "block": 0, "id": [1, 2], "values": sketched["values"]})
    family = pd.DataFrame({"family": [1, 1], "i": 0, "j": 0, "block": 0, "id": [1, 2], "docs": 1, "values": sketched["values"], "grams": [s.astype("<u8").tobytes() for s in jaccard.shingle_sets(list(texts["text"]))]})
    calls = [(jaccard._sketch, texts), (jaccard._bands, values), (jaccard._pruned, pairs), (jaccard._within_buckets, bucket), (jaccard._families, family), (suffix._fragments(suffix.Unit(400, False)), raw), (suffix._fragments(suffix.Unit(50, True)), raw)]
    rows = pd.DataFrame({"key": [1, 2], "vec_id": [1, 2], "v": [[1, 2], [3, 4]], "q": 0})
    met = pd.concat([next(vectors._pack_cells(iter([rows]))), vectors._pack_queries(rows)], axis=1)
    far = pd.DataFrame({"rank": [0, 1], "id": [1, 2], "grams": family["grams"]})
    calls += [(vectors._pack_cells, rows), (vectors._scan(1), met), (jaccard._distances, far), (jaccard._gram_bytes, texts.assign(id=[1, 2]))]
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(tuple(zip(*calls, strict=True))))
    done = subprocess.run([sys.executable, "-c", ALONE, str(tmp_path / "sent")], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0 and min(map(int, done.stdout.split())) > 0, done.stderr


def test_two_stage_sort_against_plain_sort():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.choice([1, 2, 5, 8])
        letters = rng.choice([b"ab", b"abc\x00\xff", b"a"])
        starts = [rng.randint(1, 30) for _ in range(rng.randint(1, 6))]
        stride = rng.choice([1, 1, 2, 3])
        texts = [bytes(rng.choice(letters) for _ in range((k - 1) * stride + n)) for k in starts]
        owner, offset, same = suffix.sort_suffixes(texts, starts, n, stride)
        got = [texts[a][b * stride : b * stride + n] for a, b in zip(owner, offset, strict=True)]
        assert got == sorted(t[k * stride : k * stride + n] for t, s in zip(texts, starts, strict=True) for k in range(s))
        assert len(set(zip(owner.tolist(), offset.tolist(), strict=True))) == sum(starts)
        assert same.tolist() == [False] + [x == y for x, y in zip(got, got[1:], strict=False)]


def test_anchors_are_the_leftmost_minima():
    rng = random.Random(4)
    window = suffix.LENGTH - suffix.GRAM + 1
    for _ in range(40):
        h = np.array([rng.randint(0, 5) for _ in range(rng.randint(window, 1200))], dtype=np.uint64)
        cut = sorted({0, len(h), *(rng.randint(0, len(h)) for _ in range(rng.randint(0, 2)))})
        limits = np.array(list(zip(cut, cut[1:], strict=False)))
        got = [(s, a) for a, lo, hi in zip(*suffix.anchored(h, limits, window), strict=True) for s in range(lo, hi + 1)]
        assert got == [(s, s + int(h[s : s + window].argmin())) for lo, hi in limits for s in range(lo, hi - window + 1)]


# 6 ----------------------------------------------------------------------------------------------


def test_warc(spark):
    import base64

    pages = [(3, "http://a/1", "<p>é</p>"), (1, "http://a/2", "<p>é</p>"), (2, None, ""), (5, "u", None), (7, "x\r\ny", "z" * 100000), (7, "x", "z" * 100000), (9, "q", "solo"), (None, "n", "solo"), (1, "http://a/2", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "row": F.lit(2), "payload": F.lit("p")})
    path = stage_path(spark, "t")
    warc.write_archive(df, path)
    got = warc.read_records(spark, path).collect()
    body = lambda h: (h or "").encode()
    assert len(got) == len(pages) and Counter(bytes(r["payload"]) for r in got) == Counter(body(p[2]) for p in pages)
    for r in got:
        head, payload = r["header"].encode(), bytes(r["payload"])
        revisit = b"\r\nWARC-Type: revisit\r\n" in head
        assert bytes(r["record"]) == head + (b"" if revisit else payload) + b"\r\n\r\n"
        assert f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}\r\n" in r["header"]
        assert f"Content-Length: {0 if revisit else len(payload)}\r\n" in r["header"] and "\r\n\r\n" in r["header"]
    types = Counter((bytes(r["payload"]), "revisit" if "\r\nWARC-Type: revisit" in r["header"] else "response") for r in got)
    assert all(types[b, "response"] == 1 and types[b, "revisit"] == n - 1 for b, n in Counter(body(p[2]) for p in pages).items())
    assert warc.read_payloads(spark, path).count() == len({body(p[2]) for p in pages})
    lead = {bytes(r["payload"]): r["header"] for r in got if "WARC-Type: response" in r["header"]}
    assert "urn:page:1>" in lead["<p>é</p>".encode()] and "urn:page:9>" in lead[b"solo"]
    again = stage_path(spark, "t")
    warc.write_archive(df, again, min_revisit_bytes=5)
    assert sum("WARC-Type: revisit" in r["header"] for r in warc.read_records(spark, again).collect()) == 3
    none = stage_path(spark, "t")
    warc.write_archive(df.where("false"), none)
    assert warc.read_records(spark, none).count() == 0


def test_warc_checks_what_it_rebuilds(spark):
    pages = [("a", "u", "<p>é</p>"), ("row-1", "u", "<p>é</p>"), (None, None, "x"), ("b", "v", None)]
    path = stage_path(spark, "t")
    warc.write_archive(spark.createDataFrame(pages, "page_id string, url string, html string"), path)
    whole = {r["header"]: r for r in warc.read_records(spark, path).collect()}
    got = warc.check_records(spark, path).withColumns({"page": warc.page_of("WARC-Record-ID"), "to": warc.page_of("WARC-Refers-To")}).collect()
    assert sorted((r["page"], r["to"]) for r in got if r["page"]) == [("a", None), ("b", None), ("row-1", "a")] and len(got) == 4
    assert all((r["payload_bytes"], r["record_bytes"]) == (len(whole[r["header"]]["payload"]), len(whole[r["header"]]["record"])) for r in got)
    other = stage_path(spark, "t")
    warc.read_headers(spark, path).withColumn("header", F.replace("header", F.lit("Content-Length: 1"), F.lit("Content-Length: 2"))).write.parquet(f"{other}/records")
    warc.read_payloads(spark, path).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="record is not what its header says"):
        warc.check_records(spark, other).collect()


def test_warc_notices_damage(spark):
    path = stage_path(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    bad = warc.read_payloads(spark, path).withColumn("payload", F.lit(b"abd"))
    other = stage_path(spark, "t")
    bad.write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="payload is not what its digest says"):
        warc.read_payloads(spark, other).collect()


# 7 ----------------------------------------------------------------------------------------------


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (4, 0, "user", "solo"), (5, 0, "user", "solo"), (5, 0, "user", "solo"), (6, 0, None, None), (6, 1, "user", "<|im_end|>"), (7, 0, "user", ""), (8, 0, "user", "hi"), (8, 1, "assistant", "no"), (None, 0, "user", "null id"), (9, None, "user", "hi"), (9, 1, "assistant", "yo")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(9), "h1": F.lit("x"), "last": F.lit(True)})
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 6, 7, 8, None}
    assert got[2]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and got[2]["n_turns"] == 3
    assert got[6]["text"] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n< |im_end| ><|im_end|>\n"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_against_brute_force(spark):
    rng = random.Random(6)
    convs = {}
    for k in range(80):
        convs[k] = list(rng.choice(list(convs.values())))[: rng.randint(1, 4)] if convs and rng.random() < 0.6 else []
        convs[k] += [rng.choice("abc") for _ in range(rng.randint(0 if convs[k] else 1, 3))]
    rows = [(k, t, "user", x) for k, c in convs.items() for t, x in enumerate(c)]
    got = {r["conv_id"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {k for k, c in convs.items() if not any((len(d) > len(c) and d[: len(c)] == c) or (d == c and j < k) for j, d in convs.items())}
    assert got == want


# 8 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("<nav>x</nav>", ""), ("<!-- never closed <p>x</p>", ""), ("<script>var a = '<p>no</p>'", ""),
        ("<article><p>short</p></article><div>" + "x " * 60 + "</div>", ("x " * 60).strip()),
        ("<article><h1>Teaser</h1></article><p>" + "prose " * 150 + "</p><footer>f</footer>", "Teaser\n" + ("prose " * 150).strip()),
        ("<nav>n n n</nav><article><p>" + "a b " * 20 + "</p></article><div>also here</div>", ("a b " * 20).strip()),
        ("<nav>n</nav><article><p>one two three</p></article><div class='ad'>buy now</div><article><p>four five six</p></article><footer>f</footer>", "one two three\nfour five six"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>a b &amp; c&nbsp;d<!-- x --> e</p><aside>side <p>note</p></aside><p>f <span class=\"ad-banner\">buy</span> g</p><div class='comments'><p>hi</p></div></article>", "Title\na b & c d e\nf g"),
        ('<div class="content"><p>one two three four five</p><div class="ad"><ul><li><a>b</a></li></ul></div><p>six seven</p></div><footer>x</footer>', "one two three four five\nsix seven"),
        ('<article>x<script>if(a<b){document.write("<p>no</p>")}</script>y<form>f</form></article>', "xy"),
        ("<article><ul><li>a</li><li>b</li></ul><table><tr><td>c</td><td>d</td></tr></table></article>", "a\nb\nc\nd"),
        ("<article><p>x &#233; &eacute; &lt;b&gt; &unknown; &amp</p></article>", "x é é <b> &unknown; &"),
        ("<body><article><h1>T</h1><p>" + "long " * 50000 + "</p></article></body>", "T\n" + ("long " * 50000).strip()),
        ('<body class="has-sidebar ad"><div class="page with-sidebar"><p>one two three</p><div class="sidebar">no</div><p>four five</p></div></body>', "one two three\nfour five"),
        ('<body><div><a href="/">Home</a> <a href="/b">Back</a></div><div><h2>Owls</h2><p>They fly without a sound and hear a mouse under snow.</p><p>Most hunt at night.</p></div><div><a href="/i">Imprint</a> <a href="/l">Legal</a></div></body>', "Owls\nThey fly without a sound and hear a mouse under snow.\nMost hunt at night."),
        ('<table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table><table><tr><td><p>Cork is the bark of an oak that is peeled every nine years.</p></td></tr></table>', "Cork is the bark of an oak that is peeled every nine years."),
        ('<article><h2 id="related-work">Related work</h2><section id="social-impact"><p id="notice-period">kept</p></section><p aria-label="Share of water">share</p><a title="the hidden cost">cost</a><div class="share-buttons">no</div><div id="cookie-banner">no</div></article>', "Related work\nkept\nshare\ncost"),
        ("<article><p hidden>no</p><p>yes</p><p style='display:none'>no</p>\n<b>bold</b>ly</article>", "yes\nboldly"),
    ],
)
def test_html(page, text):
    assert htmltext.main_text(page, htmltext.learn_weights(htmltext.LABELLED_PAGES)) == text


def test_html_labelled_pages_and_table(spark):
    weights = htmltext.learn_weights(htmltext.LABELLED_PAGES)
    for page, blocks in htmltext.LABELLED_PAGES:
        assert htmltext.main_text(page, weights).split("\n") == blocks
    # the scan, not the rules of markup alone, finds the region of pages that mark nothing
    whole = htmltext.best_region
    try:
        htmltext.best_region = lambda found, weights: (0, len(found))
        assert sum(htmltext.main_text(page, weights).split("\n") != blocks for page, blocks in htmltext.LABELLED_PAGES) >= 5
    finally:
        htmltext.best_region = whole
    df = spark.createDataFrame([(1, "u", "<article>é</article>"), (1, "u", "<article>é</article>"), (2, None, None)], "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    assert htmltext.extract(df.where("false")).count() == 0


def test_html_depth():
    """Time is linear in the depth of markup, closed or not, and in tags that close nothing."""
    weights = htmltext.learn_weights(htmltext.LABELLED_PAGES)
    for n in (20000, 200000):
        page = "<div>" * n + "</b>x" * n + "<p>" * n + "</div>" * n
        start = time.perf_counter()
        text = htmltext.main_text(page, weights)
        assert text.count("x") == n and time.perf_counter() - start < n / 2000


def test_best_region_is_the_best_of_all():
    rng = random.Random(8)
    weights = {"text": 1.0, "stray": -0.5, "p": -0.3, "div": -1.5, f"{htmltext.INNER}:p": -0.1}
    for _ in range(100):
        found = [(rng.choice(["text", "stray", "skip", "p", "div", "b"]), "w " * rng.randint(1, 3), False) for _ in range(rng.randint(0, 12))]
        found = [(k, r if k in ("text", "stray", "skip") else "", i) for k, r, i in found]
        score = lambda a, b: sum(0 if k == "skip" else weights.get(k, htmltext.UNSEEN) * (len(r.split()) if r else 1) for k, r, _ in found[a:b])  # noqa: E731, B023
        best = max((score(a, b) for a in range(len(found) + 1) for b in range(a, len(found) + 1)), default=0)
        assert score(*htmltext.best_region(found, weights)) == pytest.approx(max(best, 0))


# 9 ----------------------------------------------------------------------------------------------


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(400)]
    rows += [(1000, [0.1] * 8), (1001, [0.1] * 8), (1002, None), (1003, [None] * 8), (1004, [float("nan")] * 8), (1005, [float("inf")] * 8), (1006, []), (1007, [0.5, 0.5]), (1001, [0.1] * 8), (None, [0.2] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "q": F.lit(2), "score": F.lit("s"), "ids": F.lit(3)})
    got = vectors.top_k(df, F.col("vec_id") % 100 == 0).collect()
    fine = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in {i: v for i, v in fine if i % 100 == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i))[:10]  # noqa: B905
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert vectors.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = vectors.top_k(df.where("vec_id in (100, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert len(few) == 2


def test_topk_beyond_float64(spark):
    big = float(1 << 30)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0]), (3, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = vectors.top_k(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, (1 << 50) + (1 << 21)), (1, (1 << 50) + (1 << 20)), (3, (1 << 50) + (1 << 19))]


# 10 ---------------------------------------------------------------------------------------------


def brute_hits(texts, items, window=13):
    fold = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for item, t in items:
        w = fold(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for t in texts:
        w, hit, found = fold(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        found = {str(x) for x in found if x is not None}
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def brute_longest(text, items, window=13):
    """Words and start of the longest run of words that an item has too, of at least a window (or a whole shorter item)."""
    w, best = split_words((text or "").encode().decode()), (0, 0)
    for _, t in items:
        v = split_words(t)
        n = min(window, len(v))
        for a in range(len(w)):
            for b in range(len(v)):
                if not (a and b and w[a - 1] == v[b - 1]):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    if k >= n:
                        best = max(best, (k, -a))
    return best[0], -best[1] if best[0] else None


@pytest.mark.parametrize("chars, shard, passes", [(1_000_000, 2_000_000, 8), (200, 40, 8), (100, 40, 2)])
def test_decontamination(spark, docs, rows, empty, monkeypatch, chars, shard, passes):
    monkeypatch.setattr(decontaminate, "PASSES", passes)
    monkeypatch.setattr(decontaminate, "BENCHMARK_CHARS", chars)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rng = random.Random(1)
    w = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, w(rows[0][1], 10, 40).upper()), (2, w(rows[10][1], 0, 13)), (10, w(rows[10][1], 5, 17)), (3, "one"), (4, ""), (5, None), (6, words(40, rng)), (7, w(rows[13][1], 19000, 19013)), (7, w(rows[13][1], 19000, 19013)), (None, "one"), (8, rows[12][1]), (9, words(2, rng)), (None, w(rows[13][1], 500, 530))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.find_contamination(docs, bench).select("doc_id", *names).collect()
    want = brute_hits([r[1] for r in rows], items)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *x) for r, x in zip(rows, want, strict=True)), key=key)
    assert any(x[4] for x in want)
    some = [r for r in rows if len(r[1] or "") < 2000]
    longest = decontaminate.find_contamination(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 2000), bench).select("doc_id", "longest_match", "longest_start").collect()
    assert sorted(map(tuple, longest), key=key) == sorted(((r[0], *brute_longest(r[1], items)) for r in some), key=key) and max(r[1] for r in longest) > 13
    assert decontaminate.find_contamination(empty, bench).count() == 0
    clean = decontaminate.find_contamination(docs, bench.where("false"), keep_text=False).collect()
    assert len(clean) == len(rows) and not any(r["n_hit"] or r["contaminated"] for r in clean) and "text" not in clean[0].asDict()


def test_locations(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BENCHMARK_CHARS", 120)
    rng = random.Random(12)
    item, other = words(30, rng), words(14, rng)
    docs = spark.createDataFrame([(1, f"{words(5, rng)} {''.join(c.upper() if c.isascii() else c for c in item)}. {words(3, rng)}"), (2, " ".join(item.split()[3:20]) + " gap " + other), (3, None), (4, words(40, rng))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.locate(docs, bench).collect())
    assert got == [(1, "1", 5, 30), (2, "1", 0, 17), (2, "2", 18, 14)]


def test_longest_matches():
    w = decontaminate.Windows([("a", "p q r s t"), ("b", "x y z")], window=3)
    number = {tuple(k): j for j, k in enumerate(w.keys)}
    at = lambda text, p: (number[tuple(w.ids[t.encode()] for t in text.split())], p)
    assert w.longest([at("x y z", 2), at("p q r", 9), at("q r s", 10), at("r s t", 30)]) == (4, 9)
    assert w.longest([at("x y z", 7), at("p q r", 1)]) == (3, 1)
