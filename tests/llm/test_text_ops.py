"""Periodic runs, fill-in-the-middle and sentence pieces: against brute force and the library, and their edge cases."""

import hashlib
import random
import re
import struct
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import infill, periodic, pieces, queries

MODEL = Path(queries.TOKENIZERS) / queries.PIECE_MODEL
DATA = Path("/root/testdata/sf0.001")
CLASHES = dict(runs=1, n_words="w", collapsed=2.0, n=3, form="f", prefix_chars=True, middle_chars=None, output="o", ids="i", decoded=b"d", _found=1, _made=2)
needs_model = pytest.mark.skipif(not MODEL.exists(), reason="needs the public tokenizers")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "\n\t ", "one", "a a a a a a", "a b a b a b a b", "x " * 5, "x " * 6, "<P>a b", "é ß 中文 😀 x", "trailing  ", "  leading", "a\x0bb\x0cc\rd", "<s> </s> <0x0A> ▁x", "\x00 a"]
    out += [" ".join(rng.choice("ab") for _ in range(n)) for n in range(1, 60)]
    out += [" ".join(rng.choice("abcdefgh") for _ in range(20000)), "word " * 5000, " " * 3000, "x" * 20000]
    out += ["".join(rng.choice(" \n▁aábc中😀.<S>M") for _ in range(rng.randrange(80))) for _ in range(200)]
    return [*out, out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 7 else None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def brute_runs(w):
    """Every period in turn: maximal stretches of words that equal the word one period later."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs(docs):
    found = periodic.find_runs(docs)
    assert set(docs.columns) == set(found.columns)
    rows = found.collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        w = split(r["text"])
        want = brute_runs(w) if len(w) < 2000 or len(set(w)) < 3 else [x for x in map(tuple, r["runs"]) if x in brute_near(w)]
        assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(w) and r["collapsed"] == brute_collapse(w, want)
    assert any(len(r["runs"]) > 1 for r in rows)
    assert periodic.find_runs(docs.where("false")).count() == 0


def brute_near(w):
    """Runs of short periods: all that random words have."""
    out = set()
    for q in range(1, 40):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return out


def test_runs_of_batches():
    """Batches of texts whose words are numbered together find the runs of each text alone."""
    rng = random.Random(5)
    for _ in range(150):
        batch = []
        for _ in range(rng.randrange(1, 20)):
            w = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(60))]
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
            batch.append([x.encode() for x in w])
        assert [sorted(r) for r in periodic._batch(batch)] == [brute_runs(w) for w in batch]


def test_z_function():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice("ab") for _ in range(rng.randrange(30))]
        want = [next((j for j in range(len(s) - k) if s[j] != s[k + j]), len(s) - k) for k in range(len(s))]
        assert periodic.z_function(s) == want


def test_long_repetition_is_whole():
    """A run as long as a very long text, and one that begins at its last words."""
    unit = [b"%d" % k for k in range(777)]
    assert list(periodic._batch([unit * 40, unit + [b"z"] * 6])) == [[(0, 777 * 40, 777)], [(777, 6, 1)]]


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def test_rearranged(docs):
    made = infill.rearrange(docs).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    assert set(made.columns) == set(docs.columns) | {"restored"}
    rows = made.collect()
    assert len(rows) == len(texts()) + 1 and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r["text"] or ""
        w = units(text)
        assert r["restored"] == text and r["n"] == len(w)
        x = hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
        parts = ["".join(w[:a]), "".join(w[a:b]), "".join(w[b:])]
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}", "spm": f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"}[form]
        assert (r["form"], r["output"]) == (form, want)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(parts[0]), len(parts[1])))
    assert infill.rearrange(docs.where("false")).count() == 0


def test_rearranged_by_characters(docs):
    rows = infill.rearrange(docs, unit="chars", seed=7, rate=100, spm_rate=0).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    assert all(r["restored"] == (r["text"] or "") and r["n"] == len(r["text"] or "") for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm"}
    with pytest.raises(ValueError, match="unit"):
        infill.rearrange(docs, unit="lines")


@pytest.mark.parametrize("unit", infill.UNITS)
def test_every_cut(unit):
    for text in [t for t in texts() if t and len(t) < 200]:
        w = units(text) if unit == "words" else list(text)
        runs = infill.ClassRuns.of(text, unit)
        assert runs.n == len(w)
        for k in range(len(w) + 1):
            head = "".join(w[:k])
            assert runs.cut(k) == (len(head.encode()), len(head))


@needs_model
def test_pieces(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    vocabulary = pieces.load(str(MODEL))
    coded = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    assert set(coded.columns) == set(docs.columns)
    rows = coded.collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    packed = pieces.decode(pieces.encode(docs, vocabulary, packed=True, marks=False, out="p"), vocabulary, ids="p", out="back").collect()
    for r in packed:
        want = library.encode(r["text"] or "")
        assert bytes(r["p"]) == struct.pack(f"<{len(want)}I", *want) and r["back"] == library.decode(want)
    assert pieces.encode(docs.where("false"), vocabulary).count() == 0


@needs_model
def test_pieces_of_any_text_and_any_ids():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    vocabulary = pieces.load(str(MODEL))
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    rng = random.Random(9)
    known = list(vocabulary.pieces)
    cases = ["".join(rng.choice(known) for _ in range(rng.randrange(1, 12))).replace("▁", " ") for _ in range(4000)]
    cases += [" " * k for k in range(80)] + ["x" + " " * k + "the" for k in range(60)] + ["a" * k for k in range(60)]
    uncut = pieces.Encoder(vocabulary)
    uncut.cuts = None
    for k, text in enumerate(cases):
        want = library.encode(text)
        packed = struct.pack(f"<{len(want)}I", *want)
        assert encoder.encode(text) == packed and (k % 10 or uncut.encode(text) == packed)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), rng.randrange(3)]) for _ in range(rng.randrange(9))]
        assert decoder.decode(ids) == library.decode(ids)


@needs_model
def test_models_that_are_refused(tmp_path):
    raw = MODEL.read_bytes()
    at = raw.rindex(b"identity")
    assert raw[at - 2 : at] == b"\x0a\x08"
    (tmp_path / "m.model").write_bytes(raw.replace(b"identity\x12\x00", b"ident\x12\x03abc"))
    with pytest.raises(ValueError, match="normalises"):
        pieces.load(str(tmp_path / "m.model"))


@needs_data
@needs_model
def test_op13(spark):
    """Against the library itself, on all documents."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    rows = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, str(DATA)).collect()}
    given = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    assert len(rows) == len(given)
    for k, text in given:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = rows[k]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
