"""Code clones: fragments, blocked pairs, similarity classes and groups."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import components, k_core
from millrace.session import drop_staged, free_shuffles, small_batches, stage_table
from millrace.sources.frames import frames

#: Least lines and nodes of a fragment, similarities of the clone types, and the reporting threshold.
MIN_LINES, MIN_NODES = 8, 10
TYPE_THRESHOLDS = {"type1": 0.98, "type2": 0.95, "type3": 0.88}
REPORT_THRESHOLD = 0.90
BUCKET_DIGITS = 6
#: Grams that the first grams of two near texts share at least (if so many are needed in common); see ``PART``.
SHARED = 4
#: One in so many of the grams that near texts share must be among the first grams, if that is more.
PART = 4
#: Texts of the sample that tells frequent grams, and grams it tells at most.
ORDER_TEXTS, ORDER_GRAMS = 4_000, 50_000
#: Bits of a gram's hash that are dealt out: grams that fall together add pairs to compare, and lose none.
GRAM_BITS = (1 << 40) - 1
#: Texts of a block, of which a task holds two at once, and columns of their table of grams that are multiplied at once.
BLOCK, COLUMNS = 256, 1 << 13
#: Texts of a family with one gram that are held against other families' one by one.
FEW = 16
#: If more pairs of different families are left than this, each text's likeliest is compared first.
MANY_PAIRS = 200_000
#: Words from which blocks are told by runs of three words; places of such runs a word up to which they are looked up, not read off diagonals; runs at most.
LONG_TEXT, PLACES, RUNS = 150, 40, 1_000_000


def plain_text(source: str) -> str:
    """Source without comments, blank lines and indentation."""
    lines = (re.sub(r"\s+", " ", re.sub(r"#.*$", "", x)).strip() for x in source.splitlines())
    return "\n".join(x for x in lines if x)


class _Rename(ast.NodeTransformer):
    """Names to placeholders in order of appearance, constants to their type."""

    def __init__(self):
        self.names: dict[str, str] = {}

    def _slot(self, name: str) -> str:
        return self.names.setdefault(name, f"v{len(self.names)}")

    def visit_Name(self, node):
        return ast.copy_location(ast.Name(id=self._slot(node.id), ctx=node.ctx), node)

    def visit_arg(self, node):
        node.arg, node.annotation = self._slot(node.arg), None
        return node

    def visit_FunctionDef(self, node):
        node.name = "f"
        self.generic_visit(node)
        return node

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Constant(self, node):
        return ast.copy_location(ast.Constant(value=type(node.value).__name__), node)


def fragments_of(path: str, source: str) -> list[dict]:
    """Functions, methods and classes that are large enough, in three forms: text, renamed tree and shape."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        lines, nodes = node.end_lineno - node.lineno + 1, sum(1 for _ in ast.walk(node))
        if lines < MIN_LINES or nodes < MIN_NODES:
            continue
        text = ast.get_source_segment(source, node) or ""
        shape = " ".join(type(n).__name__ for n in ast.walk(node))
        renamed = ast.unparse(_Rename().visit(ast.parse(re.sub(r"^[ \t]+", "", text) if not text[:1].isspace() else text).body[0])) if _parses(text) else shape
        out.append({"file": path, "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "n_nodes": nodes, "text": plain_text(text), "renamed": renamed, "shape": shape})
    return out


def _parses(text: str) -> bool:
    try:
        return bool(ast.parse(text).body)
    except (SyntaxError, ValueError):
        return False


def extract_fragments(files: DataFrame) -> DataFrame:
    """Fragments of Python files (``path, text``), with ``frag_id`` from place and text."""
    schema = "file string, name string, start_line int, end_line int, n_nodes int, text string, renamed string, shape string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (tuple(r.values()) for p, t in zip(batch["path"], batch["text"], strict=True) for r in fragments_of(p, t or ""))
            yield from frames(rows, [c.split()[0] for c in schema.split(", ")])

    out = files.select("path", "text").mapInPandas(walk, schema)
    return out.withColumn("frag_id", F.concat_ws(":", "file", F.lpad(F.col("start_line").cast("string"), 7, "0")))


def places_of(a: str | list[str]) -> dict[str, int]:
    """Where each letter (or word) stands, as bits."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def common_length(n: int, places: dict[str, int], b: str | list[str]) -> int:
    """Length of the longest common subsequence of ``b`` and what has ``n`` letters at these places, by a vector of bits (Hyyrö, 2004)."""
    full = free = (1 << n) - 1
    for x in b:
        hit = free & places.get(x, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return n - free.bit_count()


def similarity(a: str | list[str], b: str | list[str], threshold: float) -> float:
    """difflib's ratio of texts (or word lists), 0 where lengths or the longest common subsequence, which no blocks exceed, rule the threshold out."""
    if a == b:
        return 1.0
    if not a or not b or 2 * min(len(a), len(b)) / (len(a) + len(b)) < threshold or 2.0 * common_length(len(a), places_of(a), b) / (len(a) + len(b)) < threshold:
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def matched_words(a: list[str], b: list[str]) -> int:
    """Words in difflib's matching blocks of ``a`` and ``b`` (no junk).

    Of long texts all common runs of three words or more are listed once; the longest one in a part of both texts (ties: first in ``a``, then
    in ``b``) is the longest of these as cut to the part.  Parts with no such run are left to difflib, whose choice depends on the part alone.
    """
    rest = lambda x, y: sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    if min(len(a), len(b)) < LONG_TEXT or len(a) + len(b) >= 1 << 21:
        return rest(a, b)
    codes = pd.factorize(np.array([*a, *b], dtype=object))[0].astype(np.int64)
    grams = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    x, y = grams[: len(a) - 2], grams[len(a) :]
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = high - low
    if n.sum() > PLACES * (len(a) + len(b)):  # few words, again and again: as many places as pairs of words, but few runs
        starts, shifts, lengths, count = [], [], [], 0
        for k in range(3 - len(a), len(b) - 2):
            low = max(0, -k)
            hit = x[low : len(b) - 2 - k] == y[low + k : low + k + len(x) - low]
            edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
            edge = np.concatenate([[0] if hit[0] else [], edge, [len(hit)] if hit[-1] else []]).astype(np.int64)
            starts.append(edge[::2] + low)
            lengths.append(edge[1::2] - edge[::2] + 2)
            shifts.append(np.full(len(edge) // 2, k))
            count += len(edge) // 2
            if count > RUNS:
                return rest(a, b)
        start, shift = np.concatenate(starts), np.concatenate(shifts)
        end = start + np.concatenate(lengths)
    else:
        i = np.repeat(np.arange(len(x)), n)
        j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i))]
        d = j - i
        at = np.lexsort((i, d))
        i, d = i[at], d[at]
        fresh = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])) if len(i) else np.empty(0, np.int64)
        start, shift = i[fresh], d[fresh]
        end = start + np.diff(np.append(fresh, len(i))) + 2
    total, parts = 0, [(0, len(a), 0, len(b), start, end, shift)]
    while parts:
        a0, a1, b0, b1, s, e, d = parts.pop()
        s, e = np.maximum(s, np.maximum(a0, b0 - d)), np.minimum(e, np.minimum(a1, b1 - d))
        long = e - s >= 3
        s, e, d = s[long], e[long], d[long]
        if len(s):
            k = int((e - s).max())
            best = np.flatnonzero(e - s == k)
            best = best[np.lexsort((d[best], s[best]))[0]]
            i, j = int(s[best]), int(s[best] + d[best])
            total += k
            parts += [x for x in ((a0, i, b0, j, s, e, d), (i + k, a1, j + k, b1, s, e, d)) if x[0] < x[1] and x[2] < x[3]]
        elif not set(a[a0:a1]).isdisjoint(b[b0:b1]):
            total += rest(a[a0:a1], b[b0:b1])
    return total


def exact_clones(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of rows with one normalised text: ``group, members, first``."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return docs.groupBy(F.md5(norm).alias("group")).agg(F.count("*").alias("members"), F.min(key).alias("first")).where("members > 1")


def bucket_keys(fragments: DataFrame) -> DataFrame:
    """``frag_id, bucket``: the fragment's digest prefixes in each of its three forms."""
    forms = F.array(*[F.concat(F.lit(f"{c}:"), F.substring(F.sha1(c), 1, BUCKET_DIGITS)) for c in ("text", "renamed", "shape")])
    return fragments.select("frag_id", F.explode(forms).alias("bucket"))


def clone_pairs(fragments: DataFrame, per_bucket: int | None = None, threshold: float = REPORT_THRESHOLD) -> DataFrame:
    """``a, b, similarity, clone_type`` of fragments that share a bucket; the first type that fits.

    ``per_bucket``: fragments of a bucket that are compared, in order of id; null, the default: all, exactly.
    """
    keys = bucket_keys(fragments).distinct()
    if per_bucket is not None:
        keys = keys.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy("frag_id"))).where(F.col("_n") <= per_bucket).drop("_n")
    pairs = keys.alias("x").join(keys.alias("y"), "bucket").where("x.frag_id < y.frag_id").select(F.col("x.frag_id").alias("a"), F.col("y.frag_id").alias("b")).distinct()
    f = fragments.select("frag_id", "text", "renamed", "shape")
    side = lambda s: f.select(*[F.col(c).alias(s if c == "frag_id" else f"{c}_{s}") for c in f.columns])
    full = pairs.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("struct<similarity:double,clone_type:string>")
    def judge(ta: pd.Series, tb: pd.Series, ra: pd.Series, rb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.DataFrame:
        out = []
        for forms in zip(zip(ta, tb, strict=True), zip(ra, rb, strict=True), zip(sa, sb, strict=True), strict=True):
            for (x, y), (kind, least) in zip(forms, TYPE_THRESHOLDS.items(), strict=True):
                ratio = similarity(x, y, least)
                if ratio >= least:
                    out.append((ratio, kind))
                    break
            else:
                out.append((0.0, None))
        return pd.DataFrame(out, columns=["similarity", "clone_type"])

    judged = full.withColumn("j", judge("text_a", "text_b", "renamed_a", "renamed_b", "shape_a", "shape_b"))
    return judged.select("a", "b", "j.similarity", "j.clone_type").where(F.col("clone_type").isNotNull() & (F.col("similarity") >= threshold))


def clone_groups(pairs: DataFrame, mode: str = "connected", k: int = 2) -> DataFrame:
    """Groups of fragments: connected components or the k-core's components, with size, mean similarity and most frequent type."""
    if mode == "k_core":
        core = k_core(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), k)
        pairs = pairs.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    comp = components(pairs, "a", "b")
    size = comp.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    inside = pairs.join(comp, pairs["a"] == comp["node"])
    mean = inside.groupBy("component").agg(F.avg("similarity").alias("similarity"))
    kinds = inside.groupBy("component", "clone_type").agg(F.count("*").alias("n"))
    best = kinds.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy(F.col("n").desc(), "clone_type"))).where("_n = 1").select("component", "clone_type")
    return size.join(mean, "component").join(best, "component").orderBy(F.col("size").desc(), F.col("similarity").desc(), "component")


def gram_length(threshold: float) -> int:
    """Words of a gram: as many, three at most, as leave texts of any length a gram in common (see :func:`least_shared`)."""
    return max(q for q in (1, 2, 3) if q == 1 or threshold / 2 > 2 * (q - 1) * (1 - threshold))


def least_shared(threshold: float) -> tuple[float, int]:
    """``per, less``: two different texts at the ratio ``threshold`` with ``s`` words together share ``per * s - less`` grams, and one, at least.

    At most ``(1 - threshold) * s`` words are outside of difflib's blocks, so there is at most one block more than that, and a block of m words
    has m - q + 1 grams.  Texts of so few words that none may differ are equal.
    """
    q = gram_length(threshold)
    return threshold / 2 - (q - 1) * (1 - threshold), q - 1


def prefix_share(threshold: float, n):
    """Of texts of ``n`` words (a column or an array): grams they share with any near text, and how many of those the first grams (in one order) must show.

    All but the last ``T - k`` grams hold k of any T shared ones; of two texts the lesser k counts.
    """
    per, less = least_shared(threshold)
    f = F if isinstance(n, Column) else None
    most = lambda x, y: F.greatest(x, y) if f else np.maximum(x, y)
    one, few = (F.lit(1).cast("long"), F.lit(SHARED).cast("long")) if f else (1, SHARED)
    whole = lambda x, up: (F.ceil(x) if up else F.floor(x)) if f else (np.ceil(x) if up else np.floor(x)).astype(np.int64)
    needed = most(one, whole(n * (per * 2 / (2 - threshold)) - (less + 1e-6), True))
    shown = most(F.least(few, needed) if f else np.minimum(few, needed), whole(needed / PART, False))
    return needed, shown


def word_grams(texts: list[list[str]], q: int) -> list[np.ndarray]:
    """Runs of ``q`` words of every text as 64-bit hashes; a gram's second, third ... occurrence in a text has hashes of its own."""
    codes, known = pd.factorize(np.array([w for words in texts for w in words], dtype=object))
    hashes = pd.util.hash_array(known, categorize=False)[codes] if len(codes) else np.empty(0, np.uint64)
    out, at = [], 0
    for words in texts:
        x = hashes[at : at + len(words)]
        h = x[: max(0, len(x) - q + 1)]
        for k in range(1, q):
            h = h * np.uint64(0x100000001B3) + x[k : k + len(h)]
        h = np.sort(h)
        fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        nth = np.arange(len(h)) - np.repeat(fresh, np.diff(np.append(fresh, len(h))))
        x = h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(29)))
        at += len(words)
    return out


def _word_classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``id, cls`` of every row with a text, and the texts of different words: ``cls, first, last, rows, n, t`` (ids, rows, words, text)."""
    small_batches(docs.sparkSession)

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [t.split() for t in batch["t"]]
            names = [int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for w in words]
            yield pd.DataFrame({"id": batch["id"], "cls": names, "n": [len(w) for w in words], "t": batch["t"]})

    rows = docs.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("id"), F.col(text).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = stage_table(rows.mapInPandas(classed, f"id {kind}, cls long, n long, t string"), "near-texts", compression="zstd")
    members = stage_table(rows.select("id", "cls"), "near-members")
    one = [F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("t").alias("t")]
    texts = stage_table(rows.groupBy("cls").agg(*one), "near-classes", compression="zstd")
    drop_staged(rows)
    return members, texts


def _gram_lists(texts: DataFrame, threshold: float) -> DataFrame:
    """``gram, cls, n, lead``: the first grams of every text (rare ones first) that are first grams of other texts too; ``lead``: one of the gram's texts (``cls, n``).

    Of two texts at the ratio ``threshold`` these share what :func:`prefix_share` says (prefix filter); a text with too few of them is near no other and left out.
    """
    q = gram_length(threshold)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = word_grams([t.split() for t in batch["t"]], q)
            if found:
                used, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"gram": used.view(np.int64), "c": n})

    # any one order is right, the counts only make it fast: those of the most frequent grams of a sample do
    part = max(1, texts.count() // ORDER_TEXTS)
    counts = texts.where(F.pmod("cls", F.lit(part)) == 0).select("t").mapInPandas(counted, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where("c > 2")
    counts = sorted((r["gram"] % (1 << 64), r["c"]) for r in counts.orderBy(F.col("c").desc(), "gram").limit(ORDER_GRAMS).collect())
    hot, count = np.array([w for w, _ in counts] or [0], dtype=np.uint64), np.array([c for _, c in counts] or [0], dtype=np.int64)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [np.empty(0, np.int64)]
            # the shortest text that can be near has the fewest grams in common
            needed, shown = prefix_share(threshold, batch["n"].to_numpy(np.int64))
            for left, x in zip(needed - shown, word_grams([t.split() for t in batch["t"]], q), strict=True):
                first = len(x) - int(left)
                at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
                keys.append(x[np.lexsort((x, np.where(hot[at] == x, count[at], 0)))][: max(0, first)].view(np.int64) & GRAM_BITS)
            sizes = [len(x) for x in keys[1:]]
            yield pd.DataFrame({"gram": np.concatenate(keys), "cls": np.repeat(batch["cls"].to_numpy(np.int64), sizes), "n": np.repeat(batch["n"].to_numpy(np.int64), sizes)})

    found = texts.select("cls", "n", "t").mapInPandas(prefixes, "gram long, cls long, n long")
    by, own = Window.partitionBy("gram"), Window.partitionBy("cls")
    found = stage_table(found.withColumn("_m", F.count("*").over(by)).where("_m > 1").drop("_m"), "near-first", compression="zstd")
    least = prefix_share(threshold, F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-6))[1]
    enough = found.withColumn("_c", F.count("*").over(own)).where(F.col("_c") >= least).drop("_c")
    enough = enough.withColumns({"_m": F.count("*").over(by), "lead": F.min(F.struct("cls", "n")).over(by)})
    out = stage_table(enough.where("_m > 1").drop("_m"), "near-grams", compression="zstd")
    drop_staged(found)
    return out


def _ordered() -> list[Column]:
    """``p, q, n_p, n_q`` of ``cls, n, other, m``."""
    swap = F.col("cls") < F.col("other")
    return [F.least("cls", "other").alias("p"), F.greatest("cls", "other").alias("q"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("n_p"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n_q")]


def _shared(met: DataFrame, threshold: float) -> DataFrame:
    """``p, q, shared`` of the pairs ``p, q, n_p, n_q`` (one row a gram in common) that share enough and are of like size."""
    fit = met.where(2 * F.least("n_p", "n_q") >= threshold * (F.col("n_p") + F.col("n_q")) - 1e-6)
    needed = prefix_share(threshold, F.col("n"))[1]
    return fit.groupBy("p", "q").agg(F.count("*").alias("shared"), F.first(F.least("n_p", "n_q")).alias("n")).where(F.col("shared") >= needed).drop("n")


def _ratios(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``p, q, pq, qp`` of pairs of classes, staged: difflib's ratios both ways, 0 where below the threshold or no ids are in that order."""
    wanted = pairs.select(F.col("p").alias("cls")).union(pairs.select("q")).distinct()
    asked = stage_table(texts.join(wanted, "cls", "left_semi"), "near-asked", compression="zstd")
    side = lambda s: asked.select(F.col("cls").alias(s), F.col("first").alias(f"first_{s}"), F.col("last").alias(f"last_{s}"), F.col("t").alias(f"t_{s}"))
    full = pairs.select("p", "q").join(side("p"), "p").join(side("q"), "q")

    @F.pandas_udf("struct<pq:double,qp:double>")
    def ratios(p: pd.Series, q: pd.Series, forth: pd.Series, back: pd.Series) -> pd.DataFrame:
        out, held, y, places = [], None, [], {}
        for x, last, f, b in zip(p, q, forth, back, strict=True):
            if last != held:  # rows come by q
                held, y = last, last.split()
                places = places_of(y)
            x = x.split()
            fits = 2 * min(len(x), len(y)) >= threshold * (len(x) + len(y)) - 1e-6 and 2.0 * common_length(len(y), places, x) / (len(x) + len(y)) >= threshold
            there = SequenceMatcher(None, x, y, autojunk=False).ratio() if f and fits else 0.0
            out.append((there, SequenceMatcher(None, y, x, autojunk=False).ratio() if b and fits else 0.0))
        return pd.DataFrame(out, columns=["pq", "qp"])

    # the ratio depends on which text comes first: that with the smaller id, and classes of several rows may have both orders
    forth, back = F.coalesce(F.col("first_p") < F.col("last_q"), F.lit(True)), F.coalesce(F.col("first_q") < F.col("last_p"), F.lit(True))
    judged = stage_table(full.select("p", "q", ratios("t_p", "t_q", forth, back).alias("r")).select("p", "q", "r.pq", "r.qp"), "near-ratios")
    drop_staged(asked)
    return judged


def near_texts(docs: DataFrame, key: str, text: str, threshold: float = REPORT_THRESHOLD) -> DataFrame:
    """All pairs ``a < b`` of texts whose words are at least ``threshold`` alike, with ``similarity`` (difflib's ratio of a's words to b's).

    Texts with the same words form a class, compared once.  A ratio of t needs so many grams in common that of all grams in one order (rare ones first)
    the first of each text must share ``SHARED`` (prefix filter); every pair that does is compared.  Nothing is capped or sampled: the result grows with the
    square of a group of near copies, see :func:`near_classes`.  Classes are named by 64-bit hashes of their words.
    """
    members, texts = _word_classes(docs, key, text)
    members = members.where("id is not null").distinct()
    lists = _gram_lists(texts, threshold)
    met = lists.alias("x").join(lists.alias("y"), "gram").where("x.cls < y.cls")
    pairs = stage_table(_shared(met.select(F.col("x.cls").alias("p"), F.col("y.cls").alias("q"), F.col("x.n").alias("n_p"), F.col("y.n").alias("n_q")), threshold), "near-pairs")
    judged = _ratios(pairs, texts, threshold).where((F.col("pq") >= threshold) | (F.col("qp") >= threshold))
    drop_staged(lists, pairs, texts)
    a, b = members.select(F.col("id").alias("a"), F.col("cls").alias("p")), members.select(F.col("id").alias("b"), F.col("cls").alias("q"))
    across = judged.join(a, "p").join(b, "q").where("a <> b")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("pq")).otherwise(F.col("qp")).alias("similarity"))
    same = a.join(b, F.col("p") == F.col("q")).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.where(F.col("similarity") >= threshold).unionByName(same)


def _unit_links(texts: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links among ``(side, cls, g, first, last, free, t)`` of one unit: of texts of different sides, or both of side 2, that no link or ``g`` connects yet."""
    q, (per, less) = gram_length(threshold), least_shared(threshold)
    texts = sorted(texts, key=lambda x: (x[0], x[1]))
    words = [x[6].split() for x in texts]
    n = np.array([len(w) for w in words])
    side = np.array([x[0] for x in texts])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    grams = word_grams(words, q)
    codes, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)[1:]
    of = np.repeat(np.arange(len(words)), [len(x) for x in grams])
    of, codes = of[counts[codes] > 1], codes[counts[codes] > 1]
    codes = np.unique(codes, return_inverse=True)[1]
    by = np.argsort(codes, kind="stable")
    of, codes = of[by], codes[by]
    shared = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(codes[-1]) + 1 if len(codes) else 0, COLUMNS):
        lo, hi = np.searchsorted(codes, [k, k + COLUMNS])
        held = np.zeros((len(words), COLUMNS), np.float32)
        held[of[lo:hi], codes[lo:hi] - k] = 1
        shared += held[left] @ held[right].T
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i, row in zip(left, shared, strict=True):
        total = n[i] + n[right]
        fits = (row >= np.maximum(1, np.ceil(per * total - less - 1e-6))) & (2 * np.minimum(n[i], n[right]) >= threshold * total - 1e-6)
        fits &= (right > i) if side[i] == 2 else (right != i)
        places = None
        for at in np.flatnonzero(fits)[np.argsort(-row[fits], kind="stable")]:
            j = right[at]
            (_, p, g, first_p, last_p, free_p, _), (_, r, h, first_r, last_r, free_r, _) = texts[i], texts[j]
            if p == r or find(g) == find(h):
                continue
            x, y = words[i], words[j]
            places = places or places_of(x)
            whole = len(x) + len(y)
            if 2.0 * common_length(len(x), places, y) / whole < threshold:
                continue
            # the ratio depends on which text comes first: that with the smaller id, and classes of several rows may have both orders
            forth, back = free_p or free_r or first_p < last_r, free_p or free_r or first_r < last_p
            if forth and 2.0 * matched_words(x, y) / whole >= threshold or back and 2.0 * matched_words(y, x) / whole >= threshold:
                root[find(g)] = find(h)
                links.append((p, r))
    return links


def _links(asked: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``src, dst``, staged: links that the units ``unit, side, cls, g`` hold; texts of a unit are compared in one task, which holds one unit at once.  Each text goes to a unit once, not once a pair."""
    # ids without nulls keep their type in pandas; ``free``: no row has an id
    ids = [F.coalesce(c, F.lit("0").cast(texts.schema[c].dataType)).alias(c) for c in ("first", "last")]
    full = asked.join(texts.select("cls", *ids, F.col("first").isNull().alias("free"), "t"), "cls").select("unit", "side", "cls", "g", "first", "last", "free", "t")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> Iterator[pd.DataFrame]:
            if len(held) > 1:
                links = _unit_links(held, threshold)
                yield pd.DataFrame({"src": [x for x, _ in links], "dst": [x for _, x in links]}, dtype=np.int64)

        for batch in batches:
            for unit, *text in zip(*(batch[c] for c in ("unit", "side", "cls", "g", "first", "last", "free", "t")), strict=True):
                if unit != now:
                    yield from done()
                    now, held = unit, []
                held.append(tuple(text))
        yield from done()

    # a number, as a few MB of texts may take long
    rows = full.repartition(4 * int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")
    return stage_table(rows.mapInPandas(compare, "src long, dst long"), "near-links")


def _stars(pairs: DataFrame) -> DataFrame:
    """``unit, side, cls`` of pairs ``p, q``: each p (side 0) with at most some ``BLOCK`` of its q (side 1) a unit."""
    sizes = pairs.groupBy("p").agg(F.count("*").alias("c"))
    units = pairs.join(sizes, "p").withColumn("unit", F.xxhash64("p", F.pmod(F.xxhash64("q"), F.ceil(F.col("c") / BLOCK))))
    side = lambda k, c: units.select("unit", F.lit(k).alias("side"), F.col(c).alias("cls")).distinct()
    return side(0, "p").unionByName(side(1, "q"))


def _family_units(families: DataFrame) -> DataFrame:
    """``unit, side, cls, g`` of ``cls, f, g``: all pairs of blocks of a family ``f`` that hold different classes ``g``.

    A large class has blocks of its own, which are not held against each other; small ones share blocks.
    """
    sizes = families.groupBy("f", "g").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("f").agg(F.count("*").alias("classes"), F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("small")).where("classes > 1")
    large = F.col("c") >= BLOCK
    dealt = families.join(sizes.join(open_, "f"), ["f", "g"]).withColumn("own", F.when(large, F.col("g")))
    dealt = dealt.withColumn("b", F.xxhash64("f", F.when(large, F.col("g")).otherwise(0), large, F.pmod(F.xxhash64(F.when(large, F.col("cls")).otherwise(F.col("g"))), F.ceil(F.when(large, F.col("c")).otherwise(F.col("small")) / BLOCK))))
    dealt = stage_table(dealt.select("cls", "f", "g", "b", "own"), "near-dealt")
    blocks = dealt.select("f", "b", "own").distinct()
    pairs = blocks.join(blocks.select("f", F.col("b").alias("b2"), F.col("own").alias("own2")), "f").where("b <= b2 and coalesce(own <> own2, true)")
    pairs = pairs.withColumn("unit", F.xxhash64("b", "b2"))
    same = F.col("b") == F.col("b2")
    sides = pairs.select("unit", "b", F.when(same, 2).otherwise(0).alias("side")).unionByName(pairs.where(~same).select("unit", F.col("b2").alias("b"), F.lit(1).alias("side")))
    out = dealt.join(sides, "b").select("unit", "side", "cls", "g")
    out.reads = dealt  # for drop_staged
    return out


def near_classes(docs: DataFrame, key: str, text: str, threshold: float = REPORT_THRESHOLD) -> DataFrame:
    """Every row's ``id, class_id, class_size, copies``: what the pairs of :func:`near_texts` connect is a class, named by its smallest id; ``copies``: rows of the same words.

    Each text is first compared with the one that most of its grams have as their lead; these pairs, near or not, make families.  Within a family
    blocks of texts of different classes meet, each block as a whole in one task, where shared grams, then the longest common subsequence rule pairs out;
    texts of different families that share enough grams are compared pair by pair.  What is left out lies within one class already.
    Rows without a text are classes of their own; a row without id may stand before or behind every other.
    """
    free_shuffles(docs.sparkSession)
    members, texts = _word_classes(docs, key, text)
    lists = _gram_lists(texts, threshold)
    asked = stage_table(texts.join(lists.select("cls").distinct(), "cls", "left_semi"), "near-asked", compression="zstd")
    known = stage_table(texts.select("cls", "first", "rows"), "near-known")
    drop_staged(texts)
    ends = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))

    led = lists.where("cls <> lead.cls").select("cls", "n", F.col("lead.cls").alias("other"), F.col("lead.n").alias("m"))
    one = stage_table(_shared(led.select(*_ordered()), threshold).groupBy("q").agg(F.max_by("p", F.struct("shared", "p")).alias("p")), "near-pairs")
    links = _links(_stars(one).withColumn("g", F.col("cls")), asked, threshold)
    groups, kin = components(links), components(ends(one, "p", "q"))
    grouped = groups.select(F.col("node").alias("cls"), F.col("component").alias("g"))
    families = kin.select(F.col("node").alias("cls"), F.col("component").alias("f")).join(grouped, "cls", "left").select("cls", "f", F.coalesce("g", "cls").alias("g"))
    families = stage_table(families, "near-families")
    units = _family_units(families)
    more = _links(units, asked, threshold)
    drop_staged(one, groups.reads, kin.reads, units.reads)

    gram = Window.partitionBy("gram")
    apart = lists.select("gram", "cls", "n").join(families.select("cls", "f"), "cls", "left").withColumn("f", F.coalesce("f", "cls"))
    many = F.count("*").over(Window.partitionBy("gram", "f")) > FEW
    apart = apart.withColumns({"_lo": F.min("f").over(gram), "_hi": F.max("f").over(gram)}).where("_lo < _hi").drop("_lo", "_hi").withColumn("many", many)
    apart = stage_table(apart, "near-apart", compression="zstd")
    # a gram's few texts of a family meet the others' one by one; many go by family, so that they never meet each other
    few = apart.where("not many").select("gram", "f", "cls", "n")
    other = few.select("gram", F.col("f").alias("h"), F.col("cls").alias("other"), F.col("n").alias("m"))
    met = few.join(other, "gram").where("f < h").select(*_ordered())
    others = apart.select("gram", F.col("f").alias("h"), F.col("many").alias("h_many")).distinct()
    kinds = apart.where("many").select("gram", "f").distinct().join(others, "gram").where("f < h or f > h and not h_many").drop("h_many")
    other = apart.select("gram", F.col("f").alias("h"), F.col("cls").alias("other"), F.col("n").alias("m"))
    met = met.unionByName(apart.select("gram", "f", "cls", "n").join(kinds, ["gram", "f"]).join(other, ["gram", "h"]).select(*_ordered()))
    rest = stage_table(_shared(met, threshold), "near-pairs")
    spent, found = [lists, asked, known, families, apart, rest, links, more], links.unionByName(more)
    while True:
        many = rest.count() > MANY_PAIRS and not spent[8:]
        now = rest.groupBy("q").agg(F.max_by("p", F.struct("shared", "p")).alias("p")) if many else rest
        links = _links(_stars(now.select("p", "q")).withColumn("g", F.col("cls")), asked, threshold)
        found = found.unionByName(links)
        spent.append(links)
        if not many:
            break
        groups = components(found)
        side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"g_{c}"))
        rest = rest.join(side("p"), "p", "left").join(side("q"), "q", "left").where(F.coalesce("g_p", "p") != F.coalesce("g_q", "q"))
        rest = stage_table(rest.select("p", "q", "shared"), "near-pairs")
        spent += [rest, groups.reads]
    classes = components(found)
    one = known.join(classes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("g", F.coalesce("component", "cls")).drop("component")
    sized = one.groupBy("g").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_size"))
    named = stage_table(one.join(sized, "g").select("cls", "class_id", "class_size", F.col("rows").alias("copies")), "near-named")
    drop_staged(*spent, classes.reads)
    none = docs.where(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0).select(F.col(key).alias("id"), F.col(key).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(1).cast("long").alias("copies"))
    return members.join(named, "cls").select("id", "class_id", "class_size", "copies").unionByName(none)


def digest(text: str) -> str:
    return hashlib.sha1(text.encode("utf-8", "replace")).hexdigest()
