"""Benchmark decontamination with suffix arrays over the training documents.

Each Arrow batch of documents is a shard.  Its words become numbers, 0 for words that no
benchmark window has; a suffix that cannot begin a window is left out of the array at
once, by its first two words and the length of its run of benchmark words.  The rest is
sorted, and every benchmark window is looked up by binary search, which gives all its places; windows that
follow each other both in the document and in an item make up the longest verbatim matches.  No document crosses the network.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import split_words
from millrace.session import drop_staged, stage_table

#: Words of a window.
WINDOW = 13
#: Characters of benchmark text that go to the tasks at once; a larger benchmark takes several narrow passes.
BENCHMARK_CHARS = 1_000_000
#: Blocks of the benchmark in one plan; the hits of more are written, group by group.
PASSES = 8
#: Words of documents in one shard.
SHARD_WORDS = 500_000


class Windows:
    """A block of the benchmark: its words as numbers and its distinct windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        spots: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for row, (_, text) in enumerate(items):
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in split_words(text)]
            n = min(window, len(words))
            for start in range(len(words) - n + 1) if words else ():
                spots[tuple(words[start : start + n])].append((row, start))
        self.window, self.keys = window, sorted(spots)
        #: By window: where it stands (row of the block, first word), and the ids of the items.
        self.spots = [spots[k] for k in self.keys]
        self.items = [sorted({items[row][0] for row, _ in found if items[row][0] is not None}) for found in self.spots]
        self.lengths = np.array([len(k) for k in self.keys], dtype=np.int64)
        padded = np.zeros((len(self.keys), window), dtype=">u4")
        for row, key in enumerate(self.keys):
            padded[row, : len(key)] = key
        self.padded = padded
        # shortest window by first word, and first two words of windows
        self.least = np.full(len(self.ids) + 1, np.iinfo(np.int64).max)
        for key in self.keys:
            self.least[key[0]] = min(self.least[key[0]], len(key))
        width = np.int64(len(self.ids) + 1)
        self.pairs = np.unique(np.array([k[0] * width + k[1] for k in self.keys if len(k) > 1], dtype=np.int64))
        self.single = np.unique(np.array([k[0] for k in self.keys if len(k) == 1], dtype=np.int64))

    def suffix_array(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted suffixes of ``text`` that may begin a window: positions, and their words up to a window's length.

        ``ends``: for every position the end of its document.
        """
        n = len(text)
        if not n or not self.keys:
            return np.empty(0, np.int64), np.empty((0, self.window), ">u4")
        stops = np.where(text == 0, np.arange(n), n)
        stops = np.minimum(np.minimum.accumulate(stops[::-1])[::-1], ends)
        run = stops - np.arange(n)
        after = np.append(text[1:], 0)
        pair = text * np.int64(len(self.ids) + 1) + after
        near = np.searchsorted(self.pairs, pair)
        begins = np.zeros(n, dtype=bool)
        if len(self.pairs):
            begins |= (self.pairs[np.minimum(near, len(self.pairs) - 1)] == pair) & (run > 1)
        if len(self.single):
            begins |= np.isin(text, self.single)
        at = np.flatnonzero(begins & (run >= self.least[text]))
        spread = at[:, None] + np.arange(self.window)
        words = np.where(spread < stops[at][:, None], text[np.minimum(spread, n - 1)], 0).astype(">u4")
        order = np.argsort(_keys(words), kind="stable") if len(at) else at
        return at[order], words[order]

    def places(self, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and positions of all places where windows stand, by binary search for every window."""
        if not len(at) or not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sorted_keys = _keys(words)
        top = self.padded.copy()
        top[np.arange(self.window) >= self.lengths[:, None]] = 0xFFFFFFFF
        lo = np.searchsorted(sorted_keys, _keys(self.padded), side="left")
        hi = np.searchsorted(sorted_keys, _keys(top), side="right")
        number = np.repeat(np.arange(len(self.keys)), hi - lo)
        offset = np.arange(len(number)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        return number, at[np.repeat(lo, hi - lo) + offset]

    def longest(self, found: list[tuple[int, int]]) -> tuple[int, int]:
        """Words and start of the longest verbatim match, from all ``(window, place)`` of a document; the first of equals.

        Windows that follow each other in the document and in one item extend each other, past any window's length.
        """
        lines: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for w, p in found:
            for row, start in self.spots[w]:
                lines[row, p - start].append((p, len(self.keys[w])))
        best = (0, 0)
        for line in lines.values():
            first = end = -1
            for p, n in sorted(line):
                if p > end - n + 1 or first < 0:
                    first = p
                end = p + n
                best = max(best, (end - first, -first))
        return best[0], -best[1]


def _keys(words: np.ndarray) -> np.ndarray:
    """Rows of big-endian words as byte strings, which sort as the rows do.

    Trailing zero bytes do not count in numpy's byte strings; the order stays that of the rows.
    """
    return np.ascontiguousarray(words).view(f"S{4 * words.shape[1]}").ravel()


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[Windows]:
    """The benchmark in blocks of at most ``BENCHMARK_CHARS`` (or one item), read by the driver one after the other."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(r[1] or "") > BENCHMARK_CHARS:
            yield Windows(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
    yield Windows(rows)


#: Working columns: hit words, items, words, and the longest match (its words and its start).
WORK = {"_hits": "array<long>", "_items": "array<string>", "_words": "long", "_longest": "array<long>"}
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start")


def _passes(work: DataFrame, blocks: list[Windows], keep_text: bool) -> tuple[DataFrame, list]:
    """Carry hits through one pass a block; the last leaves the texts behind.  The broadcasts come too, to be destroyed."""
    sent = [work.sparkSession.sparkContext.broadcast(cloudpickle.dumps(block)) for block in blocks]
    for k, block in enumerate(sent):
        schema = work.schema if k + 1 < len(sent) or keep_text else work.drop("text").schema
        work = work.mapInArrow(_Pass(block, schema.names), schema)
    return work, sent


def find_contamination(docs: DataFrame, benchmark: DataFrame, least_share: int = 20, keep_text: bool = True) -> DataFrame:
    """Match every document against every benchmark item.

    Adds to ``docs`` (``doc_id``, ``text`` and any others) ``n_words, n_hit, n_items, items_sha256,
    contaminated, longest_match, longest_start``; columns of the input with these names are replaced.  A window is 13
    consecutive words of an item, or all words of a shorter one; a word within any
    place of a window is hit; ``n_items`` counts the items with windows in the document;
    ``contaminated``: some word is hit and ``least_share * n_hit >= n_words``; ``longest_match`` and ``longest_start``: words of
    the longest verbatim match with an item and the word it starts at (0 and null if nothing is hit).  Null and empty texts
    have no words and are never contaminated; items without words have no
    windows; items without id hit words but are not counted; repeated items count once; an empty benchmark hits nothing.

    The benchmark is read in blocks of a fixed size, each one narrow pass over the
    documents, which carries the hits so far along; nothing is shuffled.  Beyond ``PASSES`` blocks
    the hits of each group of blocks are written to the shared folder and its broadcasts are
    destroyed, so that neither plan nor memory grows with the benchmark; hits are then joined to the documents
    at the end.  Without ``keep_text`` the texts are left behind.
    """
    empty = {name: (F.lit(0) if kind == "long" else F.array()).cast(kind) for name, kind in WORK.items()}
    blocks = _benchmark_blocks(benchmark)
    group, more = _group(blocks)
    docs = docs.drop(*ADDED)
    key = {"_doc": F.xxhash64("doc_id"), "_tx": F.xxhash64("text")} if more else {}
    earlier: list[DataFrame] = []
    while more:
        work, sent = _passes(docs.select("text", *(c.alias(n) for n, c in key.items())).withColumns(empty), group, False)
        earlier.append(stage_table(work.where(F.size("_hits") > 0).drop("_words"), "decontamination-hits"))
        for block in sent:
            block.destroy()
        group, more = _group(blocks, more)
    work, _ = _passes(docs.withColumns(empty | key), group, keep_text)
    if earlier:
        found = earlier[0]
        for part in earlier[1:]:
            found = found.unionByName(part)
        flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        longest = F.min(F.struct((-F.element_at("_longest", 1)).alias("n"), F.element_at("_longest", 2).alias("at")))
        found = stage_table(found.groupBy("_doc", "_tx").agg(flat("_hits").alias("_hits2"), flat("_items").alias("_items2"), longest.alias("_l")).select("_doc", "_tx", "_hits2", "_items2", F.array(-F.col("_l.n"), "_l.at").alias("_longest2")), "decontamination-hits")
        drop_staged(*earlier)
        work = work.join(found, ["_doc", "_tx"], "left")
        both = lambda c: F.when(F.col(f"{c}2").isNull(), F.col(c)).otherwise(F.array_union(c, f"{c}2"))
        rank = lambda c: F.struct(F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(0).cast("long")).alias("n"), -F.coalesce(F.try_element_at(c, F.lit(2)), F.lit(0).cast("long")).alias("at"))
        work = work.withColumns({"_hits": both("_hits"), "_items": both("_items"), "_longest": F.when(rank("_longest2") > rank("_longest"), F.col("_longest2")).otherwise(F.col("_longest"))})
    ordered = F.array_join(F.array_sort("_items"), ",")
    hits = F.size("_hits").cast("long")
    out = work.withColumns({"n_words": F.col("_words"), "n_hit": hits, "n_items": F.size("_items").cast("long"), "items_sha256": F.sha2(ordered, 256)})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))
    out = out.withColumns({"longest_match": F.coalesce(F.try_element_at("_longest", F.lit(1)), F.lit(0).cast("long")), "longest_start": F.try_element_at("_longest", F.lit(2))})
    return out.select(*[c for c in docs.columns if keep_text or c != "text"], *ADDED)


def _group(blocks: Iterator[Windows], first: Windows | None = None) -> tuple[list[Windows], Windows | None]:
    """The next ``PASSES`` blocks, and the one after them if there is one."""
    found = ([first] if first else []) + list(islice(blocks, PASSES - bool(first)))
    return found, next(blocks, None)


def locate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Longest verbatim matches: ``doc_id, item_id, start, words`` (in words of the document), for every run of an item's windows.

    Runs of one item that overlap or touch are one match; items without id are not located.  Rules for words, windows and missing
    values are those of :func:`find_contamination`.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    out = None
    for block in _benchmark_blocks(benchmark):
        found = rows.mapInArrow(_Locate(spark.sparkContext.broadcast(cloudpickle.dumps(block))), f"doc_id {kind}, item_id string, start long, words long")
        out = found if out is None else out.unionByName(found)
    return out


class _Locate:
    """Matches of one block of the benchmark in Arrow batches."""

    def __init__(self, block):
        self.block = block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = pickle.loads(self.block.value)
        for batch in batches:
            at_row: list[int] = []
            found: list[tuple[str, int, int]] = []
            for k, text in enumerate(batch.column("text")):
                for item, start, end in self.matches(split_words(text.as_py()), windows):
                    at_row.append(k)
                    found.append((item, start, end - start))
            cols = [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at_row, pa.int64())), *cols], names=["doc_id", "item_id", "start", "words"])

    @staticmethod
    def matches(words: list[bytes], windows: Windows) -> Iterator[tuple[str, int, int]]:
        text = np.array([windows.ids.get(w, 0) for w in words], dtype=np.int64)
        number, place = windows.places(*windows.suffix_array(text, np.full(len(text), len(text))))
        spans: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for w, p in zip(number.tolist(), place.tolist(), strict=True):
            for item in windows.items[w]:
                spans[item].append((p, p + len(windows.keys[w])))
        for item, found in sorted(spans.items()):
            start, end = None, None
            for a, b in sorted(found):
                if start is None or a > end:
                    if start is not None:
                        yield item, start, end
                    start, end = a, b
                end = max(end, b)
            yield item, start, end


class _Pass:
    """One pass over Arrow batches with one block of the benchmark."""

    def __init__(self, block, names: list[str]):
        self.block, self.names = block, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = pickle.loads(self.block.value)
        for batch in batches:
            # Arrow batches hold up to 10,000 rows; a shard ends after so many words
            texts = batch.column("text")
            start, held, words = 0, 0, []
            for k in range(batch.num_rows):
                words.append([windows.ids.get(w, 0) for w in split_words(texts[k].as_py())])
                held += len(words[-1])
                if held >= SHARD_WORDS or k == batch.num_rows - 1:
                    yield self.shard(batch.slice(start, k + 1 - start), words, windows)
                    start, held, words = k + 1, 0, []

    def shard(self, batch: pa.RecordBatch, words: list[list[int]], windows: Windows) -> pa.RecordBatch:
        counts = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(counts) - counts
        text = np.fromiter(chain.from_iterable(words), dtype=np.int64, count=int(counts.sum()))
        doc = np.repeat(np.arange(len(words)), counts)
        at, sorted_words = windows.suffix_array(text, (starts + counts)[doc])
        number, place = windows.places(at, sorted_words)
        hits: list[set[int]] = [set(x) for x in batch.column("_hits").to_pylist()]
        items: list[set[str]] = [set(x) for x in batch.column("_items").to_pylist()]
        longest = [tuple(x) for x in batch.column("_longest").to_pylist()]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for w, p in zip(number.tolist(), place.tolist(), strict=True):
            d = int(doc[p])
            found[d].append((w, p - int(starts[d])))
            hits[d].update(range(p - int(starts[d]), p - int(starts[d]) + len(windows.keys[w])))
            items[d].update(windows.items[w])
        for d, pairs in found.items():
            n, at = windows.longest(pairs)
            if not longest[d] or (n, -at) > (longest[d][0], -longest[d][1]):
                longest[d] = (n, at)
        new = {"_longest": pa.array([list(x) for x in longest], pa.list_(pa.int64())), "_hits": pa.array([sorted(x) for x in hits], pa.list_(pa.int64())), "_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "_words": pa.array(counts)}
        return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in self.names], names=self.names)


def items_digest(items: list[str]) -> str:
    """The digest of a list of item ids, as ``items_sha256`` has it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
