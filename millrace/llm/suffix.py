"""Removal of repeated strings by suffix arrays (two-stage sorting).

Strings are counted in bytes (400 by default) or in words, each of which then stands as
eight bytes of hash; only suffixes that begin with a word are sorted then.

The suffixes of all texts are dealt out by content: the 400-byte prefix of a suffix holds a
gram of least hash, its anchor, and equal prefixes have equal anchors.  Suffixes next to each
other with one anchor are a fragment.  Only fragments whose anchor repeats can hold a
repeated string; equal fragments are kept once, with their number.  Within a shard of
fragments the suffixes that are smaller than their successors are sorted directly, the rest
is induced by one scan over the buckets, and neighbours with a common prefix of 400 bytes are
repeats.

An anchor with more fragments than a task should hold is dealt out again: its suffixes are
cut into cells at fixed distances from the anchor, and keyed by the bytes that all 400-byte
strings of a cell have in common, ever finer, until a cell is one suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import hashed_words
from millrace.session import drop_staged, stage_table

#: Default bytes of the strings that count as repeated, and bytes of the grams whose hashes choose anchors.
LENGTH = 400
GRAM = 64
#: Distinct fragments of one anchor that are sorted in one task.
GROUP_ROWS = 256
#: Suffix starts of a shard that is sorted at once.
SHARD_STARTS = 100_000
#: Bytes of texts that are hashed at once.
BATCH_BYTES = 1_000_000
#: Each finer round cuts a cell into so many.
SPLIT = 7
#: Bytes that stand for a word.
WORD = 8

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _combined(x: np.ndarray, step: int) -> np.ndarray:
    """Hashes of eight values of ``x`` that lie ``step`` apart, from every start."""
    x = x * _MULTIPLIERS[0]
    for k in range(1, 4):
        x ^= x >> np.uint64(29)
        y = x[:-step] * _MULTIPLIERS[k]
        y += x[step:]
        x, step = y, step * 2
    x ^= x >> np.uint64(31)
    x *= _MULTIPLIERS[4]
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every ``GRAM`` bytes of ``data``: eight-byte words, combined pairwise."""
    if len(data) < GRAM:
        return np.empty(0, dtype=np.uint64)
    return _combined(np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,)), 8)


def word_gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM // WORD`` word codes."""
    return _combined(codes, 1) if len(codes) >= GRAM // WORD else np.empty(0, dtype=np.uint64)


def anchored(h: np.ndarray, limits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, first, last`` of all runs of starts whose ``window`` gram hashes have their leftmost least at ``anchor``.

    ``h``: the gram hashes of several texts in one array; ``limits``: where the first of each text and
    the end of its last stand.  Windows lie within one text.  Least values are found for all windows
    at once, from running minima of blocks of ``window`` values from both their ends.
    """
    n = len(h)
    starts = np.zeros(n + 1, dtype=np.int32)
    size = limits[:, 1] - limits[:, 0] - window + 1
    fits = limits[size > 0]
    if not len(fits):
        return (np.empty(0, dtype=np.int64),) * 3
    np.add.at(starts, fits[:, 0], 1)
    np.add.at(starts, fits[:, 1] - window + 1, -1)
    valid = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
    value = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    value[:n] = h
    blocks = value.reshape(-1, window)
    least = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[valid]
    np.minimum(least, np.minimum.accumulate(blocks, axis=1).ravel()[valid + window - 1], out=least)
    apart = np.diff(valid) != 1
    edge = np.flatnonzero((least[1:] != least[:-1]) | apart) + 1
    # a least value that is smaller than the one before has just come into the window
    entered = np.append(False, (least[edge] < least[edge - 1]) & ~apart[edge - 1])
    out: list[tuple[int, int, int]] = []
    for lo, hi, fresh in zip(valid[np.append(0, edge)].tolist(), valid[np.append(edge - 1, -1)].tolist(), entered.tolist(), strict=True):
        at = lo + (window - 1 if fresh else int(h[lo : lo + window].argmin()))
        while at < hi:  # the same value again, further on
            out.append((at, lo, at))
            lo = at + 1
            at = lo + int(h[lo : lo + window].argmin())
        out.append((at, lo, hi))
    anchor, first, last = np.array(out, dtype=np.int64).T
    return anchor, first, last


def sort_suffixes(texts: list[bytes], starts: list[int], length: int = LENGTH, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage sort of ``starts[k]`` suffixes of every text, ``stride`` bytes apart, by their first ``length`` bytes.

    Returns text numbers and offsets (in strides) in order, and whether each agrees with the one before in
    ``length`` bytes.  Every one of these suffixes must have ``length`` bytes.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    buffer = b"\0".join(texts) + b"\0"
    t = np.frombuffer(buffer, dtype=np.uint8).astype(np.int16) + 1
    end = base + sizes - 1
    t[end] = 0  # each text ends with something smaller than any byte
    n = len(t)
    # smaller than its successor: the next change of byte is a rise
    rise = np.append(np.sign(np.diff(t)), 1)
    change = np.where(rise != 0, np.arange(n), n - 1)
    small = rise[np.minimum.accumulate(change[::-1])[::-1]] > 0
    small[end] = True
    # the suffixes asked for, and those that their order hangs on: up to the next that is smaller than its successor
    first = np.asarray(starts, dtype=np.int64)
    nth = np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)
    asked = np.repeat(base, first) + nth * stride
    wanted = np.zeros(n, dtype=bool)
    wanted[asked] = True
    tail = np.where(small, np.arange(n), n)
    stop = np.minimum.accumulate(tail[::-1])[::-1]
    reach = np.bincount(asked, minlength=n + 1) - np.bincount(stop[asked] + 1, minlength=n + 1)
    needed = np.cumsum(reach[:-1]) > 0
    limit = np.repeat(end, sizes)
    # stage one: direct sort
    direct = np.flatnonzero(needed & small)
    keys = [buffer[i:j] for i, j in zip(direct.tolist(), np.minimum(direct + length, limit[direct]).tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    cuts = np.searchsorted(t[direct], np.arange(258))
    # stage two: buckets in order of their first byte; each suffix puts its larger predecessor into that one's bucket
    larger: list[list[np.ndarray]] = [[] for _ in range(257)]
    order: list[np.ndarray] = []

    def induce(block: np.ndarray) -> np.ndarray | None:
        order.append(block)
        before = block[block > 0] - 1
        before = before[needed[before] & ~small[before]]
        if not len(before):
            return None
        byte, here = t[before], int(t[block[0]])
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        same = None
        edges = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, edges):
            c = int(t[part[0]])
            if c == here:
                same = part
            else:
                larger[c].append(part)
        return same

    for c in range(257):
        wave = np.concatenate(larger[c]) if larger[c] else None
        while wave is not None and len(wave):
            wave = induce(wave)
        block = direct[cuts[c] : cuts[c + 1]]
        if len(block):
            induce(block)
    array = np.concatenate(order) if order else np.empty(0, dtype=np.int64)
    array = array[wanted[array]]
    at = array.tolist()
    same = np.zeros(len(at), dtype=bool)
    same[1:] = [buffer[i : i + length] == buffer[j : j + length] for i, j in zip(at, at[1:], strict=False)]
    owner = np.searchsorted(base, array, side="right") - 1
    return owner, (array - base[owner]) // stride, same


def repeated_starts(texts: list[bytes], starts: list[int], counts: list[int], length: int = LENGTH, stride: int = 1) -> list[np.ndarray]:
    """For each text a flag a start: whether its ``length`` bytes stand at another start, or its text is there more than once."""
    owner, offset, same = sort_suffixes(texts, starts, length, stride)
    twin = same.copy()
    twin[:-1] |= same[1:]
    out = [np.full(k, n > 1) for k, n in zip(starts, counts, strict=True)]
    base = np.cumsum(starts) - np.asarray(starts)
    flat = np.concatenate(out) if out else np.empty(0, dtype=bool)
    flat[base[owner] + offset] |= twin
    return [flat[b : b + k] for b, k in zip(base.tolist(), starts, strict=True)]


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (``words.split_words``) of all texts, and where each text's begin and end."""
    codes, begin, _ = hashed_words(b" ".join(texts))
    first = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return codes, np.column_stack([first[:-1], first[1:]])


def _runs(flags: np.ndarray, base: int = 0) -> list[tuple[int, int]]:
    """First and end of every run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a) + base, int(b) + base) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Unit(NamedTuple):
    """What strings are counted in: ``length`` symbols of ``stride`` bytes, with anchors among grams of ``gram`` symbols."""

    length: int
    by_words: bool

    @property
    def stride(self) -> int:
        return WORD if self.by_words else 1

    @property
    def bytes(self) -> int:
        return self.length * self.stride

    @property
    def window(self) -> int:
        return self.length - GRAM // self.stride + 1


def _fragments(unit: Unit):
    """``key, frag, doc, tx, first, lead, starts, reps`` of every fragment of the texts.

    In periodic text equal fragments follow each other; such a run is one row, ``reps`` times.
    """
    gram, stride, length = GRAM // unit.stride, unit.stride, unit.length

    def made(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
        texts = [x[2] for x in rows]
        if unit.by_words:
            codes, limits = word_codes(texts)
            hashes, data = word_gram_hashes(codes), codes.tobytes()
        else:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            limits, data = np.column_stack([ends - [len(t) for t in texts], ends]) if texts else np.empty((0, 2), dtype=np.int64), b"".join(texts)
            hashes = gram_hashes(data)
        anchor, lo, hi = anchored(hashes, np.column_stack([limits[:, 0], limits[:, 1] - gram + 1]), unit.window)
        key = hashes[anchor]
        frags = [_digest(data[a:b]) for a, b in zip((lo * stride).tolist(), ((hi + length) * stride).tolist(), strict=True)]
        text = np.searchsorted(limits[:, 1], lo, side="right") if len(limits) else lo
        base = limits[text, 0] if len(limits) else lo
        # of equal fragments one after the other the first stays, with their number
        alike = np.zeros(len(lo), dtype=bool)
        for k in (np.flatnonzero((key[1:] == key[:-1]) & (text[1:] == text[:-1])) + 1).tolist():
            alike[k] = frags[k] == frags[k - 1]
        at = np.flatnonzero(~alike)
        reps = np.diff(np.append(at, len(lo)))
        doc, tx = (np.array([x[j] for x in rows], dtype=np.int64)[text[at]] if rows else np.empty(0, dtype=np.int64) for j in (0, 1))
        small = {"first": lo - base, "lead": anchor - lo, "starts": hi - lo + 1}
        return pd.DataFrame({"key": key[at].view(np.int64), "frag": [frags[k] for k in at.tolist()], "doc": doc, "tx": tx} | {c: v[at].astype(np.int32) for c, v in small.items()} | {"reps": reps.astype(np.int32)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shortest = length * 2 - 1 if unit.by_words else length  # a word and its separator are two bytes at least
        for batch in batches:
            rows, held = [], 0
            for doc, tx, raw in zip(batch["doc"], batch["tx"], batch["raw"], strict=True):
                if len(raw) >= shortest:
                    rows.append((doc, tx, bytes(raw)))
                    held += len(raw)
                if held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return cut


def _cut_out(unit: Unit):
    """Bytes of the wanted fragments of every text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, wanted in zip(batch["raw"], batch["wanted"], strict=True):
                raw = word_codes([bytes(raw)])[0].tobytes() if unit.by_words else bytes(raw)
                for w in wanted:
                    out.append((w["key"], bytes(w["frag"]), w["n"], w["lead"], w["starts"], raw[w["first"] * unit.stride : (w["first"] + w["starts"] - 1 + unit.length) * unit.stride]))
                    if len(out) >= 4000:
                        yield pd.DataFrame(out, columns=ROW)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=ROW)

    return cut


#: Columns of a fragment in a round: its key, its identity, its number of copies, start 0's distance before the anchor, its starts and bytes.
ROW = ["key", "frag", "n", "lead", "starts", "bytes"]
ROW_SCHEMA = "key long, frag binary, n long, lead int, starts int, bytes binary"
RUNS_SCHEMA = "frag binary, runs array<struct<a:int,b:int>>"


def _sort_groups(unit: Unit):
    """Sort the fragments of whole groups, shard by shard; rows come ordered by key.

    A shard ends with a group, so that no group is cut.  Groups hold at most ``GROUP_ROWS`` rows.
    """

    def shard(held: list[tuple]) -> pd.DataFrame:
        flags = repeated_starts([x[1] for x in held], [x[2] for x in held], [x[3] for x in held], unit.bytes, unit.stride)
        return pd.DataFrame({"frag": [x[0] for x in held], "runs": [[{"a": a, "b": b} for a, b in _runs(f)] for f in flags]})

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        starts, key = 0, None
        for batch in batches:
            for r in zip(batch["key"], batch["frag"], batch["bytes"], batch["starts"], batch["n"], strict=True):
                if r[0] != key and starts >= SHARD_STARTS:
                    yield shard(held)
                    held, starts = [], 0
                key = r[0]
                held.append((bytes(r[1]), bytes(r[2]), int(r[3]), int(r[4])))
                starts += held[-1][2]
        if held:
            yield shard(held)

    return ordered


def _finer(cell: int, unit: Unit):
    """Cut fragments into cells of ``cell`` starts, aligned to the anchor, and key each by the bytes its strings share."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for frag, n, lead, starts, raw in zip(batch["frag"], batch["n"], batch["lead"], batch["starts"], batch["bytes"], strict=True):
                raw = bytes(raw)
                shift = unit.length - lead  # cells count from a fixed distance before the anchor
                lo = 0
                while lo < starts:
                    begin = (shift + lo) // cell * cell - shift
                    hi = min(begin + cell, starts)
                    core = raw[(begin + cell - 1) * unit.stride : (begin + unit.length) * unit.stride]
                    piece = raw[lo * unit.stride : (hi - 1 + unit.length) * unit.stride]
                    key = hashlib.blake2b(core + (begin + shift).to_bytes(4, "little"), digest_size=8).digest()
                    out.append((bytes(frag), lo, int.from_bytes(key, "little", signed=True), _digest(piece + key), n, lead - lo, hi - lo, piece))
                    lo = hi
                if len(out) >= 4000:
                    yield pd.DataFrame(out, columns=["parent", "at", *ROW])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["parent", "at", *ROW])

    return cut


def _resolve(rows: DataFrame, cell: int, unit: Unit, staged: list[DataFrame]) -> DataFrame:
    """``frag, runs`` of repeated starts for fragments (``ROW``) that are distinct within their keys.

    Tables written on the way are added to ``staged``.
    """

    def keep(df: DataFrame, label: str) -> DataFrame:
        staged.append(stage_table(df, label))
        return staged[-1]

    per_key = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    known = keep(per_key.where("`all` > 1 and (rows > 1)"), "suffix-keys")
    single = rows.where("n > 1").select("frag", F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b"))).alias("runs"))
    shared = rows.join(known, "key")
    fits = shared.where(F.col("rows") <= GROUP_ROWS).select(*ROW)
    sorted_runs = fits.repartition("key").sortWithinPartitions("key").mapInPandas(_sort_groups(unit), RUNS_SCHEMA)
    out = sorted_runs.unionByName(single)
    if cell > 1 and known.where(F.col("rows") > GROUP_ROWS).limit(1).count():
        cell = max(1, cell // SPLIT)
        pieces = shared.where(F.col("rows") > GROUP_ROWS).select(*ROW).mapInPandas(_finer(cell, unit), f"parent binary, at int, {ROW_SCHEMA}")
        pieces = keep(pieces, "suffix-pieces")
        distinct = pieces.groupBy("key", "frag").agg(F.sum("n").alias("n"), F.min(F.struct("lead", "starts", "bytes")).alias("x")).select("key", "frag", "n", "x.lead", "x.starts", "x.bytes")
        deeper = _resolve(keep(distinct, "suffix-finer"), cell, unit, staged)
        back = pieces.select("parent", "at", "frag").join(deeper, "frag")
        moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))
        out = out.unionByName(back.select(F.col("parent").alias("frag"), moved.alias("runs")))
    return out


def repeated_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """``doc, tx, spans``: for every text that has repeated strings the runs ``[a, b)`` of their starts (a staged table).

    ``docs``: ``doc, tx, raw``; ``doc`` and ``tx`` (a hash of the text) name a text.  Runs are in symbols of the unit.
    """
    schema = "key long, frag binary, doc long, tx long, first int, lead int, starts int, reps int"
    found = stage_table(docs.mapInPandas(_fragments(unit), schema), "suffix-fragments", compression="zstd")
    # numbers of fixed width only, so that Spark aggregates by hashing: digests are compared by a hash, any one place stands for a fragment
    name = F.xxhash64("frag")
    groups = found.groupBy("key").agg(F.sum("reps").alias("rows"), F.min(name).alias("f1"), F.max(name).alias("f2")).where("rows > 1")
    groups = groups.select("key", (F.col("f1") != F.col("f2")).alias("mixed"))
    again = stage_table(found.join(groups, "key"), "suffix-again", compression="zstd")
    drop_staged(found)
    place = ("doc", "tx", "first", "lead", "starts")
    chosen = again.where("mixed").groupBy("key", "frag").agg(F.sum("reps").alias("n"), *[F.first(c).alias(c) for c in place])
    wanted = chosen.groupBy("doc", "tx").agg(F.collect_list(F.struct("key", "frag", "n", "first", "lead", "starts")).alias("wanted"))
    texts = docs.join(wanted, ["doc", "tx"]).select("raw", "wanted").mapInPandas(_cut_out(unit), ROW_SCHEMA)
    staged = [stage_table(texts.dropDuplicates(["key", "frag"]), "suffix-rows")]
    runs = _resolve(staged[0], unit.window, unit, staged)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("starts") * F.col("reps")).alias("b")))
    alike = again.where("not mixed").select("doc", "tx", "first", whole.alias("runs"))
    # a fragment that follows itself is repeated throughout
    own = F.when(F.col("reps") > 1, whole).otherwise(F.col("runs"))
    sorted_out = again.where("mixed").join(runs.where(F.size("runs") > 0), "frag").select("doc", "tx", "first", own.alias("runs"))
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    every = alike.unionByName(sorted_out).select("doc", "tx", "first", moved.alias("runs"))
    out = stage_table(every.groupBy("doc", "tx").agg(F.flatten(F.collect_set("runs")).alias("spans")), "suffix-spans")
    drop_staged(again, *staged)
    return out


def _merged(spans, length: int) -> list[tuple[int, int]]:
    """What repeated strings cover: starts ``[a, b)`` cover ``[a, b - 1 + length)``; touching runs are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"]) - 1 + length) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Names of working columns beside those of the input.
RAW, SPANS, PASSAGES, DOC, TX = "_millrace_raw", "_millrace_spans", "_millrace_passages", "_millrace_doc", "_millrace_tx"


def _strip(unit: Unit, passage_words: int | None):
    def cut_spans(raw: bytes, spans) -> list[tuple[int, int]]:
        if spans is None:
            return []
        if not unit.by_words:
            return _merged(spans, unit.length)
        _, begin, end = hashed_words(raw)
        return [(int(begin[a]), int(end[b - 1])) for a, b in _merged(spans, unit.length)]

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, spans, passages in zip(batch[RAW], batch[SPANS], batch[PASSAGES], strict=True):
                raw = bytes(raw)
                cut = cut_spans(raw, spans)
                kept, at = [], 0
                for a, b in cut:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                n_words = sum(b - a for a, b in _merged(passages, passage_words)) if passages is not None else 0
                out.append((len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(rest).hexdigest(), n_words, rest.decode("utf-8", "ignore")))
            rest = batch.drop(columns=[RAW, SPANS, PASSAGES])
            made = pd.DataFrame(out, columns=[*ADDED, "n_passage_words", "kept"], index=rest.index)
            if not rest.columns.empty:
                made = pd.concat([rest, made], axis=1)
            yield made

    return strip


ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(docs: DataFrame, length: int = LENGTH, by_words: bool = False, passage_words: int | None = None, keep_text: bool = True) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers, or, ``by_words``, every run of ``length`` words.

    A string is repeated if it starts anywhere else in any text, its own included; all its
    places go.  Adds ``n_bytes, n_removed, n_spans, kept_sha256`` (in bytes) and, with ``keep_text``, puts what
    is left into ``text`` (bytes of characters that were cut through are dropped there, not in the
    digest).  Words are those of ``words.split_words``, so that runs are alike whatever their case and
    punctuation; what stands between two removed words goes with them.  With ``passage_words``
    also adds ``n_passage_words``: words in runs of so many words that stand anywhere else too, removed or not.

    Null text counts as empty and comes back empty; texts shorter than a string are left as they are;
    repeated rows are copies like any other; input columns with the names of new ones are
    replaced; an empty table gives no rows.  Strings must be longer than ``GRAM`` bytes (eight words).
    """
    unit = Unit(length, by_words)
    if unit.bytes <= GRAM or passage_words is not None and passage_words * WORD <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes or {GRAM // WORD} words")
    added = ADDED if passage_words is None else [*ADDED, "n_passage_words"]
    docs = docs.drop(*added, "kept")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keyed = docs.select(F.xxhash64("doc_id").alias("doc"), F.xxhash64("text").alias("tx"), raw.alias("raw"))
    others = [c for c in docs.columns if c != "text"]
    joined = docs.select(F.xxhash64("doc_id").alias(DOC), F.xxhash64("text").alias(TX), raw.alias(RAW), *others)
    for name, sought in ((SPANS, unit), (PASSAGES, Unit(passage_words, True) if passage_words else None)):
        if sought is None:
            joined = joined.withColumn(name, F.lit(None).cast("array<struct<a:int,b:int>>"))
        else:
            spans = repeated_spans(keyed, sought).select(F.col("doc").alias(DOC), F.col("tx").alias(TX), F.col("spans").alias(name))
            joined = joined.join(spans, [DOC, TX], "left")
    joined = joined.drop(DOC, TX)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in others]
    schema = ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept string"])
    out = joined.mapInPandas(_strip(unit, passage_words), schema)
    out = out.withColumnRenamed("kept", "text") if keep_text else out.drop("kept")
    return out.select(*[c for c in docs.columns if keep_text or c != "text"], *added)
