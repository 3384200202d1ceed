"""Encoding and decoding with a SentencePiece merge model, without replaying its merges.

Every prefix of a text has exactly one last token.  It ends there (an Aho-Corasick automaton of all pieces lists the
candidates) and is compatible with the last token of what stands before it: no merge across the border of the two would have
come before the merges that built them.  One scan fills a table of last tokens; ids are then read off backwards.

Texts are cut where no piece can cross (before a run of spaces, around characters that stand in no longer piece), so that
the table of every different stretch is filled once a task.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model format: the visible space, what unknown pieces decode to, fields of the model and its parts.
SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
NORMALIZER, TRAINER, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE, MODEL_TYPE, SPACE_AS_SUFFIX, BPE = 3, 2, 2, 3, 4, 5, 3, 24, 2
#: Stretches up to so many characters are remembered, so many of them, and so many verdicts on pairs of tokens; beyond, memory is emptied.
REMEMBERED_CHARS, REMEMBERED, REMEMBERED_PAIRS = 64, 1 << 18, 1 << 20


@dataclass
class Vocabulary:
    """What a task needs of a model: pieces that merges may build and their scores, and the ids of bytes and marks."""

    pieces: dict[str, int]
    scores: dict[str, float]
    surface: list[bytes]
    byte_ids: list[int] | None
    unknown: int
    begin: int
    end: int
    control: frozenset[int]
    dummy_prefix: bool


def _fields(data: bytes) -> dict[int, int | bytes]:
    """Last value of every field of a protocol buffer message."""
    at, found = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            found[key >> 3] = number()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
        found[key >> 3] = data[at : at + size]
        at += size
    return found


def load(path: str) -> Vocabulary:
    """Read a model; one that is no merge model, or rewrites texts before encoding, is refused."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    message = _fields(raw)
    trainer, normal = _fields(message.get(TRAINER, b"")), _fields(message.get(NORMALIZER, b""))
    if trainer.get(MODEL_TYPE) != BPE or trainer.get(SPACE_AS_SUFFIX):
        raise ValueError(f"{path}: no merge model with leading spaces")
    if normal.get(CHARSMAP) or normal.get(EXTRA_SPACES, 1) or not normal.get(ESCAPE, 1):
        raise ValueError(f"{path}: the model normalises texts")
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = range(model.get_piece_size())
    if any(model.is_unused(i) for i in ids):
        raise ValueError(f"{path}: the model has unused pieces")
    control = frozenset(i for i in ids if model.is_control(i))
    own = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    bytes_ = [i for i in ids if model.is_byte(i)]
    surface = [b"" if i in control else UNKNOWN_SURFACE.encode() if model.is_unknown(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
    byte_ids = None
    if bytes_:
        byte_ids = [0] * 256
        for i in bytes_:
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value], surface[i] = i, bytes([value])
    pieces = {model.id_to_piece(i): i for i in own}
    scores = {model.id_to_piece(i): model.get_score(i) for i in own}
    return Vocabulary(pieces, scores, surface, byte_ids, model.unk_id(), model.bos_id(), model.eos_id(), control, bool(normal.get(DUMMY_PREFIX, 1)))


class Encoder:
    """The prefix table's machinery over a vocabulary; one a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text_of = {i: p for p, i in vocabulary.pieces.items()}
        self.size = {i: len(p) for p, i in vocabulary.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.pieces.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        joined = {c for p in vocabulary.pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        self.cuts = None
        if all(SPACE not in p.lstrip(SPACE) for p in vocabulary.pieces):
            self.cuts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.borders: dict[int, tuple[list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, token: int) -> tuple[list, list]:
        """Symbols at the left and at the right border of a token while it is built, each with the rank of the merge that ends it.

        Ranks are negated scores: the least is merged first, of equals the leftmost.
        """
        rank = {p: -s for p, s in self.v.scores.items()} if not hasattr(self, "rank") else self.rank
        self.rank = rank
        symbols = list(self.text_of[token])
        left, right = [], []
        while len(symbols) > 1:
            found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
            if not found:
                raise ValueError(f"piece {self.text_of[token]!r} is not built by merges")
            least, k = min(found)
            if k == 0:
                left.append((symbols[0], least))
            if k == len(symbols) - 2:
                right.append((symbols[-1], least))
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return [*left, (symbols[0], float("inf"))], [*right, (symbols[0], float("inf"))]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a, b`` stay apart: no symbols that meet at their border are merged before either is part of something larger.

        Of two merges of one rank the left one is first, so a merge inside ``a`` wins against one across, and that against one inside ``b``.
        """
        for t in (a, b):
            if t not in self.borders:
                self.borders[t] = self.merged(t)
        xs, ys = self.borders[a][1], self.borders[b][0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            across = self.rank.get(x + y)
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if i == len(xs) - 1 and j == len(ys) - 1:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[int]:
        """For every prefix of ``text`` the id of its last token; -1 for the empty one and after a character that no piece has."""
        last = [-1] * (len(text) + 1)
        size, pairs = self.size, self.pairs
        for at, token in self.automaton.iter(text):
            if last[at + 1] >= 0:
                continue
            before = last[at + 1 - size[token]]
            if before >= 0:
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) >= REMEMBERED_PAIRS:
                        pairs.clear()
                    fits = pairs[before, token] = self.compatible(before, token)
                if not fits:
                    continue
            last[at + 1] = token
        return last

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch, packed: read off the table of last tokens from the end."""
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= self.size[token]
                continue
            at -= 1
            if self.v.byte_ids is not None:
                out.extend(self.v.byte_ids[x] for x in reversed(text[at].encode("utf-8", "replace")))
            elif not out or out[-1] != self.v.unknown:  # neighbouring unknown characters are one unknown piece
                out.append(self.v.unknown)
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = (SPACE if self.v.dummy_prefix else "") + text.replace(" ", SPACE)
        known, out = self.known, []
        for part in self.cuts.findall(text) if self.cuts else [text]:
            ids = known.get(part)
            if ids is None:
                ids = self.stretch(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Decoder:
    """Texts of ids; one a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        codecs.register_error("each byte", _each_byte)
        self.bytes_ = frozenset(vocabulary.byte_ids or ())

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 are replaced one by one, none read across a mark; the space that encoding put first is taken away."""
        surface, control = self.v.surface, self.v.control
        first = next((i for i in ids if i not in control), None)
        runs, start = [], 0
        for k, i in enumerate(ids):
            if i in control:
                runs.append(ids[start:k])
                start = k + 1
        runs.append(ids[start:])
        text = "".join([b"".join([surface[i] for i in run]).decode("utf-8", "each byte") for run in runs if run])
        own = self.v.dummy_prefix and first is not None and first not in self.bytes_ and first != self.v.unknown
        return text[1:] if own and text.startswith(" ") else text


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", packed: bool = False, marks: bool = True) -> DataFrame:
    """Add the ids of column ``text`` as ``out``: ``array<int>``, or with ``packed`` their bytes, four a token, little-endian.

    With ``marks`` the model's begin and end ids stand around them.  Whole texts are read, of any length, in time linear in
    it.  Null and empty texts have no ids but the marks; repeated rows are encoded alike; a column of the input named ``out``
    is replaced, all others stay.  Nothing is shuffled.
    """
    head, tail = (struct.pack("<I", vocabulary.begin), struct.pack("<I", vocabulary.end)) if marks else (b"", b"")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            found = [head + encoder.encode(t) + tail for t in batch]
            yield pd.Series(found if packed else [np.frombuffer(x, "<u4").astype(np.int32) for x in found], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "binary" if packed else "array<int>")(F.col(text)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of ``ids`` (an array of integers, or packed) as ``out``.

    Begin and end ids give nothing; null ids give a null text; no ids an empty one; an id outside of the vocabulary stops the query.  A column of the input named ``out`` is replaced.
    """
    packed = df.schema[ids].dataType.typeName() == "binary"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            yield pd.Series([None if x is None else decoder.decode((np.frombuffer(x, "<u4") if packed else np.asarray(x, dtype=np.int64)).tolist()) for x in batch], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))
