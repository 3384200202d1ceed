"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  A line's features are shapes of its own bytes and words
and those of its two neighbours; the chain's transitions tie neighbouring labels.
The document's score is the mean of its lines' forward-backward marginals, weighted by
their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted to, at most.
TRAIN_DOCS = 3000
#: Bytes of text whose features are computed at once (a longer document is a batch of its own).
BATCH_BYTES = 1_000_000

#: Byte classes whose shares are features: lower case, upper case, digits, white space, sentence marks, bars and table marks, brackets and code marks, other ASCII, control, beyond ASCII.
BYTE_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:?'\"-", b"!", b"|", b"*#$%&@^~", b"<>{}[]()=_/\\+`"]
N_CLASSES = len(BYTE_CLASSES) + 2
OWN = N_CLASSES + 7
WIDTH = 3 * OWN + 1


def _class_table() -> np.ndarray:
    found = np.full(256, N_CLASSES - 2, dtype=np.uint8)
    found[128:] = N_CLASSES - 1
    for k, members in enumerate(BYTE_CLASSES):
        found[list(members)] = k
    return found


CLASS_OF = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (one row a line), the lines' lengths in bytes, and the number of lines of each text (one for an empty text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [r.split(b"\n") for r in raw]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(float)
    kind = CLASS_OF[data]
    share = np.empty((len(ends), OWN))

    def counted(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (run[ends] - run[starts]).astype(float)

    per = np.maximum(size, 1)
    for k in range(N_CLASSES):
        share[:, k] = counted(kind == k) / per
    white = (data <= 32) & (data != 0)
    begins = ~white & np.concatenate([[True], white[:-1]])
    words = counted(begins)
    repeats = counted(np.concatenate([[False], (data[1:] == data[:-1]) & (data[1:] > 32)])) / per
    distinct, again = [], []
    for own in lines:
        seen: set[bytes] = set()
        for line in own:
            tokens = line.split()
            distinct.append(len(set(tokens)) / len(tokens) if tokens else 1.0)
            again.append(line in seen and bool(line))
            seen.add(line)
    k = N_CLASSES
    last = data[np.maximum(ends - 1, starts)]
    share[:, k] = np.log1p(size) / 8
    share[:, k + 1] = np.minimum(size / np.maximum(words, 1), 40) / 10
    share[:, k + 2] = repeats
    share[:, k + 3] = np.array(distinct)
    share[:, k + 4] = np.array(again, dtype=float)
    share[:, k + 5] = np.isin(last, np.frombuffer(b".!?:\"", dtype=np.uint8)) & (size > 0)
    share[:, k + 6] = np.log1p(words) / 6
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(share), np.zeros_like(share)
    before[1:], after[:-1] = share[:-1], share[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    return np.hstack([share, before, after, np.ones((len(share), 1))]), size, counts


class Chain:
    """Unary weights of label good, and the 2 x 2 transition scores."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected transitions of every sequence (n, 2, 2), by scaled forward-backward."""
        u = x @ self.weights
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, long = first[order], counts[order]
        emit = np.stack([1 / (1 + np.exp(np.clip(u, -30, 30))), 1 / (1 + np.exp(np.clip(-u, -30, 30)))], axis=1)
        move = np.exp(self.moves - self.moves.max())
        fore = np.empty_like(emit)
        steps = int(long[0]) if len(long) else 0
        alive = np.searchsorted(-long, -np.arange(1, steps + 1), side="right")  # sequences with at least t + 1 lines
        for t in range(steps):
            here = at[: alive[t]] + t
            a = emit[here] if t == 0 else (fore[here - 1] @ move) * emit[here]
            fore[here] = a / a.sum(axis=1, keepdims=True)
        good, pairs = np.empty(len(u)), np.zeros((len(counts), 2, 2))
        back = np.ones((len(long), 2))
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            here = at[:n] + t
            joint = fore[here] * back[:n]
            good[here] = joint[:, 1] / joint.sum(axis=1)
            if t:
                right = emit[here] * back[:n]
                both = fore[here - 1][:, :, None] * move[None] * right[:, None, :]
                pairs[order[:n]] += both / both.sum(axis=(1, 2), keepdims=True)
                b = right @ move.T
                back[:n] = b / b.sum(axis=1, keepdims=True)
        return good, pairs

    def scores(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of every document."""
        if not len(counts):
            return np.empty(0)
        good, _ = self.marginals(x, counts)
        first = np.cumsum(counts) - counts
        weight = sizes + 1.0
        return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0.0, 1.0)


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.15, ridge: float = 1e-4) -> Chain:
    """Maximum likelihood by Adam from zero; each line has its document's label, each document the same weight.

    Without two labels to tell apart the chain is neutral: every score is a half.
    """
    w, m = np.zeros(WIDTH), np.zeros((2, 2))
    if len(set(labels.tolist())) < 2:
        return Chain(w, m)
    y = np.repeat(labels, counts).astype(float)
    share = np.repeat(1.0 / counts, counts) / len(counts)
    seen = np.zeros((len(counts), 2, 2))
    seen[np.arange(len(counts)), labels, labels] = counts - 1
    params, first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        chain_now = Chain(params[:WIDTH], params[WIDTH:].reshape(2, 2))
        good, pairs = chain_now.marginals(x, counts)
        grad = np.concatenate([x.T @ ((good - y) * share), ((pairs - seen) / counts[:, None, None]).mean(axis=0).ravel()]) + ridge * params
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(params[:WIDTH], params[WIDTH:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Chain:
    """Fit a chain to at most ``max_docs`` labelled documents that are not held out.

    Which documents is settled by a hash of the id; of those, all lines are read.  Their ids (a bounded table) go to the
    scan of ``docs``; only features of their lines come to the driver.  Ids with contradicting or
    null labels are left out.
    """
    clear = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    chosen = clear.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("q").cast("int").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [line_features([text])[0].astype("<f4").tobytes() for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "q": batch["q"], "x": x})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, q int, x binary"
    once = rows.mapInPandas(featured, schema).groupBy("doc_id").agg(F.min(F.struct("q", "x")).alias("one"))
    found = sorted((bytes(r["one"]["x"]), r["one"]["q"]) for r in once.toLocalIterator())
    if not found:
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)))
    parts = [np.frombuffer(x, dtype="<f4").reshape(-1, WIDTH) for x, _ in found]
    return fit(np.vstack(parts).astype(float), np.array([len(p) for p in parts]), np.array([q for _, q in found]))


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) and ``predicted`` (1 if the score is at least a half) to ``docs``.

    Scores depend on ``text`` alone, read whole.  Null text counts as empty, empty text as one
    empty line; repeated rows are scored alike; columns of the input with these names are replaced.
    """
    weights, moves = model.weights, model.moves

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Chain(weights, moves)
        for batch in batches:
            texts = [t or "" for t in batch]
            out, start, held = [], 0, 0
            for k, t in enumerate(texts):
                held += len(t)
                if held >= BATCH_BYTES or k == len(texts) - 1:
                    out.append(own.scores(*line_features(texts[start : k + 1])))
                    start, held = k + 1, 0
            yield pd.Series(list(chain.from_iterable(out)), dtype="float64")

    rows = docs.drop("score", "predicted").withColumn("score", scored(F.col("text")))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
