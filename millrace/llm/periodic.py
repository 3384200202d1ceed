"""Periodic runs of words: stretches that repeat a short sequence at least four times over.

Main and Lorentz's divide and conquer.  A text's words become numbers, every position is the midpoint of one segment (as
wide as the largest power of two in its number, to either side), and the repetitions that cross the midpoint come from Z-functions: how
far the words after it agree with themselves ``q`` words later, and how far the words before it agree with those before that
place.  A repetition that goes on past its segment crosses the midpoint of a larger one and is found whole there.  Midpoints
at which no repetition can cross are told apart for a whole batch at a time, so that ordinary prose needs hardly any Z-function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix64

#: A run repeats its period so many times at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Words that are looked at together.
BATCH_WORDS = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def z_function(s: Sequence[int]) -> list[int]:
    """For every position how many elements from it on agree with the beginning of ``s``; at 0 its length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for k in range(1, n):
        same = min(right - k, z[k - left]) if k < right else 0
        while k + same < n and s[same] == s[k + same]:
            same += 1
        z[k] = same
        if k + same > right:
            left, right = k, k + same
    return z


def crossing(words: Sequence[int], low: int, mid: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Stretches ``start, end, period`` of ``words[low:high]`` around ``mid`` whose period fits ``TIMES`` times, half of them at least to the right of ``mid``.

    They reach as far as the segment lets them; nothing is said of periods that are multiples of smaller ones.
    """
    right = words[mid:high]
    z = z_function(right)
    periods = [q for q in range(1, len(right) // 2 + 1) if z[q] >= q]
    if not periods:
        return
    before = words[low:mid][::-1]
    agree = z_function([*before, -1, *right[: periods[-1]][::-1], *before])
    behind = len(before) + 1 + periods[-1]
    for q in periods:
        start = mid - min(agree[behind - q], mid - low)
        end = mid + q + z[q]
        if end - start >= max(LEAST, TIMES * q):
            yield start, end, q


def midpoints(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run may cross with most of it to the right, and those with most of it to the left.

    ``words``: numbers of the words of many texts, one text after the other; ``ends``: for every position the
    end of its text.  At least half of a run is on one side of a midpoint: its period twice, and three words.
    """
    n = len(words)
    at = np.arange(n)
    shifted = lambda x, k, fill: np.concatenate([x[k:], np.full(min(k, n), fill, dtype=x.dtype)])

    def needed(w: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words from every position on that the shortest repetition beginning there may have, as its first four words tell."""
        same = [(w == shifted(w, q, -1)) & (at + q < end) for q in (1, 2, 3)]
        gram = np.zeros(n, dtype=np.uint64)
        for k in range(4):
            gram = mix64(gram + (shifted(w, k, -1) + 1).astype(np.uint64))
        order = np.argsort(gram, kind="stable")  # texts stay in order, so that the next of equals is the nearest
        again = (gram[order][1:] == gram[order][:-1]) & (end[order][1:] == end[order][:-1])
        least = np.full(n, 2 * n + 1, dtype=np.int64)
        least[order[:-1][again]] = 2 * np.diff(order)[again]
        least[same[2] & shifted(same[2], 1, False) & shifted(same[2], 2, False)] = 6
        least[same[1] & shifted(same[1], 1, False)] = 4
        least[same[0] & shifted(same[0], 1, False)] = 3
        return np.where(at + least <= end, least, 2 * n + 1)

    first = np.maximum.accumulate(np.where(np.concatenate([[True], ends[1:] != ends[:-1]]), at, 0)) if n else at
    width = (at - first) & -(at - first)
    forth = needed(words, ends)
    back = needed(words[::-1], (n - first)[::-1])[::-1]
    return np.flatnonzero(forth <= width), np.flatnonzero(np.concatenate([np.full(min(n, 1), 2 * n + 1), back[:-1]]) <= width)


def runs_of(words: list[int], right: Sequence[int], left: Sequence[int]) -> list[tuple[int, int, int]]:
    """All runs ``start, length, period`` of a text, by start, then period, given where they may cross."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int) -> None:
        if (start and words[start - 1] == words[start - 1 + q]) or (end < n and words[end] == words[end - q]):
            return  # goes on past the segment: it crosses the midpoint of a larger one
        found[start, end] = min(q, found.get((start, end), q))

    for mid in right:
        width = mid & -mid
        for start, end, q in crossing(words, mid - width, mid, min(n, mid + width)):
            keep(start, end, q)
    if len(left):
        turned = words[::-1]
        for mid in left:
            width = mid & -mid
            for start, end, q in crossing(turned, n - min(n, mid + width), n - mid, n - mid + width):
                keep(n - end, n - start, q)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words outside of runs and the first period of each, joined by one space."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        dropped[start + q] += 1
        dropped[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d)


def _batch(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of every text of a batch, whose words are numbered together."""
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for words in texts for w in words]
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    stops = np.cumsum(sizes)
    right, left = midpoints(np.array(flat, dtype=np.int64), np.repeat(stops, sizes))
    cut = lambda x: [part - start for part, start in zip(np.split(x, np.searchsorted(x, stops[:-1])), stops - sizes)]
    for start, stop, r, l in zip(stops - sizes, stops, cut(right), cut(left)):
        yield runs_of(flat[start:stop], r.tolist(), l.tolist()) if len(r) or len(l) else []


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``runs`` (array of ``start, length, period`` by start, then period), ``n_words`` and ``collapsed`` to ``df``.

    Words are what white space (0x20, 0x09 to 0x0D) divides, numbered from 0.  A run is a stretch with smallest period
    ``period`` (words so far apart are identical) of at least ``max(6, 4 * period)`` words that no neighbouring word extends.
    ``collapsed``: the text without the words that stand in a run after its first period, joined by one space.  Whole texts are
    read, in time ``n log n`` of their words.  Null and empty texts have no words, no runs and collapse to an empty text; repeated rows are treated alike;
    columns of the input with the added names are replaced, all others stay.  Nothing is shuffled.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held, texts = [], 0, []
            split = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch]
            for k, words in enumerate(split):
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS or k == len(split) - 1:
                    for own, runs in zip(texts, _batch(texts)):
                        rows.append(([dict(start=s, length=n, period=q) for s, n, q in runs], len(own), _collapse(own, runs).decode("utf-8", "surrogatepass")))
                    held, texts = 0, []
            yield pd.DataFrame(rows, columns=["runs", "n_words", "collapsed"])

    found = F.pandas_udf(run, f"runs {RUNS}, n_words long, collapsed string")
    rest, held = df.drop("runs", "n_words", "collapsed"), max(df.columns, key=len) + "_"  # a name that no column has
    return rest.withColumn(held, found(F.col(text))).select(*rest.columns, f"{held}.*")
