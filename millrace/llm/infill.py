"""Fill-in-the-middle training texts: a text is cut twice between its units and put together in another order.

A text is held as its maximal runs of one character class, white space or not, with the units and characters that end with
each run.  A cut after so many units is looked up in the run that holds it, and its offset inside the run is arithmetic: no list of units is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
UNITS = ("words", "chars")


@dataclass
class ClassRuns:
    """Runs of a text in UTF-8: where each ends in bytes, and the units and characters up to there.

    ``unit``: ``chars`` counts every character; ``words`` counts a word with the white space before it as one unit, and
    white space at the end as one.
    """

    data: bytes
    unit: str
    byte_ends: np.ndarray
    char_ends: np.ndarray
    unit_ends: np.ndarray

    @classmethod
    def of(cls, text: str, unit: str = "words") -> ClassRuns:
        data = text.encode("utf-8", "surrogatepass")
        codes = np.frombuffer(data, np.uint8)
        white = WHITE[codes]
        ends = np.append(np.flatnonzero(white[1:] != white[:-1]) + 1, len(codes)) if len(codes) else np.empty(0, np.int64)
        begins = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))
        chars = np.searchsorted(begins, ends)
        if unit == "chars":
            return cls(data, unit, ends, chars, chars)
        units = np.cumsum(~white[ends - 1]) if len(ends) else ends
        if len(ends) and white[-1]:
            units[-1] += 1
        return cls(data, unit, ends, chars, units)

    @property
    def n(self) -> int:
        return int(self.unit_ends[-1]) if len(self.unit_ends) else 0

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters before the cut that comes after so many units."""
        if units <= 0:
            return 0, 0
        run = int(np.searchsorted(self.unit_ends, units))
        if self.unit == "words":  # a word's unit ends with its run
            return int(self.byte_ends[run]), int(self.char_ends[run])
        start, byte = (int(self.char_ends[run - 1]), int(self.byte_ends[run - 1])) if run else (0, 0)
        chars, size = int(self.char_ends[run]) - start, int(self.byte_ends[run]) - byte
        if size == chars:
            return byte + units - start, units
        inside = np.flatnonzero((np.frombuffer(self.data, np.uint8)[byte : byte + size] & 0xC0) != 0x80)
        return byte + (int(inside[units - start]) if units - start < chars else size), units


def _draw(key: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight digits of the hexadecimal SHA-256 of ``seed:key``, as an integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def rearrange(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "words") -> DataFrame:
    """Add ``n, form, prefix_chars, middle_chars, output`` to ``df``.

    A text of ``n`` units is cut at two places that the SHA-256 of ``seed:key`` draws (the cuts may be equal, and at either
    end).  ``form`` is ``plain`` (text left alone; cuts null) for an empty text, one that holds a mark, and all but ``rate`` of a hundred; ``spm`` (suffix, prefix, middle) for ``spm_rate`` of a hundred of the others;
    else ``psm``.  Whole texts are read, of any length, in time linear in it.  Null texts count as empty; a null key draws
    as an empty one; repeated rows come out alike; columns of the input with the added names are replaced, all others stay.  Nothing is shuffled.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r}: one of {UNITS}")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *draws in batches:
            rows = []
            for t, h1, h2, h3, h4 in zip(texts, *(d.tolist() for d in draws)):
                t = t or ""
                runs = ClassRuns.of(t, unit)
                if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or h3 % 100 >= rate:
                    rows.append((runs.n, "plain", None, None, t))
                    continue
                (a, chars_a), (b, chars_b) = (runs.cut(k) for k in sorted((h1 % (runs.n + 1), h2 % (runs.n + 1))))
                prefix, middle, suffix = (part.decode("utf-8", "surrogatepass") for part in (runs.data[:a], runs.data[a:b], runs.data[b:]))
                if h4 % 100 < spm_rate:
                    rows.append((runs.n, "spm", chars_a, chars_b - chars_a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle))
                else:
                    rows.append((runs.n, "psm", chars_a, chars_b - chars_a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = F.pandas_udf(run, "n long, form string, prefix_chars long, middle_chars long, output string")
    rest, held = df.drop("n", "form", "prefix_chars", "middle_chars", "output"), max(df.columns, key=len) + "_"  # a name that no column has
    draws = [_draw(F.col(key), seed, k) for k in range(4)]
    return rest.withColumn(held, made(F.col(text), *draws)).select(*rest.columns, f"{held}.*")


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`rearrange` made ``output`` of: marks can't stand in the parts, so the first of each is its own."""
    first, second = F.when(form == "spm", PREFIX).otherwise(SUFFIX), F.lit(MIDDLE)
    one = F.call_function("substring_index", output, first, F.lit(1))
    rest = F.substr(output, F.char_length(one) + len(PREFIX) + 1)
    two = F.call_function("substring_index", rest, second, F.lit(1))
    three = F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)
    head = F.substr(one, F.lit(len(PREFIX) + 1))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, three, head)).otherwise(F.concat(head, three, two))
