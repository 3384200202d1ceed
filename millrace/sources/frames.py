"""Rows that a task makes, as frames of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd

#: Rows of a frame: what a task of an operator that turns files into rows holds at once, besides one file's own.
FRAME_ROWS = 4096


def frames(rows: Iterable[tuple], columns: Sequence[str], most: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
    """All rows in order, in frames of at most ``most``: a batch of files has many times as many facts, tokens or nodes as it has rows."""
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pd.DataFrame(part, columns=columns)
