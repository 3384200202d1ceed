"""Exact top-k inner-product search with vector-approximation files.

The approximation file holds, per block of vectors and component, the one of 256 cells that
each value lies in: a byte a component, written once.  Scanning it alone gives a lower and
an upper bound of every inner product; a vector whose upper bound is below the k-th best
lower bound of a query is out.  Exact vectors are read for the rest only, the k with the best bounds
first, and then those whose bound is above the k-th exact score found by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import drop_staged, stage_table

#: Vectors of a block of the approximation file and, on average, of a block of queries.
BLOCK_ROWS = 4096
#: Cells per component in the approximation, and queries whose bounds a task holds at a time.
CELLS, SOME = 256, 512
#: Blocks that a scan task reads at most, on average, where there are enough tasks.
TASK_BLOCKS = 64


def quantised(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: components floor(scale * x); rows with a null vector or null or non-finite components are left out."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def padded(vectors: list) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), dtype="<i8")
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block, a byte a component, and per component where the first cell begins and how wide one is."""
    values = x.astype(float)
    lo, hi = (values.min(axis=0), values.max(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
    step = (hi - lo + 1) / CELLS
    return np.clip((values - lo) / step, 0, CELLS - 1).astype(np.uint8), lo, step


def bounds(q: np.ndarray, cells: np.ndarray, lo: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of query rows with a block's vectors.

    What rounding can add is covered by a slack in proportion to the largest products.
    """
    width = max(q.shape[1], len(lo))
    q = np.pad(q.astype(float), ((0, 0), (0, width - q.shape[1])))
    more = width - len(lo)
    cells, lo, step = np.pad(cells, ((0, 0), (0, more))), np.pad(lo, (0, more)), np.pad(step, (0, more))
    middle = (q * step) @ (cells.T + 0.5) + (q @ lo)[:, None]
    size = np.abs(q)
    radius = size @ (step / 2) + 1e-9 * (1 + size @ np.maximum(np.abs(lo), np.abs(lo + CELLS * step)))
    return middle - radius[:, None], middle + radius[:, None]


def _pack_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK_ROWS):
            part = batch.iloc[start : start + BLOCK_ROWS]
            cells, lo, step = approximate(padded(list(part["v"])))
            keys, ids = (part[c].to_numpy("<i8").tobytes() for c in ("key", "vec_id"))
            yield pd.DataFrame([{"keys": keys, "ids": ids, "lo": lo.tobytes(), "step": step.tobytes(), "cells": cells.tobytes()}])


def _pack_queries(part: pd.DataFrame) -> pd.DataFrame:
    block = padded(list(part["v"]))
    return pd.DataFrame([{"q": int(part["q"].iloc[0]), "q_ids": part["vec_id"].to_numpy("<i8").tobytes(), "q_width": block.shape[1], "q_block": block.tobytes()}])


FOUND = "query_id long, key long, lower double, upper double"


def _scan(k: int):
    """Bounds of the pairs that may be among a query's ``k`` best, as far as the blocks of this task tell."""

    class Query:
        """A block of queries, the best lower bounds of each so far, and the pairs still in."""

        def __init__(self, ids: bytes, width: int, block: bytes):
            self.ids = np.frombuffer(ids, dtype="<i8")
            self.rows = np.frombuffer(block, dtype="<i8").reshape(len(self.ids), width)
            self.best = np.full((len(self.ids), k), -np.inf)
            self.pairs: list[tuple] = []
            self.held = 0

        def meet(self, keys: np.ndarray, ids: np.ndarray, lo: np.ndarray, step: np.ndarray, cells: np.ndarray) -> None:
            for start in range(0, len(self.ids), SOME):
                at = slice(start, start + SOME)
                low, up = bounds(self.rows[at], cells, lo, step)
                own = self.ids[at, None] == ids[None, :]
                low[own] = up[own] = -np.inf
                both = np.concatenate([self.best[at], low], axis=1)
                self.best[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                r, c = np.nonzero((up >= self.best[at].min(axis=1)[:, None]) & ~own)
                self.pairs.append((start + r, keys[c], low[r, c], up[r, c]))
                self.held += len(r)

        def out(self) -> pd.DataFrame:
            r, key, low, up = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            live = up >= self.best.min(axis=1)[r]
            self.pairs, self.held = [], 0
            return pd.DataFrame({"query_id": self.ids[r[live]], "key": key[live], "lower": low[live], "upper": up[live]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries: dict[int, Query] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.q not in queries:
                    queries[r.q] = Query(r.q_ids, r.q_width, r.q_block)
                keys, ids = (np.frombuffer(x, dtype="<i8") for x in (r.keys, r.ids))
                lo, step = np.frombuffer(r.lo), np.frombuffer(r.step)
                queries[r.q].meet(keys, ids, lo, step, np.frombuffer(r.cells, dtype=np.uint8).reshape(len(ids), len(lo)))
                if queries[r.q].held > 1_000_000:
                    yield queries[r.q].out()
        for query in queries.values():
            if query.pairs:
                yield query.out()

    return scan


def top_k(rows: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """Exact best ``k`` candidates by integer inner product for every query row.

    ``rows``: ``vec_id, embedding``; ``is_query``: a boolean column over ``vec_id``.  Candidates are
    all rows but those with the query's own id.  Returns ``query_id, rank, vec_id, score``, fewer
    than ``k`` where there are fewer candidates.  Null vectors and vectors with null or
    non-finite components take no part; shorter vectors count as padded with zeros; a
    candidate row that is repeated counts as often as it is there; of a query id with several
    rows the smallest vector asks; ties go to the smaller id; an empty table gives no rows.

    Of equal vectors only the ``k + 1`` with the smallest ids can be results, so that the rest of a
    vector that many rows share never enters the file.  Queries are dealt by id into blocks of about
    ``BLOCK_ROWS``, the file into shares; only cells cross the network to meet them.  Exact vectors are joined
    to the pairs that the bounds leave, by row.
    """
    made = quantised(rows, scale)
    asked = stage_table(made.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "va-queries")
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    alike = Window.partitionBy("v").orderBy("vec_id")
    held = made.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1)
    exact = stage_table(held.select(F.monotonically_increasing_id().alias("key"), "vec_id", "n", "v"), "va-exact", compression="zstd")
    cells = stage_table(exact.select("key", "vec_id", "v").mapInPandas(_pack_cells, "keys binary, ids binary, lo binary, step binary, cells binary"), "va-cells")
    q = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    q = q.groupBy("q").applyInPandas(_pack_queries, "q int, q_ids binary, q_width int, q_block binary")

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_cells = cells.count()
    shares = max(1, -(-n_cells // TASK_BLOCKS), min(n_cells, -(-parts // blocks)))
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    c = cells.withColumn("share", F.pmod(F.xxhash64("keys"), F.lit(shares)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = stage_table(c.join(q, ["q", "share"]).mapInPandas(_scan(k), FOUND), "va-found")

    nth = lambda by, where: where.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(by).desc(), "key"))).where(F.col("nth") <= k)
    least = nth("lower", found).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("least"))
    left = stage_table(found.join(least, "query_id").where("least is null or upper >= least").drop("least", "lower"), "va-left")
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda total, x: total + x)
    asks = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def read(pairs: DataFrame) -> DataFrame:
        return pairs.select("query_id", "key").join(exact, "key").join(asks, "query_id").select("query_id", "key", "vec_id", "n", product.alias("score"))

    first = stage_table(read(nth("upper", left)), "va-first")
    sure = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("sure"))
    # a bound that rounds like the score must not fall below it
    rest = left.join(first.select("query_id", "key"), ["query_id", "key"], "left_anti").join(sure, "query_id").where("sure is null or upper >= sure - abs(sure) * 1e-12")
    every = first.unionByName(read(rest)).select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.drop("copy").withColumn("rank", F.row_number().over(order).cast("int"))
    out = stage_table(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "va-best")
    drop_staged(asked, exact, cells, found, left, first)
    return out
