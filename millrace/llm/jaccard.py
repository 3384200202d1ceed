"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with one set of shingles form a class, which one of them stands for.  MinHash bands
give buckets; every member of a bucket is compared with a leader of it, MinHash value by
MinHash value, and dropped as soon as the posterior probability of reaching the
threshold is below a tolerance (BayesLSH, Satuluri and Parthasarathy 2012).  What is left
joins texts into families; within families every pair goes through the same pruning
and is verified on its exact shingle sets.  Families are worked on in blocks, which emit counts and
spanning links, never all pairs.  In a family of several blocks the distances from one of its texts settle
most pairs beforehand, as Jaccard distance obeys the triangle inequality: near copies of one text cost a look at each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import hashed_words, mix64
from millrace.operators.graph import components
from millrace.session import drop_staged, stage_table

#: Words of a shingle, and the similarity that makes a link.
WORDS = 5
THRESHOLD = 0.8
#: Bands and MinHash values per band; a pair at 0.8 shares no band with probability 5e-7.
BANDS, ROWS = 21, 3
VALUES = BANDS * ROWS
#: MinHash values looked at before each pruning decision, and the posterior below which a pair is dropped.
STEP = 9
TOLERANCE = 1e-4
#: Similarity to its leader that puts a text into the leader's family, and share of equal values from which it needs no further comparison in the bucket.
#: A text 0.8 like one that is at least 0.6 like the leader is itself at least 0.4 like the leader, which the family's test lets pass.
FAMILY, CLOSE = 0.6, 0.7
#: Texts of a bucket's block.
BUCKET_BLOCK = 512
#: Texts and shingles, on average, of a family's block in which pairs are compared.
BLOCK, BLOCK_GRAMS = 1024, 500_000
BATCH_BYTES = 1_000_000
#: Steps into which the distance from a family's leader is cut, and how many of them a link may span.
STEPS, SPAN = 100, 20

_BASE = np.uint64(0x100000001B3)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of every text; a shorter text is one shingle, one without words has none.

    Words are runs of digits, letters and everything beyond ASCII, A-Z lower-cased.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    word, begin, _ = hashed_words(b" ".join(raw))
    limits = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(begin, limits)
    n = max(0, len(word) - WORDS + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        rolled = rolled * _BASE + word[k : k + n]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for w in word[a:b]:
                short = short * _BASE + w
            out.append(mix64(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _salts() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[VALUES:] >> np.uint64(32)).astype(np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """``VALUES`` 32-bit MinHash values of every set (which must not be empty)."""
    a, b = _salts()
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    x = np.concatenate(sets)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), VALUES), dtype=np.uint32)
    for k in range(VALUES):
        y = (low ^ b[k]) * a[k]
        y ^= y >> np.uint32(15)
        y += high
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, at)
    return out


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among ``n`` for which P(similarity >= threshold | matches) reaches the tolerance, with a uniform prior."""
    grid = np.linspace(0, 1, 4001)[1:-1]
    for m in range(n + 1):
        like = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(like - like.max())
        if p[grid >= threshold].sum() / p.sum() >= tolerance:
            return m
    return n


#: Fewest matches after each step, by threshold: plain numbers, as executors have no copy of this module to keep them in.
BOUNDS = {t: {n: least_matches(n, t) for n in range(STEP, VALUES + 1, STEP)} for t in (FAMILY, THRESHOLD)}


def survivors(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows of MinHash values outlive the incremental comparison (at one of the two thresholds in use)."""
    least = BOUNDS[threshold]
    live = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        matches[live] += (left[live, n - STEP : n] == right[live, n - STEP : n]).sum(axis=1)
        live = live[matches[live] >= least[n]]
    out = np.zeros(len(left), dtype=bool)
    out[live] = True
    return out


def _signed(data: bytes) -> int:
    return int.from_bytes(data[:8], "little", signed=True)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``row, grams, size, values`` of every text: a digest of its shingle set, the set's size and its MinHash values."""
    for batch in batches:
        start, held = 0, 0
        texts = list(batch["text"])
        for k, t in enumerate(texts):
            held += len(t or "")
            if held >= BATCH_BYTES or k == len(texts) - 1:
                part = batch.iloc[start : k + 1]
                sets = shingle_sets(texts[start : k + 1])
                full = [j for j, s in enumerate(sets) if len(s)]
                values = minhash([sets[j] for j in full]) if full else np.empty((0, VALUES), np.uint32)
                held_values = dict(zip(full, (v.astype("<u4").tobytes() for v in values), strict=True))
                frame = part.drop(columns=["text"])
                frame["grams"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                frame["size"] = np.array([len(s) for s in sets], dtype=np.int64)
                frame["values"] = [held_values.get(j) for j in range(len(sets))]
                yield frame
                start, held = k + 1, 0


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``bucket, rank, id`` for each band of each text; ``rank`` orders a bucket's members, differently in each band."""
    for batch in batches:
        if not len(batch):
            continue
        v = np.frombuffer(b"".join(batch["values"]), dtype="<u4").reshape(-1, VALUES).astype(np.uint64)
        ids = batch["id"].to_numpy(np.int64)
        for k in range(BANDS):
            key = np.full(len(v), np.uint64(k + 1), dtype=np.uint64)
            for j in range(ROWS):
                key = mix64(key * _BASE + v[:, k * ROWS + j])
            rank = mix64(ids.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            yield pd.DataFrame({"bucket": key.view(np.int64), "rank": rank.view(np.int64), "id": ids})


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether each candidate pair outlives the comparison at the family's similarity, and whether it is close beyond doubt."""
    for batch in batches:
        if len(batch):
            left, right = (np.frombuffer(b"".join(batch[c]), dtype="<u4").reshape(-1, VALUES) for c in ("va", "vb"))
            ok = survivors(left, right, FAMILY)
            close = ok & ((left == right).sum(axis=1) >= CLOSE * VALUES)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "ok": ok, "close": close})


class _Forest:
    """Disjoint sets of ids."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)
        return x != y


def _within_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning pairs of the texts of a bucket's block pair that outlive the comparison; rows come ordered by bucket and block pair."""

    def done(key: tuple, ids: list[int], blocks: list[int], values: list[bytes]) -> list[tuple[int, int]]:
        v = np.frombuffer(b"".join(values), dtype="<u4").reshape(-1, VALUES)
        rows = [k for k, b in enumerate(blocks) if b == key[1]]
        cols = rows if key[1] == key[2] else [k for k, b in enumerate(blocks) if b == key[2]]
        forest, out, right = _Forest(), [], v[cols]
        for r, k in enumerate(rows):
            first = r + 1 if key[1] == key[2] else 0
            if first < len(cols):
                hit = np.flatnonzero(survivors(np.broadcast_to(v[k], (len(cols) - first, VALUES)), right[first:]))
                out += [(ids[k], ids[cols[c + first]]) for c in hit.tolist() if forest.join(ids[k], ids[cols[c + first]])]
        return out

    key, held = None, ([], [], [])
    for batch in batches:
        found: list[tuple[int, int]] = []
        for bucket, i, j, block, ident, value in zip(*(batch[c] for c in ("bucket", "i", "j", "block", "id", "values")), strict=True):
            if key != (bucket, i, j):
                if held[0]:
                    found += done(key, *held)
                key, held = (bucket, i, j), ([], [], [])
            for store, x in zip(held, (int(ident), int(block), bytes(value)), strict=True):
                store.append(x)
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    if held[0]:
        yield pd.DataFrame(done(key, *held), columns=["a", "b"], dtype="int64")


def _verified(texts: list[tuple[int, int, bytes, np.ndarray]], i: int, j: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of a block of a family: documents linked to each text, and a spanning set of the links.

    ``texts``: (id, documents, MinHash values, shingles, block).  Pairs are those between
    blocks ``i`` and ``j``, or within ``i`` if they are one.
    """
    rows = [t for t in texts if t[4] == i]
    cols = rows if i == j else [t for t in texts if t[4] == j]
    degree: dict[int, int] = {}
    span: list[tuple[int, int]] = []
    forest = _Forest()

    cv = np.stack([np.frombuffer(t[2], dtype="<u4") for t in cols]) if cols else np.empty((0, VALUES), "<u4")
    sizes = np.array([len(t[3]) for t in cols], dtype=np.int64)
    universe, inverse = np.unique(np.concatenate([t[3] for t in cols]), return_inverse=True) if cols else (np.empty(0), np.empty(0))
    owner = np.repeat(np.arange(len(cols)), sizes)
    for r, t in enumerate(rows):
        later = np.arange(r + 1, len(cols)) if i == j else np.arange(len(cols))
        if not len(later):
            continue
        a = len(t[3])
        # sizes alone rule out pairs whose smaller set is under 0.8 of the larger
        fit = later[(np.minimum(sizes[later], a) >= THRESHOLD * np.maximum(sizes[later], a) - 1e-9)]
        fit = fit[survivors(np.broadcast_to(np.frombuffer(t[2], dtype="<u4"), (len(fit), VALUES)), cv[fit])]
        if not len(fit):
            continue
        if len(fit) <= 4:
            common = np.array([len(np.intersect1d(t[3], cols[c][3], assume_unique=True)) for c in fit])
        else:  # all at once: mark the own shingles, count marks by owner
            mine = np.zeros(len(universe), dtype=bool)
            spot = np.searchsorted(universe, t[3])
            ok = spot < len(universe)
            ok[ok] &= universe[spot[ok]] == t[3][ok]
            mine[spot[ok]] = True
            common = np.bincount(owner[mine[inverse]], minlength=len(cols))[fit]
        union = a + sizes[fit] - common
        linked = fit[common * 5 >= union * 4]  # at least 0.8, in whole numbers
        for c in linked.tolist():
            u = cols[c]
            degree[t[0]] = degree.get(t[0], 0) + u[1]
            degree[u[0]] = degree.get(u[0], 0) + t[1]
            if forest.join(t[0], u[0]):
                span.append((t[0], u[0]))
    return degree, span


def _families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verify all pairs of families, block pair by block pair; rows come ordered by family and block pair.

    Rows out: ``a, b, n``: with ``b`` a link, without it the number of documents that link to ``a``.
    """
    held: list[tuple] = []
    key: tuple | None = None

    def done() -> pd.DataFrame:
        degree, span = _verified(held, key[1], key[2])
        rows = [(a, b, 0) for a, b in span] + [(a, None, n) for a, n in degree.items()]
        return pd.DataFrame({"a": pd.Series([x[0] for x in rows], dtype="int64"), "b": pd.Series([x[1] for x in rows], dtype="Int64"), "n": pd.Series([x[2] for x in rows], dtype="int64")})

    pending: list[pd.DataFrame] = []
    for batch in batches:
        for f, i, j, block, ident, docs, values, grams in zip(*(batch[c] for c in ("family", "i", "j", "block", "id", "docs", "values", "grams")), strict=True):
            if key != (f, i, j):
                if held:
                    pending.append(done())
                held, key = [], (f, i, j)
            held.append((int(ident), int(docs), bytes(values), np.frombuffer(grams, dtype="<u8"), int(block)))
        if pending:
            yield pd.concat(pending)
            pending = []
    if held:
        yield done()


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``id, step, near``: a text's Jaccard distance from its family's leader in hundredths, cut, and whether the two are linked.

    Rows come by family and part, the leader (``rank`` 0) before the texts.
    """
    lead = np.empty(0, dtype=np.uint64)
    for batch in batches:
        ids, steps, near = [], [], []
        for rank, ident, grams in zip(batch["rank"], batch["id"], batch["grams"], strict=True):
            own = np.frombuffer(grams, dtype="<u8")
            if rank == 0:
                lead = own
                continue
            common = len(np.intersect1d(own, lead, assume_unique=True))
            union = len(own) + len(lead) - common
            ids.append(ident)
            steps.append(STEPS * (union - common) // union)
            near.append(common * 5 >= union * 4)
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "step": pd.Series(steps, dtype="int32"), "near": pd.Series(near, dtype="bool")})


def _gram_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for start in range(0, len(texts), 200):
            part = batch.iloc[start : start + 200]
            sets = shingle_sets(texts[start : start + 200])
            yield pd.DataFrame({"id": part["id"], "grams": [s.astype("<u8").tobytes() for s in sets]})


def _blocks() -> Column:
    """Blocks of a group of texts (``size`` shingles each)."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")


def _large_families(members: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Settle by distance from the leader what pairs of families of several blocks it settles.

    Jaccard distance is a metric: two texts whose distances from the leader add up to 0.2 at most are linked, two whose
    distances differ by more are not.  So a family of near copies, however large, needs a look at each text alone.  Returns what is settled (``a, b, n``: counts of links, where ``b`` is null, and links with the leader),
    the members of the pairs of blocks that are left to verify (``family, i, j, block, id, docs, values``), and the tables staged on the way.
    """
    part = F.pmod("id", "blocks").cast("int")
    asked = members.select("family", part.alias("part"), F.lit(1).alias("rank"), "id")
    leads = members.where("id = family").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("rank"), "id")
    dealt = asked.unionByName(leads).join(texts, "id").repartition("family", "part").sortWithinPartitions("family", "part", "rank")
    far = dealt.select("rank", "id", "grams").mapInPandas(_distances, "id long, step int, near boolean")
    far = table = stage_table(members.select("family", "id", "docs", "values", "size").join(far, "id"), "jaccard-distances", compression="zstd")
    close = far.where("near and id <> family").select(F.col("id").alias("a"), F.col("family").alias("b"), F.lit(0).cast("long").alias("n"))
    # neighbouring steps share a group as long as they fill no block; at most STEPS rows a family
    weight = F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS)
    steps = far.groupBy("family", "step").agg(F.sum("docs").alias("docs"), weight.alias("weight"))
    before = Window.partitionBy("family").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = stage_table(steps.withColumn("group", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0.0))).cast("long")), "jaccard-steps")
    groups = steps.groupBy("family", "group").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.sum("docs").alias("all"), F.ceil(F.sum("weight")).cast("int").alias("parts"))
    groups = stage_table(groups, "jaccard-groups")
    side = lambda s: groups.select("family", *[F.col(c).alias(f"{c}_{s}") for c in ("group", "lo", "hi", "all", "parts")])
    pairs = side("x").join(side("y"), "family")
    linked = F.col("hi_x") + F.col("hi_y") + 2 <= SPAN
    apart = F.greatest(F.col("lo_x") - F.col("hi_y"), F.col("lo_y") - F.col("hi_x")) - 1 >= SPAN
    counts = pairs.where(linked).groupBy("family", F.col("group_x").alias("group")).agg(F.sum("all_y").alias("all"), F.bool_or(F.col("group_x") == F.col("group_y")).alias("own"))
    far = far.join(steps.select("family", "step", "group"), ["family", "step"])
    sure = far.join(counts, ["family", "group"]).select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("all") - F.when(F.col("own"), F.col("docs")).otherwise(0)).cast("long").alias("n"))
    open_pairs = pairs.where(~linked & ~apart).select("family", F.col("group_x").alias("group"), F.col("parts_x").alias("parts"), F.col("group_y").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts_y") - 1)).alias("with"))
    place = lambda group, part: (F.col(group) * (1 << 31) + part).cast("long")
    dealt = far.join(open_pairs, ["family", "group"]).withColumn("block", place("group", F.pmod("id", "parts"))).withColumn("other", place("other", F.col("with")))
    unsure = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "docs", "values")
    return [sure, close], unsure, [table, steps, groups]


def join_similar(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs`` (``doc_id, text``) at five-word shingles and similarity 0.8.

    Returns one row a row of ``docs``: ``doc_id, class_id, n_links, class_size, keeper``.  A class holds the rows
    that links connect; its id is its smallest ``doc_id``.  ``n_links`` counts the other
    rows whose similarity with the row's text is at least 0.8, copies included.  ``keeper`` is true for
    one row of each class (and rows with its id and text).  Texts without words (null, empty, punctuation) have no shingles, no links and
    classes of their own; a text of fewer than five words is one shingle.  Repeated rows are copies.
    Null ids are the largest.

    Buckets of any size: members meet the bucket's leader in a join that Spark can split; those
    that are not clearly close to it are compared with each other in blocks, which emit
    spanning pairs only.
    """
    base = docs.select(F.col("doc_id"), F.xxhash64("text").alias("tx"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = stage_table(base.mapInPandas(_sketch, f"doc_id {kind}, tx long, grams binary, size long, values binary"), "jaccard-sketch", compression="zstd")
    # one text stands for each set of shingles
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx", "values", "size")).alias("one")
    groups = sketch.where("grams is not null").groupBy("grams").agg(F.count("*").alias("docs"), pick)
    groups = stage_table(groups.select("grams", "docs", F.col("one.doc_id").alias("doc_id"), F.col("one.tx").alias("tx"), F.col("one.values").alias("values"), F.col("one.size").alias("size"), F.xxhash64("grams").alias("id")), "jaccard-texts", compression="zstd")

    bands = groups.select("id", "values").mapInPandas(_bands, "bucket long, rank long, id long")
    open_rows = stage_table(bands, "jaccard-bands")
    values = groups.select("id", "values")
    leaders = open_rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("rank", "id")).alias("lead")).where("n > 1")
    met = open_rows.join(leaders.select("bucket", F.col("lead.id").alias("leader")), "bucket").where("id <> leader")
    met = stage_table(met.select("bucket", "rank", "id", "leader"), "jaccard-met")
    pairs = met.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    sided = pairs.join(values.select(F.col("id").alias("a"), F.col("values").alias("va")), "a").join(values.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b")
    judged = stage_table(sided.mapInPandas(_pruned, "a long, b long, ok boolean, close boolean"), "jaccard-pairs")

    # members that are not close to their leader, with each other
    rest = met.withColumns({"a": F.greatest("id", "leader"), "b": F.least("id", "leader")}).join(judged.where("close").select("a", "b"), ["a", "b"], "left_anti").select("bucket", "rank", "id")
    rest = stage_table(rest, "jaccard-rest")
    many = rest.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"))
    placed = rest.join(many, "bucket").withColumn("block", F.pmod("rank", "blocks").cast("int"))
    placed = placed.select("bucket", "block", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id").join(values, "id")
    placed = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    inner = placed.select("bucket", "i", "j", "block", "id", "values").mapInPandas(_within_buckets, "a long, b long")

    links = judged.where("ok").select(F.col("a").alias("src"), F.col("b").alias("dst")).union(inner).distinct()
    joined = components(links)
    linked = stage_table(joined, "jaccard-families")
    drop_staged(joined.reads)
    family = linked.select(F.col("node").alias("id"), F.col("component").alias("family"))
    members = family.join(groups, "id").select("id", "family", "docs", "doc_id", "tx", "values", "size")
    sizes = members.groupBy("family").agg(_blocks().alias("blocks"))
    members = members.join(sizes, "family")
    members = stage_table(members, "jaccard-members", compression="zstd")
    wanted = members.select("id", "doc_id", "tx")
    # one plan at every size: whether a few members could be broadcast would otherwise hang on which side is done first
    wanted = wanted.select("id", F.col("doc_id").alias("_doc"), F.col("tx").alias("_tx")).hint("merge")
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tx") == F.col("_tx"))).select("id", "text").mapInPandas(_gram_bytes, "id long, grams binary")
    texts = stage_table(texts.dropDuplicates(["id"]), "jaccard-grams", compression="none")
    small = members.where("blocks = 1").select("family", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("block"), "id", "docs", "values")
    large = members.where("blocks > 1")
    settled, done = [], []
    if large.limit(1).count():
        settled, unsure, done = _large_families(large, texts)
        small = small.unionByName(unsure)
    placed = small.join(texts, "id").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    checked = placed.select("family", "i", "j", "block", "id", "docs", "values", "grams").mapInPandas(_families, "a long, b long, n long")
    for part in settled:
        checked = checked.unionByName(part)
    verified = stage_table(checked, "jaccard-verified")
    classes = components(verified.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = verified.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))

    labelled = groups.select("grams", "docs", "doc_id", "tx", "id").join(classes.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    per_class = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("docs").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("first"))
    labelled = labelled.join(per_class, "component").select("grams", "class_id", "class_size", F.col("first.tx").alias("first_tx"), (F.coalesce("n", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    labelled = stage_table(labelled, "jaccard-classes")
    drop_staged(groups, open_rows, met, judged, rest, linked, members, texts, verified, classes.reads, *done)
    out = sketch.select("doc_id", "tx", "grams").join(labelled, "grams", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("grams").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tx") == F.col("first_tx")))).alias("keeper"),
        "tx",
    )
