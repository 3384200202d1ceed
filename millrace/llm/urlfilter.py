"""URL filters: host and path rules first, a hashed character n-gram model for the rest.

The model is a logistic regression over character n-grams of host and path, hashed
into ``2 ** bits`` weights and trained on a small table of labelled URLs by full-batch
gradient steps, always in the same order, so that every run has the same weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words for the kinds of site that web filters list by category (gambling, drugs, adult, advertising, spam, malware, fraud), and for
#: ordinary kinds of site.  Written down from general knowledge of such categories; no table of urls was looked at.
BLOCKED_WORDS = (
    "casino poker roulette blackjack jackpot slots lottery betting bookmaker sportsbook wager gambling "
    "viagra cialis levitra tramadol steroids pills pharmacy slimming "
    "porn xxx sex nude escort webcam adult fetish "
    "ads adserver advert banner popup popunder tracker tracking pixel affiliate "
    "spam backlinks linkfarm seo bulkmail clickbait "
    "malware phishing keygen warez crack torrent serials hack "
    "payday loans forex replica counterfeit giveaway prize winner free cheap discount"
)
ORDINARY_WORDS = (
    "news times journal magazine review library museum gallery archive university college school academy institute research "
    "science physics chemistry biology medicine hospital health nursing history geography language grammar dictionary literature poetry philosophy "
    "music concert orchestra theatre cinema film radio television photography painting design architecture "
    "city village council parliament government court justice police fire weather climate river mountain forest garden farm harbour island station railway airport bridge "
    "travel hotel kitchen recipes bread coffee cooking restaurant market bakery "
    "football cycling running swimming chess sailing climbing "
    "software hardware computer network database programming engineering energy water steel paper printing furniture clothing "
    "family children parents letters notes stories blog forum wiki guide atlas calendar the and that with from other nation action thing"
)
#: Hosts and paths that the words get in turn, the same for both labels, so that the model learns nothing from them.
SHAPES = ("{}.test/", "www.{}.example/index.html", "my{}.invalid/a/b", "{}24.test/p?q", "the-{}.example/2020/01/", "{}s.invalid/x.php")


def _in_turn() -> list[tuple[str, int]]:
    """Every word in two shapes, and with another word of its label."""
    out = []
    for label, text in ((1, BLOCKED_WORDS), (0, ORDINARY_WORDS)):
        names = text.split()
        for k, name in enumerate(names):
            other = names[(k + 7) % len(names)]
            out += [(SHAPES[(k + j) % len(SHAPES)].format(x), label) for j, x in enumerate((name, name, f"{name}-{other}", f"{other}{name}"))]
    return out


#: The labelled table: host and path, and label.
LABELLED_URLS = _in_turn()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule text and action of the longest rule that fits, else nulls.

    ``rules``: ``(action, host, path)``.  A rule fits its host and all subdomains if the path
    starts with the rule's path.  Longest: by the text ``host + path``, then by that text.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        rule = F.when(fits, F.lit(at + below)).otherwise(rule)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def grams(host: str, path: str, sizes: Iterable[int] = (3, 4, 5), bits: int = 14) -> list[int]:
    """Buckets of the distinct n-grams of ``^host$`` and ``^path$``, the two kept apart by a prefix."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            for i in range(len(text) - n + 1):
                found.add(zlib.crc32((mark + text[i : i + n]).encode("utf-8", "replace")) & ((1 << bits) - 1))
    return sorted(found)


def train(labelled: Sequence[tuple[str, int]], bits: int = 14, steps: int = 600, rate: float = 0.5, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the model, from rows ``(host/path, label)``."""
    rows = [grams(*_cut(url), bits=bits) for url, _ in labelled]
    used = np.unique(np.array([g for found in rows for g in found], dtype=np.int64))
    x = np.zeros((len(rows), len(used)))
    for k, found in enumerate(rows):
        x[k, np.searchsorted(used, found)] = 1.0 / math.sqrt(max(1, len(found)))
    y = np.array([label for _, label in labelled], dtype=float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(steps):
        off = 1.0 / (1.0 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ off / len(y) * 10 + ridge * w)
        b -= rate * off.mean()
    weights = np.zeros(1 << bits)
    weights[used] = w
    return weights, b


def _cut(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: Sequence[tuple[str, int]] = LABELLED_URLS, cutoff: float = 0.5) -> DataFrame:
    """Judge every row of ``pages`` by its ``url``.

    Adds to the row's columns ``host, path, rule, verdict, score``: the verdict is that of the
    longest rule that fits, else ``block`` where the model's score is at least ``cutoff``.
    Null urls and urls without ``://`` have empty host and path and are scored as such; repeated
    rows are judged alike; columns of the input with the names of new ones are replaced.
    The model is a few kilobytes and goes with the task.
    """
    w, b = train(labelled)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=1 << 16)
        def one(host: str, path: str) -> float:
            found = grams(host, path)
            return 1.0 / (1.0 + math.exp(-(float(w[found].sum()) / math.sqrt(max(1, len(found))) + b)))

        for hosts, paths in batches:
            yield pd.Series([one(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    host, path = split_url(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action, "score": score("host", "path")})
    verdict = F.coalesce("action", F.when(F.col("score") >= cutoff, "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).drop("action")
