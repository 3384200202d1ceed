"""Many patterns against many names: an equi-join on a literal that every fitting name must hold, then the pattern on what is left.

A pattern's key is the text it begins with, else the one it ends with, else a piece of the one after its leading wildcards; a name has a row for
each of its own beginnings, ends and pieces whose length some pattern uses.  There is no join without a key: names and patterns meet if they share
a literal, and only patterns without any (``*``) meet all names, which is as many rows as they fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters of a literal that make a key at the ends of names and within them.
ENDS, PIECE = 32, 3
_CHAR = r"[A-Za-z0-9_/:@ ,=-]|\\[^A-Za-z0-9\s]"


def _plain(literal: Column) -> Column:
    return F.regexp_replace(literal, r"\\(.)", "$1")


def literal_key(pattern: Column) -> Column:
    """``kind, size, key`` of a regular expression: ``p`` (names begin with the key), ``s`` (end), ``g`` (hold) or ``a`` (any name).

    A character that a quantifier follows is no part of a literal; expressions with alternatives or flags have none, nor have ends without an anchor.
    """
    quantified = rf"((?:{_CHAR})*?)(?:(?:{_CHAR})[*?{{]|(?!{_CHAR}))"
    first = _plain(F.regexp_extract(pattern, r"^\^" + quantified, 1))
    inner = _plain(F.regexp_extract(pattern, r"^\^?(?:\.|\.\*|\\w\*)*" + quantified, 1))
    end = _plain(F.regexp_extract(pattern, rf"(?:^|[*.+?)}}])((?:{_CHAR})+)\$$", 1))
    loose = pattern.contains("|") | pattern.contains("(") | pattern.contains("[")
    kind = lambda k, size, key: F.struct(F.lit(k).alias("kind"), size.alias("size"), key.alias("key"))
    cut = lambda c, n: F.least(F.char_length(c), F.lit(n))
    return (
        F.when(pattern.contains("|") | pattern.contains("(?"), kind("a", F.lit(0), F.lit("")))
        .when(first != "", kind("p", cut(first, ENDS), F.left(first, F.lit(ENDS))))
        .when((end != "") & ~loose, kind("s", cut(end, ENDS), F.right(end, F.lit(ENDS))))
        .when((inner != "") & ~loose, kind("g", cut(inner, PIECE), F.left(inner, F.lit(PIECE))))
        .otherwise(kind("a", F.lit(0), F.lit("")))
    )


def _keys(kind: str, n: int) -> Column:
    """The keys of one kind and size that ``_name`` holds."""
    row = lambda key: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("size"), key.alias("key"))
    if kind == "g":
        places = F.sequence(F.lit(1), F.greatest(F.char_length("_name") - n + 1, F.lit(1)))
        found = F.transform(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("_name"), i, F.lit(n)))), row)
    else:
        found = F.array(row(F.lit("") if kind == "a" else F.left("_name", F.lit(n)) if kind == "p" else F.right("_name", F.lit(n))))
    return F.when(F.char_length("_name") >= n, found)


def matches(names: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """``name, pattern`` of all distinct pairs that fit (a regular expression that is found in the name).

    Null names and patterns fit nothing, repeated ones count once; the driver sees the lengths of keys alone, at most ``2 * ENDS + PIECE + 1`` numbers.
    """
    rules = patterns.select(F.col(pattern).alias("_pattern")).where("_pattern is not null").distinct().withColumn("_k", literal_key(F.col("_pattern"))).select("_pattern", "_k.*")
    sizes = sorted({(r["kind"], r["size"]) for r in rules.select("kind", "size").distinct().collect()})
    words = names.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    keys = [_keys(kind, n) for kind, n in sizes]
    if not keys:
        return words.select(F.col("_name").alias(name)).limit(0).withColumn(pattern, F.lit(None).cast("string"))
    spread = words.select("_name", F.explode(F.flatten(F.array_compact(F.array(*keys)))).alias("_k")).select("_name", "_k.*")
    hit = spread.join(rules, ["kind", "size", "key"]).where(F.rlike("_name", F.col("_pattern")))
    return hit.select(F.col("_name").alias(name), F.col("_pattern").alias(pattern))
