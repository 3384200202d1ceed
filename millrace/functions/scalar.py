"""Scalar functions that rules use, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_message(message: Column) -> Column:
    """Lower case, white space collapsed, without ``line N`` and ``:N``."""
    text = F.regexp_replace(F.trim(F.lower(message)), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"line \d+", ""), r":\d+", "")


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for null and empty text."""
    chars = F.split(text, "")
    n = F.char_length(text).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))
    return F.when(F.coalesce(n, F.lit(0.0)) > 0, bits).otherwise(0.0)


def glob_to_regex(glob: Column) -> Column:
    """A shell pattern (``*``, ``?``) as an anchored regular expression."""
    quoted = F.regexp_replace(glob, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


#: Scores that stand for severity labels where no CVSS score is given.
LABEL_SCORES = {"CRITICAL": 9.5, "HIGH": 8.0, "MEDIUM": 5.5, "MODERATE": 5.5, "LOW": 2.5}


def path_suffixes(path: Column) -> Column:
    """``a/b/c`` to ``[a/b/c, b/c, c]``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version; arrays compare by element."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))


def exact_npm_version(spec: Column) -> Column:
    """The version of a spec that names exactly one (``1.2.3``, ``=1.2.3``, ``v1.2.3``), else null."""
    found = F.regexp_extract(F.trim(spec), r"^[=v]*(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?)$", 1)
    return F.when(found != "", found)


def dependency_name(name: Column) -> Column:
    """Lower case, runs of ``-``, ``_`` and ``.`` as one dash."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-_.]+", "-")


#: Zero-width and directional code points.
ZERO_WIDTH = "​‌‍⁠﻿‎‏‪‫‬‭‮"
#: Code points of bidirectional overrides and isolates (Trojan source).
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"
#: Cyrillic and Greek letters and the Latin letters that they look like.
CONFUSABLE = "АВСЕНКМОРТХаеорсухѕіјΑΒΕΗΙΚΜΝΟΡΤΧο"
LOOKS_LIKE = "ABCEHKMOPTXaeopcyxsijABEHIKMNOPTXo"


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def zero_width_chars(text: Column, most: int | None = None) -> Column:
    """Hidden characters in order; the first ``most`` if a number is given."""
    found = F.regexp_extract_all(text, F.lit(f"([{ZERO_WIDTH}])"), 1)
    return found if most is None else F.slice(found, 1, most)


#: Full-width forms of printable ASCII and the spaces of other widths, with what they stand for under compatibility normalisation.
WIDE = "".join(chr(0xFF01 + k) for k in range(94)) + "\u3000\u00a0\u2007\u202f"
NARROW = "".join(chr(0x21 + k) for k in range(94)) + "    "


def canonical(text: Column) -> Column:
    """The text as its readers would take it: without hidden characters, wide forms and lookalikes as plain letters, blanks as one."""
    return collapse_blanks(latin_lookalike(F.translate(strip_zero_width(text), WIDE, NARROW)))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def homoglyph_words(text: Column) -> Column:
    """Words that mix ASCII letters with letters that only look like them."""
    words = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    return F.filter(words, lambda w: w.rlike("[a-zA-Z]") & w.rlike(f"[{CONFUSABLE}]"))


def latin_lookalike(text: Column) -> Column:
    return F.translate(text, CONFUSABLE, LOOKS_LIKE)


def base64_texts(text: Column) -> Column:
    """Decoded base64 tokens that read as text: at least 8 characters, a space, over 80 % printable.  All tokens, however many and long."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z0-9+/]{16,}={0,2})"), 1), lambda t: F.length(t) % 4 == 0)
    raw = F.transform(tokens, lambda t: F.try_to_binary(t, F.lit("base64")))
    decoded = F.transform(F.filter(raw, lambda b: b.isNotNull() & F.is_valid_utf8(b.cast("string"))), lambda b: b.cast("string"))
    printable = lambda s: F.length(F.regexp_replace(s, r"[\p{C}\p{Zl}\p{Zp}]", "")) / F.length(s)
    return F.filter(decoded, lambda s: (F.length(s) >= 8) & s.contains(" ") & (printable(s) > 0.8))


#: Formats of credentials that are masked in evidence.
SECRET_PATTERNS = [
    r"\bsk_(?:live|test|proj)_[A-Za-z0-9_-]{8,}\b",
    r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"(?i)AWS_SECRET_ACCESS_KEY\s*[:=]\s*['\"]?[A-Za-z0-9/+=]{40,}",
]
#: Armoured blocks of any length, from their first line to their last.
PEM_BLOCK = r"-----BEGIN [^\n-]+-----[\s\S]*?-----END [^\n-]+-----"
KEYED_SECRET = r"(?i)\b(token|secret|password|passwd|api_?key|access_?key)(\s*[:=]\s*)([\"'][^\"'\n]{8,}[\"'])"
MASK = "[REDACTED]"


def redact(text: Column) -> Column:
    """Mask credentials: known formats, PEM blocks and quoted values of keys that name a secret."""
    out = F.regexp_replace(text, PEM_BLOCK, MASK)
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, MASK)
    return F.regexp_replace(out, KEYED_SECRET, f"$1$2{MASK}")


#: Starts of tokens that providers hand out.
KNOWN_PREFIXES = ["sk_live_", "sk_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "SG.", "glpat-", "npm_", "pypi-"]


def secret_severity(token: Column, min_length: int = 16, min_long: int = 20, least_entropy: float = 4.5) -> Column:
    """CRITICAL for a known prefix, HIGH for a long base64 token of high entropy, else null."""
    known = F.lit(False)
    for prefix in KNOWN_PREFIXES:
        known = known | token.startswith(prefix)
    dense = (F.length(token) >= min_long) & token.rlike(r"^[A-Za-z0-9+/=_-]+$") & (shannon_entropy(token) > least_entropy)
    return F.when((F.length(token) >= min_length) & known, "CRITICAL").when(dense, "HIGH")
