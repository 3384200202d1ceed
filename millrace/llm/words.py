"""Words of texts as arrays: byte-level tokens and hashes for whole batches at a time."""

from __future__ import annotations

import numpy as np

#: Bytes of words: digits, a-z (A-Z is lower-cased to it) and everything from 0x80 on; the rest divides words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (fixed constants); spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``data`` (UTF-8), and the bytes where each begins and ends.

    A polynomial in an odd base, for all words at once by prefix sums and division by the base's power.
    """
    x = np.frombuffer(b" " + data.translate(FOLD) + b" ", dtype=np.uint8)
    white = x == 32
    begin = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    end = np.flatnonzero(~white[:-1] & white[1:]) + 1
    up, down = np.full(len(x), _BASE, dtype=np.uint64), np.full(len(x), _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up)])
    return mix64((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin - 1, end - 1
