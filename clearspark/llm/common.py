"""Words, hashes and the scratch folder that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from clearspark.scratch import Scratch, fresh, shared_folder

__all__ = ["Scratch", "alnum_words", "chunked", "fresh", "mix", "rolling", "shared_folder", "space_words", "text_bytes", "word_hashes"]

#: Longer keys are worked out each time, so that a bound on the number of remembered keys bounds their bytes too.
LONGEST_KEY = 64

#: Bytes outside words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` become spaces, A-Z become a-z.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 bytes; null has none."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes: bytes.split() cuts at exactly these six bytes."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most `most` words of up to LONGEST_KEY bytes."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.most and len(word) <= LONGEST_KEY:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(4)
def word_hashes(seed: int) -> WordHashes:
    """The hashes that a Python worker keeps from task to task."""
    return WordHashes(seed)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes (mod 2^64, then mixed) of every window of `width` word hashes.

    H[i] = sum of h[i+j] * base^(width-1-j); the sum over powers of `base` is built by doubling,
    so each window costs a few vector operations and not `width` of them.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done = None, 0
        block, size, shift = h.astype(np.uint64), 1, np.uint64(base)
        left = width
        while left:
            if left & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else out * shift + part
                done += size
            left >>= 1
            if left:
                block = block[:-size] * shift + block[size:]
                size, shift = size * 2, shift * shift
    return mix(out)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in a table, to choose partition counts by."""
    return df.selectExpr(f"sum(octet_length(`{column}`)) as n").first()["n"] or 0


def chunked(items: Iterable, size: int) -> Iterable[list]:
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
