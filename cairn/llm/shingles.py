"""Word shingles and MinHash signatures in numpy, over whole texts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

WIDTH = 5
HASHES = 64
_STEP = 1 << 15


class _WordHashes(dict):
    """64-bit hash of a word, kept for words seen before; emptied when it holds 200,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _WordHashes()


def forget() -> None:
    """Empty what a worker remembers, at the end of a task."""
    _words.clear()


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE, _MINS, _TAGS = _odd(101, WIDTH), _odd(102, HASHES), _odd(103, HASHES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct five-word shingles.

    Words are runs of anything but ASCII blanks, A-Z lower-cased (exactly what bytes.lower and bytes.split do).
    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(w) < WIDTH:
        return _mixed((w * _PLACE[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - WIDTH + 1
    s = w[:n] * _PLACE[0]
    for j in range(1, WIDTH):
        s += w[j : j + n] * _PLACE[j]
    return np.unique(_mixed(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit tags of the minima of 64 multiplicative hashes."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STEP):
        part = shingles[i : i + _STEP]
        for k in range(HASHES):
            low[k] = min(low[k], (part * _MINS[k]).min())
    return (_mixed(low * _TAGS) >> np.uint64(48)).astype(">u2")


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


