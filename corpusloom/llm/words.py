"""Word hashes of whole texts in Arrow batches: what the shingle and substring operators start from."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd multiplier for rolling hashes of word sequences, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word of `[^\\x20\\x09-\\x0D]+`, in order. Hashing each word anew is faster than remembering hashes."""
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * BASE
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per `n` consecutive words."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * BASE + words[i : i + count]
    return mix(h)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive values, the position of the least by its upper 40 bits, the leftmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = []
    step = 1 << 23  # positions have 24 bits
    for start in range(0, n, step):
        part = values[start : min(start + step, n) + width - 1]
        least = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < width:  # minima of twice as many values each time
            more = min(span, width - span)
            least = np.minimum(least[:-more], least[more:])
            span += more
        out.append((least & np.uint64(0xFFFFFF)).astype(np.int64) + start)
    return np.concatenate(out)
