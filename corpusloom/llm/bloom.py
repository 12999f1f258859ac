"""A Bloom filter built by a DataFrame aggregation, its size bounded whatever the input, tested in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter (16 MB). A larger key set makes a fuller filter, which lets more rows through to the exact
#: step behind it, in the end all of them; it never loses a row, and there is no size from which on it isn't used.
MAX_BITS = 1 << 27


def build_bloom(keys: DataFrame, column: str, rows: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Words of a filter over the non-null longs of `column`. `rows`: about how many there are."""
    bits = 1 << 16
    while bits < min(16 * max(1, rows), max_bits):
        bits *= 2
    shift = 64 - bits.bit_length() + 1
    k = F.col(column)
    first = F.shiftrightunsigned(k, shift)
    second = F.shiftrightunsigned(F.xxhash64(k), shift)
    cells = keys.where(k.isNotNull()).select(F.explode(F.array(first, second)).alias("at"))
    words = cells.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()  # at most MAX_BITS / 64 rows
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter. `second`: Spark's xxhash64 of each key."""
    shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)
    found = np.ones(len(keys), bool)
    for k in (keys, second):
        at = k.view(np.uint64) >> shift
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return found
