"""A filter of the hashes that may occur more than once, built without sending the hashes.

Each task sets bits for the hashes it sees, once or again, and sends its bits packed: a segment of the filter, a range of
hashes, is one row however many hashes fall into it, of about two bytes a set bit. Segments are merged one by one; what two
tasks set, or one task twice, is set in the result. That is a table of words, applied in slices of a fixed size: each is a
range of hashes and is broadcast to the rows of that range where they are. So the rows never move for it, whatever the
table's size; they are written sorted by hash, file by file, and a slice reads its range of each file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each row, at least: at most one unique hash in this many meets another's bit.
BITS_PER_ROW = 64
#: Hashes of one segment, about: what one step of the merge holds, a few 10 MB.
ROWS_PER_SEGMENT = 1 << 21
_FLUSH = 1 << 21
#: Words of a slice, about: 16 bytes each, so 32 MB are broadcast at a time.
WORDS_PER_SLICE = 1 << 21


def filter_bits(rows: int) -> int:
    """Logarithm of the filter's size for so many rows."""
    return max(20, (BITS_PER_ROW * max(1, rows) - 1).bit_length())


def _pack(at: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, their bytes in planes: the upper planes are nearly all zero and take no room
    once the shuffle has compressed them."""
    return np.ascontiguousarray(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint64)


def repeated_hashes(hashes: DataFrame, column: str, rows: int, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """(word long, bits long): the words with a set bit of a filter of 2 ** filter_bits(rows) bits. A hash that two or more
    rows of `hashes` have is in it; of the others, few are. `rows`: about how many there are. Null hashes aren't counted."""
    size = filter_bits(rows)
    segments = min(size - 10, max(4, (rows // rows_per_segment).bit_length(), size - 31))  # as a logarithm
    inner = np.uint64(size - segments)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            at = np.sort(np.concatenate(held) >> np.uint64(64 - size))
            at = at[np.concatenate([np.ones(min(2, len(at)), bool), at[2:] != at[:-2]])]  # once, or twice for again
            segment = (at >> inner).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            parts = np.split(at & ((np.uint64(1) << inner) - np.uint64(1)), cuts[1:])
            return pa.RecordBatch.from_arrays([pa.array(segment[cuts]), pa.array([_pack(p) for p in parts], pa.binary())], names=["segment", "marks"])

        held, n = [], 0
        for batch in batches:
            own = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(own)
            n += len(own)
            if n >= _FLUSH:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words(segment: int, held: list[np.ndarray]) -> pa.RecordBatch:
            at = np.sort(np.concatenate(held))
            again = np.unique(at[1:][at[1:] == at[:-1]])
            word = again >> np.uint64(6)
            cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(again) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (again & np.uint64(63)), cuts) if len(again) else again
            return pa.RecordBatch.from_arrays([pa.array((word[cuts] + (np.uint64(segment) << (inner - np.uint64(6)))).view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        now, held = None, []
        for batch in batches:
            for segment, marks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now:
                    if held:
                        yield words(now, held)
                    now, held = segment, []
                held.append(_unpack(marks.as_buffer()))
        if held:
            yield words(now, held)

    marks = hashes.select(column).mapInArrow(mark, "segment long, marks binary")
    return marks.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "word long, bits long")


def may_repeat(rows: DataFrame, column: str, found: DataFrame, size: int, words_per_slice: int = WORDS_PER_SLICE) -> DataFrame:
    """`rows` with a column maybe: false where the hash in `column` is certainly that of no other row. `found`, `size`: what
    repeated_hashes gave, as a written table, and filter_bits. Rows aren't shuffled: words come in slices, broadcast one by
    one, and each row is asked in the slice that its hash belongs to. Hashes are even, so slices are of about one size."""
    slices = max(0, (found.count() // words_per_slice).bit_length())  # as a logarithm
    at = F.shiftrightunsigned(column, 64 - size)
    bit: Column = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = found.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    out = None
    for i in range(1 << slices):
        own, asked = words, rows
        if slices:
            low = i << (64 - slices)
            low -= (low >> 63) << 64  # Spark's numbers are signed
            own = words.where(F.shiftrightunsigned("_word", size - 6 - slices) == i)
            own_range = F.col(column).between(low, low + (1 << (64 - slices)) - 1)
            asked = rows.where(own_range if i else own_range | F.col(column).isNull())
        joined = asked.withColumns({"_word": F.shiftrightunsigned(at, 6), "_bit": bit}).join(F.broadcast(own), "_word", "left")
        part = joined.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits")
        out = part if out is None else out.unionByName(part)
    return out
