"""Best-fit-decreasing packing of a whole corpus into sequences of fixed length.

Tasks cut documents into pieces and count pieces per length. The order of best-fit decreasing depends on lengths only, so
the plan is made from that histogram, which has at most `capacity` rows whatever the corpus: lengths are taken from the
largest down, and a segment tree over remaining capacities finds the tightest open bins that fit in logarithmic time.
Pieces of one length that go to bins with one remaining capacity are planned together as a range of places, exactly as if
they had come one by one. Tasks then look up each piece's range by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.bpe import encode_text, load_encoding
from corpusloom.llm.common import text_of

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that a task ranks together, about: common lengths are cut into more slices.
ROWS_PER_SLICE = 1_000_000


class RemainingTree:
    """Segment tree over remaining capacities 0..n: how many open bins have each, and the tightest that fits."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        node = self.size + remaining
        while node:
            self.total[node] += bins
            node //= 2

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least `need` with an open bin, else -1."""
        node = self.size + need
        if self.total[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.total[node + 1]:
                node += 1
                while node < self.size:
                    node *= 2
                    if not self.total[node]:
                        node += 1
                return node - self.size
            node //= 2
        return -1


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing of `histogram` (length: pieces). Rows (length, first rank, first bin, offset): from that rank on,
    up to the next row of the length, pieces go one to a bin, to bins with numbers that rise by one, at that offset."""
    tree, plan, bins = RemainingTree(capacity), [], 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first bin, bins)

    def opened(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            open_bins.setdefault(remaining, []).append((first, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                remaining, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins[remaining].pop()
                tree.add(remaining, -count)
            # one by one, a bin would take pieces until no more fits: `full` bins do, the next one takes what is left
            each = remaining // length
            full = min(count, left // each)
            rest = min(left - full * each, each - 1) if full < count else 0
            for bin_first, n, layers in ((first, full, each), (first + full, 1, rest)):
                for layer in range(layers if n else 0):
                    plan.append((length, rank, bin_first, capacity - remaining + layer * length))
                    rank, left = rank + n, left - n
            opened(remaining - each * length, first, full)
            if rest:
                opened(remaining - rest * length, first + full, 1)
            opened(remaining, first + full + (rest > 0), count - full - (rest > 0))
    return plan


class _Cache(dict):
    """Little-endian ids of a word after a blank, by word."""

    def __init__(self, encoding, most: int = 400_000):
        self.encoding, self.most = encoding, most

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(" " + word) if len(word) < 20000 else encode_text(self.encoding, " " + word)).tobytes()
        if len(word) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


_BLANK_AFTER_SPACE = re.compile(r"\s ").search


@functools.lru_cache(1)
def _cache() -> _Cache:
    """The ranks of byte_bpe_50k.tiktoken are the vocabulary and merge order of byte_bpe_50k.json and give its ids."""
    import public_tokenizers

    return _Cache(load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def token_bytes(text: str) -> bytes:
    """Ids of a text, 4 bytes each. A blank after another character than white space starts a match of its own, so words
    are encoded one by one and remembered; a text with a blank after white space is encoded as a whole."""
    cache = _cache()
    if _BLANK_AFTER_SPACE(text):
        return array("I", encode_text(cache.encoding, text)).tobytes()
    head, *words = text.split(" ")
    return array("I", encode_text(cache.encoding, head)).tobytes() + b"".join(map(cache.__getitem__, words))


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, piece, start, length, ids): the documents' token ids with `end_id` after them, ids as little-endian 32-bit
    integers. Documents over `capacity` are cut into pieces of `capacity`, the first shorter where it doesn't go even.
    A null or empty text is the end id alone; rows with null or repeated ids are pieces like any others."""
    schema = T.StructType([*docs.select(id_col).schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[tuple[int, int, int, bytes]] = []
            size = 0
            for i, text in enumerate(texts):
                ids = token_bytes(text.as_py()) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    rows.append((i, piece, start, ids[4 * start : 4 * stop]))
                size += len(ids)
                if size > 8 << 20 or i + 1 == batch.num_rows:
                    if rows:
                        at, piece, start, parts = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array(parts, pa.binary())], names=schema.names)
                    rows, size = [], 0

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(cut, schema)


def _order(length: np.ndarray, rank: np.ndarray, capacity: int) -> np.ndarray:
    return (capacity - np.asarray(length, np.int64)) << 48 | rank


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length_col: str = "length", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """`pieces` with sequence_id and offset: a place in a sequence for every row, gapless from 0 in each sequence.

    Lengths are 1 to `capacity`, without nulls. `pieces` is read several times, so give a written table. Rows are ranked
    within their length and one of as many slices as its count asks for, and slices are put one after another, so no task
    holds all rows of a common length. Null and repeated ids and whole rows that repeat get places like any others; of
    rows alike in everything, which one gets which place doesn't matter. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    per_length = {r["length"]: r["count"] for r in pieces.groupBy(F.col(length_col).alias("length")).count().collect()}  # capacity rows at most
    slices = np.array([max(1, -(-per_length.get(n, 0) // rows_per_slice)) for n in range(capacity + 1)], np.int64)
    first = np.concatenate([[0], np.cumsum(slices)[:-1]])
    of_length = F.element_at(F.expr(f"cast(split('{','.join(map(str, slices.tolist()))}', ',') AS array<bigint>)"), F.col(length_col).cast("int") + 1)
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*pieces.columns), of_length))
    counts = sliced.groupBy(F.col(length_col).alias("length"), "_slice").count().collect()  # a row per length, and per million pieces
    sizes = np.zeros(int(slices.sum()), np.int64)
    for row in counts:
        sizes[first[row["length"]] + row["_slice"]] = row["count"]
    before = np.cumsum(sizes) - sizes
    base = before - np.repeat(before[first], slices)
    plan = np.array(plan_best_fit(per_length, capacity), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((first, base, plan))  # bounded by capacity, but for a number per million pieces
    ranked = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_slice").orderBy(*(F.col(c) for c in pieces.columns if pieces.schema[c].dataType.typeName() not in ("binary", "map", "variant")))) - 1)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keep = pieces.columns

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, plan = shared.value
        key = _order(plan[:, 0], plan[:, 1], capacity)
        for batch in batches:
            if not batch.num_rows:
                continue
            length, cut, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (length_col, "_slice", "_rank"))
            rank = rank + base[first[length] + cut]
            # the plan's rows are sorted by falling length, then rising rank: one search finds each piece's row
            at = np.searchsorted(key, _order(length, rank, capacity), "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], names=schema.names)

    return ranked.mapInArrow(place, schema)
