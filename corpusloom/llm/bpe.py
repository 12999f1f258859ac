"""Byte-level BPE with the tiktoken library and a local rank file, inside Arrow batches of a Spark job."""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import text_of

#: Texts over this many characters are cut at safe boundaries before the library sees them.
LONG_TEXT = 1 << 16
#: The white space of the pattern's `\\s`: the Unicode property, which Python's own `\\s` exceeds by 1C to 1F.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer runs of white space, whatever it is made of, overflow the library's regex stack in the end, so they are encoded
#: as the one match they are: before another character all of the run but its last character, at the end all of it.
_LONG_RUN = re.compile(f"[{_SPACES}]{{2000,}}")
#: Before a blank, tab or line end that follows another character than white space, a match of the pattern always ends:
#: no alternative goes on from the one to the other, and what the lookahead sees is white space or the end either way.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def _default_tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@functools.lru_cache(2)
def load_encoding(rank_file: str, pattern: str):
    """The encoding of a rank file (lines of base64 token and rank), without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """`text` in pieces of about `size` characters whose encodings, put together, are that of the whole. A piece is longer
    where no safe boundary is."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding, text: str) -> list[int]:
    """Ids of a text of any length. Lone surrogates can't occur in Spark strings."""
    if len(text) <= 20000:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_pieces(text[start : run.start()]):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
        start = end
    for piece in safe_pieces(text[start:]):
        ids += encoding.encode_ordinary(piece)
    return ids


def _shared_file(spark: SparkSession, path: str | None) -> str:
    """The name under which executors find a rank file that only the driver has; installed files are found by path."""
    if path is None:
        return ""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, text_col: str = "text", rank_path: str | None = None, pattern: str | None = None, rank_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """`docs` with a column `ids` array<int>: the text's token ids. Null and empty texts give an empty array.

    `rank_path`: a rank file on the driver, sent to the executors (then give its `pattern` too); by default the file
    `rank_name` of the installed public tokenizers. Columns named ids are replaced; all others are kept. An empty table
    gives an empty one. Memory: one Arrow batch and the ids of one document.
    """
    own = _shared_file(docs.sparkSession, rank_path)
    docs = docs.withColumn("_text", text_of(text_col)).drop("ids")
    schema = docs.drop("_text").withColumn("ids", F.array().cast("array<int>")).schema

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, default = (SparkFiles.get(own), pattern) if own else _default_tokenizer(rank_name)
        encoding = load_encoding(path, pattern or default)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            for part in _bounded(batch, at):
                offsets, flat = array("i", [0]), array("i")
                for value in part.column(at):
                    flat.extend(encode_text(encoding, value.as_py()))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), ids], names=[*(n for n in part.schema.names if n != "_text"), "ids"])

    return docs.mapInArrow(encode, schema)


def _bounded(batch: pa.RecordBatch, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes of text, so that ids of many long texts aren't held together."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(at)).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        total += size or 0
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def decode_documents(docs: DataFrame, ids_col: str = "ids", rank_path: str | None = None, pattern: str | None = None, rank_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """`docs` with a column `decoded` binary: the raw bytes of the ids. They need not be valid UTF-8 on their own, so no
    string is made of them. Null ids give null, none give no bytes; an id without a token fails the job."""
    own = _shared_file(docs.sparkSession, rank_path)
    docs = docs.drop("decoded")
    schema = docs.withColumn("decoded", F.lit(b"").cast("binary")).schema

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, default = (SparkFiles.get(own), pattern) if own else _default_tokenizer(rank_name)
        encoding = load_encoding(path, pattern or default)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            decoded = pa.array([None if not x.is_valid else encoding.decode_bytes(x.values.to_pylist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return docs.mapInArrow(decode, schema)
