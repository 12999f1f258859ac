"""Chunks of texts: paragraphs, sentences and word windows packed to a token target with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: targets in tokens of the three configurations, and the share of a chunk that the next one repeats
CONFIGS = {"256tok_15pct": (256, 0.15), "512tok_15pct": (512, 0.15), "1024tok_15pct": (1024, 0.15)}
_PARAGRAPH, _SENTENCE = re.compile(r"\n[ \t]*\n"), re.compile(r"(?<=[.!?।॥])\s+")
_NOT_LATIN = re.compile("[^\u0000-ɏ]")


def tokens_of(text: str) -> int:
    if not text.strip():
        return 0
    other = len(_NOT_LATIN.findall(text))
    return max(1, round((len(text) - other) / 4 + other / 2))


def ranges(sizes: list[int], target: int, budget: float = 0) -> Iterator[tuple[int, int]]:
    """Index ranges [first, stop) of chunks over units of these sizes, from sums of sizes alone.

    A chunk goes on as long as its sum is within `target`, but takes at least one unit that no chunk has yet. The next
    one begins at the earliest later unit from which on the units of this one sum up to `budget` at most."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    first = stop = 0
    while stop < len(sizes):
        stop = max(stop + 1, int(np.searchsorted(total, total[first] + target, "right")) - 1)
        yield first, stop
        first = max(first + 1, int(np.searchsorted(total, total[stop] - budget)))


def units(text: str, target: int, cuts: tuple[re.Pattern, ...] = (_PARAGRAPH, _SENTENCE)) -> Iterator[str]:
    """Parts of the text within `target` tokens, as long as may be: paragraphs; of longer ones the sentences; of longer ones
    runs of words."""
    if not cuts:
        words = text.split()
        yield from (" ".join(words[i:j]) for i, j in ranges([tokens_of(w) for w in words], target))
        return
    for part in filter(None, (p.strip() for p in cuts[0].split(text))):
        yield from [part] if tokens_of(part) <= target else units(part, target, cuts[1:])


def chunk_text(text: str, target: int, overlap: float) -> list[str]:
    """Chunks of up to `target` tokens: units joined by an empty line, of which a chunk's first ones repeat up to `overlap` of
    the target from the end of the chunk before."""
    parts = list(units(text, target))
    return ["\n\n".join(parts[i:j]) for i, j in ranges([tokens_of(p) for p in parts], target, overlap * target)]


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, configs: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """(`id_col`, chunk_config, seq, text, content_hash): the chunks of every text under every configuration."""
    chosen = configs or CONFIGS
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (target, overlap) in chosen.items():
                at, seq, chunks = [], [], []
                for i, text in enumerate(batch.column(1)):
                    own = chunk_text(text.as_py() or "", target, overlap)
                    at += [i] * len(own)
                    seq += range(len(own))
                    chunks += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([name] * len(at), pa.string()), pa.array(seq, pa.int32()), pa.array(chunks, pa.string())], names=["id", "chunk_config", "seq", "text"])

    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(cut, f"id {kind}, chunk_config string, seq int, text string")
    return out.withColumnRenamed("id", id_col).withColumn("content_hash", F.sha2("text", 256))
