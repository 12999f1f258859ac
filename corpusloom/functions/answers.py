"""JSON objects at the start of a model's answer, whatever follows them."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: marks of a code block around an answer, at the start and at the end of a line
FENCES = r"(?dm)^```(?:json)?\s*|\s*```$"


def object_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each stretch of bytes, where the bracket that it begins with is closed again (the place after it), or -1. Brackets in
    strings don't count, nor do quotes behind a backslash. All stretches, which follow one another, are gone through at once."""
    n = len(data)
    if not n:
        return np.full(len(starts), -1, np.int64)
    at = np.arange(n)
    row = np.repeat(np.arange(len(starts)), stops - starts)
    begin = starts[row]
    plain = np.maximum(np.maximum.accumulate(np.where(data != ord("\\"), at, -1)), begin - 1)  # the last byte that is no backslash
    before = np.where(at > begin, plain[at - 1], at - 1)
    quote = (data == ord('"')) & ((at - 1 - before) % 2 == 0)
    quotes = np.cumsum(quote) - quote
    inside = (quotes - quotes[begin]) % 2 == 1
    opens = ((data == ord("{")) | (data == ord("["))) & ~inside
    closes = ((data == ord("}")) | (data == ord("]"))) & ~inside
    depth = np.cumsum(opens.astype(np.int64) - closes)
    depth -= np.where(begin > 0, depth[begin - 1], 0)
    last = np.flatnonzero(closes & (depth == 0))
    found = np.searchsorted(last, starts)
    known = found < len(last)
    end = np.where(known, last[np.minimum(found, max(0, len(last) - 1))] if len(last) else -1, n)
    bracket = np.isin(data[np.minimum(starts, n - 1)], [ord("{"), ord("[")])
    return np.where(known & (end < stops) & (stops > starts) & bracket, end + 1, -1)


@F.arrow_udf(T.StringType())
def _prefix(texts: pa.Array) -> pa.Array:
    """The well-formed JSON object that each text begins with; null where there is none."""
    texts = pa.concat_arrays([texts])
    flat = b"".join(t.encode() for t in texts.to_pylist() if t)
    sizes = np.array([len(t.encode()) if t else 0 for t in texts.to_pylist()], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for start, end in zip(starts.tolist(), object_ends(np.frombuffer(flat, np.uint8), starts, starts + sizes).tolist(), strict=True):
        try:
            found = flat[start:end].decode() if end >= 0 and flat[start : start + 1] == b"{" else None
            out.append(found if found is not None and isinstance(json.loads(found), dict) else None)
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.string())


def first_object(answer: Column) -> Column:
    """The JSON object that an answer begins with, white space and marks of a code block apart. What follows it doesn't matter;
    nothing is repaired, so an object that is cut off, or anything else at the start, gives null."""
    return _prefix(F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"(?U)^\s+|\s+$", ""), FENCES, ""), r"(?U)^\s+", ""))


_TEXTS = ["edge_type", "src_title", "src_language", "dst_title", "dst_language", "supporting_sentence"]
_EDGE = T.StructType([*(T.StructField(f, T.StringType()) for f in _TEXTS), T.StructField("confidence", T.DoubleType())])
# fixed values: kinds of edges that an answer may propose
EDGE_TYPES = ("is_remake_of", "is_official_dub_of", "is_sequel_of", "based_on")


def _proposal(x: object) -> dict | None:
    """A proposed edge with its fields checked; None if one is amiss."""
    if not isinstance(x, dict) or x.get("edge_type") not in EDGE_TYPES:
        return None
    text = lambda name, least: isinstance(x.get(name), str) and len(x[name]) >= least
    languages = all(x.get(name) is None or isinstance(x[name], str) for name in ("src_language", "dst_language"))
    try:
        confidence = float(x["confidence"])
    except (KeyError, TypeError, ValueError, OverflowError):
        return None
    if not (text("src_title", 1) and text("dst_title", 1) and text("supporting_sentence", 10) and languages and 0 <= confidence <= 1):
        return None
    return {k: x.get(k) for k in _TEXTS} | {"confidence": confidence}


@F.arrow_udf(T.ArrayType(_EDGE))
def proposals(objects: pa.Array) -> pa.Array:
    """The proposed edges of `{"relationships": [...]}`; null if a field of any of them is amiss, as nothing is repaired."""
    kind = pa.list_(pa.struct([*((f, pa.string()) for f in _TEXTS), ("confidence", pa.float64())]))
    out = []
    for text in objects.to_pylist():
        got = json.loads(text).get("relationships") if text is not None else None
        rows = [_proposal(x) for x in got] if isinstance(got, list) else [None]
        out.append(None if any(r is None for r in rows) else rows)
    return pa.array(out, kind)
