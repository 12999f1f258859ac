"""JSON of any shape and depth, changed or read string by string in Arrow batches. The tree is walked with a stack of its own, so
depth costs no recursion; text that isn't JSON gives null."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import FLAG_PATTERNS, LOOKALIKES, ZERO_WIDTH

# fixed values: what replaces a blank in data, and a withheld string
DATAMARK, WITHHELD = "ˆ", "[content withheld: failed safety check]"
_PLAIN = {ord(a): b for a, b in zip(*LOOKALIKES, strict=True)} | {ord(c): None for c in ZERO_WIDTH}
_PATTERNS = [(name, re.compile(p)) for name, p in FLAG_PATTERNS.items()]


def parse(text: str | None) -> object:
    """The value of a JSON text; ValueError for anything else, and for what is nested too deeply to be read."""
    try:
        return json.loads(text if text is not None else "")
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def strings(tree: list | dict) -> Iterator[tuple[list | dict, str | int, str | None, str]]:
    """(holder, place in it, key, value) of every string value, in the order in which they stand; keys aren't values. A string
    in a list has no key."""
    todo: list = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            holder, place = node
            yield holder, place, place if isinstance(holder, dict) else None, holder[place]
            continue
        items = node.items() if isinstance(node, dict) else enumerate(node)
        todo += reversed([(node, place) if isinstance(value, str) else value for place, value in items if isinstance(value, str | list | dict)])


def rewritten(text: str | None, change: Callable[[str | None, str], str]) -> tuple[str | None, int]:
    """The JSON with every string value replaced by change(key, value), and how many differ."""
    try:
        tree = [parse(text)]
    except ValueError:
        return None, 0
    changed = 0
    for holder, place, key, value in strings(tree):
        holder[place] = change(key, value)
        changed += holder[place] != value
    try:
        return json.dumps(tree[0], ensure_ascii=False), changed
    except RecursionError:
        return None, 0


def _shape(tree: object) -> Iterator[tuple]:
    """What a tree is made of, in a fixed order: types of values, keys, lengths of lists."""
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            keys = sorted(node)
            yield "object", *keys
            todo += [node[k] for k in reversed(keys)]
        elif isinstance(node, list):
            yield "array", len(node)
            todo += reversed(node)
        else:
            yield (type(node).__name__,)


def _flags(value: str) -> list[str]:
    """Classes of instructions that a string holds, as it is or normalised."""
    plain = unicodedata.normalize("NFKC", value).translate(_PLAIN)
    return [name for name, p in _PATTERNS if p.search(value) or p.search(plain)]


@F.arrow_udf(T.StructType().add("content", T.StringType()).add("warnings", T.ArrayType(T.StringType())))
def spotlight(payloads: pa.Array) -> pa.Array:
    """A result's JSON as it may stand before a model: blanks of string values are marked, strings that hold instructions are
    withheld, with a warning each that names the classes. Numbers, keys and structure stay."""
    out = []
    for text in payloads.to_pylist():
        warnings: list[str] = []

        def mark(key: str | None, value: str, warnings: list[str] = warnings) -> str:
            found = _flags(value)
            if found:
                warnings.append(f"withheld: {', '.join(found)}")
                return WITHHELD
            return value.replace(" ", DATAMARK)

        content = rewritten(text, mark)[0]
        out.append({"content": content, "warnings": warnings if content is not None else None})
    return pa.array(out, pa.struct([("content", pa.string()), ("warnings", pa.list_(pa.string()))]))


@F.arrow_udf(T.StructType().add("content", T.StringType()).add("changed", T.IntegerType()).add("same_shape", T.BooleanType()))
def _spliced(payloads: pa.Array, added: pa.Array, fields: pa.Array) -> pa.Array:
    out = []
    for text, more, own in zip(payloads.to_pylist(), added.to_pylist(), fields.to_pylist(), strict=True):
        keys = set(own or ())
        put = lambda key, value, more=more, keys=keys: f"{value} {more}" if more is not None and key in keys else value
        content, changed = rewritten(text, put)
        same = content is not None and list(_shape(parse(text))) == list(_shape(parse(content)))
        out.append({"content": content, "changed": changed, "same_shape": same if content is not None else None})
    return pa.array(out, pa.struct([("content", pa.string()), ("changed", pa.int32()), ("same_shape", pa.bool_())]))


# fixed values: fields of results that hold text
TEXT_FIELDS = ("title", "matched_title", "canonical_title", "overview")


def splice(payload: Column, added: Column, field: Column | None = None) -> Column:
    """struct(content, changed, same_shape): `added` put behind the string values of text fields, at any depth, or of the one that
    `field` names; how many changed, and whether types, keys and lengths are what they were. Strings in a list stay."""
    every = F.array(*map(F.lit, TEXT_FIELDS))
    chosen = every if field is None else F.when(field.isNull() | (field == ""), every).otherwise(F.filter(every, lambda x: x == field))
    return _spliced(payload, added, chosen)


@F.arrow_udf(T.BooleanType())
def same_shape(before: pa.Array, after: pa.Array) -> pa.Array:
    """Whether two JSON texts differ in the values of leaves alone; null if one isn't JSON."""
    out = []
    for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True):
        try:
            out.append(list(_shape(parse(a))) == list(_shape(parse(b))))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _collected(payloads: pa.Array, keys: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(payloads.to_pylist(), keys.to_pylist(), strict=True):
        try:
            tree = [parse(text)]
        except ValueError:
            out.append(None)
            continue
        out.append(list(dict.fromkeys(v for holder, place, _, v in strings(tree) if isinstance(holder, dict) and place in own)))
    return pa.array(out, pa.list_(pa.string()))


def collect(payload: Column, *keys: str) -> Column:
    """The string values of these keys at any depth, each once, as they come. What looks like a key inside a string isn't one."""
    return _collected(payload, F.array(*map(F.lit, keys)))
