"""Texts that a model rewrites: names locked before, checked and unlocked after; what it leaks undone."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCK = re.compile(r"\[\[T(\d+)\]\]")
_PLACES = re.compile(r"(\*\*)?\[\[T(\d+)\]\](\*\*)?")
_BOLD_SPAN = re.compile(r"\*\*(.+?)\*\*")
# fixed values: phrases of an answer about the task in place of the task; the token of an answer that declines; the mark of an
# intent line
META_PHRASES = ("rewrite", "rewritten text", "placeholder", "guidelines", "provide the input", "input text", "surface realization")
DECLINED, INTENT = "NO_MATCH", "INTENT: "
# fixed values: bounds of the checks
LONGEST_WORD, WORD_GROWTH, NATIVE_BEFORE, NATIVE_AFTER, SHORTEST, LONGEST = 30, 10, 0.20, 0.10, 0.3, 2.5
REASONS = ("locked_altered", "bold_lost", "unknown_lock", "new_bold", "list_changed", "decline_dropped", "words_glued", "script_flipped", "about_the_task", "length", "intent_dropped", "intent_altered")


def _folds() -> dict[int, str]:
    """A character for each that has a case, the same for all that `re` takes for equal when case doesn't matter: those that share
    their upper case, with the dotted capital I as a plain one."""
    first, out = {}, {}
    for n in range(sys.maxunicode + 1):
        c = "I" if n == 0x130 else chr(n)
        if c.lower() != c or c.upper() != c:
            out[n] = first.setdefault(c.lower().upper(), c.lower())
    return out


_FOLDS = _folds()
#: What str.lower does not fold alike; a surrogate, which no text in a table has.
_UNEVEN, _TAKEN = re.compile("[" + re.escape("".join(chr(n) for n, c in _FOLDS.items() if chr(n).lower() != c or chr(n) == "Σ")) + "]"), "\ud800"


def _folded(text: str) -> str:
    return text.translate(_FOLDS) if _UNEVEN.search(text) else text.lower()


def _places(text: str, name: str) -> list[int]:
    """Where a folded name stands in a folded text, from left to right and not over itself; a number not within a longer one."""
    out, at, digits = [], text.find(name), name.isdecimal()
    while at >= 0:
        stop = at + len(name)
        inside = digits and (text[at - 1 : at].isdecimal() or text[stop : stop + 1].isdecimal())
        if not inside:
            out.append(at)
        at = text.find(name, at + 1 if inside else stop)
    return out


def locked(text: str, entities: Iterable[str | None]) -> tuple[str, dict[str, str]]:
    """The text with its names locked, and the locks that are in it. What a name has taken is marked in a folded copy, of the same
    length as the text, so each name costs one search; the text is put together once."""
    left, taken, found = _folded(text), [], {}
    for m in _LOCK.finditer(text):  # what is locked already is passed over
        left = left[: m.start()] + _TAKEN * len(m[0]) + left[m.end() :]
    for n, name in enumerate(sorted({e for e in entities if e}, key=lambda e: (-len(e), e)), 1):
        plain = _folded(name)
        if places := _places(left, plain):
            found[f"[[T{n}]]"] = name
            taken += [(at, at + len(plain), f"[[T{n}]]") for at in places]
            kept = zip([0, *(at + len(plain) for at in places)], [*places, len(left)], strict=True)
            left = (_TAKEN * len(plain)).join(left[start:stop] for start, stop in kept)
    out, at = [], 0
    for start, stop, lock in sorted(taken):
        out += [text[at:start], lock]
        at = stop
    return "".join([*out, text[at:]]), found


@F.arrow_udf(T.StructType().add("locked", T.StringType()).add("names", T.MapType(T.StringType(), T.StringType())))
def lock(texts: pa.Array, entities: pa.Array) -> pa.Array:
    """Each name replaced by [[Tn]], in any case, the longest first; digits only where no digit stands beside them. names: the locks
    that are in the text. A null text gives nulls."""
    out = []
    for text, own in zip(texts.to_pylist(), entities.to_pylist(), strict=True):
        after, found = (None, None) if text is None else locked(text, own or ())
        out.append({"locked": after, "names": None if found is None else list(found.items())})
    return pa.array(out, pa.struct([("locked", pa.string()), ("names", pa.map_(pa.string(), pa.string()))]))


def unlock(text: Column, names: Column) -> Column:
    """Locks replaced by the names that they stand for; unknown ones stay. Names aren't looked at again."""
    return _unlocked(text, names)


@F.arrow_udf(T.StringType())
def _unlocked(texts: pa.Array, names: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), names.to_pylist(), strict=True):
        known = dict(own or ())
        out.append(None if text is None else _LOCK.sub(lambda m, known=known: known.get(m[0], m[0]), text))
    return pa.array(out, pa.string())


def _native_share(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(c >= "ऀ" for c in letters) / len(letters) if letters else 0.0


def reasons(before: str, after: str, names: dict[str, str], with_intent: bool) -> list[tuple[str, str]]:
    """(reason, detail) of everything that a rewrite has done to a locked text and may not: one pass over the locks of either side,
    then one check each of what is written around them."""
    count, bold = {}, {}
    for side, text in (("before", before), ("after", after)):
        places = [(m[2], bool(m[1] and m[3])) for m in _PLACES.finditer(text)]
        count[side] = Counter(f"[[T{n}]]" for n, _ in places)
        bold[side] = Counter(f"[[T{n}]]" for n, b in places if b)
    out = [("locked_altered", t) for t in names if count["before"][t] != count["after"][t]]
    out += [("bold_lost", t) for t in names if bold["before"][t] > bold["after"][t]]
    out += [("unknown_lock", t) for t in sorted(count["after"].keys() - names.keys())]
    out += [("new_bold", s) for s in _BOLD_SPAN.findall(after) if not _LOCK.fullmatch(s.strip())]
    items = [sum(line.startswith("- ") for line in t.splitlines()) for t in (before, after)]
    if items[0] and items[0] != items[1]:
        out.append(("list_changed", f"{items[0]} to {items[1]}"))
    if DECLINED in before and DECLINED not in after:
        out.append(("decline_dropped", DECLINED))
    longest = [max(map(len, t.split()), default=0) for t in (before, after)]
    if longest[1] > max(longest[0] + WORD_GROWTH, LONGEST_WORD):
        out.append(("words_glued", str(longest[1])))
    if _native_share(before) >= NATIVE_BEFORE and _native_share(after) < NATIVE_AFTER:
        out.append(("script_flipped", ""))
    if said := [p for p in META_PHRASES if p in after.casefold()]:
        out.append(("about_the_task", said[0]))
    if before.strip() and after.strip() and not SHORTEST <= len(after) / len(before) <= LONGEST:
        out.append(("length", f"{len(after) / len(before):.2f}"))
    if with_intent:
        heads = [t.split("\n", 1)[0] for t in (before, after)]
        if not heads[1].startswith(INTENT):
            out.append(("intent_dropped", heads[1]))
        elif heads[0] != heads[1]:
            out.append(("intent_altered", heads[1]))
    return out


@F.arrow_udf(T.ArrayType(T.StructType().add("reason", T.StringType()).add("detail", T.StringType())))
def _reasons(before: pa.Array, after: pa.Array, names: pa.Array, intent: pa.Array) -> pa.Array:
    rows = zip(before.to_pylist(), after.to_pylist(), names.to_pylist(), intent.to_pylist(), strict=True)
    out = [[{"reason": r, "detail": d} for r, d in reasons(b or "", a or "", dict(n or ()), bool(i))] for b, a, n, i in rows]
    return pa.array(out, pa.list_(pa.struct([("reason", pa.string()), ("detail", pa.string())])))


def rewrite_issues(rows: DataFrame, id_col: str, before: str = "locked", after: str = "rewritten", names: str = "names", with_intent: Column | None = None) -> DataFrame:
    """(`id_col`, reason, detail): a row per reason for which a rewrite is rejected; what has none is accepted. Null texts count as
    empty, null names as none."""
    found = _reasons(F.col(before), F.col(after), F.col(names), with_intent if with_intent is not None else F.lit(False))
    return rows.select(id_col, F.explode(found).alias("_r")).select(id_col, "_r.reason", "_r.detail")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable in Latin-1, and those from
    256 on for the others, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_OF = {c: b for b, c in byte_characters().items()}
_LEAKED = re.compile("[" + re.escape("".join(_BYTE_OF)) + "]+")


def undo_bytes(text: str) -> str:
    """A text with leaked byte-level tokens as the text that they spell. It counts as leaked if a blank's or a line feed's
    character is in it. Of each run of such characters what is UTF-8 is decoded; bytes of a sequence that is cut off, and
    characters of no byte, stay as they are."""
    if _BLANK not in text and _FEED not in text:
        return text

    def spelled(m: re.Match) -> str:
        data, out, at = bytes(_BYTE_OF[c] for c in m[0]), [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [data[at : at + e.start].decode(), m[0][at + e.start : at + e.end]]
                at += e.end
        return "".join(out)

    return _LEAKED.sub(spelled, text)


_BLANK, _FEED = byte_characters()[32], byte_characters()[10]


@F.arrow_udf(T.StringType())
def _undone(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else undo_bytes(t) for t in texts.to_pylist()], pa.string())


def leaked(text: Column) -> Column:
    """A text as the byte-level characters of its bytes: these read as Latin-1, and each translated."""
    by = byte_characters()
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(map(chr, by)), "".join(by.values()))


def clean_answer(text: Column) -> Column:
    """Leaked tokens undone; without white space around, what stands up to the last end of a think block, and a pair of quotes
    around all of it."""
    strip = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    said = strip(F.substring_index(strip(_undone(text)), "</think>", -1))
    first, last = F.substring(said, 1, 1), F.substring(said, -1, 1)
    return F.when((F.length(said) >= 2) & (first == last) & first.isin(*"\"'“”"), strip(F.substring(said, F.lit(2), F.length(said) - 2))).otherwise(said)
