"""Title keys and fuzzy ratios, in Arrow batches where Spark has no function for a step."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH_THRESHOLD = 0.80
_NOT_WORD = re.compile(r"[^\w\s]|_")
_REPEAT = re.compile(r"(.)\1+")
# fixed values: letters of the shared layout of the Indic blocks (offset in a block of 128: Latin form), after the published code charts
_CONSONANTS = {0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "zh", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h"}
_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
_OTHER = {0x01: "n", 0x02: "n", 0x03: "h"}
_VIRAMA, _FIRST, _LAST = 0x4D, 0x0900, 0x0D7F
_FINAL_SCHWA_DROPPED = (0x0900, 0x0980)


def romanize(text: str) -> str:
    """Indic letters in Latin ones: a consonant carries an a unless a sign or the virama follows; at a word's end, Devanagari
    and Bengali drop it."""
    out: list[str] = []
    chars = list(text)
    for i, c in enumerate(chars):
        code = ord(c)
        if not _FIRST <= code <= _LAST:
            out.append(c)
            continue
        block, at = code - code % 0x80, code % 0x80
        follow = ord(chars[i + 1]) if i + 1 < len(chars) else 0
        follow_at = follow % 0x80 if _FIRST <= follow <= _LAST else -1
        if at in _CONSONANTS:
            ends = follow_at < 0 and not (follow and chr(follow).isalnum())
            schwa = not (follow_at in _SIGNS or follow_at == _VIRAMA or (ends and block in _FINAL_SCHWA_DROPPED and i and chars[i - 1].strip()))
            out.append(_CONSONANTS[at] + ("a" if schwa else ""))
        else:
            out.append(_VOWELS.get(at) or _SIGNS.get(at) or _OTHER.get(at) or "")
    return "".join(out)


def fold(text: str) -> str:
    """Case folded, marks stripped, punctuation as blanks, repeated characters and blanks collapsed."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(_REPEAT.sub(r"\1", _NOT_WORD.sub(" ", bare)).split())


def key_of(title: str | None) -> str | None:
    return None if title is None else fold(romanize(unicodedata.normalize("NFC", title)))


@F.pandas_udf(T.StringType())
def match_key(titles: pd.Series) -> pd.Series:
    """The key that titles are compared by. Equal titles are computed once a batch."""
    known = {t: key_of(t) for t in titles.unique()}
    return titles.map(known)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of `a` at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


class Texts:
    """Many texts, to be compared with one at a time: all of them advance by a character together."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.chars, self.codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)

    def lcs(self, a: str) -> np.ndarray:
        """Length of the longest common subsequence of `a` with each text: bit i of a text's state is 0 where its part so far
        has one more character in common with a[: i + 1] than with a[:i]."""
        size = -(-len(a) // 64)
        masks = np.zeros((size, len(self.chars)), np.uint64)
        own = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.chars, own)
        known = np.flatnonzero(np.append(self.chars, 0)[at] == own) if len(self.chars) else np.zeros(0, np.int64)
        np.bitwise_or.at(masks, (known // 64, at[known]), np.uint64(1) << (known % 64).astype(np.uint64))
        state = np.full((size, len(self.lengths)), np.uint64(2**64 - 1))
        active = np.searchsorted(-self.lengths, -np.arange(self.lengths[0] if len(self.lengths) else 0), "left")  # texts longer than that
        for t, n in enumerate(active.tolist()):
            code = self.codes[self.starts[:n] + t]
            carry = np.zeros(n, np.uint64)
            for now, mask in zip(state, masks, strict=True):
                now = now[:n]
                hit = now & mask[code]
                added = now + hit
                over = added < hit
                added += carry
                carry = (over | (added < carry)).astype(np.uint64)
                np.bitwise_or(added, now & ~hit, out=now)
        out = np.empty(len(self.lengths), np.int64)
        rest = np.uint64(2**64 - 1) >> np.uint64(-len(a) % 64)
        keep = np.array([2**64 - 1] * (size - 1) + [int(rest)] * (size > 0), np.uint64)
        out[self.order] = np.bitwise_count(~state & keep[:, None]).sum(0, dtype=np.int64)
        return out

    def ratios(self, a: str) -> np.ndarray:
        total = np.empty(len(self.lengths), np.int64)
        total[self.order] = self.lengths + len(a)
        return np.where(total > 0, 2 * self.lcs(a) / np.maximum(1, total), 1.0)


def ratio(a: str, b: str) -> float:
    """2 LCS / (length + length), which is 1 for two empty strings."""
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def length_bound(a: Column, b: Column, threshold: float) -> Column:
    """True for all pairs that can reach the ratio: the shorter is threshold / (2 - threshold) of the longer, at least."""
    return F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b)) * (threshold / (2 - threshold)) - 1e-9
