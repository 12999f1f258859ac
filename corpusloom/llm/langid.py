"""Language identification by unigrams with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all
ways to cut it into pieces, by the forward algorithm; that of a text is the product over its words. Piece probabilities
are learned by expectation maximisation: counts of words per language are summed by Spark, and each round sums the expected
counts of pieces over all segmentations (forward and backward) of all those words. A word is computed once per batch of
texts that has it, all words of a length together; nothing depends on how long a text is.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import free_name, materialize

UNDETERMINED = "und"
#: Folds by CRC-32 of the decimal id; fold 0 is held out.
FOLDS = 5
ROUNDS = 3
#: Letters of a stretch: longer runs of letters are cut, so that products of probabilities stay within a double's range.
STRETCH = 32
SCALE, _LEAST = 20.0, 1e-300
#: Strength of the prior, in pieces: a language's rare pieces lean on what all languages together say of them.
PRIOR = 200.0
#: Different tokens that a task remembers, and words that it counts before it sends them.
REMEMBERED = 600_000
_START = "▁"  # the vocabulary's mark of a word's start
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def public_pieces(path: str | None = None) -> list[str]:
    """Pieces of letters of a sentencepiece model, by default the installed public one: cased pieces are dropped, since texts are
    lower-cased."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and regex.fullmatch(r"▁?[\p{L}\p{M}]+|▁", p)})


def stretches(token: str) -> list[str]:
    """The token's runs of letters, marked as starts of words and cut where they are too long."""
    own = token if token.isalpha() else token[:-1]
    if own.isalpha() and (own is token or token[-1] < "\x80") and len(low := own.lower()) < STRETCH:  # one run, as most tokens are
        return [_START + low]
    return [(_START + run)[i : i + STRETCH] for run in _RUN.findall(token.lower()) for i in range(0, len(run) + 1, STRETCH)]


class Lattice:
    """Pieces by hash, and forward and backward sums over all segmentations of many words at once. A character that is no piece
    is spelled by the pieces of its UTF-8 bytes, which come after the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        lengths = np.array([len(p) for p in pieces], np.int64)
        codes = np.zeros((len(pieces), self.longest), np.uint64)
        for i, p in enumerate(pieces):
            codes[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.tables, h = {}, np.zeros(len(pieces), np.uint64)
        for size in range(1, self.longest + 1):
            h = self._step(h, codes[:, size - 1])
            begins, own = np.flatnonzero(lengths >= size), np.flatnonzero(lengths == size)
            order = own[np.argsort(h[own])]
            assert len(np.unique(h[own])) == len(own), "two pieces have one hash"
            begun, whole = np.zeros((2, 1 << 20), bool)
            begun[h[begins] >> np.uint64(44)] = True
            whole[h[own] >> np.uint64(44)] = True
            self.tables[size] = (begun, whole, h[order], order)

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hashes of stretches that are longer by a character each."""
        h = ((h ^ code) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(31))

    def arcs(self, words: list[str]) -> list[tuple[np.ndarray, int, int, np.ndarray]]:
        """Of words of one length: (rows, start, end, piece) per stretch of characters that is a piece of some of them, in the order
        of the ends. Characters that are no piece are numbered -1 - code. From each start only words go on of which what is read
        so far may begin a piece."""
        length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).T.astype(np.uint64)
        by_end: list[list] = [[] for _ in range(length + 1)]
        for start in range(length):
            rows, h = np.arange(len(words)), np.zeros(len(words), np.uint64)
            for size in range(1, min(self.longest, length - start) + 1):
                begun, whole, keys, ids = self.tables[size]
                h = self._step(h, codes[start + size - 1][rows])
                at = h >> np.uint64(44)
                alive, maybe = begun[at], np.flatnonzero(whole[at])
                found = np.searchsorted(keys, h[maybe])
                same = keys[np.minimum(found, len(keys) - 1)] == h[maybe] if len(keys) else np.zeros(0, bool)
                hit, piece = rows[maybe[same]], ids[found[same]]
                if size == 1:
                    rest = np.ones(len(words), bool)
                    rest[hit] = False
                    hit = np.concatenate([hit, np.flatnonzero(rest)])
                    piece = np.concatenate([piece, -1 - codes[start][rest].astype(np.int64)])
                if len(hit):
                    by_end[start + size].append((hit, start, start + size, piece))
                if not alive.all():
                    rows, h = rows[alive], h[alive]
                    if not len(rows):
                        break
        return [arc for own in by_end for arc in own]

    def spelled(self, code: int) -> list[int]:
        return [self.n + b for b in chr(code).encode()]

    def scales(self, chances: np.ndarray, arcs: list, words: int, length: int) -> np.ndarray:
        """Per word and place, the log of a factor that keeps sums up to there within a double's range: each character counts for
        SCALE, or what all languages give its bytes. Factors are the same for every language and segmentation. One row for all
        words if none has a character that is no piece."""
        unknown = [(rows, end, found) for rows, start, end, found in arcs if end - start == 1 and found.min() < 0]
        pooled, out = chances.mean(axis=1), np.full((words if unknown else 1, length + 1), math.log(SCALE))
        out[:, 0] = 0
        for rows, end, found in unknown:
            at = found < 0
            codes, back = np.unique(found[at], return_inverse=True)
            out[rows[at], end] = np.array([-np.log(pooled[self.spelled(int(-1 - c))]).sum() for c in codes])[back]
        return out.cumsum(axis=1)

    @staticmethod
    def factors(scale: np.ndarray, rows: np.ndarray, start: int, end: int) -> np.ndarray | float:
        if len(scale) == 1:
            return math.exp(scale[0, end] - scale[0, start])
        return np.exp(scale[rows, end] - scale[rows, start])

    def weights(self, chances: np.ndarray, found: np.ndarray, lang: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of pieces as arcs() numbers them, per language or in that of each."""
        out = chances[np.maximum(found, 0)] if lang is None else chances[np.maximum(found, 0), lang]
        if found.min() < 0:
            spelled = np.flatnonzero(found < 0)
            codes, back = np.unique(found[spelled], return_inverse=True)
            rows = np.array([chances[self.spelled(int(-1 - c))].prod(axis=0) for c in codes])[back]
            out[spelled] = rows if lang is None else rows[np.arange(len(spelled)), lang[spelled]]
        return out


@functools.lru_cache(2)
def _lattice(pieces: tuple[str, ...]) -> Lattice:
    """Made once per worker: its tables are many times the size of the pieces, which is what tasks are sent."""
    return Lattice(list(pieces))


def _by_length(words: Iterable[str], languages: int = 1) -> Iterator[list[int]]:
    """Positions of the words, those of one length together, in groups of a bounded size: sums are kept per language."""
    most = max(500, 80_000 // max(4, languages))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for own in groups.values():
        yield from (own[i : i + most] for i in range(0, len(own), most))


def log_chances(lattice: Lattice, chances: np.ndarray, words: list[str]) -> np.ndarray:
    """Per word and language, the log of the sum over all segmentations."""
    out = np.zeros((len(words), chances.shape[1]))
    for own in _by_length(words, chances.shape[1]):
        held = [words[i] for i in own]
        forward = np.zeros((len(held[0]) + 1, len(held), chances.shape[1]))
        forward[0] = 1.0
        arcs = lattice.arcs(held)
        scale = lattice.scales(chances, arcs, len(held), len(held[0]))
        for rows, start, end, found in arcs:
            factor = lattice.factors(scale, rows, start, end)
            forward[end, rows] += forward[start, rows] * lattice.weights(chances, found) * (factor if isinstance(factor, float) else factor[:, None])
        out[own] = np.log(np.maximum(forward[-1], _LEAST)) - scale[:, -1:]
    return out


def expected_pieces(lattice: Lattice, chances: np.ndarray, words: list[str], languages: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(pieces and bytes) x languages: expected counts over all segmentations of words that occur `counts` times in a language."""
    out = np.zeros_like(chances)
    for own in _by_length(words):
        held, lang, n = [words[i] for i in own], languages[own], counts[own]
        arcs = lattice.arcs(held)
        forward, backward = np.zeros((2, len(held[0]) + 1, len(held)))
        forward[0] = backward[-1] = 1.0
        scale = lattice.scales(chances, arcs, len(held), len(held[0]))
        weights = [lattice.weights(chances, found, lang[rows]) * lattice.factors(scale, rows, start, end) for rows, start, end, found in arcs]
        for (rows, start, end, _), w in zip(arcs, weights, strict=True):
            forward[end, rows] += forward[start, rows] * w
        for (rows, start, end, _), w in zip(reversed(arcs), reversed(weights), strict=True):
            backward[start, rows] += backward[end, rows] * w
        share = n / np.maximum(forward[-1], _LEAST)
        for (rows, start, end, found), w in zip(arcs, weights, strict=True):
            used = forward[start, rows] * w * backward[end, rows] * share[rows]
            whole = found >= 0
            np.add.at(out.reshape(-1), found[whole] * out.shape[1] + lang[rows][whole], used[whole])
            for code in np.unique(found[~whole]):
                at = found == code
                sums = np.bincount(lang[rows][at], used[at], out.shape[1])
                for b in lattice.spelled(int(-1 - code)):
                    out[b] += sums
    return out


@dataclass(frozen=True)
class Model:
    """What was learned: languages in order, the log of their share of the documents, and probabilities of pieces and bytes."""

    languages: list[str]
    shares: np.ndarray
    pieces: list[str]
    chances: np.ndarray


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document is in the fold that nothing is learned from; one without an id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % FOLDS == 0, F.lit(True))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of `docs` (lang, text): counted per task first, so that a frequent word moves once a task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def words() -> Iterator[pa.RecordBatch]:
            for lang, tokens in held.items():
                found: Counter = Counter()
                for token, n in tokens.items():
                    for w in stretches(token):
                        found[w] += n
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(text.as_py().lower().split())
                if sum(map(len, held.values())) > REMEMBERED:
                    yield from words()
                    held = {}
        yield from words()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", pieces: list[str] | None = None, rounds: int = ROUNDS) -> Model:
    """A model of the languages of `docs`, learned from all rows whose text and language aren't null, whole texts.

    Rows that repeat count as often as they are there. A table without such rows gives a model without languages. To the driver
    comes a number per piece and language, as does the model to each task: both are bounded by the vocabulary and the languages.
    """
    pieces = public_pieces() if pieces is None else pieces
    sent = tuple(pieces)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    seen = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    languages, shares = [r["lang"] for r in seen], np.log([r["count"] for r in seen]) - math.log(max(1, sum(r["count"] for r in seen)))
    size = len(pieces) + 256
    chances = np.full((size, len(languages)), 1.0 / size)
    if not languages:
        return Model([], shares, pieces, chances)
    words = materialize(_word_counts(rows))
    number = {lang: i for i, lang in enumerate(languages)}
    for _ in range(rounds):

        def expect(batches: Iterable[pa.RecordBatch], now: np.ndarray = chances) -> Iterator[pa.RecordBatch]:
            sums, lattice = np.zeros_like(now), _lattice(sent)
            for batch in batches:
                own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                sums += expected_pieces(lattice, now, batch.column("word").to_pylist(), own, batch.column("n").to_numpy().astype(float))
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(sums[piece, lang])], names=["piece", "language", "n"])

        got = words.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros_like(chances)
        sums[got["piece"].to_numpy(), got["language"].to_numpy()] = got["n"].to_numpy()
        pooled = sums.sum(axis=1, keepdims=True) + 0.1
        chances = (sums + PRIOR * pooled / pooled.sum()) / (sums.sum(axis=0) + PRIOR)
    return Model(languages, shares, pieces, chances)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score: the likeliest language of the whole text and its probability among the model's languages.

    A null text and one without a letter are `und` with a score of 0, as is every text if the model knows no language. Of
    equally likely languages the first by name counts. Rows that repeat get equal results; columns of these names are replaced,
    all others kept. Neither language nor source nor id is looked at.
    """
    name = free_name(docs, "_text")
    docs = docs.drop("lang_pred", "score").withColumn(name, F.col(text_col))
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent, many = tuple(model.pieces), len(model.languages)
    chances, shares, languages = model.chances, model.shares, model.languages

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(sent)
        place: dict[str, int] = {}
        table = np.zeros((0, many + 1))  # of each known token: log chances, and how many stretches it has
        known: dict[str, int] = {}  # likewise of words, which tokens with different marks around them share
        logs_of = np.zeros((0, many))
        for batch in batches:
            found = []
            for part in _slices(batch, batch.schema.get_field_index(name)):
                tokens = [(t or "").lower().split() for t in part]
                new = set().union(*tokens) - place.keys()
                if len(place) + len(new) > REMEMBERED:
                    place, table, new = {}, table[:0], set().union(*tokens)
                    known, logs_of = {}, logs_of[:0]
                owners, words = [], []
                for i, token in enumerate(new, len(place)):
                    place[token] = i
                    own = stretches(token)
                    words += own
                    owners += [i] * len(own)
                table = np.concatenate([table, np.zeros((len(new), many + 1))])
                unseen = list(set(words) - known.keys())
                if unseen:
                    known |= zip(unseen, range(len(known), len(known) + len(unseen)), strict=True)
                    logs_of = np.concatenate([logs_of, log_chances(lattice, chances, unseen)])
                if words:
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    np.add.at(table, np.array(owners), np.concatenate([logs_of[at], np.ones((len(at), 1))], axis=1))
                for own in tokens:
                    total = table[np.fromiter(map(place.__getitem__, own), np.int64, len(own))].sum(axis=0)
                    if not total[-1] or not many:
                        found.append((UNDETERMINED, 0.0))
                        continue
                    logs = total[:-1] + shares
                    best = int(np.argmax(logs))
                    found.append((languages[best], float(1 / np.exp(logs - logs[best]).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.fieldNames())

    return docs.mapInArrow(judge, schema)


def _slices(batch: pa.RecordBatch, at: int, limit: int = 8 << 20) -> Iterator[list[str | None]]:
    """The texts of a batch, in lists of about `limit` characters."""
    held, size = [], 0
    for value in batch.column(at):
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
