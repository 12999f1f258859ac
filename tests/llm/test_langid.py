import math
import zlib

import numpy as np
import pytest
from corpusloom.llm import langid
from corpusloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def cuts(word):
    """Every way to cut a word."""
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in cuts(word[i:]):
            yield [word[:i], *rest]


@pytest.fixture(scope="module")
def small():
    pieces = ["▁", "▁a", "a", "ab", "b", "bab", "▁ba", "é"]
    chances = np.random.default_rng(5).random((len(pieces) + 256, 3))
    return langid.Lattice(pieces), pieces, chances / chances.sum(axis=0)


def chance(pieces, chances, cut, lang):
    out = 1.0
    for p in cut:
        if p in pieces:
            out *= chances[pieces.index(p), lang]
        elif len(p) == 1:
            out *= math.prod(chances[len(pieces) + b, lang] for b in p.encode())
        else:
            return 0.0
    return out


WORDS = ["▁ab", "▁bab", "▁babab", "▁", "▁é", "▁xé", "▁世a", "ab"]


def test_forward_sums_all_segmentations(small):
    lattice, pieces, chances = small
    got = langid.log_chances(lattice, chances, WORDS)
    for word, row in zip(WORDS, got, strict=True):
        for lang in range(3):
            assert row[lang] == pytest.approx(math.log(sum(chance(pieces, chances, c, lang) for c in cuts(word))))


def test_expected_pieces_over_all_segmentations(small):
    lattice, pieces, chances = small
    langs, counts = np.array([0, 1, 2, 0, 1, 2, 0, 1]), np.arange(1.0, 9.0)
    want = np.zeros_like(chances)
    for word, lang, n in zip(WORDS, langs, counts, strict=True):
        whole = sum(chance(pieces, chances, c, lang) for c in cuts(word))
        for cut in cuts(word):
            share = n * chance(pieces, chances, cut, lang) / whole
            for p in cut if share else []:
                for at in [pieces.index(p)] if p in pieces else [len(pieces) + b for b in p.encode()]:
                    want[at, lang] += share
    assert np.allclose(langid.expected_pieces(lattice, chances, WORDS, langs, counts), want)


def test_stretches():
    assert langid.stretches("Don't, 3x Été_2") == ["▁don", "▁t", "▁x", "▁été"]
    assert "".join(langid.stretches("q" * 100)) == "▁" + "q" * 100 and max(map(len, langid.stretches("q" * 100))) == langid.STRETCH
    assert langid.stretches("123 --- _") == []


def test_op11(spark):
    """Held-out accuracy; the contract's fold and undetermined rows."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    learn = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("kein", None), ("", "en"), ("the dog", "en"), ("le chien", "fr")]
    model = langid.learn(spark.createDataFrame(learn, "text string, lang string"))
    assert model.languages == ["en", "fr"]
    assert model.chances.sum(axis=0) == pytest.approx([1, 1])
    rows = [(1, "The dog!", 1, "x"), (1, "The dog!", 1, "x"), (2, "LE CHIEN", 2, "x"), (3, None, 3, None), (4, "", 4, ""), (5, "12 _ \n\t --", 5, ""), (6, "the dog " * 100000, 6, ""), (7, "x" * 200000, 7, ""), (None, "世界 the", None, ""), (8, "²①", 8, "")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score long, _text string"), model).collect()
    assert [r.lang_pred for r in got[:6]] == ["en", "en", "fr", "und", "und", "und"]
    assert got[0] == got[1] and got[6].lang_pred == "en" and got[6].score == 1.0
    assert got[7].lang_pred in ("en", "fr") and got[8].lang_pred == "en" and got[9].lang_pred == "und"
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert [(r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows[:1], "doc_id long, text string, score long, _text string"), none).collect()] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
