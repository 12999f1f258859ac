import hashlib
import random
import zlib
from array import array

import public_tokenizers
import pytest
from corpusloom.llm import bpe, packing
from corpusloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    return bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_pieces_do_not_change_ids(encoding):
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", "\t ", "é", "'s", "1234", "!?", " ", "漢字", " ", "'", "ll", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=60))
        whole = encoding.encode_ordinary(text)
        assert [i for p in bpe.safe_pieces(text, 5) for i in encoding.encode_ordinary(p)] == whole
        assert array("I", packing.token_bytes(text)).tolist() == whole


def test_very_long_runs(encoding):
    for text in ("a" * 300000, " " * 1000000 + "x", "x" + "\n" * 500000, "b" + " " * 90000 + "c" * 90000 + " d"):
        ids = bpe.encode_text(encoding, text)
        assert encoding.decode(ids) == text
    for n in (20001, 30000):  # short enough for the library itself
        for text in ("ab" + " " * n + "cd", "ab" + "\n" * n, " " * n + "x"):
            assert bpe.encode_text(encoding, text) == encoding.encode_ordinary(text)


def test_ranks_give_the_ids_of_the_tokenizers_file(spark, encoding):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(2)
    vocabulary = [encoding.decode([i]) for i in range(encoding.n_vocab - 1)]
    cases = [*vocabulary, *("".join(rng.choices(vocabulary, k=4)) for _ in range(20000)), *texts(spark).values(), "a <|endoftext|> b"]
    for text, got in zip(cases, tokenizer.encode_batch(cases, add_special_tokens=False), strict=True):
        assert array("I", packing.token_bytes(text)).tolist() == got.ids


def test_op1(spark, encoding):
    rows = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, SF).collect()}
    want = texts(spark)
    assert rows.keys() == want.keys()
    for k, text in want.items():
        ids = encoding.encode_ordinary(text)
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encode_odd_rows(spark, odd_docs):
    rows = bpe.decode_documents(bpe.encode_documents(odd_docs)).collect()
    assert sorted((bytes(r.decoded).decode() for r in rows)) == sorted(r.text or "" for r in odd_docs.collect())
    assert bpe.encode_documents(odd_docs.limit(0)).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        b = min(fits, key=lambda b: b[0]) if fits else bins.append([capacity, 0]) or bins[-1]
        b[0] -= n
    return sorted(b[0] for b in bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_best_fit(histogram, capacity)
        used, placed = {}, 0
        for i, (n, rank, first, offset) in enumerate(plan):
            end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else histogram[n]
            for r in range(rank, end):
                assert used.get(first + r - rank, 0) == offset
                used[first + r - rank] = offset + n
                placed += 1
        assert placed == len(lengths)
        assert sorted(capacity - u for u in used.values()) == best_fit(lengths, capacity)


def check_packed(rows, want_ids):
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    assert seen.keys() == want_ids.keys()
    for k, pieces in seen.items():
        pieces.sort(key=lambda r: r.piece)
        ids, at = want_ids[k], 0
        for i, r in enumerate(pieces):
            assert (r.piece, r.start) == (i, at) and (r.length == 2048 or i == 0)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_op2(spark, encoding):
    want = {k: [*encoding.encode_ordinary(t), 0] for k, t in texts(spark).items()}
    rows = QUERIES["op2_packing"](spark, SF).collect()
    sequences = check_packed(rows, want)
    assert sorted(2048 - sum(n for _, n in own) for own in sequences.values()) == best_fit([r.length for r in rows], 2048)


def test_pack_odd_rows(spark, odd_docs):
    pieces = packing.cut_pieces(odd_docs).drop("ids")
    assert packing.pack(pieces).count() == pieces.count() >= 7
    assert packing.pack(packing.cut_pieces(odd_docs.limit(0)).drop("ids")).count() == 0


def test_long_runs_of_any_white_space(encoding):
    rng = random.Random(3)
    space = "\t \n\r\x0b\x0c\x85\xa0      　"
    for k in range(200):  # short enough for the library itself
        run = "".join(rng.choices(space, k=rng.choice([2000, 2001, 2500])))
        text = rng.choice(["", "a", "x1!", "'s", " "]) + run + rng.choice(["", "a", "1", "!", " b", "'s\x1c"]) + ("q" * 20001 if k % 3 else "")
        text = text if k % 3 else "q" * 20001 + text
        assert bpe.encode_text(encoding, text) == encoding.encode_ordinary(text)
    for run in ("\xa0", "\x0c", " \xa0", "\xa0 ", "　\n"):
        text = f"a{run * 1000000}b"
        assert encoding.decode(bpe.encode_text(encoding, text)) == text
        assert encoding.decode(array("I", packing.token_bytes(text)).tolist()) == text


def test_slices_of_common_lengths(spark):
    """Null ids, repeated rows and many slices of one length: the same sequences, and no place twice."""
    rows = [(None if i % 3 == 0 else i // 2, 0, 0, (i % 5 + 1) * 100) for i in range(900)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long")
    for per_slice in (7, 10**6):
        got = packing.pack(pieces, rows_per_slice=per_slice).collect()
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in sequences.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert len(got) == 900 and sorted(2048 - sum(n for _, n in own) for own in sequences.values()) == best_fit([r[3] for r in rows], 2048)
