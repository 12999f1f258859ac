import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from corpusloom.llm import substring_dedup
from corpusloom.llm.bloom import build_bloom, in_bloom
from corpusloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=13):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op3(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op3_substring_dedup"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(docs)


@pytest.mark.parametrize("max_group", [50_000, 3])
def test_random_texts(spark, max_group):
    """Few different words, so windows repeat within and between documents; with small groups, prefixes grow."""
    rng = random.Random(max_group)
    passage = [rng.choices("abcdefghij", k=rng.randint(10, 40)) for _ in range(6)]
    docs = [(None, "x " * 40), (7, "x " * 40), (3, None), (4, ""), (5, "x " * 12), (6, "x " * 13), (8, "x " * 13), (8, "x " * 13)]
    for d in range(20, 90):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passage)[rng.randint(0, 3) :] if rng.random() < 0.6 else rng.choices("abcdefghijklmnop", k=rng.randint(1, 30))
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text", F.lit(1))
    got = substring_dedup.remove_repeats(frame, max_group=max_group).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str) == brute(docs)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) for r in got)


def test_odd_rows(spark, odd_docs):
    assert substring_dedup.remove_repeats(odd_docs).count() == odd_docs.count()
    assert substring_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def test_bloom(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    words = build_bloom(keys, "k", 1000)
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"), F.xxhash64(F.xxhash64("id")).alias("s")).toPandas()
    found = in_bloom(words, rows.k.to_numpy(), rows.s.to_numpy())
    assert found[rows.id % 3 == 0].all() and found[rows.id % 3 != 0].mean() < 0.1
    assert (substring_dedup._xxhash64_of_longs(rows.k.to_numpy().view(np.uint64)).view(np.int64) == rows.s.to_numpy()).all()
    crowded = build_bloom(spark.range(0, 60000, 3).select(F.xxhash64("id").alias("k")), "k", 20000, max_bits=1 << 16)
    assert len(crowded) == 1 << 10 and in_bloom(crowded, rows.k.to_numpy(), rows.s.to_numpy())[rows.id % 3 == 0].all()


def test_tree():
    """Nodes at every depth are the sequences' common beginnings, within groups only."""
    rng = random.Random(1)
    for _ in range(100):
        n, depth = rng.randint(1, 30), rng.randint(1, 5)
        group, words = (np.array([rng.randint(0, 2) for _ in range(n)]), np.array([[rng.randint(0, 2) for _ in range(depth)] for _ in range(n)], np.int32))
        nodes = substring_dedup._tree(group, words)
        for i in range(n):
            for j in range(n):
                assert all((nodes[i, k] == nodes[j, k]) == (group[i] == group[j] and (words[i, :k] == words[j, :k]).all()) for k in range(depth + 1))


def test_other_windows(spark):
    docs = [(i, " ".join("abcab cabca abcde fghij klmno pqrst".split()[i % 3 :])) for i in range(9)] + [(20, "abcde fghij x klmno pqrst abcde fghij")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (2, 3, 5, 6):
        got = substring_dedup.remove_repeats(frame, window=window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str) == brute(docs, window)


@pytest.mark.parametrize("max_group", [50_000, 3])
def test_words_with_alike_hashes(spark, max_group):
    """Two words whose hashes agree in their upper half: windows that differ in nothing else aren't equal."""
    seen, pair = {}, None
    for i in range(200_000):
        upper = xxhash.xxh64_intdigest(f"w{i}".encode()) >> 32
        if upper in seen:
            pair = (seen[upper], f"w{i}")
            break
        seen[upper] = f"w{i}"
    docs = []
    for k in range(20):
        common = " ".join(f"c{k}x{j}" for j in range(12))
        docs += [(2 * k, f"{common} {pair[0]}"), (2 * k + 1, f"{common} {pair[1]}")]
    rows = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), max_group=max_group).collect()
    assert [r.n_removed for r in rows] == [0] * 40
