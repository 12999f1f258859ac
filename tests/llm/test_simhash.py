import contextlib
import random
import threading
from collections import defaultdict
from pathlib import Path

import numpy as np
import xxhash
from corpusloom.llm import simhash
from corpusloom.llm.common import brief_shuffles, materialize
from corpusloom.llm.components import connected_components
from corpusloom.llm.components import connected_components
from corpusloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_op4(spark):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_components(fps, 4)
    rows = QUERIES["op4_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{fps[k]:016x}", want[k]) for k in fps} and len(rows) == len(fps)


def test_links_keep_all_components(spark):
    """Random fingerprints in clusters of many distances, under plans for few and for very many rows."""
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(12):
            v ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 6)))
            v %= 1 << 64
            values.append(v)
    values = sorted(set(values))
    sample = np.array(values, np.uint64)
    signed = sample.view(np.int64).tolist()
    prints = spark.createDataFrame([(v, v, [], 1, []) for v in signed], "node long, fp long, more array<long>, size int, least array<long>")
    want = brute_components(dict(zip(signed, values, strict=True)), 4)
    for rows in (500, 1e6, 1e9):
        plan = simhash.allocate(sample, 4, rows)
        assert sum(t + 1 for _, t in plan) == 5
        assert sorted(b for g, _ in plan for b in g) == sorted({b for g, _ in plan for b in g})
        for most in (simhash.MAX_UNDER_KEY, 1):  # also with keys that are divided
            got = {r.node: r.component for r in connected_components(simhash.link(prints, plan, 4, most=most)).collect()}
            assert {k: got.get(k, k) for k in want} == want


def test_thresholds_follow_the_size():
    sample = np.random.default_rng(0).integers(0, 2**63, 2000, np.int64).view(np.uint64)
    few, many = (simhash.allocate(sample, 4, n) for n in (1e4, 1e10))
    assert len(few) > len(many) and max(t for _, t in many) > max(t for _, t in few)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}}


def test_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicate_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2, 6)} == {1: 1, 2: 1, 6: 1}
    assert simhash.near_duplicate_groups(odd_docs.limit(0)).count() == 0


def brute_similar(sets, similarity):
    """Components, and the pairs of a similarity in [0.6, 1)."""
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys, pairs = sorted(sets), {}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            if j >= similarity or sets[a] == sets[b]:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
            if 0.6 <= j < 1:
                pairs[b, a] = j
    return {k: find(k) for k in keys}, pairs


def test_near_copies_by_jaccard(spark):
    """Chains of copies of every similarity, long and short texts: links are exact, and of pairs in 0.80 to 0.85 at least 0.9 are
    found; no document is linked but by a chain of pairs of 0.8 or more."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = {}
    for i in range(260):
        words = rng.choices(vocabulary, k=rng.choice([12, 20, 28, 150, 300, 600]))
        copy = list(words)
        if len(words) < 30:
            copy = copy[rng.randint(0, 3) :] + rng.choices(vocabulary, k=rng.randint(0, 2))
        else:
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([45, 48, 50, 55, 70]))):
                copy[at] = rng.choice(vocabulary)
        docs |= {2 * i: " ".join(words), 2 * i + 1: " ".join(copy).upper()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in docs.items() for w in [t.lower().split()]}
    want, pairs = brute_similar(sets, 0.8)
    rows = simhash.near_duplicate_groups(spark.createDataFrame([*docs.items(), (None, docs[0])], "doc_id long, text string"), **simhash.NEAR_COPIES).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(docs) + 1 and got[None] is None
    assert all(got[k] in (k, want[k]) for k in docs)  # precision: nothing under 0.8
    near = [(a, b) for (a, b), j in pairs.items() if 0.8 <= j < 0.85 and len(sets[a]) > simhash.SMALL_SET]
    found = sum(got[a] == got[b] for a, b in near)
    print("found of pairs in 0.80 to 0.85:", found, "of", len(near))
    assert len(near) > 20 and found >= 0.9 * len(near)
    short = [(a, b) for (a, b), j in pairs.items() if j >= 0.8 and min(len(sets[a]), len(sets[b])) <= 20]
    assert len(short) > 10 and all(got[a] == got[b] for a, b in short)


def test_exact_clusters():
    rng = random.Random(2)
    for _ in range(200):
        base = [set(rng.sample(range(40), rng.randint(1, 12))) for _ in range(6)]
        sets = [b ^ set(rng.sample(range(40), rng.randint(0, 2))) for b in base for _ in range(3)]
        want, _ = brute_similar(dict(enumerate(sets)), 0.8)
        got = list(range(len(sets)))
        for own in simhash._similar([np.array(sorted(s), np.uint64) for s in sets], 0.8):
            for k in own:
                got[k] = int(min(own))
        # two empty sets have no similarity to speak of; they are one fingerprint, and linked by that
        assert all(got[k] == want[k] for k in want if sets[k])


def test_large_groups_meet_in_blocks(spark):
    """A group dealt over pairs of blocks holds together what one task would."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, (6, 40))
    rows = [(i, np.sort(np.where(rng.random(40) < 0.03, rng.integers(0, 2**62, 40), base[i % 6]).astype(np.uint64)).tobytes()) for i in range(180)]
    sets = spark.createDataFrame([(n, bytearray(h)) for n, h in rows], "node long, hashes binary")
    members = spark.createDataFrame([(7, n) for n, _ in rows] + [(8, n) for n, _ in rows[:9]], "key long, node long")
    parts = []
    for most in (1000, 20):
        links = simhash.similar_links(members, sets, 0.8, most)
        parts.append({(r.node, r.component) for r in connected_components(links).collect()})
    assert parts[0] == parts[1] and len(parts[0]) > 150
    dealt = simhash._in_blocks(members, 20).groupBy("key").count().collect()
    assert max(r["count"] for r in dealt) <= 45 and len(dealt) > 100


def shuffle_files(spark):
    found = {}
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for path in Path(str(top)).rglob("shuffle_*.data"):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                found[str(path)] = path.stat().st_size
    return found


def test_disk_of_a_plan_with_many_keys(spark):
    """A plan for many rows sends each fingerprint under 64 keys; what lies on disk at once is that of a pass over 16."""
    rng, n = np.random.default_rng(6), 6000
    words = rng.integers(-(2**63), 2**63, (n, 4))
    words[::10] = words[1::10] ^ (1 << rng.integers(0, 62, (n // 10, 4)))
    nodes = materialize(spark.createDataFrame([(i, int(w[0]), w[1:].tolist(), 100, []) for i, w in enumerate(words)], "node long, fp long, more array<long>, size int, least array<long>").repartition(4))
    plan = [(list(range(8 * g, 8 * g + 8)), 1) for g in range(8)]
    before, most, over = shuffle_files(spark).keys(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], sum(v for k, v in shuffle_files(spark).items() if k not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        with brief_shuffles(spark):
            rows = materialize(simhash.link(nodes, plan, 15, 50, groups=True)).collect()
    finally:
        over.set()
        watcher.join()
    pairs = {(min(a, b), max(a, b)) for a, b in ((i, i + 1) for i in range(0, n, 10))}
    groups = defaultdict(set)
    for r in rows:
        groups[r.key].add(r.node)
    assert {tuple(sorted(g)) for g in groups.values()} == pairs and len(rows) == 2 * len(pairs)
    print("bytes a row:", most[0] / n)
    assert 0 < most[0] / n < 3500  # 32 rows of about 60 bytes under 16 keys and 2 sizes; 128 rows under all
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_passes():
    assert list(simhash._passes([1.0] * 64, 16)) == [(0, 16), (16, 32), (32, 48), (48, 64)]
    assert list(simhash._passes([1.0] * 5, 16)) == [(0, 5)]
    assert list(simhash._passes([16.0, 1.0, 15.0, 1.0], 16)) == [(0, 1), (1, 3), (3, 4)]


def test_groups_that_hang_together_are_sent_once(spark):
    """Groups of a small component become one; those of a large one stay, whose pairs are not all worth comparing."""
    small, large = [(1, (1, 2)), (2, (2, 3)), (3, (1, 2, 3)), (4, (8, 9))], [(10, (20, 21, 22)), (11, (22, 23)), (12, (23, 24))]
    members = spark.createDataFrame([(k, n) for k, nodes in small + large for n in nodes], "key long, node long")
    groups = defaultdict(set)
    for r in simhash._whole(members, 4).collect():
        assert r.node not in groups[r.key]
        groups[r.key].add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [8, 9], [20, 21, 22], [22, 23], [23, 24]]


def test_one_pass_finds_what_all_keys_do(spark, monkeypatch):
    """Clusters with many near ones by the first word only: the same links for any number of keys at once, keys divided or not."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, (5, 4))
    words = base[rng.integers(0, 5, 400)]
    for _ in range(9):
        words[:, 0] ^= 1 << rng.integers(0, 62, 400)
        words[:, 1:] ^= np.where(rng.random((400, 3)) < 0.6, 1 << rng.integers(0, 62, (400, 3)), 0)
    words[::3, 1:] = rng.integers(0, 2**62, (len(words[::3]), 3))
    nodes = spark.createDataFrame([(i, int(w[0]), w[1:].tolist(), 100 + i % 40, []) for i, w in enumerate(words)], "node long, fp long, more array<long>, size int, least array<long>")
    near = {(i, j) for i in range(400) for j in range(i) if int(np.bitwise_count(words[i, 0] ^ words[j, 0])) <= 15 and int(np.bitwise_count(words[i, 1:] ^ words[j, 1:]).sum()) <= 50 and (100 + min(i % 40, j % 40)) / (100 + max(i % 40, j % 40)) >= 0.8}
    want = {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(near), "a long, b long")).collect()}
    plan = [(list(range(4 * g, 4 * g + 4)), 0) for g in range(16)]
    for at_once, most in ((1, simhash.MAX_UNDER_KEY), (100, simhash.MAX_UNDER_KEY), (5, 1)):
        monkeypatch.setattr(simhash, "KEYS_AT_ONCE", at_once)
        got = {r.node: r.component for r in connected_components(simhash.link(nodes, plan, 15, 50, most=most)).collect()}
        assert got == want and len(want) > 100
