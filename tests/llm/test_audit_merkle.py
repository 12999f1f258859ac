import hashlib
import re
import zlib
from itertools import permutations

import pytest
from corpusloom.llm import filter_audit, merkle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """Letters of the filters that each (doc_id, text) fails, in plain Python."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u in rows)]
        out.append({c for c, f in zip("ABCDE", fails, strict=True) if f})
    return out


def audited(docs, labels):
    """The audit by walking through every order for every document."""
    good, toxic = ({d for d, *flags in labels if flags[i] == 1 and d is not None} for i in (0, 1))
    fails = failing([(d, t) for d, t, _ in docs])
    out = {}
    for part in {s or "" for _, _, s in docs}:
        rows = [(d, f) for (d, _, s), f in zip(docs, fails, strict=True) if (s or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                removed_by[c] += len(gone)
                every = [r for r in rows if c in r[1]]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(r[1] == {c} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                out[part, order, step].append(removed_by[c])
    return out


def found(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, source string, mask int, FP string")
    got = filter_audit.audit(filter_audit.failure_masks(d), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def test_audit_of_odd_rows(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, None), (2, "", "a"), (3, prose, "a"), (3, prose, "a"), (4, prose, "b"), (None, prose, "b"), (None, "x", ""), (5, "A B " * 40, "b"), (6, "long# " * 30000, "b"), (7, "long# " * 30000, None), (0, "\x1c \x0b" * 70, "a"), (8, prose + " |", "c"), (9, prose.upper(), "c")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (4, None, None), (6, 0, 1), (7, 1, None), (99, 1, 1), (None, 1, 1)]
    want = audited(docs, labels)
    assert len(want) == 600 * 4
    assert found(spark, docs, labels) == want
    assert found(spark, [], labels) == {}


def test_duplicates_across_ranges(spark):
    """A text that most rows share lies in many ranges; only its least id is no duplicate."""
    docs = [(i * 7919 % 5000, "the same" if i % 3 else f"own {i}", "s") for i in range(5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.id: r.mask for r in filter_audit.failure_masks(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same = {i for i, t, _ in docs if t == "the same"}
    assert {i for i, m in got.items() if m & filter_audit.DUPLICATE} == same - {min(same)}


def test_neighbours_with_one_fingerprint(spark):
    """Different texts under one fingerprint aren't equal, wherever a range begins."""
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_pylist([{"fp": 1, "text": t, "id": i, "part": "", "mask": 0} for t, i in rows], schema=pa.schema([("fp", pa.int64()), ("text", pa.string()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())]))

    rows = [r for b in filter_audit._mark([batch([("a", 1), ("a", 4)]), batch([("a", 5), ("b", 2), ("b", None)])]) for r in b.to_pylist()]
    assert [(r["id"], r["mask"], r["text"]) for r in rows] == [(1, 0, "a"), (4, 16, None), (5, 16, None), (2, 0, "b"), (None, 0, None)]


def plain_manifest(docs):
    """The tree by lists, with every proof and fold."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(field, r)))

    def tree(nodes):
        """Its top, and per node the runs it is in, as (left, right) siblings."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, i in zip(ways, at, strict=True):
                run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
                way.append((run[: i % 3], run[i % 3 + 1 :]))
            nodes, at = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
        return nodes[0], ways

    sources = sorted({r[1] for r in docs}, key=lambda s: (s is not None, (s or "").encode()))
    first = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = [sorted((r for r in docs if r[1] == s), key=first) for s in sources]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, over = tree([t for t, _ in trees])
    out = []
    for rows, (sub, ways), above in zip(groups, trees, over, strict=True):
        for r, way in zip(rows, ways, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for a, b in way + above:
                now = digest("".join([*a, now, *b]))
            out.append((r[0], leaf(r), sub, root, digest("".join("".join(a + b) for a, b in way + above)), now, now == root))
    return out


def merkle_rows(spark, docs):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, source string, lang string, n_chars long, text string, _group int, Leaf string").repartition(5)
    rows = merkle.fold_proofs(merkle.manifest(merkle.document_leaves(d), carry="tampered"), "tampered")
    return [(r.doc_id, r.leaf, r.subroot, r.root, hashlib.sha256(r.proof_hex.encode()).hexdigest(), r.folded_root, r.folded_root == r.root) for r in rows.collect()]


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 28, 4], [27, 81, 82], [1] * 30, [730]])
def test_merkle_of_any_size(spark, sizes):
    docs = [(1000 * s + i, f"s{s}", "en", i, f"text {i}\nof {s}") for s, n in enumerate(sizes) for i in range(n)]
    got = merkle_rows(spark, docs)
    assert sorted(got) == sorted(plain_manifest(docs))
    assert any(not r[-1] for r in got) or len(docs) < 4


def test_merkle_of_odd_rows(spark):
    docs = [(1, None, None, None, None), (2, "", "", 0, ""), (3, "é", "fr", 3, "a\nb"), (3, "é", "fr", 3, "a\nb"), (3, "é", "fr", 3, "other\n"), (None, "é", "fr", 3, "no\nid"), (None, None, "fr", 3, "no\nid"), (4, "z", "en", -5, "long\n" * 50000), (5, "Z", "en", 1, "\n")]
    assert sorted(merkle_rows(spark, docs), key=str) == sorted(plain_manifest(docs), key=str)
    assert merkle_rows(spark, []) == []


def test_a_changed_leaf_is_found(spark):
    docs = [(i, "s", "en", 1, f"t{i}") for i in range(40)]
    rows = merkle.manifest(merkle.document_leaves(spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string"))).collect()
    for r in rows:
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(r.proof))[0].hex() == r.root
        assert merkle.fold(hashlib.sha256(b"another").digest(), bytes(r.proof))[0].hex() != r.root
