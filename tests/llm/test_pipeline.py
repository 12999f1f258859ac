import re
from collections import defaultdict

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect() if name == "packed" else {r.doc_id: r for r in docs.collect()}
        assert name == "packed" or docs.columns == COLUMNS
    return out


def test_quality(stages):
    kept, docs = stages["quality_rules"], stages["documents"]
    assert 0.6 * len(docs) < len(kept) < len(docs)
    assert all(kept[k] == docs[k] for k in kept)


def test_lines(stages):
    before, after = stages["quality_rules"], stages["repeated_lines"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for k, r in before.items():
        for x in (r.text or "").split("\n"):
            held[key(x)].add(k)
    for k, r in before.items():
        lines = [x for x in (r.text or "").split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == k]
        assert after[k].text == "\n".join(lines) and after[k].n_chars == len(after[k].text)


def test_near_copies(spark, stages):
    before, after = stages["repeated_lines"], stages["near_copies"]
    sets = {}
    for k, r in before.items():
        w = r.text.encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    near = defaultdict(float)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            near[a], near[b] = max(near[a], j), max(near[b], j)
            if j >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    groups = defaultdict(list)
    for k in keys:
        groups[find(k)].append(k)
    # one of a group of copies stays; candidates are found by fingerprints, so a few may be missed
    too_many = sum(sum(k in after for k in own) - 1 for own in groups.values())
    assert too_many <= 0.02 * sum(len(own) - 1 for own in groups.values())
    assert all(k in after for k in keys if near[k] < 0.8) and all(any(k in after for k in own) for own in groups.values())
    assert all(after[k].text == before[k].text for k in after)


def test_secrets(stages):
    before, after = stages["near_copies"], stages["secrets_masked"]
    planted = re.compile(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    assert before.keys() == after.keys()
    assert all(after[k].text == planted.sub("[SECRET]", r.text) for k, r in before.items())


def test_packed(stages):
    from test_bpe_packing import check_packed
    import public_tokenizers
    from corpusloom.llm.bpe import load_encoding

    encoding = load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    check_packed(stages["packed"], {k: [*encoding.encode_ordinary(r.text or ""), 0] for k, r in stages["secrets_masked"].items()})


def test_run_on_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "x", 0), (None, "words " * 30, "en", "x", 9), (4, "a b c " * 50000, "en", "x", 9), (5, "plain words of one text which nobody repeats at all in any other place here", "en", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {5}
    for t in ("documents", "labels"):
        empty = spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).coalesce(1)
        empty.write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_columns_with_clashing_names(spark):
    """Every stage but the last returns the columns it was given, whatever their names, with their values."""
    extra = ["n_words", "kept", "rule", "base_failed", "_words", "_own0", "_dropped", "_drop_id", "_gone", "_rid", "_rhash", "_spans", "component_id", "fp", "start", "length", "_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0").selectExpr("*", *(f"doc_id * {i + 2} AS {c}" for i, c in enumerate(extra)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id * (i + 2) for r in rows for i, c in enumerate(extra)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
