import json
from collections import Counter

import pytest
from corpusloom.functions import rewrites
from corpusloom.operators import excerpts, generator
from pyspark.sql import functions as F

BEFORE = "INTENT: {\"intent\": \"find\"}\nYou want **[[T1]]** ([[T2]]).\n- [[T1]] one\n- two"


def changed(after, names=None, with_intent=False, before=BEFORE):
    return {r for r, _ in rewrites.reasons(before, after, names if names is not None else {"[[T1]]": "Drishyam", "[[T2]]": "2013"}, with_intent)}


@pytest.mark.parametrize(
    ("after", "want"),
    [
        (BEFORE, set()),
        (BEFORE.replace("want", "would like"), set()),
        (BEFORE.replace(" ([[T2]])", ""), {"locked_altered"}),
        (BEFORE + "\n[[T2]]", {"locked_altered"}),
        (BEFORE.replace("**[[T1]]**", "[[T1]]"), {"bold_lost"}),
        (BEFORE + " [[T3]]", {"unknown_lock"}),
        (BEFORE + " **Kaithi**", {"new_bold"}),
        (BEFORE.replace("\n- two", " two"), {"list_changed"}),
        (BEFORE + " " + "x" * 41, {"words_glued"}),
        (BEFORE + " as per the guidelines", {"about_the_task"}),
        (BEFORE + " and so on" * 30, {"length"}),
    ],
)
def test_reasons(after, want):
    assert changed(after) == want


def test_other_reasons():
    assert changed("none here", {}, before="NO_MATCH here") == {"decline_dropped"}
    assert changed("this is that film", {}, before="यह वही फिल्म है जो") == {"script_flipped"} and changed("यह film है", {}, before="यह वही फिल्म") == set()
    assert changed("x" * 10, {}, before="x" * 100) == {"length"} and changed("", {}, before="") == set() and changed(" ", {}, before="abc") == set()
    assert changed(BEFORE.split("\n", 1)[1], with_intent=True) == {"intent_dropped"} and changed(BEFORE.replace("find", "look"), with_intent=True) == {"intent_altered"} and changed(BEFORE, with_intent=True) == set()


def test_a_row_per_reason(spark):
    rows = spark.createDataFrame([(1, "[[T1]] a", "[[T1]] a b", {"[[T1]]": "X"}), (2, "[[T1]] a", "a **b** [[T7]]", {"[[T1]]": "X"}), (3, None, None, None)], "id int, locked string, rewritten string, names map<string, string>")
    assert sorted(tuple(r) for r in rewrites.rewrite_issues(rows, "id").collect()) == [(2, "locked_altered", "[[T1]]"), (2, "new_bold", "b"), (2, "unknown_lock", "[[T7]]")]


def test_lock_and_unlock(spark):
    rows = [(1, "Drishyam 2 and DRISHYAM, 2013 not 12013", ["Drishyam", "Drishyam 2", "2013", "absent", ""]), (2, "[T1] T1 1 a.b", ["1", "T1", "a.b"]), (3, None, ["x"]), (4, "plain", None)]
    got = {r.id: r for r in spark.createDataFrame(rows, "id int, text string, names array<string>").select("id", rewrites.lock(F.col("text"), F.col("names")).alias("l")).select("id", "l.*", rewrites.unlock(F.col("l.locked"), F.col("l.names")).alias("back")).collect()}
    assert got[1].locked == "[[T1]] and [[T2]], [[T4]] not 12013" and got[1].names == {"[[T1]]": "Drishyam 2", "[[T2]]": "Drishyam", "[[T4]]": "2013"}
    assert got[1].back == "Drishyam 2 and Drishyam, 2013 not 12013" and got[2].back == rows[1][1]
    assert got[3].locked is None and got[3].back is None and (got[4].locked, got[4].names) == ("plain", {})


def test_all_bytes_leak_and_return():
    letters = rewrites.byte_characters()
    assert sorted(letters) == list(range(256)) and len(set(letters.values())) == 256 and letters[32] == "Ġ" and letters[10] == "Ċ" and letters[65] == "A"
    text = "".join(map(chr, range(0x250))) + "\n देखो 世界 🙂"
    assert rewrites.undo_bytes("".join(letters[b] for b in text.encode())) == text
    assert rewrites.undo_bytes("clean é text") == "clean é text"


def test_sequences_cut_off_stay():
    leak = lambda data: "".join(rewrites.byte_characters()[b] for b in data)
    whole = "a é 世".encode()
    assert rewrites.undo_bytes(leak(whole[:-1])) == "a é " + leak(whole[-3:-1])
    assert rewrites.undo_bytes(leak(b" x\xff y")) == " x" + leak(b"\xff") + " y"
    assert rewrites.undo_bytes("Ġa 世 Ã©") == " a 世 é"


def test_clean_answer(spark):
    texts = [' "quoted" ', "think</think> so</think>\n“x“", "'a\"", '"', "ĠhelloĠworld", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rewrites.clean_answer(F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(rows)] == ["quoted", "x", "'a\"", '"', "hello world", None, ""]


def test_excerpts_of_long_texts_take_one_pass(spark):
    """2,000 sentences, of which only the last two tell a story: judged once each, not once for every other one."""
    import time

    filler = "Nothing in this sentence tells a story whatever it may say. "
    pair = "The quiet teacher hides a letter from the police of the town. A young officer finds it under the floor of the old school."
    rows = spark.createDataFrame([(1, "w", filler * 2000 + pair, "en")], "id int, work string, text string, lang string")
    start = time.time()
    got = excerpts.excerpts(rows, "work", "text", "lang", "id").collect()
    assert [(r.work, r.nth, r.id, r.excerpt) for r in got] == [("w", 1, 1, pair)]
    assert time.time() - start < 20


def test_lock_of_many_names_is_quick():
    """A text of 4,000 different words, all of them names, as fast as a search for each; and what equals what when case doesn't matter."""
    import time

    words = [f"wörd{i}x" for i in range(4000)]
    start = time.time()
    text, found = rewrites.locked(" ".join(words).upper(), words)
    assert time.time() - start < 5
    assert len(found) == 4000 and text.split()[:2] == [k for w in words[:2] for k, name in found.items() if name == w]
    assert rewrites.locked("ſtrasse İn 12 x12 ΣΑΣ [[T9]]", ["STRASSE", "in", "12", "ς", "T9"]) == ("[[T1]] [[T4]] [[T2]] x[[T2]] [[T5]]Α[[T5]] [[T9]]", {"[[T1]]": "STRASSE", "[[T2]]": "12", "[[T4]]": "in", "[[T5]]": "ς"})


def test_leaked_characters(spark):
    texts = ["a b\n\tc", "é ¡\xad\x00\x7f", "मलയാ 𝒳", "", None]
    by = rewrites.byte_characters()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rewrites.leaked(F.col("t")).alias("l")).collect()
    assert [r.l for r in sorted(rows)] == [t if t is None else "".join(by[b] for b in t.encode()) for t in texts]


def test_excerpts(spark):
    story = ["The man hides the body of the boy in the garden.", "His family learns to tell the same story again and again.", "A Short Name, Of Many, Is Here And There And Everywhere Else."]
    about = "The film was directed by someone who has won a prize for it."
    rows = [(1, "w", f"{about} {story[0]} (in 2013) {story[1]} {story[0]}", "en"), (2, "w", f"{story[0]}\n{about}\n{story[1]}", "en"), (3, "w", " ".join(story[:2]) + " Zz", "en"), (4, "w", "A " + " ".join(story[:2]), "en"), (5, "w", " ".join(story[:2]), "ml"), (6, "v", None, "en"), (7, "v", "short", "en"), (8, "v", f"{story[2]} {story[2]}", "en"), (9, None, story[1] + "\n\n" + story[0][:-1] + " " + "x" * 400, "en")]
    got = excerpts.excerpts(spark.createDataFrame(rows, "id int, work string, text string, lang string"), "work", "text", "lang", "id").collect()
    found = {(r.work, r.nth): (r.id, r.excerpt) for r in got}
    assert found[("w", 1)] == (4, "A " + " ".join(story[:2])) and found[("w", 2)] == (1, " ".join(story[:2])) and set(found) == {("w", 1), ("w", 2), (None, 1)}
    assert len(found[(None, 1)][1]) == 320


def works(spark, n):
    return spark.createDataFrame([(3 * i, f"Film (No. {i})", 1990 + i % 30 if i % 5 else None, f"a man sees film (no. {i}) twice") for i in range(n)], "work_id long, title string, year int, excerpt string")


@pytest.mark.parametrize("total", [1, 7, 97, 640])
def test_quotas_are_exact(spark, total):
    rows = generator.conversations(works(spark, 50), total).collect()
    assert Counter(r.behaviour for r in rows) == Counter(generator.quotas(generator.BEHAVIOURS, total)) and sum(generator.quotas(generator.LANGUAGES, total).values()) == total
    assert Counter(r.query_lang for r in rows) == Counter(generator.quotas(generator.LANGUAGES, total))
    assert len({r.conv_id for r in rows}) == len({r.plan_hash for r in rows}) == total
    if total > 500:
        assert len({(r.behaviour, r.query_lang) for r in rows}) == 42 and len({r.work_id for r in rows} - {None}) == 50


def test_largest_remainders():
    assert generator.quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0} and generator.quotas({"a": 0.1, "b": 0.9}, 0) == {"a": 0, "b": 0}
    assert generator.quotas({"x": 0.5, "y": 0.25, "z": 0.25}, 5) == {"x": 3, "y": 1, "z": 1}
    with pytest.raises(ValueError, match="permuted"):
        generator.place(F.lit(1), generator._PRIMES["work"], "work", 1)


def test_same_rows_at_any_partitioning(spark):
    a = generator.conversations(works(spark, 40), 200)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = generator.conversations(works(spark, 40).repartition(13), 200)
        assert sorted(a.collect()) == sorted(b.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    other = generator.conversations(works(spark, 40), 200, generator.Mix(seed=8)).collect()
    assert {r.plan_hash for r in other}.isdisjoint(r.plan_hash for r in a.collect())


def test_turns_of_conversations(spark):
    held = {r.work_id: r for r in works(spark, 30).collect()}
    for r in generator.conversations(works(spark, 30), 120).collect():
        user, call, tool, answer = r.turns
        assert [t.role for t in r.turns] == ["user", "call", "tool", "assistant"] and call.name == tool.name
        results = json.loads(tool.content)["results"]
        assert [x["score"] for x in results] == sorted((x["score"] for x in results), reverse=True) and all(held[x["work_id"]].title == x["title"] for x in results)
        if r.behaviour == "out_of_catalog":
            assert r.work_id is None and json.loads(tool.content)["abstain"] and answer.content.endswith("NO_MATCH")
        else:
            assert results[0]["work_id"] == r.work_id and held[r.work_id].title in answer.content and 2 <= len(results) <= 4
        if r.behaviour == "find_by_plot":
            assert "a man sees that film twice" in user.content
    assert generator.conversations(works(spark, 0), 10).count() == 0 and generator.conversations(works(spark, 2), 0).count() == 0
