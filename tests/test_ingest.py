import json
import random
import re

import pytest
from corpusloom.functions import answers
from corpusloom.operators import extraction
from corpusloom.streaming import session_store
from pyspark.sql import functions as F


def state(i, **other):
    return json.dumps({"conversation_id": f"c{i}", "created_at": "2024-01-01T00:00:00Z", "last_active": "2024-01-01T00:00:01Z", "messages": [{"role": "user", "content": "hi {\"}"}], "turn_count": i} | other)


BROKEN = ["", "{", "null", "[]", "{}", state(1)[:-3], state(1, turn_count="many"), state(1, created_at="never"), state(1, messages=[{"role": "system", "content": "x"}]), state(1, extra=1), state(1, messages=None), None]


def test_valid_state(spark):
    good = [state(1), json.dumps({k: v for k, v in json.loads(state(2)).items() if k not in ("messages", "turn_count")}), state(3, messages=[])]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(good + BROKEN)], "i int, p string").select("i", session_store.valid_state(F.col("p")).alias("ok")).collect()
    assert [r.ok for r in sorted(rows)] == [True] * len(good) + [False] * len(BROKEN)


def operations():
    """Saves, loads and deletes of a few keys over some hours, one key with most of them; broken payloads among them."""
    rng = random.Random(4)
    out = []
    for seq in range(900):
        key = rng.choice(["hot", "hot", "hot", "a", "b", "c"])
        op = rng.choice(["save", "load", "load", "delete"]) if rng.random() < 0.5 else "load"
        payload = rng.choice([state(seq), state(seq), rng.choice(BROKEN)]) if op == "save" else None
        out.append((key, 1_700_000_000_000_000 + rng.randrange(8 * 3600) * 1_000_000 + rng.choice([0, 1, 999_999]), seq, op, payload))
    return [*out, ("hot", 1_700_000_000_000_000, 901, "touch", None), (None, 1_700_000_000_000_000, 902, "load", None)]


def by_loop(rows, ttl):
    held, out = {}, {}
    for key, us, seq, op, payload in sorted((r for r in rows if r[0] is not None and r[3] in ("save", "load", "delete")), key=lambda r: (r[1], r[2])):
        if op == "load":
            deadline, found = held.get(key, (0, None))
            found = found if us < deadline else None
            bad = found is not None and found in BROKEN
            out[key, seq] = (None if bad else found, bad)
        else:
            held[key] = (us + ttl * 1_000_000, payload) if op == "save" else (0, None)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, us long, seq long, op string, payload string").withColumn("ts", F.timestamp_micros("us")).drop("us")


@pytest.mark.parametrize("ttl", [600, 7200])
def test_sessions_replayed(spark, ttl):
    rows = operations()
    got = {(r.key, r.seq): (r.loaded, r.broken) for r in session_store.replay(frame(spark, rows).repartition(5), ttl).collect()}
    want = by_loop(rows, ttl)
    assert got == want and len({v for v in want.values()}) > 20 and any(b for _, b in want.values())
    assert session_store.replay(frame(spark, rows).limit(0), ttl).count() == 0


def test_sessions_streamed(spark, tmp_path):
    """In files of any order within the lateness; what comes too late is dropped, and the rest is as a replay without it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(operations(), key=lambda r: r[1])
    rng = random.Random(9)
    late = ("a", rows[100][1], 5000, "save", state(5000))
    parts = [rows[i : i + 300] for i in range(0, len(rows), 300)]
    parts[1] = parts[1][::-1]
    rng.shuffle(parts[2])
    end = ("end", rows[-1][1] + 10**12, 9999, "load", None)
    for i, part in enumerate([*parts, [late], [end]]):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    try:
        run = session_store.served(stream, 7200, "10 minutes").writeStream.format("memory").queryName("served").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
        if run.exception():
            raise run.exception()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.key, r.seq): (r.loaded, r.broken) for r in spark.table("served").collect()}
    assert got == by_loop(rows, 7200)
    assert spark.table("served").count() == len(got)


TREES = ['{"a": "}\\"{", "b": [1, {"c": "\\\\"}], "d": {}}', "{}", '{"é": "世\\u4e16"}', '{"a": ' + "[" * 60 + "]" * 60 + "}"]


def first_by_decoder(text):
    cleaned = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip(), flags=re.MULTILINE).lstrip()
    try:
        found, end = json.JSONDecoder().raw_decode(cleaned)
    except ValueError:
        return None
    return cleaned[:end] if isinstance(found, dict) else None


def test_first_object_of_cut_and_followed_answers(spark):
    texts = ["", " ", "null", "[{}]", "}{", '"{}"', "x {}", "{]", '{"a": [}', "```json\n{\"a\": 1}\n```", "```\n{}```", " {} tail"]
    for t in TREES:
        texts += [t[:i] for i in range(len(t) + 1)]
        texts += [t + tail for tail in ('{"b": 2}', " and so on", '"', "\\", "}}", "\n```\nmore", "]")] + [f"```json\n{t}\n```", f"  \n{t}  "]
    assert sum(first_by_decoder(t) is not None for t in texts) > 30
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(3).select("i", answers.first_object(F.col("t")).alias("o")).collect()
    assert {r.i: r.o for r in rows} == {i: first_by_decoder(t) if t is not None else None for i, t in enumerate([*texts, None])}


def test_ends_in_random_bytes():
    """Against a scanner with a stack, over stretches that follow one another."""
    import numpy as np

    def scan(text):
        depth, inside, run = 0, False, 0
        for i, c in enumerate(text):
            if c == "\\":
                run += 1
                continue
            if c == '"' and run % 2 == 0:
                inside = not inside
            elif not inside and c in "{[":
                depth += 1
            elif not inside and c in "}]":
                depth -= 1
                if depth == 0:
                    return i + 1
            run = 0
        return -1

    rng = random.Random(3)
    for _ in range(300):
        texts = ["".join(rng.choices('{}[]"\\a', k=rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        texts = [rng.choice(["{", "["]) + t if rng.random() < 0.7 else t for t in texts]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        got = answers.object_ends(np.frombuffer("".join(texts).encode(), np.uint8), starts, starts + sizes)
        want = [scan(t) if t[:1] in ("{", "[") else -1 for t in texts]
        assert [int(e - s) if e >= 0 else -1 for e, s in zip(got, starts, strict=True)] == want


def edge(src="A", dst="B", sentence="it was made again", kind="is_remake_of", confidence=0.5, **other):
    return {"edge_type": kind, "src_title": src, "dst_title": dst, "supporting_sentence": sentence, "confidence": confidence} | other


def test_exits(spark):
    pages = [("p1", "T1", "Here  it was\nmade again, they say.", 7), ("p2", "T2", "it was made again", 8), ("p3", "T1", "it was made again", 9), ("p4", "T4", None, 1), ("p5", "T5", "x", 1), ("p6", "T6", "it was made again", 2)]
    say = lambda *edges: json.dumps({"relationships": list(edges), "note": 1})
    raw = [
        ("p1", "```json\n" + say(edge(), edge(dst="C"), edge(sentence="never said, this one"), edge(src_language="xx")) + "\n``` and more"),
        ("p2", say(edge(), edge(src="A", dst="A2"), edge(dst="gone"), edge(src_language="hi"))),
        ("p3", say(edge(), edge(kind="based_on"))),  # page of the title that p1 has
        ("p4", say(edge())), ("p5", say()), ("p6", say(edge(), edge(confidence=1.5))), ("p7", say(edge())), ("p8", None),
    ]
    table = spark.createDataFrame([("is_remake_of", "A", "gone", "T2")], "edge_type string, src_title string, dst_title string, source_page string")
    names = spark.createDataFrame([("A", "hi", 1), ("B", "ta", 2), ("A2", "hi", 1), ("C", "hi", 3), ("C", "ta", 4)], "title string, language string, version_id int")
    found = extraction.exits(spark.createDataFrame(raw, "page_key string, raw string").repartition(4), spark.createDataFrame(pages, "page_key string, title string, text string, revision int"), table, names)
    rows = sorted(((r.page_key, r.place, r.exit, r.src_version_id, r.dst_version_id) for r in found.collect()), key=str)
    assert rows == sorted([
        ("p1", 0, "inserted", 1, 2), ("p1", 1, "unbound", 1, None), ("p1", 2, "unsupported", None, None), ("p1", 3, "repeat_in_batch", None, 2),
        ("p2", 0, "inserted", 1, 2), ("p2", 1, "unbound", 1, None), ("p2", 2, "repeat_in_table", 1, None), ("p2", 3, "repeat_in_batch", 1, 2),
        ("p3", 0, "repeat_in_batch", 1, 2), ("p3", 1, "inserted", 1, 2), ("p4", 0, "unsupported", None, None), ("p5", None, "empty", None, None),
        ("p6", None, "malformed", None, None), ("p7", None, "malformed", None, None), ("p8", None, "malformed", None, None)], key=str)
    told = extraction.report(found).first()
    assert sum(told[e] for e in extraction.EXITS) == len(rows) and (told.answers, told.malformed, told.proposals, told.failure_rate) == (8, 3, 11, 0.375)
    again = extraction.exits(spark.createDataFrame(raw, "page_key string, raw string"), spark.createDataFrame(pages, "page_key string, title string, text string, revision int"), extraction.new_candidates(found), names)
    assert extraction.new_candidates(again).where("source_page <> 'T2' OR dst_title <> 'gone'").count() == 0
