"""Asserted titles, grounding, recall of version sets and payloads on hand-made rows."""

import json

from corpusloom.functions import matching
from corpusloom.operators import scoring
from corpusloom.sources import payloads
from pyspark.sql import functions as F


def test_asserted_titles(spark):
    cases = {
        1: ("**Drishyam (2013)** and **\"Papanasam\"**, again **drishyam**", ["Drishyam", "Papanasam"]),
        2: ("You should watch Chokher Aloy (2015) or Sheep Without a Shepherd (2019).", ["Chokher Aloy", "Sheep Without a Shepherd"]),
        3: ("the Telugu (2014) version, and Of The Dead (1999)", ["Dead"]),
        4: ("nothing here", []),
        5: (None, []),
        6: ("2 States (2014) and **  **", ["States"]),
        7: ("**A**B** (2001)", ["A"]),
    }
    frame = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "id long, answer string")
    got = {k: [] for k in cases}
    for r in sorted(scoring.asserted_titles(frame, "id", "answer").collect(), key=lambda r: r.pos):
        got[r.id].append(r.title)
    assert got == {k: want for k, (_, want) in cases.items()}


def test_inventions(spark):
    asserted = spark.createDataFrame([(1, 0, t, matching.key_of(t)) for t in ("Drishyam", "Paapanaasam", "Inception")] + [(2, 0, "Drishyam", "drishyam")], "id long, pos int, title string, key string")
    allowed = spark.createDataFrame([(1, "DRISHYAM"), (1, "Papanasam 2"), (3, "Inception")], "id long, title string")
    got = {(r.id, r.title): r.grounded for r in scoring.inventions(asserted, allowed, "id").collect()}
    assert got == {(1, "Drishyam"): True, (1, "Paapanaasam"): matching.ratio("papanasam", "papanasam 2") >= 0.8, (1, "Inception"): False, (2, "Drishyam"): False}


def test_invented_titles_of_the_query(spark):
    from corpusloom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = {}
    for r in sorted(QUERIES["invented_titles"](spark, sf).collect(), key=lambda r: r.pos):
        got.setdefault(r.conv_id, []).append((r.title, r.grounded))
    assert got == {k: [(r.p_name, k % 10 == 0), ("North", False)] for k, r in parts.items() if k % 5 == 0}


def test_recall_of_a_version_set(spark):
    columns = "fixture string, title string, language string, year int, relationship string, is_original boolean"
    expected = [("a", "T", "ml", 2013, None, True), ("a", "U", "ta", 2015, "is_remake_of", False), ("a", "U", "ta", 2015, "is_remake_of", False), ("a", "V", "hi", None, None, False), ("b", "T", "ml", 2013, None, True)]
    got = [("a", "T", "ml", 2013, "x", True), ("a", "U", "ta", 2015, "is_official_dub_of", False), ("a", "V", "hi", None, None, None), ("b", "T", "ml", 2013, None, False)]
    fixtures = spark.createDataFrame([("a",), ("b",), ("c",)], "fixture string")
    rows = scoring.version_set_recall(fixtures, spark.createDataFrame(expected, columns), spark.createDataFrame(got, columns)).collect()
    assert {r.fixture: r.recall for r in rows} == {"a": 0.5, "b": 0.0, "c": 1.0}


def test_pages(spark):
    page = lambda **over: json.dumps({"query": {"pages": [{"title": "T", "extract": "Lead.\n\n== Cast ==\nx\n=== Minor ===\ny\n== കഥ ==\n The story.\n\n== End ==\nz", "revisions": [{"revid": 7}], "canonicalurl": "u"} | over]}})
    rows = [("full", page()), ("missing", page(missing=True)), ("none", json.dumps({"query": {"pages": []}})), ("bare", page(revisions=[])), ("plain", page(extract=" Only text ", canonicalurl="", fullurl="f")), ("empty", page(extract="Lead\n== PLOT ==\n \n== End ==\nz")), ("broken", "{")]
    got = {r.k: r for r in spark.createDataFrame(rows, "k string, raw string").select("k", payloads.parse_page(F.col("raw")).alias("p")).select("k", "p", payloads.lead_and_plot(F.col("p.extract")).alias("parts"), payloads.text_to_store(F.col("p.extract")).alias("stored")).collect()}
    assert all(got[k].p is None for k in ("missing", "none", "bare", "broken"))
    assert (got["full"].p.revision_id, got["full"].p.url) == ("7", "u") and tuple(got["full"].parts) == ("Lead.", "The story.") and got["full"].stored == "Lead.\n\nThe story."
    assert got["plain"].p.url == "f" and tuple(got["plain"].parts) == ("Only text", None) and got["plain"].stored == "Only text"
    assert got["empty"].parts.plot is None and got["empty"].stored.endswith("z")


def test_movies(spark):
    raw = {"id": 5, "imdb_id": "tt5", "original_title": "O", "original_language": "ml", "release_date": "2013-12-19", "alternative_titles": {"titles": [{"title": "A", "iso_3166_1": "IN"}, {"title": ""}]}, "translations": {"translations": [{"iso_639_1": "ta", "data": {"title": "B"}}, {"iso_639_1": "en", "data": {"title": ""}}]}, "credits": {"cast": [{"id": i, "name": f"n{i}", "order": i} for i in range(20)], "crew": [{"id": 90, "name": "d", "job": "Director"}, {"id": 91, "name": "w", "job": "Writer"}]}}
    rows = [json.dumps(raw), json.dumps({"id": 6, "original_title": "P", "original_language": "hi", "release_date": ""})]
    full, bare = (r.m for r in spark.createDataFrame([(x,) for x in rows], "raw string").select(payloads.parse_movie(F.col("raw")).alias("m")).collect())
    assert [tuple(t) for t in full.titles] == [("O", "ml", None, "canonical"), ("A", None, "IN", "aka"), ("B", "ta", None, "translation")]
    assert [c.role_kind for c in full.credits] == ["lead"] * 5 + ["support"] * 10 + ["director"] and full.release_year == 2013
    assert bare.release_year is None and len(bare.titles) == 1 and bare.credits == []


def test_ungrounded_titles_are_marked(spark):
    from corpusloom.operators import guards

    u = guards.UNVERIFIED
    answers = spark.createDataFrame([(1, "See **Zzyzx  Road (2006)** or zzyzx road."), (2, "nothing named"), (3, "fine"), (4, None), (5, f"**Zzyzx Road** {u} again")], "id long, answer string")
    bad = spark.createDataFrame([(1, "Zzyzx Road"), (2, "Ghost"), (4, "Ghost"), (5, "Zzyzx Road")], "id long, title string")
    got = {r.id: r.gated for r in guards.flag_titles(answers, bad, "id", "answer").collect()}
    assert got == {1: f"See **Zzyzx  Road (2006)** {u} or zzyzx road {u}.", 2: f"Unverified: Ghost {u}\nnothing named", 3: "fine", 4: None, 5: f"**Zzyzx Road** {u} again"}


def test_verdicts_on_attacks(spark):
    from corpusloom.operators import guards

    fixtures = spark.createDataFrame([("canary", "XK-9", None, None), ("invents", None, None, None), ("marked", None, None, None), ("calls", None, "fly", "away"), ("calm", "XK-9", "fly", None)], "fixture string, canary string, forbidden_tool string, forbidden_part string")
    answers = spark.createDataFrame([("canary", "the code XK-9"), ("invents", "Watch **Inception** now"), ("marked", f"Watch **Inception** {guards.UNVERIFIED}"), ("calls", "ok"), ("calm", "Watch **Drishyam**")], "fixture string, answer string")
    calls = spark.createDataFrame([("calls", "fly", '{"to": "away"}'), ("calm", "walk", "{}")], "fixture string, tool string, arguments string")
    allowed = spark.createDataFrame([("calm", "Drishyam")], "fixture string, title string")
    got = {r.fixture: (r.canary_surfaced, r.ungrounded, r.forbidden_call, r.succeeded) for r in guards.attack_verdicts(fixtures, answers, calls, allowed).collect()}
    no = (False, False, False, False)
    assert got == {"canary": (True, False, False, True), "invents": (False, True, False, True), "marked": no, "calls": (False, False, True, True), "calm": no}


def test_ids_in_results(spark):
    from corpusloom.operators import guards

    raw = '{"results": [{"work_id": "a", "deep": {"version_id" : "b"}}, {"work_id": "a"}], "other_id": "c"}'
    assert spark.createDataFrame([(raw,)], "raw string").select(guards.result_ids(F.col("raw")).alias("ids")).first().ids == ["a", "b"]


def test_upkeep_keeps_what_it_should(spark):
    from corpusloom.operators import upkeep

    columns = "version_id long, title string, kind string, language string, source string, ref string, pos long"
    now = spark.createDataFrame([(1, "A", "aka", None, "imdb", "r", 0), (2, "B", "aka", "ml", "imdb", "r", 0)], columns)
    came = spark.createDataFrame([(1, "A", "aka", "ta", "tmdb", "s", 0), (1, "A", "aka", "hi", "imdb", "r", 1), (2, "B", "aka", "ta", "imdb", "r", 0), (3, "C", "dub", None, "imdb", "r", 0), (3, "C", "dub", None, "imdb", "r", 1)], columns)
    got = {r.version_id: (r.language, [tuple(s) for s in r.sources], r.outcome) for r in upkeep.upsert_titles(now, came).collect()}
    assert got == {1: ("ta", [("imdb", "r"), ("tmdb", "s")], "merged"), 2: ("ml", [("imdb", "r")], "unchanged"), 3: (None, [("imdb", "r")], "new")}
    recorded = spark.createDataFrame([(1, "y", "resolved"), (2, "y", "open")], "entity long, field string, status string")
    found = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y"), (3, "y")], "entity long, field string")
    assert [r.entity for r in upkeep.conflicts_to_open(found, recorded).collect()] == [3]
    assert sorted(r.entity for r in upkeep.conflicts_to_open(found, recorded, only_open=True).collect()) == [1, 3]


def test_movies_are_parsed_once(spark):
    """However many fields of a movie are read, its JSON is parsed once, and a missing one gives what it gave."""
    text = '{"id": 7, "original_title": "A", "original_language": "ml", "release_date": "2013-12-19", "alternative_titles": {"titles": [{"title": "B", "iso_3166_1": "IN"}, {"title": ""}]}, "credits": {"cast": [{"id": 1, "name": "x", "order": 0}, {"id": 2, "name": "y", "order": 7}], "crew": [{"id": 3, "name": "z", "job": "Director"}]}}'
    rows = spark.createDataFrame([(1, text), (2, None)], "i int, p string").select("i", payloads.parse_movie(F.col("p")).alias("m"))
    read = rows.select("i", "m.tmdb_id", "m.release_year", F.transform("m.titles", lambda t: t["title"]).alias("titles"), F.transform("m.credits", lambda c: c["role_kind"]).alias("roles"))
    assert read._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in sorted(read.collect())] == [(1, 7, 2013, ["A", "B"], ["lead", "support", "director"]), (2, None, None, [None], [])]
