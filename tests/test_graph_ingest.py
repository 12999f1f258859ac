import pytest
from corpusloom.operators import ingest
from corpusloom.plans.ingest import graph_ingest
from corpusloom.sources import runs
from pyspark.sql import functions as F

WORK = "work_key string, work_type string, primary_title string, original_language string, first_release_year int, wikidata_qid string"
VERSION = "work_key string, version_key string, title string, language string, release_year int, country string, is_original boolean, wikidata_qid string"
ENTITY = "qid string, publication_years array<int>, tmdb_id string, imdb_id string, based_on array<string>, derivative_works array<string>, follows array<string>, followed_by array<string>"


@pytest.fixture
def seed(spark):
    works = spark.createDataFrame([("a", "film", "A", "ml", 2013, None), ("b", "book", "B", "en", 1950, "QB"), ("c", "film", "C", "hi", 2001, None)], WORK)
    versions = spark.createDataFrame([("a", "1", "A", "ml", 2013, "IN", True, "Q1"), ("a", "2", "A2", "hi", 2015, "IN", False, "Q2"), ("a", "3", "A dub", "ta", 2013, "IN", False, None), ("c", "1", "C", "hi", 2001, None, True, "Q3")], VERSION)
    none = []
    entities = spark.createDataFrame([("Q1", [2013], "t1", None, ["QB"], ["Q2"], none, none), ("Q2", [2014], "t2", "i2", ["Q1", "Q99"], none, none, none), ("Q3", none, None, None, none, none, ["Q2", "Q98"], none), ("QB", none, None, None, none, ["Q1", "Q97"], none, none)], ENTITY)
    return works, versions, entities


def test_one_pass(spark, tmp_path, seed):
    """Tables by hand; the second run over the first's result changes nothing; both are sealed versions."""
    base = f"{tmp_path}/graph"
    number, counts = ingest.ingest_and_commit(base, *seed)
    assert number == 1 and counts["works"] == {"new": 3, "changed": 0, "unchanged": 0, "kept": 0} and counts["versions"]["new"] == 4 and counts["edges"]["new"] == 3 and counts["conflicts"]["new"] == 1 and counts["unmatched"]["rows"] == 2
    t = runs.latest(spark, base)
    work = {r.primary_title: r for r in t["works"].collect()}
    version = {r.title: r for r in t["versions"].collect()}
    assert (work["A"].wikidata_qid, work["A"].confidence, work["C"].wikidata_qid, work["B"].wikidata_qid) == ("Q1", "HIGH", "Q3", "QB")
    assert version["A dub"].confidence == "MEDIUM" and [tuple(s) for s in version["A2"].sources] == [("human", "seed"), ("wikidata", "Q2")] and version["A2"].tmdb_id == "t2"
    edges = {(r.edge_type, r.src_id, r.dst_id): r.sources[0].ref for r in t["edges"].collect()}
    assert edges == {("is_remake_of", version["A2"].version_id, version["A"].version_id): "Q1#P4969", ("based_on", work["A"].work_id, work["B"].work_id): "Q1#P144", ("is_sequel_of", work["C"].work_id, work["A"].work_id): "Q3#P155"}
    conflict = t["conflicts"].first()
    assert conflict.entity_id == version["A2"].version_id and "2015" in conflict["values"] and "2014" in conflict["values"]
    assert {r.qid for r in t["unmatched"].collect()} == {"Q97", "Q99"}
    number, counts = ingest.ingest_and_commit(base, *seed)
    assert number == 2 and counts["works"]["unchanged"] == 3 and counts["versions"]["unchanged"] == 4 and counts["edges"] == {"new": 0, "changed": 0, "unchanged": 0, "kept": 3} and counts["conflicts"]["kept"] == 1 and counts["conflicts"]["new"] == 0
    again = runs.latest(spark, base)
    assert all(again[n].exceptAll(t[n]).isEmpty() and t[n].exceptAll(again[n]).isEmpty() for n in ("edges", "conflicts"))
    assert {tuple(r) for r in again["works"].select("work_id", "wikidata_qid").collect()} == {tuple(r) for r in t["works"].select("work_id", "wikidata_qid").collect()}


def test_verified_rows_keep_their_values(spark, seed):
    works, versions, entities = seed
    current = {n: spark.createDataFrame([], s) for n, s in ingest.TABLES.items()}
    first = {n: d.drop("outcome") for n, d in ingest.ingest(current, works, versions, entities).items() if n in ingest.TABLES}
    first["versions"] = first["versions"].withColumns({"human_verified": F.lit(True), "title": F.lit("mine"), "imdb_id": F.lit(None).cast("string")})
    after = ingest.ingest(first, works, versions, entities)["versions"].collect()
    assert {r.title for r in after} == {"mine"} and {r.wikidata_qid: r.imdb_id for r in after}["Q2"] == "i2"
    assert {r.wikidata_qid: r.outcome for r in after} == {"Q1": "unchanged", "Q2": "changed", "Q3": "unchanged", None: "unchanged"}


def test_several_seed_rows_for_one_record(spark):
    works = spark.createDataFrame([("a", "film", "A", "ml", 2013, "Q"), ("b", "film", "A again", "hi", 2014, "Q"), ("c", "film", "N", "hi", None, None), ("d", "film", "N", "ta", None, None)], WORK)
    current = {n: spark.createDataFrame([], s) for n, s in ingest.TABLES.items()}
    out = ingest.ingest(current, works, spark.createDataFrame([], VERSION), spark.createDataFrame([], ENTITY))
    assert sorted((r.primary_title, r.original_language) for r in out["works"].collect()) == [("A again", "hi"), ("N", "ta")]
    assert all(out[n].count() == 0 for n in ("versions", "edges", "conflicts", "unmatched"))


def test_sealed_runs(spark, tmp_path):
    rows = spark.range(10)
    runs.seal({"a": rows, "b": rows.limit(0)}, f"{tmp_path}/r")
    assert runs.open_run(spark, f"{tmp_path}/r")["a"].count() == 10 and runs.open_run(spark, f"{tmp_path}/r")["b"].count() == 0
    with pytest.raises(runs.RunError, match="already"):
        runs.seal({"a": rows}, f"{tmp_path}/r")
    with pytest.raises(runs.RunError, match="nothing"):
        runs.seal({}, f"{tmp_path}/none")
    stray = tmp_path / "r/tables/a/stray.parquet"
    stray.write_bytes(b"x")
    with pytest.raises(runs.RunError, match="stray: a/stray.parquet"):
        runs.open_run(spark, f"{tmp_path}/r")
    stray.unlink()
    part = max((tmp_path / "r/tables/a").glob("part-*"), key=lambda p: p.stat().st_size)
    for sum_file in (tmp_path / "r/tables/a").glob(".*.crc"):  # else the file system itself refuses the changed file
        sum_file.unlink()
    data = part.read_bytes()
    part.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(runs.RunError, match="changed: a/part"):
        runs.open_run(spark, f"{tmp_path}/r")
    part.unlink()
    with pytest.raises(runs.RunError, match="missing: a/part"):
        runs.open_run(spark, f"{tmp_path}/r")


def test_broken_write_is_no_version(spark, tmp_path):
    """A table that fails while it is written leaves no version, and its number isn't used again."""
    base = f"{tmp_path}/v"
    assert runs.versions(spark, base) == []
    with pytest.raises(runs.RunError):
        runs.latest(spark, base)
    assert runs.commit({"a": spark.range(3)}, base) == 1
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise("x").alias("x"))
    with pytest.raises(Exception, match="broken"):
        runs.commit({"a": spark.range(5), "b": bad}, base)
    assert runs.versions(spark, base) == [1] and runs.latest(spark, base)["a"].count() == 3
    with pytest.raises(runs.RunError, match="sealed"):
        runs.open_run(spark, f"{base}/v000002")
    assert runs.commit({"a": spark.range(7)}, base) == 3 and runs.latest(spark, base)["a"].count() == 7


def test_query_has_all_outcomes(spark):
    got = graph_ingest(spark, "/root/testdata/sf0.001").groupBy("table_name", "outcome").count().collect()
    assert {("works", "new"), ("works", "changed"), ("versions", "changed"), ("edges", "new"), ("conflicts", "new"), ("conflicts", "kept"), ("unmatched", "new")} <= {(r.table_name, r.outcome) for r in got}


def test_enriching_again_adds_nothing(spark):
    from corpusloom.operators import enrich

    versions = spark.createDataFrame([(1, 10, 7, None, "ml", 2013, True), (2, 10, None, None, "ta", 2015, False), (3, 11, 8, "tt8", "hi", None, True), (4, 12, 9, None, "hi", 2000, False)], "version_id int, work_id int, tmdb_id int, imdb_id string, language string, release_year int, is_original boolean")
    title, person = "array<struct<title: string, language: string, kind: string>>", "array<struct<person_id: int, name: string, role_kind: string, billing_order: int>>"
    movies = spark.createDataFrame([(7, "tt7", "hi", 2014, [("A", "hi", "canonical"), ("B", "ta", "translation"), ("C", "bn", "translation"), ("", None, "aka")], [(5, "P", "lead", 0), (5, "P", "lead", 3), (6, "Q", "director", None)]), (8, "ttX", "hi", 1999, None, None)], f"tmdb_id int, imdb_id string, original_language string, release_year int, titles {title}, credits {person}")
    titles = spark.createDataFrame([], "version_id int, title string, kind string, language string, source string, ref string, pos int")
    people, cast = spark.createDataFrame([("own", "P", 5)], "person_id string, name string, tmdb_person int"), spark.createDataFrame([], "version_id int, person_id string, role_kind string, billing_order int")
    conflicts = spark.createDataFrame([], "entity int, field string, status string")
    out = enrich.enrich(versions, movies, titles, people, cast, conflicts)
    assert {r.version_id: (r.imdb_id, r.outcome) for r in out["versions"].collect()} == {1: ("tt7", "filled"), 2: (None, "unchanged"), 3: ("tt8", "unchanged"), 4: (None, "unchanged")}
    assert {(r.version_id, r.title, r.kind) for r in out["titles"].collect()} == {(1, "A", "canonical"), (2, "B", "dub")}
    assert [r.name for r in out["people"].collect()] == ["Q"] and {(r.role_kind, r.billing_order) for r in out["cast"].collect()} == {("lead", 0), ("director", None)}
    assert {(r.field, r.status) for r in out["conflicts"].collect()} == {("release_year", "open"), ("original_language", "resolved")} and [r.tmdb_id for r in out["missing"].collect()] == [9]
    refs = out["titles"].select("version_id", "title", "kind", "language", F.posexplode("sources").alias("pos", "s")).select("version_id", "title", "kind", "language", "s.source", "s.ref", "pos")
    again = enrich.enrich(out["versions"].drop("outcome"), movies, refs, people.unionByName(out["people"].select(*people.columns)), cast.unionByName(out["cast"].select(*cast.columns)), conflicts.unionByName(out["conflicts"].select(*conflicts.columns)))
    assert all(again[n].count() == 0 for n in ("people", "cast", "conflicts")) and {r.outcome for r in again["titles"].collect()} == {"unchanged"} and {r.outcome for r in again["versions"].collect()} == {"unchanged"}
