"""One ordered pass that takes curated works and versions, and what an entity base says of them, into the graph.

Works, versions, conflicts and edges depend on one another: a version's work must have its id before the version has one, and
an edge needs both. Ids are hashes of natural keys, so they are known without writing anything, and all four tables follow
from one reading; they are sealed together as one version. Running the pass again over its own result changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.merge import merge_sources
from corpusloom.session import written
from corpusloom.sources import runs

_SOURCES = "array<struct<source: string, ref: string>>"
WORKS = "work_id string, work_type string, primary_title string, original_language string, first_release_year int, wikidata_qid string, confidence string, human_verified boolean, sources " + _SOURCES
VERSIONS = "version_id string, work_id string, wikidata_qid string, tmdb_id string, imdb_id string, title string, language string, release_year int, country string, is_original boolean, confidence string, human_verified boolean, sources " + _SOURCES
EDGES = "edge_type string, src_kind string, src_id string, dst_kind string, dst_id string, confidence string, sources " + _SOURCES
CONFLICTS = "entity_kind string, entity_id string, field string, `values` string, status string, resolution string"
TABLES = {"works": WORKS, "versions": VERSIONS, "edges": EDGES, "conflicts": CONFLICTS}
# fixed values: properties of the entity base that edges come from, by the field that holds them
PROPERTIES = {"based_on": "P144", "derivative_works": "P4969", "follows": "P155", "followed_by": "P156"}
_YEAR = "P577"


def natural_id(*parts: Column | str) -> Column:
    """An id from a natural key: the same key, null or not, gives the same id in every run."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("-")) for p in parts)), 256), 1, 32)


def _refs(seed_ref: str, qid: str) -> Column:
    entry = lambda source, ref: F.struct(F.lit(source).alias("source"), ref.alias("ref"))
    own = F.array(entry("human", F.lit(seed_ref)))
    return F.when(F.col(qid).isNotNull(), F.concat(own, F.array(entry("wikidata", F.col(qid))))).otherwise(own)


def _union_of_refs(refs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, sources): references of a key's rows together, each once, in the order in which they first come. Rows are reduced to
    one a reference before a key's are listed."""
    each = refs.select(*keys, *order, F.posexplode("sources").alias("_n", "_s")).groupBy(*keys, "_s").agg(F.min(F.struct(*order, "_n")).alias("_first"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_s"))), lambda x: x["_s"]).alias("_came"))


def _upserted(name: str, current: DataFrame, incoming: DataFrame, key: str, overwritten: list[str], filled: list[str], raised: bool) -> DataFrame:
    """`current` after `incoming` (one row per `key`, with _came): sources merged; unless a human verified the row, `overwritten` are
    the incoming ones; of `filled`, incoming values take the place of nulls where one did; confidence is incoming HIGH or what
    it was if `raised`. outcome: new, changed, unchanged, kept."""
    old = current.select(*(F.col(c).alias(f"_old_{c}") for c in current.columns), F.lit(True).alias("_is_old"))
    both = incoming.withColumn("_is_new", F.lit(True)).join(old, F.col(key) == F.col(f"_old_{key}"), "full_outer")
    verified = F.coalesce("_old_human_verified", F.lit(False))

    def value(c: str) -> Column:
        new, was = F.col(c) if c in incoming.columns else F.lit(None), F.col(f"_old_{c}")
        if c == "sources":
            return F.when(F.col("_is_old").isNull(), F.col("_came")).when(F.col("_is_new").isNull(), was).otherwise(merge_sources(was, F.col("_came")))
        if c == "human_verified":
            return verified
        if c == "confidence":
            return F.when(F.col("_is_old").isNull(), new).when(~verified & (new == "HIGH") & F.lit(raised), new).otherwise(was)
        if c in filled:
            return F.when(F.col("_is_old").isNull(), new).when(F.col("_is_new").isNull(), was).when(verified, F.coalesce(was, new)).otherwise(new if c in overwritten else F.coalesce(new, was))
        takes = F.col("_is_old").isNull() | (F.col("_is_new").isNotNull() & ~verified) if c in overwritten or c == key else F.col("_is_old").isNull()
        return F.when(takes, new).otherwise(was)

    kinds = T.StructType.fromDDL(TABLES[name])
    out = both.select(*(value(c).cast(kinds[c].dataType).alias(c) for c in current.columns), *(F.col(f"_old_{c}") for c in current.columns), "_is_old", "_is_new")
    differs = F.lit(False)
    for c in current.columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    outcome = F.when(F.col("_is_old").isNull(), "new").when(F.col("_is_new").isNull(), "kept").when(differs, "changed").otherwise("unchanged")
    return out.select(*current.columns, outcome.alias("outcome"))


def ingest(current: dict[str, DataFrame], seed_works: DataFrame, seed_versions: DataFrame, entities: DataFrame, seed_ref: str = "seed") -> dict[str, DataFrame]:
    """The four tables after the pass, each with outcome (new, changed, unchanged, kept), and `unmatched` (qid): what entities name
    that is neither a version nor a work of the seed.

    `current`: works, versions, edges, conflicts. `seed_works`: work_key, work_type, primary_title, original_language,
    first_release_year, wikidata_qid. `seed_versions`: work_key, version_key, title, language, release_year, country, is_original,
    wikidata_qid. `entities`: qid, publication_years, tmdb_id, imdb_id, and arrays of ids in the fields of PROPERTIES; one row
    per qid. A work is known by its id in the entity base, or that of its first original version, else by title and year; a
    version by its id there, else by work, language and year. Of several seed rows for one record the last by key counts, their
    sources are joined. A year that the entity base doesn't have opens a conflict, unless one is open. Edges are written once.
    """
    # works: the anchor, the record that is there, or a new id
    original = seed_versions.where("is_original AND wikidata_qid IS NOT NULL").groupBy("work_key").agg(F.min_by("wikidata_qid", "version_key").alias("_of_original"))
    works = seed_works.join(original, "work_key", "left").withColumn("_anchor", F.coalesce("wikidata_qid", "_of_original"))
    by_qid = current["works"].where("wikidata_qid IS NOT NULL").groupBy(F.col("wikidata_qid").alias("_anchor")).agg(F.min("work_id").alias("_by_qid"))
    by_name = current["works"].groupBy(F.col("primary_title").alias("_t"), F.col("first_release_year").alias("_y")).agg(F.min("work_id").alias("_by_name"))
    works = works.join(by_qid, "_anchor", "left").join(by_name, F.col("primary_title").eqNullSafe(F.col("_t")) & F.col("first_release_year").eqNullSafe(F.col("_y")), "left")
    # new works under one anchor are one, named by the first of them
    name = natural_id(F.lit("work"), "primary_title", "first_release_year")
    named = works.where("_anchor IS NOT NULL").groupBy("_anchor").agg(F.min_by(name, "work_key").alias("_shared"))
    works = written(works.join(named, "_anchor", "left").withColumn("work_id", F.coalesce("_by_qid", "_by_name", "_shared", name)).select("work_key", "work_id", "work_type", "primary_title", "original_language", "first_release_year", F.col("_anchor").alias("wikidata_qid")))
    works = works.withColumns({"confidence": F.when(F.col("wikidata_qid").isNotNull(), "HIGH").otherwise("MEDIUM"), "sources": _refs(seed_ref, "wikidata_qid")})
    fields = ["work_type", "primary_title", "original_language", "first_release_year", "wikidata_qid", "confidence"]
    last = works.groupBy("work_id").agg(*(F.max_by(c, "work_key").alias(c) for c in fields)).join(_union_of_refs(works, ["work_id"], ["work_key"]), "work_id")
    new_works = _upserted("works", current["works"], last, "work_id", ["original_language", "wikidata_qid"], ["wikidata_qid"], raised=False)
    ids = works.select("work_key", "work_id")

    # versions: likewise, below their works
    rows = seed_versions.join(ids, "work_key").join(entities.select(F.col("qid").alias("wikidata_qid"), "publication_years", "tmdb_id", "imdb_id", F.lit(True).alias("_entity")), "wikidata_qid", "left")
    by_qid = current["versions"].where("wikidata_qid IS NOT NULL").groupBy(F.col("wikidata_qid")).agg(F.min("version_id").alias("_by_qid"))
    by_key = current["versions"].groupBy(F.col("work_id").alias("_w"), F.col("language").alias("_l"), F.col("release_year").alias("_y")).agg(F.min("version_id").alias("_by_key"))
    same = (F.col("work_id") == F.col("_w")) & F.col("language").eqNullSafe(F.col("_l")) & F.col("release_year").eqNullSafe(F.col("_y"))
    key = natural_id(F.lit("version"), "work_id", "language", "release_year")
    shared = rows.where("wikidata_qid IS NOT NULL").groupBy("wikidata_qid").agg(F.min_by(key, F.struct("work_key", "version_key")).alias("_shared"))
    rows = rows.join(by_qid, "wikidata_qid", "left").join(by_key, same, "left").join(shared, "wikidata_qid", "left").withColumn("version_id", F.coalesce("_by_qid", "_by_key", "_shared", key))
    rows = rows.withColumns({"confidence": F.when(F.col("wikidata_qid").isNotNull(), "HIGH").otherwise("MEDIUM"), "sources": _refs(seed_ref, "wikidata_qid")})
    fields = ["work_id", "wikidata_qid", "tmdb_id", "imdb_id", "title", "language", "release_year", "country", "is_original", "confidence", "publication_years", "_entity"]
    rows = written(rows.select("version_id", "work_key", "version_key", *fields, "sources"))
    order = F.struct("work_key", "version_key")
    last = rows.groupBy("version_id").agg(*(F.max_by(c, order).alias(c) for c in fields)).join(_union_of_refs(rows, ["version_id"], ["work_key", "version_key"]), "version_id")
    new_versions = _upserted("versions", current["versions"], last, "version_id", ["title", "release_year", "country", "is_original"], ["tmdb_id", "imdb_id"], raised=True)

    # conflicts: a year of the seed that the entity base doesn't have
    off = rows.where(F.size("publication_years") > 0).where(~F.array_contains("publication_years", F.col("release_year")))
    said = F.to_json(F.array(F.struct(F.col("release_year").cast("string").alias("value"), F.lit(f"human:{seed_ref}").alias("source")), F.struct(F.array_join("publication_years", ",").alias("value"), F.concat(F.lit("wikidata:"), "wikidata_qid", F.lit(f"#{_YEAR}")).alias("source"))))
    found = off.groupBy("version_id").agg(F.min_by(said, order).alias("values")).select(F.lit("version").alias("entity_kind"), F.col("version_id").alias("entity_id"), F.lit("release_year").alias("field"), "values", F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"))
    opened = found.join(current["conflicts"].where("status = 'open'").select("entity_id", "field").distinct(), ["entity_id", "field"], "left_anti").select(*current["conflicts"].columns)
    new_conflicts = current["conflicts"].withColumn("outcome", F.lit("kept")).unionByName(opened.withColumn("outcome", F.lit("new")))

    # edges: what the entity base states between versions of the seed, and between their works
    own = rows.where("wikidata_qid IS NOT NULL").groupBy(F.col("wikidata_qid").alias("_q")).agg(F.max_by("version_id", order).alias("_v"), F.max_by("work_id", order).alias("_vw"))
    of_work = works.where("wikidata_qid IS NOT NULL").groupBy(F.col("wikidata_qid").alias("_q")).agg(F.max_by("work_id", "work_key").alias("_w"))
    stated = None
    for field, prop in PROPERTIES.items():
        one = entities.select("qid", F.lit(field).alias("field"), F.lit(prop).alias("prop"), F.explode(field).alias("target"))
        stated = one if stated is None else stated.unionByName(one)
    for end, column in (("src", "qid"), ("dst", "target")):
        for side in (own, of_work):
            named = side.select(*(F.col(c).alias(f"{end}{c}") for c in side.columns))
            stated = stated.join(named, F.col(column) == F.col(f"{end}_q"), "left").drop(f"{end}_q")
    stated = written(stated)
    between = F.col("src_v").isNotNull() & F.col("dst_v").isNotNull()
    edge = lambda kind, of, src, dst: F.struct(F.lit(kind).alias("edge_type"), F.lit(of).alias("of"), src.alias("src"), dst.alias("dst"))
    c = F.col
    made = (
        F.when((c("field") == "based_on") & between, edge("is_remake_of", "version", c("src_v"), c("dst_v")))
        .when((c("field") == "based_on") & c("src_v").isNotNull() & c("dst_w").isNotNull(), edge("based_on", "work", c("src_vw"), c("dst_w")))
        .when((c("field") == "derivative_works") & between, edge("is_remake_of", "version", c("dst_v"), c("src_v")))
        .when((c("field") == "derivative_works") & c("src_w").isNotNull() & c("dst_v").isNotNull(), edge("based_on", "work", c("dst_vw"), c("src_w")))
        .when((c("field") == "follows") & between, edge("is_sequel_of", "work", c("src_vw"), c("dst_vw")))
        .when((c("field") == "followed_by") & between, edge("is_sequel_of", "work", c("dst_vw"), c("src_vw")))
    )
    edges = stated.withColumn("e", made).where("e.src <> e.dst").groupBy("e.edge_type", "e.of", "e.src", "e.dst").agg(F.min(F.struct("qid", "prop")).alias("_ref"))
    known = current["edges"].select("edge_type", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()
    fresh = edges.join(known, ["edge_type", "src", "dst"], "left_anti").select("edge_type", F.col("of").alias("src_kind"), F.col("src").alias("src_id"), F.col("of").alias("dst_kind"), F.col("dst").alias("dst_id"), F.lit("HIGH").alias("confidence"), F.array(F.struct(F.lit("wikidata").alias("source"), F.concat("_ref.qid", F.lit("#"), "_ref.prop").alias("ref"))).alias("sources"))
    new_edges = current["edges"].withColumn("outcome", F.lit("kept")).unionByName(fresh.withColumn("outcome", F.lit("new")))
    unmatched = stated.where("field IN ('based_on', 'derivative_works') AND dst_v IS NULL AND dst_w IS NULL").select(F.col("target").alias("qid")).distinct()
    return {"works": new_works, "versions": new_versions, "edges": new_edges, "conflicts": new_conflicts, "unmatched": unmatched}


def ingest_and_commit(base: str, seed_works: DataFrame, seed_versions: DataFrame, entities: DataFrame, seed_ref: str = "seed") -> tuple[int, dict[str, dict[str, int]]]:
    """Take the seed into the newest sealed version of the graph at `base` (an empty one if there is none) and seal the tables
    together as the next. Gives its number and, by table, how many rows had each outcome, counted while they were written."""
    spark = seed_works.sparkSession
    current = {n: t for n, t in runs.latest(spark, base).items() if n in TABLES} if runs.versions(spark, base) else {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    after = ingest(current, seed_works, seed_versions, entities, seed_ref)
    seen, out = {}, {}
    for name, rows in after.items():
        seen[name] = Observation(name)
        if name == "unmatched":
            out[name] = rows.observe(seen[name], F.count("*").alias("rows"))
        else:
            out[name] = rows.observe(seen[name], *(F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "changed", "unchanged", "kept"))).drop("outcome")
    number = runs.commit(out, base)
    return number, {name: seen[name].get for name in after}
