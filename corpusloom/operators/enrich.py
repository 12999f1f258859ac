"""Versions enriched from movie payloads: ids, conflicts, titles, people and cast by one reading of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import fields, merge, routing, upkeep
from corpusloom.operators.ingest import natural_id


def enrich(versions: DataFrame, movies: DataFrame, titles: DataFrame, people: DataFrame, cast: DataFrame, conflicts: DataFrame, source: str = "tmdb") -> dict[str, DataFrame]:
    """What becomes of the tables after `movies` (tmdb_id, imdb_id, original_language, release_year, titles, credits, as parse_movie
    gives them; one row an id) have been taken in: versions, titles, people, cast, conflicts with the rows that are new, and missing
    (tmdb_id), the versions' ids without a movie. Taking them in again adds nothing.

    `versions`: version_id, work_id, tmdb_id, imdb_id, language, release_year, is_original. `titles`: a row per reference
    (version_id, title, kind, language, source, ref, pos). `people`: person_id, name, tmdb_person. `cast`: version_id, person_id,
    role_kind, billing_order. `conflicts`: entity, field, status. An imdb id fills a gap and replaces nothing. Years are judged
    by majority, so two that differ open a conflict; a version that is the original has its language judged by the source's
    order. A conflict that was recorded, whatever its status, isn't recorded again. Titles go to the version or to a sibling
    that the source doesn't know. A person is known by the source's id, a cast row by version, person and role.
    """
    known = versions.where("tmdb_id IS NOT NULL")
    met = known.join(movies.select("tmdb_id", F.col("imdb_id").alias("_imdb"), "original_language", F.col("release_year").alias("_year"), F.col("titles").alias("_titles"), "credits"), "tmdb_id")
    missing = known.join(movies, "tmdb_id", "left_anti").select("tmdb_id").distinct()
    ids = movies.select("tmdb_id", F.col("imdb_id").alias("_imdb"))
    filled = versions.join(ids, "tmdb_id", "left").withColumn("outcome", F.when(F.col("imdb_id").isNull() & F.col("_imdb").isNotNull(), "filled").otherwise("unchanged"))
    filled = filled.withColumn("imdb_id", F.coalesce("imdb_id", "_imdb")).select(*versions.columns, "outcome")

    claim = lambda field, value, by, pos: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(by).alias("source"), F.lit(pos).alias("pos"))
    years = F.when(F.col("release_year").isNotNull() & F.col("_year").isNotNull(), F.array(claim("release_year", F.col("release_year"), "human", 0), claim("release_year", F.col("_year"), source, 1)))
    languages = F.when(F.col("is_original") & F.col("language").isNotNull() & F.col("original_language").isNotNull(), F.array(claim("original_language", F.col("language"), "human", 0), claim("original_language", F.col("original_language"), source, 1)))
    none = F.array().cast("array<struct<field: string, value: string, source: string, pos: int>>")
    claims = met.select(F.col("version_id").alias("entity"), F.explode(F.concat(F.coalesce(years, none), F.coalesce(languages, none))).alias("c")).select("entity", "c.*")
    judged = fields.resolve_fields(claims).where("conflict <> 'none'").select("entity", "field", F.col("conflict").alias("status"), F.col("value").alias("chosen"), "rule")
    opened = upkeep.conflicts_to_open(judged, conflicts)

    # a title takes its reference along as one value, so routing needs to know nothing of it
    listed = met.select(F.col("tmdb_id").alias("external_id"), F.posexplode("_titles").alias("pos", "t"))
    packed = listed.select("external_id", F.struct(F.col("t.title").alias("title"), F.col("external_id").cast("string").alias("ref"), "pos").alias("title"), F.col("t.kind").alias("kind"), F.col("t.language").alias("language"))
    routed = routing.route_titles(packed, versions.withColumnRenamed("tmdb_id", "external_id"))
    incoming = routed.select("version_id", "title.title", "kind", "language", F.lit(source).alias("source"), "title.ref", "title.pos").where("title <> ''")
    merged = upkeep.upsert_titles(titles, incoming)

    credits = met.select("version_id", F.explode("credits").alias("c")).select("version_id", "c.*").where("person_id IS NOT NULL")
    found = credits.groupBy(F.col("person_id").alias("tmdb_person")).agg(F.min("name").alias("name"))
    found = found.select(natural_id(F.lit("person"), "tmdb_person").alias("person_id"), "name", "tmdb_person")
    everyone = merge.insert_absent(people.select("person_id", "name", "tmdb_person"), found, ["tmdb_person"])
    by_person = credits.join(everyone.select(F.col("person_id").alias("_own"), "tmdb_person"), F.col("person_id") == F.col("tmdb_person"))
    roles = by_person.groupBy("version_id", F.col("_own").alias("person_id"), "role_kind").agg(F.min("billing_order").alias("billing_order"))
    key = ["version_id", "person_id", "role_kind"]
    new_cast = roles.join(cast.select(*key), key, "left_anti")
    return {"versions": filled, "titles": merged, "people": everyone.join(people.select("tmdb_person"), "tmdb_person", "left_anti"), "cast": new_cast, "conflicts": opened, "missing": missing}
