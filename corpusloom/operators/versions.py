"""Versions of works: sets with scope and franchise, the original, literary sources, title resolution, ways to refine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import matching
from corpusloom.operators import blocks, refine
from corpusloom.session import written


def version_sets(asked: DataFrame, versions: DataFrame, franchises: DataFrame | None = None, scope: str = "all") -> DataFrame:
    """`versions` of every asked work (work_id), of its whole franchise where franchises (node, component) are given, of one
    country unless `scope` is all, with asked (the work) and is_the_original: the original of the work itself, of several one
    with a hub id before others, then the first by year and id. `versions`: version_id, work_id, country, year, is_original, hub_id."""
    works = asked.select(F.col("work_id").alias("asked")).distinct()
    if franchises is None:
        pairs = works.withColumn("work_id", F.col("asked"))
    else:
        other = franchises.select(F.col("node").alias("work_id"), "component")
        linked = works.join(franchises.select(F.col("node").alias("asked"), "component"), "asked").join(other, "component").select("asked", "work_id")
        pairs = works.withColumn("work_id", F.col("asked")).unionByName(linked).distinct()
    rows = versions.join(pairs, "work_id").where(F.lit(True) if scope == "all" else F.col("country") == scope)
    able = F.col("is_original") & (F.col("work_id") == F.col("asked"))
    first = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(able), F.col("hub_id").isNull(), F.asc_nulls_last("year"), "version_id")) == 1
    return rows.withColumn("is_the_original", F.coalesce(able & first, F.lit(False)))


# fixed values: labels of a version's edges
EDGE_LABELS = {"is_remake_of": "remake", "is_official_dub_of": "official_dub"}


def version_entries(rows: DataFrame, cast: DataFrame, edges: DataFrame, leads: int = 5) -> DataFrame:
    """`rows` of version_sets with leads (names of the first `leads` leads by billing, then name) and relationship: that of an edge
    that the version goes out from, the least by type and target of several, else `original`, else `sequel` for a version of
    another work than the asked one, else null. `cast`: version_id, name, role_kind, billing_order; `edges`: edge_type, src, dst."""
    asked = rows.select("version_id").distinct()
    names = refine.top_names(cast.where("role_kind = 'lead'").join(asked, "version_id", "left_semi"), "version_id", [F.asc_nulls_last("billing_order"), F.asc("name")], "name", leads)
    kinds = F.create_map(*(F.lit(x) for pair in EDGE_LABELS.items() for x in pair))
    out = edges.where(F.col("edge_type").isin(*EDGE_LABELS)).groupBy(F.col("src").alias("version_id")).agg(F.min(F.struct("edge_type", "dst")).alias("_edge"))
    joined = rows.join(names.select("version_id", F.col("names").alias("leads")), "version_id", "left").join(out, "version_id", "left")
    label = F.when(F.col("_edge").isNotNull(), kinds[F.col("_edge.edge_type")]).when(F.col("is_original"), "original").when(F.col("work_id") != F.col("asked"), "sequel")
    return joined.withColumns({"leads": F.coalesce("leads", F.array().cast("array<string>")), "relationship": label}).drop("_edge")


def with_source(works: DataFrame, edges: DataFrame) -> DataFrame:
    """`works` (work_id, title, work_type) with n_based_on and the work that each is based on, the least id of several:
    source_id, source_title, source_type. A source that isn't among the works has an id but no title."""
    based = edges.where("edge_type = 'based_on'").groupBy(F.col("src").alias("work_id")).agg(F.count_distinct("dst").alias("n_based_on"), F.min("dst").alias("source_id"))
    source = works.select(F.col("work_id").alias("source_id"), F.col("title").alias("source_title"), F.col("work_type").alias("source_type"))
    return works.join(based, "work_id", "left").join(source, "source_id", "left").withColumn("n_based_on", F.coalesce("n_based_on", F.lit(0)))


def resolve_titles(queries: DataFrame, titles: DataFrame, language: str | None = None, keys: int = 50, k: int = 10) -> DataFrame:
    """(query, version_id, work_id, matched_title, score, rank, ambiguous): of each query (query) up to `k` versions by score, then
    title, over titles (version_id, work_id, title, language) of visible versions. The best `keys` match keys within the
    ratio count, all versions under one key; of a version's titles the best, then the first by title. Ambiguous: more than one
    work is among those returned. Queries are a stated set: they are compared with all keys in blocks."""
    index = written((titles if language is None else titles.where(F.col("language") == language)).withColumn("key", matching.match_key("title")))
    asked = written(queries.select("query").distinct().withColumns({"key": matching.match_key("query"), "id": F.xxhash64("query")}))
    near = blocks.near_texts(asked.select("id", "key"), written(index.select("key").distinct()), "id", "key", matching.MATCH_THRESHOLD).where(F.col("score") >= matching.MATCH_THRESHOLD)
    best = refine.best_per_group(near.select("id", "key", F.round("score", 4).alias("score")), ["id"], [F.desc("score"), F.asc("key")], keys)
    found = best.join(index, "key").join(asked.select("id", "query"), "id")
    per_version = refine.best_per_group(found, ["query", "version_id"], [F.desc("score"), F.asc("title")])
    ranked = per_version.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "title", "version_id"))).where(F.col("rank") <= k)
    works = Window.partitionBy("query")
    return ranked.select("query", "version_id", "work_id", F.col("title").alias("matched_title"), "score", "rank", (F.min("work_id").over(works) != F.max("work_id").over(works)).alias("ambiguous"))


def card_hits(resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, item, score, rank): the title channel of a search, the metadata card of each resolved version in that order.
    `chunks`: chunk_id, version_id, kind; versions without a card drop out."""
    cards = chunks.where("kind = 'metadata_card'").groupBy("version_id").agg(F.min("chunk_id").alias("item"))
    hits = resolved.join(cards, "version_id")
    return hits.select("query", "item", "score", F.row_number().over(Window.partitionBy("query").orderBy("rank")).alias("rank"))


def refinements(entries: DataFrame) -> DataFrame:
    """(set_id, dimension, value string): by what a set of versions (set_id, version_id, language, year, lead, is_original) can be
    narrowed: languages and years that some but not all of it have, up to three first leads, and newer if there is an
    original among several."""
    sizes = entries.groupBy("set_id").agg(F.count("*").alias("n"), F.max("is_original").alias("has_original"))
    parts = []
    for dimension in ("language", "year"):
        counts = entries.where(F.col(dimension).isNotNull()).groupBy("set_id", dimension).agg(F.count("*").alias("c"))
        parts.append(counts.join(sizes, "set_id").where("c < n").select("set_id", F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("value")))
    leads = entries.where("lead IS NOT NULL").select("set_id", "lead").distinct()
    parts.append(refine.best_per_group(leads, ["set_id"], [F.asc("lead")], 3).select("set_id", F.lit("actor").alias("dimension"), F.col("lead").alias("value")))
    parts.append(sizes.where("has_original AND n > 1").select("set_id", F.lit("era").alias("dimension"), F.lit("newer").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
