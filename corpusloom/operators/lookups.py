"""Joins that put recorded things beside those that name them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse_space


def replayed(fixtures: DataFrame, recorded: DataFrame, k: int = 10) -> DataFrame:
    """(fixture, works, abstain) of each fixture: the first `k` of its recorded ranking (fixture, works array, abstain); one that
    wasn't recorded gives no works and abstains."""
    joined = fixtures.select("fixture").join(recorded, "fixture", "left")
    kind = recorded.schema["works"].dataType
    return joined.select("fixture", F.coalesce(F.slice("works", 1, k), F.array().cast(kind)).alias("works"), F.coalesce("abstain", F.lit(True)).alias("abstain"))


def citations(chunks: DataFrame, plots: DataFrame, fallback: str = "seed metadata") -> DataFrame:
    """`chunks` (chunk_id, plot_id) with citation: the plot's source and address, or `fallback` for chunks without a plot."""
    named = plots.select("plot_id", F.concat_ws(" ", "source", "source_url").alias("cited"))
    return chunks.join(named, "plot_id", "left").select("chunk_id", F.coalesce("cited", F.lit(fallback)).alias("citation"))


def pages_to_read(plots: DataFrame, versions: DataFrame, language: str = "en") -> DataFrame:
    """(page_key, page_title, revision_id): encyclopedia plots in one language, keyed `title (year)|version's language|language`; the
    page's title is the last part of its address, underscores as blanks."""
    own = plots.where((F.col("source") == "wikipedia") & (F.col("language") == language)).select("version_id", F.col("language").alias("plot_language"), "source_url", "revision_id")
    key = F.concat(F.col("title"), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(")|"), F.col("language"), F.lit("|"), F.col("plot_language"))
    return own.join(versions, "version_id").select(key.alias("page_key"), F.replace(F.element_at(F.split("source_url", "/"), -1), F.lit("_"), F.lit(" ")).alias("page_title"), "revision_id")


def proposed(candidates: DataFrame) -> DataFrame:
    """Candidates still to be decided on, with their place by type and title, those without a title last."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("edge_type").orderBy(F.asc_nulls_last("title"), "candidate_id")
    return candidates.where("status = 'proposed'").withColumn("place", F.row_number().over(order))


def protected_queries(surfaces: dict[str, DataFrame]) -> DataFrame:
    """(surface, query) of every set of queries that training data must keep away from; one that two sets have is in both."""
    parts = [rows.select(F.lit(name).alias("surface"), collapse_space(F.col("query")).alias("query")).where("query <> ''") for name, rows in surfaces.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backlinks(statements: DataFrame, known: DataFrame) -> DataFrame:
    """(item): what is based on a known item, or what a known item says is derived from it, once each and not known itself.
    `statements`: (item, property, target), `known`: (item)."""
    seeds = known.select(F.col("item").alias("seed")).distinct()
    based = statements.where("property = 'based_on'").join(seeds, F.col("target") == F.col("seed")).select("item")
    derived = statements.where("property = 'derivative'").join(seeds, F.col("item") == F.col("seed")).select(F.col("target").alias("item"))
    return based.union(derived).distinct().join(seeds, F.col("item") == F.col("seed"), "left_anti")


def expected_rows(expected: DataFrame, visible: DataFrame) -> DataFrame:
    """`expected` (fixture, title, language, year) with n_visible: how many visible versions are exactly that; 0 is an issue."""
    keys = ["title", "language", "year"]
    counts = visible.groupBy(*keys).agg(F.count("*").alias("n_visible"))
    return expected.join(counts, keys, "left").withColumn("n_visible", F.coalesce("n_visible", F.lit(0)))
