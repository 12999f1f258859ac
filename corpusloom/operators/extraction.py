"""Loading what a model has extracted: every proposal leaves by exactly one exit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.answers import first_object, proposals
from corpusloom.functions.text import collapse_space
from corpusloom.session import written

#: What a repeat is known by.
_KEY = ["edge_type", "src_title", "dst_title", "source_page"]
EXITS = ("malformed", "empty", "unsupported", "repeat_in_table", "repeat_in_batch", "unbound", "inserted")


def exits(answers: DataFrame, pages: DataFrame, table: DataFrame, names: DataFrame) -> DataFrame:
    """(page_key, place, exit, edge_type, src_title, dst_title, supporting_sentence, confidence, source_page, source_revision,
    src_version_id, dst_version_id): a row per proposal of `answers` (page_key, raw), and one, without place, per answer that
    has none.

    exit: `malformed` (no well-formed object of the expected fields, or no page of that key), `empty` (no proposals),
    `unsupported` (its sentence doesn't stand in the page's text), `repeat_in_table` (`table` has its kind, titles and page),
    `repeat_in_batch` (an earlier supported one has, by page key and place), else `inserted`, or `unbound` if an end has no
    version: such candidates are kept too, for a reviewer. `pages`: page_key, title, text, revision; keys of answers and pages
    are unique. `names`: title, language, version_id, the titles that are bound without doubt, once each; a null language
    of a proposal is any. Both ends bound to one version leave the second unbound.
    """
    page = pages.select("page_key", F.col("title").alias("source_page"), F.col("revision").cast("string").alias("source_revision"), collapse_space(F.col("text")).alias("_source"))
    read = answers.select("page_key", proposals(first_object(F.col("raw"))).alias("_found")).join(page, "page_key", "left")
    # the page's text is looked at here, before proposals become rows of their own
    supported = lambda p: F.coalesce((collapse_space(p["supporting_sentence"]) != "") & F.contains(F.col("_source"), collapse_space(p["supporting_sentence"])), F.lit(False))
    checked = read.withColumn("_found", F.transform("_found", lambda p: F.struct(p.alias("p"), supported(p).alias("ok"))))
    state = F.when(F.col("_found").isNull() | F.col("source_page").isNull(), "malformed").when(F.size("_found") == 0, "empty")
    rows = checked.withColumn("_state", state).select("page_key", "source_page", "source_revision", "_state", F.posexplode_outer(F.when(F.col("_state").isNull(), F.col("_found"))).alias("place", "_one"))
    flat = rows.select("page_key", "place", "_state", F.col("_one.ok").alias("_ok"), "_one.p.*", "source_page", "source_revision")
    flat = written(flat.withColumn("_state", F.coalesce("_state", F.when(~F.col("_ok"), "unsupported"))))
    open_ = flat.where("_state IS NULL")
    known = table.select(*_KEY).distinct().withColumn("_known", F.lit(True))
    marked = open_.join(known, _KEY, "left")
    first = open_.groupBy(*_KEY).agg(F.min(F.struct("page_key", "place")).alias("_first"))
    marked = marked.join(first, _KEY)
    repeat = F.when(F.col("_known"), "repeat_in_table").when(F.struct("page_key", "place") != F.col("_first"), "repeat_in_batch")
    marked = marked.withColumn("_state", repeat).drop("_known", "_first")
    for end in ("src", "dst"):
        own = names.groupBy(F.col("title").alias(f"{end}_title"), "language").agg(F.min("version_id").alias("_v"), F.max("version_id").alias("_w"))
        any_language = own.groupBy(f"{end}_title").agg(F.min("_v").alias("_v"), F.max("_w").alias("_w")).withColumn("language", F.lit(None).cast("string"))
        bound = own.where("language IS NOT NULL").unionByName(any_language).where("_v = _w").select(f"{end}_title", F.col("language").alias(f"_{end}_language"), F.col("_v").alias(f"{end}_version_id"))
        marked = marked.join(bound, (marked[f"{end}_title"] == bound[f"{end}_title"]) & marked[f"{end}_language"].eqNullSafe(bound[f"_{end}_language"]), "left").drop(bound[f"{end}_title"], f"_{end}_language")
    marked = marked.withColumn("dst_version_id", F.when(~F.col("dst_version_id").eqNullSafe(F.col("src_version_id")), F.col("dst_version_id")))
    bound_both = F.col("src_version_id").isNotNull() & F.col("dst_version_id").isNotNull()
    settled = marked.withColumn("_state", F.coalesce("_state", F.when(bound_both, "inserted").otherwise("unbound")))
    every = flat.where("_state IS NOT NULL").withColumns({f"{e}_version_id": F.lit(None).cast(names.schema["version_id"].dataType) for e in ("src", "dst")}).unionByName(settled)
    return every.select("page_key", "place", F.col("_state").alias("exit"), "edge_type", "src_title", "dst_title", "supporting_sentence", "confidence", "source_page", "source_revision", "src_version_id", "dst_version_id")


def new_candidates(found: DataFrame) -> DataFrame:
    """The rows of exits() that go into the table, with their status."""
    return found.where(F.col("exit").isin("inserted", "unbound")).drop("exit", "place", "page_key").withColumn("status", F.lit("proposed"))


def report(found: DataFrame) -> DataFrame:
    """One row: answers, malformed ones and their rate, proposals, and how many left by each exit. The exits sum to the rows."""
    counts = [F.count_if(F.col("exit") == e).alias(e) for e in EXITS]
    totals = found.agg(F.count_distinct("page_key").alias("answers"), F.count("place").alias("proposals"), *counts)
    return totals.withColumn("failure_rate", F.when(F.col("answers") > 0, F.round(F.col("malformed") / F.col("answers"), 4)))
