"""Keeping the graph: titles and plots upserted, conflicts opened once, human decisions applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["version_id", "title", "kind"]


def upsert_titles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(version_id, title, kind, language, sources array<struct<source, ref>>, outcome), one row per title: current and incoming
    references (version_id, title, kind, language, source, ref, pos) together, current ones first, each (source, ref) once. The
    first language that isn't null counts. outcome: new, merged if there is a reference that wasn't there, unchanged, or
    kept if nothing came in. References are reduced to one row each before a title's are put in a list."""
    rows = current.withColumn("new", F.lit(0)).unionByName(incoming.withColumn("new", F.lit(1)))
    at = F.struct("new", "pos")
    said = F.min(F.when(F.col("language").isNotNull(), F.struct("new", "pos", "language"))).alias("said")
    refs = rows.groupBy(*_KEY, "source", "ref").agg(F.min(at).alias("at"), F.max("new").alias("came"), said)
    per = refs.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("at", "source", "ref"))).alias("refs"), F.min("said").alias("said"), F.min("at.new").alias("oldest"), F.max("at.new").alias("newest"), F.max("came").alias("came"))
    outcome = F.when(F.col("oldest") == 1, "new").when(F.col("newest") == 1, "merged").when(F.col("came") == 1, "unchanged").otherwise("kept")
    return per.select(*_KEY, F.col("said.language").alias("language"), F.transform("refs", lambda x: F.struct(x["source"], x["ref"])).alias("sources"), outcome.alias("outcome"))


def upsert_plots(current: DataFrame, pages: DataFrame) -> DataFrame:
    """(version_id, language, revision_id, text, outcome): plots keyed by version and language after `pages` of those columns came
    in: new, re-pinned if the revision is another one, unchanged, kept. Pages without text are passed over."""
    old = current.select("version_id", "language", F.col("revision_id").alias("old_revision"), F.col("text").alias("old_text"), F.lit(True).alias("has_old"))
    new = pages.where(F.coalesce("text", F.lit("")) != "").select("version_id", "language", "revision_id", "text", F.lit(True).alias("has_new"))
    both = new.join(old, ["version_id", "language"], "full_outer")
    outcome = F.when(F.col("has_new").isNull(), "kept").when(F.col("has_old").isNull(), "new").when(F.col("revision_id").eqNullSafe(F.col("old_revision")), "unchanged").otherwise("re-pinned")
    takes = outcome.isin("new", "re-pinned")
    return both.select("version_id", "language", F.when(takes, F.col("revision_id")).otherwise(F.col("old_revision")).alias("revision_id"), F.when(takes, F.col("text")).otherwise(F.col("old_text")).alias("text"), outcome.alias("outcome"))


def conflicts_to_open(found: DataFrame, recorded: DataFrame, only_open: bool = False) -> DataFrame:
    """Rows of `found` (entity, field) that have no recorded conflict (entity, field, status): of any status, so what was
    resolved isn't opened again, or of open ones only."""
    known = (recorded.where("status = 'open'") if only_open else recorded).select("entity", "field").distinct()
    return found.dropDuplicates(["entity", "field"]).join(known, ["entity", "field"], "left_anti")


def verify_edges(edges: DataFrame, versions: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`edges` and `versions` after a human has verified the listed (edge_id) ones: edges of MEDIUM confidence that a rule made
    and nobody has verified, with those of their ends that are MEDIUM and unverified; human_verified is set."""
    able = (F.col("confidence") == "MEDIUM") & ~F.col("human_verified")
    named = listed.select("edge_id").distinct().withColumn("named", F.lit(True))
    marked = edges.join(named, "edge_id", "left").withColumn("now", F.coalesce(able & F.col("by_rule") & F.col("named"), F.lit(False)))
    ends = marked.where("now").select(F.explode(F.array("src", "dst")).alias("version_id")).distinct().withColumn("touched", F.lit(True))
    settled = versions.join(ends, "version_id", "left").withColumn("human_verified", F.col("human_verified") | F.coalesce(able & F.col("touched"), F.lit(False)))
    return marked.withColumn("human_verified", F.col("human_verified") | F.col("now")).drop("named", "now"), settled.drop("touched")


def apply_resolutions(conflicts: DataFrame, versions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`conflicts` (entity, field, status, chosen) and `versions` (version_id, year) after human decisions (entity, field, value):
    open conflicts that one is about are resolved with its value; a release year is also written to the version. Of several
    decisions on one field, the least value counts."""
    decided = decisions.groupBy("entity", "field").agg(F.min("value").alias("value"))
    applied = conflicts.join(decided, ["entity", "field"], "left").withColumn("applies", (F.col("status") == "open") & F.col("value").isNotNull())
    settled = applied.withColumn("chosen", F.when(F.col("applies"), F.col("value")).otherwise(F.col("chosen"))).withColumn("status", F.when(F.col("applies"), "resolved").otherwise(F.col("status")))
    years = applied.where("applies AND field = 'release_year'").select(F.col("entity").alias("version_id"), F.col("value").cast("int").alias("decided_year")).distinct()
    return settled.drop("value", "applies"), versions.join(years, "version_id", "left").withColumn("year", F.coalesce("decided_year", "year")).drop("decided_year")
