"""To which version of a work a title from a source belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _siblings(versions: DataFrame) -> DataFrame:
    """(sib_work, sib_language, sibling, sib_original): of each work and language the first version that the source doesn't know."""
    unknown = versions.where(F.col("external_id").isNull() & F.col("language").isNotNull())
    first = F.min(F.struct("version_id", "is_original"))
    return unknown.groupBy(F.col("work_id").alias("sib_work"), F.col("language").alias("sib_language")).agg(first.alias("s")).select("sib_work", "sib_language", F.col("s.version_id").alias("sibling"), F.col("s.is_original").alias("sib_original"))


def _routed(titles: DataFrame, versions: DataFrame) -> DataFrame:
    own = versions.where(F.col("external_id").isNotNull()).select("external_id", "version_id", "work_id", F.col("language").alias("own_language"))
    return titles.join(own, "external_id", "left").join(_siblings(versions), (F.col("work_id") == F.col("sib_work")) & (F.col("language") == F.col("sib_language")), "left")


def _display(kind: Column) -> Column:
    return F.when(kind, "canonical").otherwise("dub")


def route_akas(akas: DataFrame, versions: DataFrame) -> DataFrame:
    """(external_id, title, language, version_id, kind) of akas (external_id, title, language, is_original): an original title is
    the canonical one of its version; one in the language of a version of the same work that the source doesn't know goes
    there; others are akas. version_id is null where no version has the external id: those are to be reported.
    `versions`: version_id, work_id, external_id, language, is_original; external ids are unique."""
    to_sibling = ~F.coalesce("is_original", F.lit(False)) & F.col("sibling").isNotNull()
    kind = F.when(F.col("version_id").isNull(), None).when(F.col("is_original"), "canonical").when(to_sibling, _display(F.col("sib_original"))).otherwise("aka")
    return _routed(akas, versions).select("external_id", "title", "language", F.when(to_sibling, F.col("sibling")).otherwise(F.col("version_id")).alias("version_id"), kind.alias("kind"))


def route_titles(titles: DataFrame, versions: DataFrame) -> DataFrame:
    """(version_id, title, kind, language) of titles (external_id, title, kind, language): canonical ones, and translations into
    the version's own language, are its canonical title, in its language if none is given; translations in the language of
    a sibling that the source doesn't know are that one's title; akas stay akas; other translations are dropped, like
    titles of unknown versions."""
    own = (F.col("kind") == "canonical") | ((F.col("kind") == "translation") & F.col("language").eqNullSafe(F.col("own_language")))
    to_sibling = ~own & (F.col("kind") == "translation") & F.col("sibling").isNotNull()
    kind = F.when(own, "canonical").when(to_sibling, _display(F.col("sib_original"))).when(F.col("kind") == "aka", "aka")
    language = F.when(own, F.coalesce("language", "own_language")).otherwise(F.col("language"))
    rows = _routed(titles, versions).where(F.col("version_id").isNotNull())
    return rows.select(F.when(to_sibling, F.col("sibling")).otherwise(F.col("version_id")).alias("version_id"), "title", kind.alias("kind"), language.alias("language")).where(F.col("kind").isNotNull())
