"""Version sets and their refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def era_filter(versions: DataFrame, group: str, year: str, is_original: str, era: str) -> DataFrame:
    """Versions newer or older than the pivot year of their set, strictly, or its originals. The pivot is the first
    original's year, else the first year. A null year is neither newer nor older."""
    if era == "original":
        return versions.where(is_original)
    pivots = versions.groupBy(F.col(group).alias("_group")).agg(F.coalesce(F.min(F.when(F.col(is_original), F.col(year))), F.min(year)).alias("pivot_year"))
    joined = versions.join(pivots, F.col(group) == F.col("_group")).drop("_group")
    return joined.where(F.col(year) > F.col("pivot_year") if era == "newer" else F.col(year) < F.col("pivot_year"))


def refine(versions: DataFrame, *, language: str | None = None, year: int | None = None, actor: str | None = None, relationship: str | None = None, names: str = "leads") -> DataFrame:
    """All given filters together. `actor` is part of one of the lead names, case apart."""
    out = versions
    for column, value in (("language", language), ("release_year", year), ("relationship", relationship)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out if actor is None else out.where(F.exists(names, lambda n: F.lower(n).contains(actor.lower())))


def top_names(rows: DataFrame, key: str, order: list[Column], name: str, k: int = 5) -> DataFrame:
    """Up to `k` names per key in order, as an array. Reduced to k rows a key before anything is collected."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= k)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", name))), lambda x: x[name]).alias("names"))


def best_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
