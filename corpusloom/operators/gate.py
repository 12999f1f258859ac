"""The verification gate, and constraints as queries for what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_view(entities: DataFrame, conflicts: DataFrame, key: str, kind: str, sources: str = "sources") -> DataFrame:
    """Entities with at least one source and no open conflict of their kind. `conflicts`: entity_kind, entity_id, status."""
    opened = conflicts.where((F.col("entity_kind") == kind) & (F.col("status") == "open")).select(F.col("entity_id").alias("_open")).distinct()
    return entities.where(F.coalesce(F.size(sources), F.lit(0)) > 0).join(opened, F.col(key) == F.col("_open"), "left_anti")


def golden_eligible(confidence: Column, human_verified: Column) -> Column:
    return F.coalesce(confidence == "HIGH", F.lit(False)) | F.coalesce(human_verified, F.lit(False))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found more than once, with their counts; nulls count as equal."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def dangling(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference isn't in the parent table; null references are none."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias("_parent")).distinct(), F.col(column) == F.col("_parent"), "left_anti")


def not_in_set(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def single_match(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has: the lookup that answers only if exactly one row matches."""
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return rows.join(once, keys, "left_semi")
