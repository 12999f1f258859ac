"""Merging observations and tables: ordered unions of sources, conflict resolution by precedence, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_sources(old: Column, new: Column) -> Column:
    """Arrays of structs (source, ref, ...) joined in order; of entries with one (source, ref), the first stays."""
    both = F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))
    earlier = lambda x, i: F.exists(F.slice(both, 1, i), lambda y: (y["source"] == x["source"]) & (y["ref"] == x["ref"]))
    return F.filter(both, lambda x, i: F.when(i == 0, True).otherwise(~earlier(x, i)))


def resolve_by_majority(observations: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Per key: the value most observed (ties: observed first), how many observations and different values there are, and
    `agreed` for one value, `resolved` for a strict majority, `open` otherwise. Null values aren't observations."""
    votes = observations.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_votes"), F.min(position).alias("_first"))
    best = F.max_by(F.col(value), F.struct("_votes", -F.col("_first")))
    out = votes.groupBy(*keys).agg(best.alias(value), F.max("_votes").alias("votes"), F.sum("_votes").alias("observations"), F.count("*").alias("n_values"))
    state = F.when(F.col("n_values") == 1, "agreed").when(2 * F.col("votes") > F.col("observations"), "resolved").otherwise("open")
    return out.withColumn("status", state)


def union_values(observations: DataFrame, keys: list[str], value: str, source: str, position: str) -> DataFrame:
    """Each value of a key once, where first observed, with confidence HIGH if two sources or more have it."""
    out = observations.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(position).alias("first_at"), F.count_distinct(source).alias("n_sources"))
    return out.withColumn("confidence", F.when(F.col("n_sources") >= 2, "HIGH").otherwise("MEDIUM"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """The next version of a table: `incoming` rows replace those of equal keys, others stay; `outcome` is new, changed,
    unchanged or kept. Keys are compared null-safe; both sides have one row a key."""
    old = current.select(*(F.col(c).alias(f"_old_{c}") for c in current.columns), F.lit(True).alias("_has_old"))
    new = incoming.select(*current.columns, F.lit(True).alias("_has_new"))
    same_key = [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys]
    joined = new.join(old, same_key, "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    outcome = F.when(F.col("_has_old").isNull(), "new").when(F.col("_has_new").isNull(), "kept").when(changed, "changed").otherwise("unchanged")
    return joined.select(*(F.when(F.col("_has_new").isNull(), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns), outcome.alias("outcome"))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`current` and those rows of `incoming` whose key it lacks."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def write_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Delete and re-insert the partitions that `rows` has; the others stay. Writing the same rows again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
