"""Which source's claim about a field counts, and whether the claims are in conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the rule of each field and the order of the sources that it prefers
RULES = {
    "external_id": ("hub", ["wikidata"]),
    "canonical_title": ("primary", ["tmdb", "wikidata", "wikipedia"]),
    "release_year": ("majority", ["tmdb", "wikidata", "imdb", "human"]),
    "original_language": ("primary", ["tmdb", "wikidata", "imdb"]),
    "director": ("primary", ["tmdb", "wikidata", "imdb"]),
    "lead_cast": ("primary", ["tmdb", "wikipedia", "imdb"]),
}
_UNNAMED = 99


def _by_field(of: dict[str, Column]) -> Column:
    chosen = F.lit(None)
    for name, value in of.items():
        chosen = F.when(F.col("field") == name, value).otherwise(chosen)
    return chosen


def resolve_fields(claims: DataFrame, rules: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """(entity, field, value, confidence, conflict, rule) of claims (entity, field, value, source, pos), pos giving their order.

    hub: the first claim of the hub, else the first of all. primary: the first claim of the source that stands first in the
    field's order, else the first of all; HIGH if another claim says the same. majority: the value of most claims, of equal
    ones that met first; HIGH if there are two or more and all agree; open if it hasn't more than half of them. Other
    conflicts are resolved by the rule. Fields without a rule are left out. Claims are reduced per value first."""
    rules = rules or RULES
    place = F.array_position(_by_field({f: F.array(*map(F.lit, order)) for f, (_, order) in rules.items()}), F.col("source"))
    known = claims.where(F.col("field").isin(*rules)).withColumn("place", F.when(place > 0, place).otherwise(_UNNAMED))
    per_value = known.groupBy("entity", "field", "value").agg(F.count("*").alias("n"), F.min("pos").alias("met"), F.min(F.struct("place", "pos", "source")).alias("best"))
    own = F.struct("value", "n", "best.source", "best.place")
    per_field = per_value.groupBy("entity", "field").agg(
        F.sum("n").alias("claims"), F.count("*").alias("values"), F.min_by(own, F.struct("best.place", "best.pos")).alias("preferred"), F.max_by(own, F.struct(F.col("n"), -F.col("met"))).alias("common")
    )
    rule = _by_field({f: F.lit(kind) for f, (kind, _) in rules.items()})
    agree, named = F.col("values") == 1, F.col("preferred.place") < _UNNAMED
    enough = F.when(rule == "hub", named).when(rule == "primary", F.when(agree, F.col("claims") >= 2).otherwise(F.col("preferred.n") >= 2)).otherwise(agree & (F.col("claims") >= 2))
    won = 2 * F.col("common.n") > F.col("claims")
    by = F.when(rule == "hub", "hub:wikidata").when(rule == "primary", F.concat(F.lit("primary:"), "preferred.source")).when(won, "majority")
    return per_field.select(
        "entity", "field", F.when(rule == "majority", F.col("common.value")).otherwise(F.col("preferred.value")).alias("value"), F.when(enough, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.when(agree, "none").when((rule == "majority") & ~won, "open").otherwise("resolved").alias("conflict"), F.when(~agree, by).alias("rule"),
    )
