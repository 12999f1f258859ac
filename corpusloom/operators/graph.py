"""The entity graph: closure, derived edges, overlap of leads, binding of candidates, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written


def undirected_closure(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst): the least node it reaches, edges taken both ways.

    Labels spread along edges and then jump to the label of their label, so the rounds are few even for long chains.
    Each round reduces per node before it shuffles."""
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        spread = written(spread)
        hop = spread.select(F.col("node").alias("_at"), F.col("component").alias("_then"))
        jumped = written(spread.join(hop, F.col("component") == F.col("_at")).select("node", "old", F.least("component", "_then").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"closure didn't settle in {max_rounds} rounds")


def derive_edges(statements: DataFrame, kinds: dict[str, tuple[str, bool]]) -> DataFrame:
    """(edge_type, src, dst), each once, without self edges, from statements (id, property, targets array): `kinds` gives a
    property's edge type, and whether the edge points from the target to the statement's own id."""
    out = None
    rows = statements.select("id", "property", F.explode("targets").alias("target"))
    for prop, (kind, inverse) in kinds.items():
        one = rows.where(F.col("property") == prop).select(F.lit(kind).alias("edge_type"), F.col("target" if inverse else "id").alias("src"), F.col("id" if inverse else "target").alias("dst"))
        out = one if out is None else out.unionByName(one)
    return out.where("src <> dst").distinct()


def visible_edges(edges: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Edges both ends of which are visible."""
    seen = visible.select(F.col(key).alias("_v")).distinct()
    return edges.join(seen, F.col("src") == F.col("_v"), "left_semi").join(seen, F.col("dst") == F.col("_v"), "left_semi")


def dub_or_remake(overlap: Column, threshold: float = 0.5) -> Column:
    return F.when(overlap >= threshold, "is_official_dub_of").when(overlap.isNotNull(), "is_remake_of")


def bind_candidates(candidates: DataFrame, matches: DataFrame, least: float = 0.9) -> DataFrame:
    """Candidates (candidate_id, ...) with the version bound to them: the best of `matches` (candidate_id, version_id,
    work_id, score), if it scores `least` and all that do share one work."""
    good = matches.where(F.col("score") >= least).groupBy("candidate_id").agg(F.count_distinct("work_id").alias("_works"), F.min_by("version_id", F.struct(-F.col("score"), "version_id")).alias("bound_version"))
    return candidates.join(good.where("_works = 1").drop("_works"), "candidate_id", "left")


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their new status, issues). Only proposed candidates are decided; decisions on unknown or already decided
    ones, and further decisions on one, are issues. `decisions`: candidate_id, verdict, seq."""
    first = decisions.groupBy("candidate_id").agg(F.min_by("verdict", "seq").alias("_verdict"), F.count("*").alias("_n"))
    joined = candidates.join(first, "candidate_id", "left")
    decided = F.when(F.col("status") != "proposed", F.col("status")).when(F.col("_verdict") == "confirm", "confirmed").when(F.col("_verdict") == "reject", "rejected").otherwise(F.col("status"))
    unknown = first.join(candidates, "candidate_id", "left_anti").select("candidate_id", F.lit("unknown").alias("issue"))
    late = joined.where(F.col("_verdict").isNotNull() & (F.col("status") != "proposed")).select("candidate_id", F.lit("already_decided").alias("issue"))
    again = first.where("_n > 1").select("candidate_id", F.lit("decided_twice").alias("issue"))
    return joined.withColumn("status", decided).drop("_verdict", "_n"), unknown.unionByName(late).unionByName(again)
