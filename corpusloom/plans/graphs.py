"""Graph queries: suppliers, nations and the parts they share stand for works, franchises and their leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import graph
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("""
    WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 3 AS dst FROM supplier WHERE s_acctbal > 3000), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    n AS (SELECT src AS node FROM b UNION SELECT dst FROM b), r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Franchises: suppliers linked to the one at a third of their number, if they are in credit."""
    edges = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey DIV 3").alias("dst"))
    return graph.undirected_closure(edges)


@query("""
    WITH s AS (SELECT o_custkey AS id, o_orderpriority AS p, o_orderkey % 1500 AS t FROM orders)
    SELECT DISTINCT * FROM (SELECT 'is_remake_of' AS edge_type, id AS src, t AS dst FROM s WHERE p = '1-URGENT' UNION ALL SELECT 'is_remake_of', t, id FROM s WHERE p = '2-HIGH' UNION ALL SELECT 'is_sequel_of', id, t FROM s WHERE p = '3-MEDIUM') WHERE src <> dst""")
def edge_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("property"), F.array(F.col("o_orderkey") % 1500).alias("targets"))
    return graph.derive_edges(rows, {"1-URGENT": ("is_remake_of", False), "2-HIGH": ("is_remake_of", True), "3-MEDIUM": ("is_sequel_of", False)})


@query("""
    WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS other FROM supplier),
    c AS (SELECT l_suppkey, count(*) AS k FROM p GROUP BY ALL), i AS (SELECT s_suppkey, other, count(*) AS shared FROM n JOIN p a ON a.l_suppkey = s_suppkey JOIN p b ON b.l_suppkey = other AND b.l_partkey = a.l_partkey GROUP BY ALL)
    SELECT n.s_suppkey, n.other, round(coalesce(shared, 0) / least(x.k, y.k), 6) AS overlap, CASE WHEN coalesce(shared, 0) / least(x.k, y.k) >= 0.5 THEN 'is_official_dub_of' ELSE 'is_remake_of' END AS edge_type
    FROM n JOIN c x ON x.l_suppkey = n.s_suppkey JOIN c y ON y.l_suppkey = n.other LEFT JOIN i USING (s_suppkey, other)""")
def lead_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring suppliers of a nation compared by the parts both have. Overlaps are counted by joins, not in arrays, so a
    supplier may have any number of parts."""
    pairs = table(spark, sf_dir, "supplier").select("s_suppkey", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("other")).where("other IS NOT NULL")
    leads = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    sizes = leads.groupBy("l_suppkey").agg(F.count("*").alias("k"))
    own = pairs.join(leads, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "other", "l_partkey")
    shared = own.join(leads.withColumnRenamed("l_suppkey", "other"), ["other", "l_partkey"]).groupBy("s_suppkey", "other").agg(F.count("*").alias("shared"))
    a, b = sizes.select(F.col("l_suppkey").alias("s_suppkey"), F.col("k").alias("ka")), sizes.select(F.col("l_suppkey").alias("other"), F.col("k").alias("kb"))
    joined = pairs.join(a, "s_suppkey").join(b, "other").join(shared, ["s_suppkey", "other"], "left")
    overlap = F.coalesce("shared", F.lit(0)) / F.least("ka", "kb")
    return joined.select("s_suppkey", "other", F.round(overlap, 6).alias("overlap"), graph.dub_or_remake(overlap).alias("edge_type"))


@query("""
    WITH o AS (SELECT s_nationkey, count(*) FILTER (s_acctbal > 8000) AS n FROM supplier GROUP BY s_nationkey)
    SELECT s_nationkey, n AS n_originals, CASE WHEN n = 0 THEN 'no_original' WHEN n > 2 THEN 'many_originals' ELSE 'ok' END AS anomaly FROM o""")
def original_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(F.col("s_acctbal") > 8000)
    out = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(n.alias("n_originals"))
    return out.withColumn("anomaly", F.when(F.col("n_originals") == 0, "no_original").when(F.col("n_originals") > 2, "many_originals").otherwise("ok"))


@query("""
    WITH m AS (SELECT o_orderkey AS candidate_id, l_partkey AS version_id, p_brand AS work_id, 1 - l_discount AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
    g AS (SELECT candidate_id, count(DISTINCT work_id) AS works, arg_min(version_id, (-score, version_id)) AS bound_version FROM m WHERE score >= 0.95 GROUP BY candidate_id)
    SELECT o_orderkey AS candidate_id, bound_version FROM orders LEFT JOIN (SELECT * FROM g WHERE works = 1) ON candidate_id = o_orderkey""")
def bind_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    matches = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("candidate_id"), F.col("l_partkey").alias("version_id"), F.col("p_brand").alias("work_id"), (1 - F.col("l_discount")).alias("score"))
    return graph.bind_candidates(candidates, matches, 0.95)


@query("""
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN v = 'confirm' THEN 'confirmed' WHEN v = 'reject' THEN 'rejected' ELSE 'proposed' END AS status
        FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'R' THEN 'reject' ELSE 'skip' END, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS v FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey) GROUP BY status
    UNION ALL SELECT 'issue', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) + (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions (lines) applied to candidates (orders): statuses after it, and how many decisions were at issue."""
    status = F.when(F.col("o_orderstatus") == "P", "proposed").otherwise(F.col("o_orderstatus"))
    candidates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), status.alias("status"))
    verdict = F.when(F.col("l_returnflag") == "A", "confirm").when(F.col("l_returnflag") == "R", "reject").otherwise("skip")
    decisions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), verdict.alias("verdict"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    after, issues = graph.apply_decisions(candidates, decisions)
    return after.groupBy("status").agg(F.count("*").alias("n")).unionByName(issues.agg(F.count("*").alias("n")).select(F.lit("issue").alias("status"), "n"))


@query("""
    WITH v AS (SELECT p_partkey FROM part WHERE p_size > 10), e AS (SELECT l_partkey AS src, (l_partkey * 7 + l_suppkey) % 2000 AS dst, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT src, dst, n, a.p_name AS src_title, b.p_name AS dst_title FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE src IN (FROM v) AND dst IN (FROM v)""")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between versions both of which the gate shows, with the titles of both and how often each was stated."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2000).alias("dst")).agg(F.count("*").alias("n"))
    seen = graph.visible_edges(edges, parts.where("p_size > 10"), "p_partkey")
    title = lambda end: parts.select(F.col("p_partkey").alias(end), F.col("p_name").alias(f"{end}_title"))
    return seen.join(title("src"), "src").join(title("dst"), "dst")
