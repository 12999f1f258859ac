"""Gate, version sets, merging and coverage over the star tables: suppliers stand for works, their parts for versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import gate, merge, refine
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("""
    SELECT c_custkey, c_mktsegment, n AS n_sources FROM customer
    JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey AND x.o_orderstatus = 'P' AND x.o_orderpriority = '1-URGENT')""")
def gate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a source (an order) and no open conflict (a pending urgent order)."""
    orders = table(spark, sf_dir, "orders")
    sources = orders.groupBy("o_custkey").agg(F.count("*").alias("n_sources"))
    entities = table(spark, sf_dir, "customer").join(sources, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("sources", F.when(F.col("n_sources") > 0, F.array(F.lit("order"))))
    conflicts = orders.where("o_orderpriority = '1-URGENT'").select(F.lit("version").alias("entity_kind"), F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("resolved").alias("status"))
    return gate.gate_view(entities, conflicts, "c_custkey", "version").select("c_custkey", "c_mktsegment", "n_sources")


@query("""
    SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'""")
def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that fixtures may rely on: of high confidence, or verified by a human."""
    confidence = F.when(F.col("c_acctbal") > 5000, "HIGH").when(F.col("c_acctbal") > 0, "MEDIUM")
    return table(spark, sf_dir, "customer").where(gate.golden_eligible(confidence, F.col("c_mktsegment") == "BUILDING")).select("c_custkey")


@query("""
    SELECT l_suppkey AS version_id, l_partkey % 50 AS person_id, min(l_linenumber) AS billing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 50 = l_partkey % 50 AND p_size = l_suppkey) GROUP BY ALL
    UNION ALL SELECT DISTINCT p_size, p_partkey % 50, 0 FROM part""")
def cast_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast rows of versions, with those of a source that weren't there."""
    there = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("version_id"), (F.col("p_partkey") % 50).alias("person_id"), F.lit(0).alias("billing")).distinct()
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("version_id"), (F.col("l_partkey") % 50).alias("person_id")).agg(F.min("l_linenumber").alias("billing"))
    return merge.insert_absent(there, new, ["version_id", "person_id"])


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    SELECT 'orphan_order' AS issue, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    UNION ALL SELECT 'bad_status', o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'no_price', p_partkey FROM part WHERE NOT p_retailprice > 900.5""")
def constraint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a reference, an enumeration and a check."""
    orders, good = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    parts = [("orphan_order", gate.dangling(orders, "o_custkey", good, "c_custkey"), "o_orderkey"), ("bad_status", gate.not_in_set(orders, "o_orderstatus", ["F", "O"]), "o_orderkey"), ("no_price", table(spark, sf_dir, "part").where("NOT p_retailprice > 900.5"), "p_partkey")]
    issues = [rows.select(F.lit(issue).alias("issue"), F.col(key).alias("id")) for issue, rows, key in parts]
    return issues[0].unionByName(issues[1]).unionByName(issues[2])


@query("""
    SELECT p_name, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_size HAVING count(*) = 1""")
def single_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, size) keys with exactly one part, and the part."""
    return gate.single_match(table(spark, sf_dir, "part"), ["p_name", "p_size"]).select("p_name", "p_size", "p_partkey")


@query("""
    SELECT l_orderkey, string_agg(p_name, '|' ORDER BY r) AS leads FROM (
        SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem JOIN part ON p_partkey = l_partkey)
    WHERE r <= 5 GROUP BY l_orderkey""")
def leads_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest parts of each order, in order."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    top = refine.top_names(rows, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber")], "p_name")
    return top.select("l_orderkey", F.array_join("names", "|").alias("leads"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer: year, original if of status F, language by priority."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("release_year"), (F.col("o_orderstatus") == "F").alias("is_original"), F.col("o_orderpriority").alias("language"), "o_totalprice")


_VERSIONS_SQL = "v AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS release_year, o_orderstatus = 'F' AS is_original, o_orderpriority AS language, o_totalprice FROM orders)"


@query(f"""
    WITH {_VERSIONS_SQL}, p AS (SELECT o_custkey, coalesce(min(release_year) FILTER (is_original), min(release_year)) AS pivot_year FROM v GROUP BY o_custkey)
    SELECT o_orderkey, o_custkey, release_year, pivot_year FROM v JOIN p USING (o_custkey) WHERE release_year > pivot_year AND language = '2-HIGH'""")
def refine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    newer = refine.era_filter(_versions(spark, sf_dir), "o_custkey", "release_year", "is_original", "newer")
    return refine.refine(newer, language="2-HIGH").select("o_orderkey", "o_custkey", "release_year", "pivot_year")


@query(f"""
    WITH {_VERSIONS_SQL}
    SELECT c_custkey, o_orderkey, release_year, n_name AS nation FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY release_year, o_totalprice DESC, o_orderkey) AS r FROM v WHERE is_original)
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE r = 1 AND n_regionkey = 2""")
def first_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first original of each work in one scope."""
    scope = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey = 2"), F.col("n_nationkey") == F.col("c_nationkey"))
    first = refine.best_per_group(_versions(spark, sf_dir).where("is_original"), ["o_custkey"], [F.asc_nulls_last("release_year"), F.desc("o_totalprice"), F.asc("o_orderkey")])
    return first.join(scope, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "release_year", F.col("n_name").alias("nation"))


@query(f"""
    WITH {_VERSIONS_SQL}, e AS (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN flag = 'A' THEN 'remake' WHEN flag = 'R' THEN 'dub' WHEN is_original THEN 'original' WHEN language = '1-URGENT' THEN 'sequel' END AS relationship
    FROM v LEFT JOIN e ON l_orderkey = o_orderkey""")
def rel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per version: that of an edge, else original, else sequel, else none."""
    edges = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    joined = _versions(spark, sf_dir).join(edges, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    label = F.when(F.col("flag") == "A", "remake").when(F.col("flag") == "R", "dub").when(F.col("is_original"), "original").when(F.col("language") == "1-URGENT", "sequel")
    return joined.select("o_orderkey", label.alias("relationship"))


@query("""
    WITH o AS (SELECT l_orderkey, l_returnflag AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos
               FROM lineitem),
    c AS (SELECT l_orderkey, v, count(*) AS votes, min(pos) AS first FROM o GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, first) AS k, sum(votes) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) AS kinds FROM c)
    SELECT l_orderkey, v AS l_returnflag, votes, total::BIGINT AS observations, kinds AS n_values, CASE WHEN kinds = 1 THEN 'agreed' WHEN 2 * votes > total THEN 'resolved' ELSE 'open' END AS status FROM r WHERE k = 1""")
def precedence_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    seen = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")))
    return merge.resolve_by_majority(seen, ["l_orderkey"], "l_returnflag", "pos")


@query("""
    SELECT l_partkey, l_returnflag, min(l_orderkey) AS first_at, count(DISTINCT l_suppkey) AS n_sources, CASE WHEN count(DISTINCT l_suppkey) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
    FROM lineitem GROUP BY l_partkey, l_returnflag""")
def union_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union_values(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", "l_suppkey", "l_orderkey")


@query("""
    WITH old AS (SELECT l_orderkey, l_suppkey AS s, l_partkey AS p, 0 AS side, l_linenumber AS n, l_extendedprice AS x FROM lineitem WHERE l_linestatus = 'F'),
    new AS (SELECT l_orderkey, l_suppkey, l_partkey, 1, l_linenumber, l_extendedprice FROM lineitem WHERE l_linestatus = 'O'),
    u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, s ORDER BY side, n, p, x) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY side, n, s, p, x) AS pos FROM (FROM old UNION ALL FROM new))
    SELECT l_orderkey, string_agg(s::VARCHAR, ',' ORDER BY pos) AS merged FROM u WHERE k = 1 GROUP BY l_orderkey""")
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the finished lines of an order, then those of its open lines, each once."""
    side = F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_linestatus") == "O", 1)
    item = F.struct(side.alias("side"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("x"))
    # each supplier's first line, so that no list holds more than an order's suppliers
    first = table(spark, sf_dir, "lineitem").where("l_linestatus IN ('F', 'O')").groupBy("l_orderkey", "l_suppkey").agg(F.min(item).alias("e"))
    lists = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return lists.select("l_orderkey", F.array_join(F.transform("e", lambda e: e["s"].cast("string")), ",").alias("merged"))


@query("""
    WITH old AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 40), new AS (SELECT p_partkey, p_name, CASE WHEN p_brand = 'Brand#4' THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size >= 10)
    SELECT coalesce(new.p_partkey, old.p_partkey) AS p_partkey, coalesce(new.p_name, old.p_name) AS p_name, coalesce(new.p_size, old.p_size) AS p_size,
           CASE WHEN old.p_partkey IS NULL THEN 'new' WHEN new.p_partkey IS NULL THEN 'kept' WHEN new.p_size <> old.p_size THEN 'changed' ELSE 'unchanged' END AS outcome
    FROM new FULL JOIN old ON new.p_partkey = old.p_partkey""")
def upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping editions of the part list: a stored one and one that comes in."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    old = part.where("p_size <= 40").drop("p_brand")
    new = part.where("p_size >= 10").withColumn("p_size", F.col("p_size") + F.when(F.col("p_brand") == "Brand#4", 1).otherwise(0)).drop("p_brand")
    return merge.upsert(old, new, ["p_partkey"], ["p_name", "p_size"])


@query("""
    WITH want AS (SELECT DISTINCT c_nationkey, c_mktsegment, year(o_orderdate)::INT AS y FROM customer JOIN orders ON o_custkey = c_custkey),
    have AS (SELECT DISTINCT c_nationkey, c_mktsegment, year(o_orderdate)::INT AS y FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
    SELECT c_nationkey, count(*) AS expected, count(have.y) AS present, count(*) - count(have.y) AS missing, round(count(have.y) / count(*), 4) AS coverage
    FROM want LEFT JOIN have USING (c_nationkey, c_mktsegment, y) GROUP BY c_nationkey""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected (segment, year) versions per nation, and which of them a finished order has; null-safe."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("o_orderdate"))
    # both sets come from one pass: a version is present if any of its orders is finished
    want = rows.groupBy("c_nationkey", "c_mktsegment", "y").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("has"))
    out = want.groupBy("c_nationkey").agg(F.count("*").alias("expected"), F.sum("has").alias("present"))
    return out.select("c_nationkey", "expected", "present", (F.col("expected") - F.col("present")).alias("missing"), F.round(F.col("present") / F.col("expected"), 4).alias("coverage"))


@query("""
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) FILTER (o_orderstatus = 'O') AS rejected,
           round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 4) AS precision
    FROM orders GROUP BY o_orderpriority""")
def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by decision, and precision among the decided."""
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), is_("F").alias("confirmed"), is_("O").alias("rejected"))
    return out.withColumn("precision", F.round(F.col("confirmed") / F.nullif(F.col("confirmed") + F.col("rejected"), F.lit(0)), 4))
