"""Upkeep of the graph, lookups and guards over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import guards, lookups, upkeep
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("""
    WITH r AS (SELECT l_partkey AS version_id, l_returnflag AS title, l_linestatus AS kind, CASE WHEN l_suppkey % 3 > 0 THEN 'l' || (l_suppkey % 3)::VARCHAR END AS language, 's' || (l_suppkey % 4)::VARCHAR AS source, (l_orderkey % 5)::VARCHAR AS ref, l_orderkey * 10000 + l_suppkey AS pos, (l_orderkey % 3 = 0)::INT AS new FROM lineitem),
    u AS (SELECT version_id, title, kind, source, ref, min(new) AS new, max(new) AS came FROM r GROUP BY ALL),
    g AS (SELECT version_id, title, kind, count(*) AS n_sources, min(new) AS oldest, max(new) AS newest, max(came) AS came FROM u GROUP BY ALL),
    l AS (SELECT version_id, title, kind, arg_min(language, {'n': new, 'p': pos}) AS language FROM r WHERE language IS NOT NULL GROUP BY ALL),
    f AS (SELECT version_id, title, kind, arg_min(source || ':' || ref, {'n': new, 'p': pos}) AS first_source FROM r GROUP BY ALL)
    SELECT g.version_id, g.title, g.kind, language, n_sources, first_source, CASE WHEN oldest = 1 THEN 'new' WHEN newest = 1 THEN 'merged' WHEN came = 1 THEN 'unchanged' ELSE 'kept' END AS outcome FROM g LEFT JOIN l USING (version_id, title, kind) JOIN f USING (version_id, title, kind)""")
def title_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles after a third of the references came in."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("version_id"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("kind"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("l"), F.col("l_suppkey") % 3)).alias("language"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("source"), (F.col("l_orderkey") % 5).cast("string").alias("ref"), (F.col("l_orderkey") * 10000 + F.col("l_suppkey")).alias("pos"), "l_orderkey",
    )
    out = upkeep.upsert_titles(rows.where("l_orderkey % 3 > 0").drop("l_orderkey"), rows.where("l_orderkey % 3 = 0").drop("l_orderkey"))
    first = F.get("sources", 0)
    return out.select("version_id", "title", "kind", "language", F.size("sources").cast("long").alias("n_sources"), F.concat_ws(":", first["source"], first["ref"]).alias("first_source"), "outcome")


@query("""
    WITH c AS (SELECT doc_id AS version_id, lang AS language, (doc_id % 4)::VARCHAR AS revision_id, doc_id % 10 AS t FROM documents WHERE doc_id % 3 > 0), p AS (SELECT doc_id AS version_id, lang AS language, (doc_id % 8)::VARCHAR AS revision_id, CASE WHEN doc_id % 11 > 0 THEN 'text ' || doc_id::VARCHAR ELSE '' END AS text FROM documents WHERE doc_id % 2 = 0),
    j AS (SELECT coalesce(c.version_id, p.version_id) AS version_id, coalesce(c.language, p.language) AS language, c.revision_id AS o, p.revision_id AS n, c.version_id IS NOT NULL AS has_old, p.version_id IS NOT NULL AS has_new FROM c FULL JOIN (SELECT * FROM p WHERE text <> '') p ON c.version_id = p.version_id AND c.language = p.language)
    SELECT version_id, language, CASE WHEN NOT has_new THEN o WHEN NOT has_old OR o <> n THEN n ELSE o END AS revision_id, CASE WHEN NOT has_new THEN 'kept' WHEN NOT has_old THEN 'new' WHEN o = n THEN 'unchanged' ELSE 're-pinned' END AS outcome FROM j""")
def plot_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots after pages came in: new, re-pinned, unchanged, kept."""
    docs = table(spark, sf_dir, "documents")
    current = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("version_id"), F.col("lang").alias("language"), (F.col("doc_id") % 4).cast("string").alias("revision_id"), F.lit("old").alias("text"))
    pages = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("version_id"), F.col("lang").alias("language"), (F.col("doc_id") % 8).cast("string").alias("revision_id"), F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("text "), "doc_id")).otherwise("").alias("text"))
    return upkeep.upsert_plots(current, pages).drop("text")


@query("""
    SELECT DISTINCT l_partkey AS entity, l_returnflag AS field FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 20 AND l_returnflag = CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END)""")
def new_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts that haven't been recorded, whatever became of the recorded ones."""
    recorded = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("entity"), F.element_at(F.array(*map(F.lit, "ANR")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("field"), F.when(F.col("p_size") > 30, "open").otherwise("resolved").alias("status"))
    return upkeep.conflicts_to_open(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("field")), recorded)


@query("""
    WITH e AS (SELECT o_orderkey AS edge_id, o_custkey % 200 AS src, o_orderkey % 200 AS dst, CASE WHEN o_orderpriority < '3' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, o_orderstatus = 'F' AS human_verified, o_custkey % 2 = 0 AS by_rule FROM orders),
    n AS (SELECT * FROM e WHERE confidence = 'MEDIUM' AND NOT human_verified AND by_rule AND edge_id % 40 = 0)
    SELECT p_partkey AS version_id, (p_size % 2 = 0) OR (p_size % 3 > 0 AND p_partkey IN (SELECT src FROM n UNION SELECT dst FROM n)) AS human_verified FROM part""")
def verified_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after listed edges were verified, with the ends of these."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") % 200).alias("src"), (F.col("o_orderkey") % 200).alias("dst"), F.when(F.col("o_orderpriority") < "3", "MEDIUM").otherwise("HIGH").alias("confidence"), (F.col("o_orderstatus") == "F").alias("human_verified"), (F.col("o_custkey") % 2 == 0).alias("by_rule"))
    versions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), F.when(F.col("p_size") % 3 > 0, "MEDIUM").otherwise("HIGH").alias("confidence"), (F.col("p_size") % 2 == 0).alias("human_verified"))
    return upkeep.verify_edges(edges, versions, edges.where("edge_id % 40 = 0"))[1].select("version_id", "human_verified")


@query("""
    WITH d AS (SELECT l_partkey AS entity, min(1990 + l_linenumber) AS y FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 GROUP BY l_partkey)
    SELECT p_partkey AS version_id, CASE WHEN p_size > 25 AND y IS NOT NULL THEN y ELSE 2000 + p_size END AS year FROM part LEFT JOIN d ON entity = p_partkey""")
def resolved_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of versions after human decisions on open conflicts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), (2000 + F.col("p_size")).alias("year"), "p_size")
    conflicts = parts.select(F.col("version_id").alias("entity"), F.lit("release_year").alias("field"), F.when(F.col("p_size") > 25, "open").otherwise("resolved").alias("status"), F.lit(None).cast("string").alias("chosen"))
    decisions = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_quantity > 40").select(F.col("l_partkey").alias("entity"), F.lit("release_year").alias("field"), (1990 + F.col("l_linenumber")).cast("string").alias("value"))
    return upkeep.apply_resolutions(conflicts, parts.drop("p_size"), decisions)[1]


@query("""
    WITH r AS (SELECT l_orderkey AS fixture, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS works, max(l_quantity) < 40 AS abstain FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY l_orderkey)
    SELECT o_orderkey AS fixture, coalesce(array_to_string(works[1:3], ','), '') AS works, coalesce(abstain, true) AS abstain FROM orders LEFT JOIN r ON fixture = o_orderkey""")
def replayed_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of recorded rankings."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0")
    recorded = lines.groupBy(F.col("l_orderkey").alias("fixture")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("works"), (F.max("l_quantity") < 40).alias("abstain"))
    return lookups.replayed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture")), recorded, 3).withColumn("works", F.array_join(F.col("works").cast("array<string>"), ","))


@query("""
    SELECT vec_id AS chunk_id, coalesce('wikipedia http://' || doc_id::VARCHAR, 'seed metadata') AS citation FROM embeddings LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) ON doc_id = vec_id""")
def chunk_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("plot_id"), F.lit("wikipedia").alias("source"), F.concat(F.lit("http://"), "doc_id").alias("source_url"))
    return lookups.citations(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("plot_id")), plots)


@query("""
    SELECT 't ' || p_name || ' (' || coalesce(CASE WHEN p_size > 5 THEN (1970 + p_size)::VARCHAR END, '?') || ')|' || p_brand || '|en' AS page_key, 'The ' || p_partkey::VARCHAR || ' film' AS page_title, p_size::VARCHAR AS revision_id FROM part WHERE p_partkey % 2 = 0""")
def pages_for_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    versions = parts.select(F.col("p_partkey").alias("version_id"), F.concat(F.lit("t "), "p_name").alias("title"), F.when(F.col("p_size") > 5, 1970 + F.col("p_size")).alias("year"), F.col("p_brand").alias("language"))
    plots = parts.select(F.col("p_partkey").alias("version_id"), F.lit("wikipedia").alias("source"), F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("ml").alias("language"), F.concat(F.lit("http://w/wiki/The_"), "p_partkey", F.lit("_film")).alias("source_url"), F.col("p_size").cast("string").alias("revision_id"))
    return lookups.pages_to_read(plots, versions)


@query("""
    SELECT o_orderkey AS candidate_id, o_orderpriority AS edge_type, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_custkey % 5 > 0 THEN o_custkey::VARCHAR END NULLS LAST, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'""")
def proposed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("edge_type"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey").cast("string")).alias("title"), F.when(F.col("o_orderstatus") == "P", "proposed").otherwise("decided").alias("status"))
    return lookups.proposed(rows).select("candidate_id", "edge_type", "place")


@query(r"""
    SELECT surface, sha256(q) AS query_hash, count(*) AS n FROM (SELECT 'golden' AS surface, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark UNION ALL SELECT 'exemplars', trim(regexp_replace(text, '\s+', ' ', 'g')) FROM conversations WHERE role = 'user' UNION ALL SELECT 'negatives', trim(regexp_replace(text, '\s+', ' ', 'g')) FROM benchmark WHERE item_id % 3 = 0) WHERE q <> '' GROUP BY ALL""")
def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that training data must keep away from, per set."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "query")
    users = table(spark, sf_dir, "conversations").where("role = 'user'").withColumnRenamed("text", "query")
    rows = lookups.protected_queries({"golden": items, "exemplars": users, "negatives": items.where("item_id % 3 = 0")})
    return rows.groupBy("surface", F.sha2("query", 256).alias("query_hash")).agg(F.count("*").alias("n"))


@query("""
    WITH k AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) SELECT DISTINCT item FROM (SELECT l_partkey AS item FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey IN (FROM k) UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (FROM k)) WHERE item NOT IN (FROM k)""")
def discovered_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.when(F.col("l_returnflag") == "A", "based_on").when(F.col("l_returnflag") == "R", "derivative").alias("property"), F.col("l_suppkey").alias("target"))
    return lookups.backlinks(statements, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("item")))


@query("""
    WITH v AS (SELECT p_name AS title, p_brand AS language, p_size AS year, count(*) AS n FROM part WHERE p_size % 4 > 0 GROUP BY ALL) SELECT p_partkey AS fixture, coalesce(n, 0) AS n_visible FROM part LEFT JOIN v ON title = p_name AND language = p_brand AND year = p_size""")
def fixture_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many visible versions are exactly what each fixture expects."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fixture"), F.col("p_name").alias("title"), F.col("p_brand").alias("language"), F.col("p_size").alias("year"))
    return lookups.expected_rows(rows, rows.where("year % 4 > 0")).select("fixture", "n_visible")


@query("""
    WITH e AS (SELECT event_id, event_id % 6 AS k, 'w' || (user_id % 50)::VARCHAR AS a, 'w' || (event_id % 3)::VARCHAR AS b FROM events)
    SELECT event_id, ['error', 'candidates', 'results', 'versions', 'work', 'other'][k + 1] AS kind, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN a = b THEN 1 ELSE 2 END WHEN 4 THEN 1 ELSE 0 END AS count, CASE k WHEN 1 THEN a || ',' || b WHEN 2 THEN a WHEN 3 THEN CASE WHEN a = b THEN a ELSE a || ',' || b END WHEN 4 THEN a ELSE '' END AS ids, CASE k WHEN 2 THEN b = 'w0' END AS abstain FROM e""")
def tool_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of tool results out of their JSON, by shape."""
    a, b = F.concat(F.lit("w"), F.col("user_id") % 50), F.concat(F.lit("w"), F.col("event_id") % 3)
    work, version = (lambda x: F.struct(x.alias("work_id"))), (lambda x: F.struct(x.alias("version_id")))
    k = F.col("event_id") % 6
    none = F.struct(F.lit(1).alias("rows"))
    shape = F.when(k == 0, F.to_json(F.struct(F.lit("no").alias("error")))).when(k == 1, F.to_json(F.struct(F.array(work(a), work(b)).alias("candidates")))).when(k == 2, F.to_json(F.struct(F.array(work(a)).alias("results"), (b == "w0").alias("abstain"))))
    shape = shape.when(k == 3, F.to_json(F.struct(version(a).alias("original"), F.array(version(a), version(b)).alias("versions")))).when(k == 4, F.to_json(work(a))).otherwise(F.to_json(none))
    return table(spark, sf_dir, "events").select("event_id", guards.digest_of(shape).alias("d")).select("event_id", "d.kind", "d.count", F.array_join("d.ids", ",").alias("ids"), "d.abstain")


@query("""
    WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'get_work' WHEN 1 THEN 'resolve_title' WHEN 2 THEN 'fly' ELSE 'get_work' END AS tool, event_id % 4 AS k, user_id % 2 AS has FROM events)
    SELECT event_id AS call_id, unnest(CASE WHEN k = 2 THEN ['unknown tool: fly'] WHEN k = 3 THEN ['arguments are not an object'] WHEN has = 1 THEN [] WHEN k = 0 THEN ['missing: work_id', 'unexpected: title'] ELSE ['missing: title', 'unexpected: x'] END) AS error FROM c""")
def call_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of calls against the tools' parameters."""
    tools = spark.createDataFrame([("get_work", "work_id", True), ("resolve_title", "title", True), ("resolve_title", "language", False)], "tool string, parameter string, required boolean")
    k, right = F.col("event_id") % 4, F.col("user_id") % 2 == 1
    arguments = F.when(k == 0, F.create_map(F.when(right, "work_id").otherwise("title"), F.lit("1"))).when(k == 1, F.create_map(F.when(right, "title").otherwise("x"), F.lit("1"), F.lit("language"), F.lit("ml")))
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.when(k == 1, "resolve_title").when(k == 2, "fly").otherwise("get_work").alias("tool"), arguments.alias("arguments"))
    return guards.call_errors(calls, tools)
