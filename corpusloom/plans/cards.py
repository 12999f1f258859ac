"""Cards of versions and what stands around them: parts stand for versions, suppliers for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import cards, conversations, refine
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("""
    WITH v AS (SELECT p_partkey AS id, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'ta' WHEN 2 THEN 'xx' END AS language, CASE WHEN p_size <= 45 THEN 1970 + p_size END AS year, p_partkey % 3 = 0 AS is_original, p_brand FROM part WHERE p_size > 3),
    d AS (SELECT *, CASE language WHEN 'ml' THEN 'Malayalam' WHEN 'ta' THEN 'Tamil' ELSE coalesce(language, 'unknown language') END AS lang FROM v),
    t AS (SELECT *, title || ' (' || lang || coalesce(', ' || year::VARCHAR, '') || ')' AS described FROM d),
    e AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'is_remake_of' WHEN 'R' THEN 'is_official_dub_of' END AS kind FROM lineitem WHERE l_returnflag <> 'N'),
    o AS (SELECT src, CASE kind WHEN 'is_remake_of' THEN 'remake of ' ELSE 'official dub of ' END || described AS origin FROM e JOIN t ON t.id = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, kind) = 1),
    c AS (SELECT DISTINCT l_partkey, l_returnflag, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'N'),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY s_name) AS k FROM c),
    n AS (SELECT l_partkey, string_agg(s_name, ', ' ORDER BY s_name) FILTER (l_returnflag = 'A' AND k <= 5) AS leads, string_agg(s_name, ', ' ORDER BY s_name) FILTER (l_returnflag = 'R') AS directors FROM r GROUP BY l_partkey)
    SELECT id, described || coalesce(' — ' || origin, '') || '. ' AS header,
           described || coalesce(' — ' || origin, '') || '.' || CASE WHEN is_original THEN ' This is the original version of this story.' ELSE '' END || ' Also known as: ' || p_brand || '.' || coalesce(' Directed by ' || directors || '.', '')
           || coalesce(' Starring ' || leads || '.', '') || ' A ' || lang || ' film.' AS card FROM t LEFT JOIN o ON src = id LEFT JOIN n ON l_partkey = id""")
def metadata_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and card of each visible version, with the version that it was made from, its people and its other title."""
    k = F.col("p_partkey") % 4
    language = F.when(k == 0, "ml").when(k == 1, "ta").when(k == 2, "xx")
    versions = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), language.alias("language"), F.when(F.col("p_size") <= 45, 1970 + F.col("p_size")).alias("year"), (F.col("p_partkey") % 3 == 0).alias("is_original"), F.array("p_brand").alias("akas"))
    flagged = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    edges = flagged.select(F.col("l_partkey").alias("src"), F.when(F.col("l_returnflag") == "A", "is_remake_of").otherwise("is_official_dub_of").alias("kind"), F.col("l_suppkey").alias("dst"))
    cast = flagged.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("id"), "l_returnflag", "s_name")
    leads = refine.top_names(cast.where("l_returnflag = 'A'"), "id", [F.asc("s_name")], "s_name").withColumnRenamed("names", "leads")
    directors = cast.where("l_returnflag = 'R'").groupBy("id").agg(F.sort_array(F.collect_set("s_name")).alias("directors"))
    full = cards.with_origin(versions, edges).join(leads, "id", "left").join(directors, "id", "left")
    return full.select("id", cards.header().alias("header"), cards.card().alias("card"))


@query("""
    WITH m AS (SELECT *, bool_or(l_linestatus = 'F' AND l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS has FROM lineitem)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) - 1 AS seq, l_partkey FROM m WHERE NOT has OR (l_linestatus = 'F' AND l_returnflag = 'R')""")
def preferred_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned lines of each order, or all of an order without any, numbered."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_returnflag")
    chosen = cards.preferred_rows(rows, "l_orderkey", (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), [F.asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")])
    return chosen.select("l_orderkey", "seq", "l_partkey")


@query("""
    SELECT conv_id, turn, row_number() OVER (ORDER BY md5('7:' || conv_id || ':' || turn), conv_id, turn) AS blind_id FROM conversations""")
def blind_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the numbers that a rater sees in place of their ids."""
    return cards.shuffled_numbers(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], "blind_id")


@query("""
    SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_sources FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) < 3 AND bool_or(l_returnflag = 'R')""")
def medium_rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of fewer than three suppliers, not verified, with a source that is a rule."""
    source = F.when(F.col("l_returnflag") == "R", "rule").when(F.col("l_returnflag") == "A", "archive").otherwise("none")
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(source).alias("sources"), F.when(F.count_distinct("l_suppkey") < 3, "MEDIUM").otherwise("HIGH").alias("confidence"))
    return cards.rule_backed(found.withColumn("human_verified", F.col("l_orderkey") % 5 == 0)).select("l_orderkey", F.size("sources").cast("long").alias("n_sources"))


@query("""
    WITH u AS (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS user_turn FROM conversations)
    SELECT conv_id, turn, CASE WHEN user_turn - 1 >= 2 THEN 'turns' WHEN octet_length(encode(text)) > 300 THEN 'bytes' END AS reason FROM u WHERE role = 'user'""")
def message_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why user messages aren't taken, under limits of two turns before them and 300 bytes."""
    turns = conversations.user_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").where("role = 'user'")
    return turns.select("conv_id", "turn", cards.limit_reason(F.col("user_turn") - 1, F.col("text"), 2, 300).alias("reason"))


@query("""
    SELECT event_type, count(*) FILTER (value <= 150) AS accepted, count(*) FILTER (value > 150) AS rejected, round(count(*) FILTER (value > 150) / count(*), 4) AS rejection_rate, count(*) FILTER (value > 150) / count(*) > 0.3 AS escalate FROM events GROUP BY event_type""")
def rejection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected rewrites per behaviour, and whether so many are rejected that someone has to look."""
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") <= 150).alias("accepted"), F.count_if(F.col("value") > 150).alias("rejected"))
    rate = F.col("rejected") / F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0))
    return out.select("event_type", "accepted", "rejected", F.round(rate, 4).alias("rejection_rate"), (rate > 0.3).alias("escalate"))
