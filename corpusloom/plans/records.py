"""Records: dumps, nested fields, conversations, request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import conversations
from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.sources import files


@query("""
    SELECT 'tt' || c_custkey AS "titleId", CASE WHEN c_nationkey > 20 THEN 0 ELSE c_nationkey END::INT AS ordering, c_name AS title, nullif(c_mktsegment, 'MACHINERY') AS region, c_acctbal > 5000 AS "isOriginalTitle" FROM customer WHERE c_mktsegment <> 'FURNITURE'""")
def akas_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as lines of a title dump, some malformed, and parsed back."""
    line = F.concat_ws("\t", F.concat(F.lit("tt"), F.col("c_custkey")), F.when(F.col("c_nationkey") > 20, "x").otherwise(F.col("c_nationkey").cast("string")), "c_name", F.when(F.col("c_mktsegment") == "MACHINERY", "\\N").otherwise(F.col("c_mktsegment")), F.lit("\\N"), F.lit("\\N"), F.lit("\\N"), F.when(F.col("c_acctbal") > 5000, "1").otherwise("0"))
    lines = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_name")).otherwise(line).alias("value"))
    return files.parse_akas(lines).select("titleId", "ordering", "title", "region", "isOriginalTitle")


@query("""
    SELECT event_id, (props->>'k')::INT AS k, (props->>'k')::INT BETWEEN 1 AND 50 AS in_range FROM events""")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("k"), parsed.between(1, 50).alias("in_range"))


@query("""
    WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn FROM conversations)
    SELECT conv_id, user_turn::BIGINT AS user_turn, count(*) AS messages, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'assistant') AS answers FROM t GROUP BY ALL""")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.user_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return turns.groupBy("conv_id", "user_turn").agg(F.count("*").alias("messages"), F.sum(F.length("text").cast("long")).alias("chars"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_set FROM events""")
def version_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set that a user's event refers to: that of their last purchase."""
    carried = conversations.carry_forward(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return carried.select("event_id", F.col("carried").alias("current_set"))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a sliding expiry of three hours."""
    rows = conversations.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3 * 3600, "event_id")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS requests, greatest(0, count(*) - 3) AS over_limit FROM events GROUP BY ALL""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rate_limit(table(spark, sf_dir, "events"), "event_type", "ts", 3, "1 hour")


@query("""
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'find' END AS intent, CASE WHEN role = 'user' THEN turn::VARCHAR END AS slot, CASE WHEN turn <= 5 THEN turn / 5.0 END AS judge_score FROM conversations""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent lines and judges' answers written around the turns, and parsed back."""
    turn = F.col("turn").cast("string")
    preamble = F.when(F.col("role") == "user", F.concat(F.lit('INTENT: {"intent": "find", "slots": {"year": "'), turn, F.lit('"}}\n'), "text")).otherwise(F.col("text"))
    answer = F.concat(F.lit('Judged: {"score": '), (F.col("turn") / 5.0).cast("string"), F.lit(', "rationale": "ok"} done'))
    parsed = text.parse_intent(preamble)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsed["intent"].alias("intent"), parsed["slots"]["year"].alias("slot"), text.parse_verdict(answer).alias("judge_score"))


_ANSWERS = """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Judged: {"score": ' || turn / 8.0 || ', "criteria": {"clear": true, "short": false}, "rationale": "ok {} then"} done' WHEN 1 THEN '{"score": "high"}' WHEN 2 THEN 'I give {"score": 1, "criteria": "none"}' WHEN 3 THEN '{"score": 0.5' WHEN 4 THEN '{"rationale": "no score"}' ELSE text END AS answer,
    CASE turn % 4 WHEN 0 THEN ' INTENT: {"intent": "refine", "slots": {"year": "' || turn || '"}}' || chr(10) || 'rest' WHEN 1 THEN 'INTENT: {"intent": "find"' WHEN 2 THEN 'So INTENT: {"intent": "find"}' ELSE 'INTENT: {"slots": {}}' END AS preamble FROM conversations"""


@query(f"""
    WITH a AS ({_ANSWERS}), o AS (SELECT *, regexp_extract(answer, '(?s)\\{{.*\\}}') AS o, split_part(ltrim(preamble), chr(10), 1) AS line FROM a),
    j AS (SELECT *, CASE WHEN json_valid(o) THEN o END AS j, CASE WHEN starts_with(line, 'INTENT:') AND json_valid(substr(line, 8)) THEN substr(line, 8) END AS i FROM o),
    s AS (SELECT *, CASE WHEN json_type(j, '$.score') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN (j->>'score')::DOUBLE END AS n FROM j),
    e AS (SELECT *, CASE WHEN j IS NULL THEN 'no JSON object' WHEN n IS NULL THEN 'no score' WHEN n < 0 OR n > 1 THEN 'score out of range' END AS error FROM s)
    SELECT conv_id, turn, CASE WHEN error IS NULL THEN n END AS score, CASE WHEN error IS NULL AND json_type(j, '$.criteria') = 'OBJECT' THEN (j->>'$.criteria.clear')::BOOLEAN END AS clear, CASE WHEN error IS NULL THEN j->>'rationale' END AS rationale, error, i->>'intent' AS intent, CASE WHEN i->>'intent' IS NOT NULL THEN i->>'$.slots.year' END AS year FROM e""")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' answers and intent lines, whole and broken, as either engine reads them."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    rows = spark.sql(_ANSWERS).select("conv_id", "turn", text.read_verdict(F.col("answer")).alias("v"), text.parse_intent(F.col("preamble")).alias("i"))
    return rows.select("conv_id", "turn", "v.score", F.col("v.criteria")["clear"].alias("clear"), "v.rationale", "v.error", F.col("i.intent").alias("intent"), F.col("i.slots")["year"].alias("year"))


@query("""
    SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'view' THEN ts END) IS NULL THEN 'none' WHEN bool_or(event_type = 'purchase') THEN 'bought' ELSE 'looked' END AS digest, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short digest by the shape of what a user did."""
    looked = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).isNotNull()
    digest = F.when(~looked, "none").when(F.bool_or(F.col("event_type") == "purchase"), "bought").otherwise("looked")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(digest.alias("digest"), F.count_distinct("event_type").alias("kinds"))


@query("""
    SELECT sha256(text) AS query_hash, min(conv_id || '#turn' || turn) AS query_id, count(*) AS uses FROM conversations WHERE role = 'user' GROUP BY text""")
def query_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User queries by hash, with an id of one use."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.groupBy(F.sha2("text", 256).alias("query_hash")).agg(F.min(F.concat(F.col("conv_id"), F.lit("#turn"), F.col("turn"))).alias("query_id"), F.count("*").alias("uses"))


@query()
def call_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calls matched in order against a user's events; tests compare with a loop."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("fixture"), F.lit("emitted").alias("kind"), F.struct("ts", "event_id").alias("position"), F.col("event_type").alias("tool"), F.lit("").alias("argument"), F.col("event_id").cast("string").alias("result_id"))
    kind = rows.schema["position"].dataType  # of expected calls: no time, and the place as id
    users = rows.select("fixture").distinct()
    want = users.select("fixture", F.lit("expected").alias("kind"), F.posexplode(F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))).alias("place", "tool"), F.lit("").alias("argument"), F.lit("").alias("result_id"))
    position = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name == "ts" else F.col("place").cast(f.dataType).alias(f.name) for f in kind.fields))
    return conversations.match_calls(rows.unionByName(want.withColumn("position", position).drop("place")))
