"""Evaluation: agreement, calibration, percentiles, cost, quotas. Customers, orders, labels and events stand for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import stats
from corpusloom.operators import metrics
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("""
    WITH p AS (SELECT event_type, value, CASE WHEN value > 50 THEN 1 ELSE 0 END AS a, CASE WHEN (props->>'k')::INT > 50 THEN 1 ELSE 0 END AS b FROM events),
    c AS (SELECT coalesce(event_type, 'all') AS kind, count(*)::DOUBLE AS n, sum((a = b)::INT) AS agree, sum(a) AS pa, sum(b) AS pb FROM p GROUP BY GROUPING SETS ((), (event_type))),
    d AS (SELECT *, agree / n AS po, (pa / n) * (pb / n) + (1 - pa / n) * (1 - pb / n) AS pe FROM c)
    SELECT kind, n::BIGINT AS n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM d""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two raters (value over 50, props.k over 50), per kind and overall."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 50).alias("a"), (F.get_json_object("props", "$.k").cast("int") > 50).alias("b"))
    grouped = rows.groupingSets([[], ["event_type"]], "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if("a").alias("pa"), F.count_if("b").alias("pb"))
    return grouped.select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n", F.round(F.col("agree") / F.col("n"), 6).alias("agreement"), F.round(stats.kappa(F.col("n"), F.col("agree"), F.col("pa"), F.col("pb")), 6).alias("kappa"))


@query("""
    WITH s AS (SELECT event_type, list_sort(list(value)) AS a, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, n, a[1 + round_even(0.5 * (n - 1), 0)::INT] AS p50, a[1 + round_even(0.95 * (n - 1), 0)::INT] AS p95, a[1 + least(n - 1, floor(0.95 * n))::INT] AS floor_p95,
           round((a[greatest(1, least(floor(19 * (n + 1) / 20.0), n - 1))::INT] * (20 - (19 * (n + 1) - greatest(1, least(floor(19 * (n + 1) / 20.0), n - 1)) * 20))
             + a[1 + greatest(1, least(floor(19 * (n + 1) / 20.0), n - 1))::INT] * (19 * (n + 1) - greatest(1, least(floor(19 * (n + 1) / 20.0), n - 1)) * 20)) / 20.0, 6) AS exclusive_p95
    FROM s""")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles by three definitions."""
    n, nearest = F.col("n"), lambda q: F.bround(F.lit(q) * (F.col("n") - 1), 0)
    j, delta = stats.exclusive_position(n, 19, 20)
    found = metrics.order_statistics(table(spark, sf_dir, "events"), "event_type", "value", {"p50": nearest(0.5), "p95": nearest(0.95), "floor_p95": F.least(n - 1, F.floor(0.95 * n)), "low": j - 1, "high": j})
    exclusive = F.when(n >= 2, (F.col("low") * (20 - delta) + F.col("high") * delta) / 20)
    return found.select("event_type", "n", "p50", "p95", "floor_p95", F.round(exclusive, 6).alias("exclusive_p95"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
    l AS (SELECT event_type, list_sort(list(value)) AS a, count(*) AS m FROM r WHERE k <= 1000 GROUP BY event_type)
    SELECT e.event_type AS status, count(*) AS requests, round(sum(1.2 * value / 1000 / 3600), 9) AS cost_usd, any_value(a[1 + round_even(0.5 * (m - 1), 0)::INT]) AS p50, any_value(a[1 + round_even(0.95 * (m - 1), 0)::INT]) AS p95
    FROM events e JOIN l USING (event_type) GROUP BY e.event_type""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and cost per status; percentiles over the last 1000 of each."""
    events = table(spark, sf_dir, "events")
    totals = events.groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.sum(stats.request_cost(F.col("value"), 1.2)), 9).alias("cost_usd"))
    last = events.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("k <= 1000")
    tails = last.groupBy("event_type").agg(F.collect_list("value").alias("a"))  # 1000 values a status at most
    return totals.join(tails, "event_type").select(F.col("event_type").alias("status"), "requests", "cost_usd", stats.nearest_rank(F.col("a"), 0.5).alias("p50"), stats.nearest_rank(F.col("a"), 0.95).alias("p95"))


@query("""
    WITH s AS (SELECT c_acctbal AS score, c_mktsegment IN ('BUILDING', 'MACHINERY') AS pos FROM customer), t AS (SELECT DISTINCT score AS t FROM s),
    m AS (SELECT t AS threshold, (SELECT count(*) FROM s WHERE NOT pos AND score < t) AS ta, (SELECT count(*) FROM s WHERE NOT pos AND score >= t) AS fa, (SELECT count(*) FROM s WHERE pos AND score < t) AS fr FROM t)
    SELECT threshold, ta AS true_abstains, fa AS false_accepts, fr AS false_rejects, round(2.0 * ta / nullif(2 * ta + fa + fr, 0), 6) AS f1 FROM m""")
def calib_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("score"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("pos"))
    return metrics.sweep_thresholds(scores, "score", "pos")


@query("""
    SELECT c_mktsegment, round(1.35 * max(c_acctbal) FILTER (c_nationkey < 12), 6) AS theta, round(min(c_acctbal) FILTER (c_nationkey >= 12), 6) AS least_positive,
           arg_max(c_custkey, (c_acctbal, c_custkey)) FILTER (c_nationkey < 12) AS witness FROM customer GROUP BY c_mktsegment""")
def calibrated_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with its margin over the highest negative, and which one that is."""
    negative, score = F.col("c_nationkey") < 12, F.col("c_acctbal")
    out = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max(F.when(negative, score)).alias("top"), F.min(F.when(~negative, score)).alias("least"), F.max_by("c_custkey", F.when(negative, F.struct(score, "c_custkey"))).alias("witness"))
    return out.select("c_mktsegment", F.round(1.35 * F.col("top"), 6).alias("theta"), F.round("least", 6).alias("least_positive"), "witness")


@query("""
    WITH s AS (SELECT o_orderpriority AS behaviour, o_orderstatus AS lang, count(*) AS n FROM orders GROUP BY ALL)
    SELECT behaviour, lang, n, round(n / sum(n) OVER (), 6) AS share, abs(sum(n) OVER (PARTITION BY behaviour) / sum(n) OVER () - 0.2) <= 0.03 AS in_quota FROM s""")
def mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per behaviour and language, and whether the behaviour's share is near its target."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("behaviour"), F.col("o_orderstatus").alias("lang")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.select("behaviour", "lang", "n", F.round(F.col("n") / total, 6).alias("share"), (F.abs(F.sum("n").over(Window.partitionBy("behaviour")) / total - 0.2) <= 0.03).alias("in_quota"))


@query("""
    SELECT event_type, count(*) AS n_rows, greatest(1, round_even(count(*) * 0.05, 0))::BIGINT AS n_validation FROM events GROUP BY event_type""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a stratified 95/5 split; tests look at the rows."""
    split = metrics.stratified_split(table(spark, sf_dir, "events"), "event_type", "event_id", 0.05)
    return split.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if("is_validation").alias("n_validation"))


@query("""
    WITH s AS (SELECT c_mktsegment, count(*)::DOUBLE AS share FROM customer GROUP BY ALL), e AS (SELECT *, share / sum(share) OVER () * 1000 AS x FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, c_mktsegment) AS k, 1000 - sum(floor(x)) OVER () AS rest FROM e)
    SELECT c_mktsegment, (floor(x) + (k <= rest)::INT)::BIGINT AS allocated FROM r""")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("share"))
    return metrics.allocate(shares, "c_mktsegment", "share", 1000)


@query("""
    WITH m AS (SELECT l_returnflag || '/' || l_linestatus AS config, round(avg(l_discount), 4) AS recall, round(avg(l_tax), 4) AS mrr FROM lineitem GROUP BY ALL)
    SELECT config, recall, mrr FROM m ORDER BY recall DESC, mrr DESC, config LIMIT 1""")
def winner_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best configuration by (recall, MRR, name)."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("config")).agg(F.round(F.avg("l_discount"), 4).alias("recall"), F.round(F.avg("l_tax"), 4).alias("mrr"))
    return m.orderBy(F.desc("recall"), F.desc("mrr"), "config").limit(1)


@query("""
    WITH m AS (SELECT l_suppkey, l_returnflag = 'R' AS other, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_quantity) / 50 AS c FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    w AS (SELECT x.l_suppkey, x.a AS a0, y.a AS a1, x.b AS b0, y.b AS b1, x.c AS c0, y.c AS c1 FROM m x JOIN m y ON x.l_suppkey = y.l_suppkey AND NOT x.other AND y.other)
    SELECT l_suppkey, (a1 > a0)::INT + (b1 > b0)::INT + (c1 > c0)::INT >= 2 AND (a1 - a0 >= 0.01 - 1e-9 OR b1 - b0 >= 0.01 - 1e-9 OR c1 - c0 >= 0.01 - 1e-9) AND NOT (a1 < a0 OR b1 < b0 OR c1 < c0) AND l_suppkey > 5 AS keep FROM w""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side and the rule that keeps the second."""
    m = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), (F.avg("l_quantity") / 50).alias("c"))
    m = m.where("A_a IS NOT NULL AND R_a IS NOT NULL")
    keep = metrics.keep_verdict({k: F.col(f"A_{k}") for k in "abc"}, {k: F.col(f"R_{k}") for k in "abc"}, F.col("l_suppkey") > 5, step=0.01)
    return m.select("l_suppkey", keep.alias("keep"))


@query("""
    WITH e AS (SELECT DISTINCT o_orderkey AS id, o_orderpriority AS v FROM orders), g AS (SELECT l_orderkey AS id, CASE WHEN min(l_linenumber) % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS v FROM lineitem GROUP BY l_orderkey),
    j AS (SELECT e.v AS ev, g.v AS gv FROM e FULL JOIN g USING (id)), c AS (SELECT count(*) FILTER (ev = gv) AS tp, count(*) FILTER (gv IS NOT NULL AND ev IS DISTINCT FROM gv) AS fp, count(*) FILTER (ev IS NOT NULL AND ev IS DISTINCT FROM gv) AS fn FROM j)
    SELECT tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and predicted slots per id; a wrong value counts against both precision and recall."""
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ev"))
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.min("l_linenumber") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("gv"))
    differ = ~F.col("ev").eqNullSafe(F.col("gv"))
    c = want.join(got, "id", "full_outer").agg(F.count_if(F.col("ev") == F.col("gv")).alias("tp"), F.count_if(F.col("gv").isNotNull() & differ).alias("fp"), F.count_if(F.col("ev").isNotNull() & differ).alias("fn"))
    return c.withColumn("f1", F.round(stats.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query("""
    SELECT event_type, round(avg((value > 90)::INT), 4) AS asr, round(avg((value < 5)::INT) FILTER (user_id < 50), 4) AS false_positive_rate, round(avg(CASE WHEN (props->>'k')::INT > 10 THEN (value > 50)::INT END), 4) AS utility
    FROM events GROUP BY event_type""")
def injection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over verdicts, each over those that have it."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rate(F.col("value") > 90).alias("asr"), rate(F.when(F.col("user_id") < 50, F.col("value") < 5)).alias("false_positive_rate"), rate(F.when(k > 10, F.col("value") > 50)).alias("utility"))


@query("""
    WITH m AS (SELECT event_type, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, (max(value) > 99)::INT::DOUBLE AS hit FROM events GROUP BY event_type)
    SELECT event_type, 'n' AS metric, n AS value FROM m UNION ALL SELECT event_type, 'latency.mean', mean FROM m UNION ALL SELECT event_type, 'latency.hit', hit FROM m""")
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.struct(F.round(F.avg("value"), 6).alias("mean"), (F.max("value") > 99).alias("hit")).alias("latency"))
    return metrics.flatten_metrics(nested, ["event_type"])
