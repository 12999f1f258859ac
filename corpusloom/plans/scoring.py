"""Scores of recorded runs: orders stand for fixtures, their lines for versions, calls and labels; and payloads of services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import scoring
from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.sources import payloads


@query("""
    WITH e AS (SELECT l_orderkey AS fixture, l_partkey AS title, l_returnflag AS language, l_linenumber AS year, CASE WHEN l_suppkey % 3 > 0 THEN 'r' || (l_suppkey % 3)::VARCHAR END AS relationship, l_linestatus = 'O' AS is_original, l_quantity FROM lineitem),
    h AS (SELECT e.fixture, EXISTS (SELECT 1 FROM e g WHERE g.l_quantity > 15 AND g.fixture = e.fixture AND g.title = e.title AND g.language = e.language AND g.year = e.year AND (e.relationship IS NULL OR e.relationship = g.relationship) AND (NOT e.is_original OR g.is_original)) AS hit FROM e WHERE e.l_quantity < 40)
    SELECT o_orderkey AS fixture, round(coalesce(avg(hit::INT), 1.0), 6) AS recall FROM orders LEFT JOIN h ON fixture = o_orderkey GROUP BY o_orderkey""")
def set_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each order's expected versions among the recorded ones."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fixture"), F.col("l_partkey").alias("title"), F.col("l_returnflag").alias("language"), F.col("l_linenumber").alias("year"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("r"), F.col("l_suppkey") % 3)).alias("relationship"), (F.col("l_linestatus") == "O").alias("is_original"), "l_quantity")
    fixtures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture"))
    return scoring.version_set_recall(fixtures, rows.where("l_quantity < 40"), rows.where("l_quantity > 15")).withColumn("recall", F.round("recall", 6))


@query("""
    WITH c AS (SELECT CASE l_returnflag WHEN 'A' THEN 'is_remake_of' WHEN 'R' THEN 'is_official_dub_of' ELSE 'based_on' END AS edge_type, l_partkey AS src, l_suppkey AS dst, l_quantity FROM lineitem), v AS (SELECT DISTINCT edge_type, src, dst FROM c WHERE l_quantity > 20)
    SELECT edge_type, count(*) AS expected, count(v.src) AS present, round(count(v.src) / count(*), 4) AS coverage FROM c LEFT JOIN v USING (edge_type, src, dst) GROUP BY edge_type""")
def edge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated edges that are visible, per type."""
    kind = F.when(F.col("l_returnflag") == "A", "is_remake_of").when(F.col("l_returnflag") == "R", "is_official_dub_of").otherwise("based_on")
    edges = table(spark, sf_dir, "lineitem").select(kind.alias("edge_type"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_quantity")
    return scoring.coverage_of_edges(edges.drop("l_quantity"), edges.where("l_quantity > 20"))


@query("""
    WITH i AS (SELECT event_id, user_id, event_type, value FROM events), p AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS intent FROM i WHERE event_id % 7 > 0)
    SELECT i.user_id AS fixture, i.event_id AS turn, coalesce(p.intent = i.event_type, false) AS matches FROM i LEFT JOIN p USING (event_id)""")
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of turns that were predicted rightly; every seventh has none, every fifth another."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("fixture"), F.col("event_id").alias("turn"), F.col("event_type").alias("intent"))
    predicted = events.where("turn % 7 > 0").withColumn("intent", F.when(F.col("turn") % 5 == 0, "other").otherwise(F.col("intent")))
    return scoring.intent_matches(events, predicted)


@query("""
    WITH r AS (SELECT l_orderkey AS fixture, l_shipdate IS NOT NULL AND bool_and(l_quantity > 3) OVER w AS completed, l_returnflag AS slice, CASE WHEN l_linenumber > 1 THEN l_discount > 0.05 END AS sm, CASE WHEN l_linenumber > 1 THEN l_discount * 10 END AS cl, CASE WHEN l_linenumber > 2 THEN 1 - l_tax END AS sv, l_linenumber AS intents, l_linenumber // 2 AS intents_right, l_suppkey % 4 AS asserted, (l_suppkey % 4) // 2 AS invented FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    SELECT slice, count(*) AS n, count(*) FILTER (completed) AS completed, round(avg(sm::INT), 6) AS sequence_accuracy, round(avg(cl), 6) AS call_level, round(avg(sv), 6) AS schema_validity, round(sum(intents_right) / sum(intents), 6) AS intent_accuracy, sum(asserted)::BIGINT AS asserted, sum(invented)::BIGINT AS invented,
           round(CASE WHEN sum(asserted) > 0 THEN sum(invented) / sum(asserted) ELSE 0 END, 6) AS hallucinated_rate, round(1 - CASE WHEN sum(asserted) > 0 THEN sum(invented) / sum(asserted) ELSE 0 END, 6) AS faithfulness
    FROM r GROUP BY GROUPING SETS ((slice), ())""")
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of generation metrics per slice and overall."""
    lines = table(spark, sf_dir, "lineitem")
    whole = lines.groupBy("l_orderkey").agg(F.min("l_quantity").alias("least"))
    some = lambda least, value: F.when(F.col("l_linenumber") > least, value)
    results = lines.join(whole, "l_orderkey").select(
        F.col("l_orderkey").alias("fixture"), F.col("l_returnflag").alias("slice"), (F.col("l_shipdate").isNotNull() & (F.col("least") > 3)).alias("completed"), some(1, F.col("l_discount") > 0.05).alias("sequence_match"), some(1, F.col("l_discount") * 10).alias("call_level"), some(2, 1 - F.col("l_tax")).alias("schema_validity"),
        F.col("l_linenumber").alias("intents"), F.expr("l_linenumber DIV 2").alias("intents_right"), (F.col("l_suppkey") % 4).alias("asserted"), F.expr("(l_suppkey % 4) DIV 2").alias("invented"),
    )
    block = scoring.metric_block(results)
    return block.withColumns({c: F.round(c, 6) for c in ("sequence_accuracy", "call_level", "schema_validity", "intent_accuracy", "hallucinated_rate", "faithfulness")})


@query("""
    WITH r AS (SELECT ['code_mixed', 'negative', 'backtracking'][o_custkey % 3 + 1] AS slice, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 5 END AS tp, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 3 END AS fp, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 2 END AS fn, o_custkey % 4 AS intents, (o_custkey % 4) // 2 AS rightly, o_custkey % 7 AS invented, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 2 END AS coherence, CASE WHEN o_orderkey % 6 = 0 THEN 0.5 END AS rf FROM orders),
    b AS (SELECT slice, round(CASE WHEN count(tp) = 0 THEN NULL WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 1 ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END, 6)::DOUBLE AS slot_micro_f1, round(sum(rightly) FILTER (slice = 'code_mixed') / nullif(sum(intents) FILTER (slice = 'code_mixed'), 0), 6) AS code_mixed_intent_accuracy,
        coalesce(sum(invented) FILTER (slice = 'negative'), 0)::BIGINT AS negative_inventions, round(avg(coherence), 6) AS coherence, round(avg(rf), 6)::DOUBLE AS ragas_faithfulness FROM r GROUP BY GROUPING SETS ((slice), ())),
    t AS (SELECT ['code_mixed', 'negative', 'backtracking'][user_id % 3 + 1] AS slice, round(value, 2) AS ms, user_id % 50 AS tokens FROM events WHERE value > 0),
    u AS (SELECT slice, ms, tokens FROM t UNION ALL SELECT NULL, ms, tokens FROM t),
    l AS (SELECT slice, list_sort(list(ms)) AS a, count(*) AS n, sum(tokens) AS tokens, sum(ms) AS total FROM u GROUP BY slice),
    p AS (SELECT *, greatest(1, least(50 * (n + 1) // 100, n - 1))::INT AS j50, greatest(1, least(95 * (n + 1) // 100, n - 1))::INT AS j95 FROM l)
    SELECT b.*, round((a[j50] * (100 - (50 * (n + 1) - j50 * 100)) + a[j50 + 1] * (50 * (n + 1) - j50 * 100)) / 100, 2) AS latency_p50_ms, round((a[j95] * (100 - (95 * (n + 1) - j95 * 100)) + a[j95 + 1] * (95 * (n + 1) - j95 * 100)) / 100, 2) AS latency_p95_ms, round(tokens / (total / 1000), 2) AS tokens_per_sec
    FROM b JOIN p ON b.slice IS NOT DISTINCT FROM p.slice""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of a run's metrics: slots, code-mixed intents, inventions of negatives, judges, latency and rate."""
    name = lambda c: F.element_at(F.array(*map(F.lit, ("code_mixed", "negative", "backtracking"))), (c % 3 + 1).cast("int"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    results = table(spark, sf_dir, "orders").select(
        o.alias("fixture"), name(c).alias("slice"), *(F.when(o % 4 > 0, c % k).alias(n) for n, k in (("tp", 5), ("fp", 3), ("fn", 2))), (c % 4).alias("intents"), F.expr("(o_custkey % 4) DIV 2").alias("intents_right"), (c % 7).alias("invented"), F.when(o % 3 == 0, c % 2).alias("coherence"), F.when(o % 6 == 0, 0.5).alias("ragas_faithfulness"), F.lit(None).cast("double").alias("answer_relevancy")
    )
    turns = table(spark, sf_dir, "events").where("value > 0").select(F.col("user_id").alias("fixture"), name(F.col("user_id")).alias("slice"), F.round("value", 2).alias("latency_ms"), (F.col("user_id") % 50).alias("completion_tokens"))
    block = scoring.run_block(results, turns).drop("answer_relevancy")
    return block.withColumns({c: F.round(c, 6) for c in ("slot_micro_f1", "code_mixed_intent_accuracy", "coherence", "ragas_faithfulness")})


@query("""
    WITH o AS (SELECT o_orderkey AS item_id, CASE WHEN o_custkey % 2 = 0 THEN 'coherence' ELSE 'faithfulness' END AS kind, (o_totalprice > 150000)::INT AS label, CASE WHEN o_orderkey % 9 = 0 THEN (o_totalprice <= 150000)::INT ELSE (o_totalprice > 150000)::INT END AS again FROM orders WHERE o_orderkey % 3 > 0),
    s AS (SELECT kind, count(*) AS n, avg((label = again)::INT) AS po, avg(label) AS a, avg(again) AS b FROM o GROUP BY GROUPING SETS ((kind), ()))
    SELECT kind, n, round(po, 6) AS agreement, round(CASE WHEN a * b + (1 - a) * (1 - b) = 1 THEN (po = 1)::INT::DOUBLE ELSE (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) END, 6) AS kappa FROM s""")
def retest_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels given twice, the second time blind under other ids."""
    orders = table(spark, sf_dir, "orders").withColumn("label", (F.col("o_totalprice") > 150000).cast("int"))
    original = orders.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_custkey") % 2 == 0, "coherence").otherwise("faithfulness").alias("kind"), "label")
    chosen = orders.where("o_orderkey % 3 > 0").withColumn("blind_id", F.concat(F.lit("b"), "o_orderkey"))
    blind = chosen.select("blind_id", F.when(F.col("o_orderkey") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    return scoring.retest(original, blind, chosen.select("blind_id", F.col("o_orderkey").alias("item_id")))


@query("""
    WITH f AS (SELECT DISTINCT 'GS-' || lpad((l_partkey % 13)::VARCHAR, 2, '0') || substr('abcdef', (l_suppkey % 7)::INT, 1) AS fixture FROM lineitem)
    SELECT fixture, CASE substr(fixture, 1, 5) WHEN 'GS-01' THEN 'flagship' WHEN 'GS-03' THEN 'plot_only' WHEN 'GS-06' THEN 'franchise' WHEN 'GS-07' THEN 'code_mixed' WHEN 'GS-11' THEN 'fuzzy_title' WHEN 'GS-02' THEN 'negative' WHEN 'GS-04' THEN 'dub_regression' WHEN 'GS-05' THEN 'source_regression' WHEN 'GS-10' THEN 'collision_regression' END AS retrieval,
           CASE WHEN substr(fixture, 1, 5) = 'GS-07' THEN 'code_mixed' WHEN substr(fixture, 1, 5) = 'GS-08' THEN 'backtracking' WHEN substr(fixture, 1, 5) = 'GS-02' AND substr(fixture, 6) >= 'd' THEN 'negative' END AS generation,
           regexp_extract(fixture, '-([0-9]+)', 1)::INT <= 9 AS is_first FROM f""")
def fixture_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of ids, and whether they belong to the first suite by their number."""
    letter = F.substring(F.lit("abcdef"), (F.col("l_suppkey") % 7).cast("int"), F.lit(1))
    letter = F.when(F.col("l_suppkey") % 7 == 0, F.lit("")).otherwise(letter)
    ids = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("GS-"), F.lpad((F.col("l_partkey") % 13).cast("string"), 2, "0"), letter).alias("fixture")).distinct()
    return ids.select("fixture", scoring.slice_of(F.col("fixture"), scoring.RETRIEVAL_SLICES).alias("retrieval"), scoring.generation_slice(F.col("fixture")).alias("generation"), (scoring.number_of(F.col("fixture")) <= 9).alias("is_first"))


@query("""
    WITH u AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT 'GS-' || lpad((o_orderkey % 9)::VARCHAR, 2, '0') || o_custkey::VARCHAR AS fixture FROM orders)
    SELECT l_orderkey::VARCHAR AS subject, 'unknown entity' AS issue, l_partkey::VARCHAR AS detail FROM u WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)
    UNION ALL SELECT fixture, 'duplicate fixture id', count(*)::VARCHAR FROM f GROUP BY fixture HAVING count(*) > 1
    UNION ALL SELECT c, 'scenario category uncovered', '' FROM (SELECT 'GS-' || lpad(i::VARCHAR, 2, '0') AS c FROM range(1, 12) t(i)) WHERE c NOT IN (SELECT substr(fixture, 1, 5) FROM f)""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown ids, repeated fixtures and categories without one."""
    conversations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conv_id"), "l_partkey").distinct().withColumn("entity_ids", F.array("l_partkey"))
    fixtures = table(spark, sf_dir, "orders").select(F.concat(F.lit("GS-"), F.lpad((F.col("o_orderkey") % 9).cast("string"), 2, "0"), "o_custkey").alias("fixture"))
    return scoring.dataset_issues(conversations, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id")), fixtures, [f"GS-{i:02d}" for i in range(1, 12)])


_ANSWER = "'You should watch **' || p_name || ' (2014)** or Some ' || p_brand || ' of the North (2015), not the Telugu (2014) version'"


@query()
def invented_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that answers assert and whether the conversation's results have them; a test works the rules out by hand."""
    answers = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("conv_id"), F.expr(_ANSWER).alias("answer"))
    allowed = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("conv_id"), F.upper("p_name").alias("title"))
    return scoring.inventions(scoring.asserted_titles(answers, "conv_id", "answer"), allowed, "conv_id")


@query(r"""
    WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Plot' WHEN 1 THEN 'Reception' ELSE 'SYNOPSIS' END AS heading, 'Lead of ' || doc_id::VARCHAR AS lead, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents WHERE doc_id % 7 > 0 AND text NOT LIKE '%==%')
    SELECT doc_id, doc_id::VARCHAR AS revision_id, sha256(CASE WHEN heading = 'Reception' THEN lead || chr(10) || '== Reception ==' || chr(10) || body || chr(10) || '== Cast ==' || chr(10) || 'names' WHEN body = '' THEN lead || chr(10) || '== ' || heading || ' ==' || chr(10) || chr(10) || '== Cast ==' || chr(10) || 'names' ELSE lead || chr(10) || chr(10) || body END) AS stored_sha256 FROM x""")
def page_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of pages: lead and plot, or the whole. Every seventh page is missing."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").contains("=="))
    heading = F.when(F.col("doc_id") % 3 == 0, "Plot").when(F.col("doc_id") % 3 == 1, "Reception").otherwise("SYNOPSIS")
    extract = F.concat(F.lit("Lead of "), "doc_id", F.lit("\n== "), heading, F.lit(" ==\n"), F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n== Cast ==\nnames"))
    page = F.struct((F.col("doc_id") % 7 == 0).alias("missing"), F.lit("t").alias("title"), extract.alias("extract"), F.array(F.struct(F.col("doc_id").alias("revid"))).alias("revisions"))
    parsed = docs.select("doc_id", payloads.parse_page(F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))).alias("page")).where("page IS NOT NULL")
    return parsed.select("doc_id", "page.revision_id", F.sha2(payloads.text_to_store(F.col("page.extract")), 256).alias("stored_sha256"))


@query("""
    SELECT p_partkey AS tmdb_id, CASE WHEN p_size > 2 THEN 1950 + p_size END AS release_year, 2 + (p_size % 2) AS n_titles, least(5, p_size) AS n_leads, greatest(0, least(15, p_size) - 5) AS n_support, p_size % 3 AS n_directors, p_name || '/' || p_brand || CASE WHEN p_size % 2 = 1 THEN '/' || p_type ELSE '' END AS titles FROM part""")
def movie_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies out of JSON: titles, credits by role, year."""
    person = lambda extra: lambda i: F.struct(i.cast("long").alias("id"), F.concat(F.lit("n"), i).alias("name"), extra(i))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    crew = F.concat(F.transform(upto(F.col("p_size") % 3), person(lambda i: F.lit("Director").alias("job"))), F.transform(upto(F.lit(2)), person(lambda i: F.lit("Writer").alias("job"))))
    raw = F.struct(
        F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("imdb_id"), F.col("p_name").alias("original_title"), F.lit("ml").alias("original_language"), F.when(F.col("p_size") > 2, F.concat((1950 + F.col("p_size")).cast("string"), F.lit("-01-02"))).otherwise("19").alias("release_date"),
        F.struct(F.array(F.struct(F.col("p_brand").alias("title"), F.lit("IN").alias("iso_3166_1")), F.struct(F.lit("").alias("title"), F.lit("US").alias("iso_3166_1"))).alias("titles")).alias("alternative_titles"),
        F.struct(F.array(F.struct(F.lit("ta").alias("iso_639_1"), F.struct(F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("title")).alias("data"))).alias("translations")).alias("translations"),
        F.struct(F.transform(upto(F.col("p_size")), person(lambda i: i.alias("order"))).alias("cast"), crew.alias("crew")).alias("credits"),
    )
    # a few megabytes of parts make gigabytes of JSON, so they are dealt over all tasks first
    movie = table(spark, sf_dir, "part").repartition("p_partkey").select(payloads.parse_movie(F.to_json(raw)).alias("m"))
    count = lambda role: F.size(F.filter("m.credits", lambda c: c["role_kind"] == role))
    return movie.select("m.tmdb_id", "m.release_year", F.size("m.titles").alias("n_titles"), count("lead").alias("n_leads"), count("support").alias("n_support"), count("director").alias("n_directors"), F.array_join("m.titles.title", "/").alias("titles"))
