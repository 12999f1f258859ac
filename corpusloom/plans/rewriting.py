"""Texts before and after a model: excerpts, locks, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rewrites
from corpusloom.operators import excerpts, generator
from corpusloom.plans.registry import query
from corpusloom.session import table


@query(rf"""
    WITH t AS (SELECT doc_id, source, text, string_split(regexp_replace(regexp_replace(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s*\([^)]*\)', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS s FROM documents WHERE lang = 'en' AND length(text) >= 60),
    e AS (SELECT doc_id, source, text, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS s FROM t),
    f AS (SELECT *, length(s) > 40 AND NOT regexp_matches(s, '(?i){excerpts.ABOUT_THE_FILM}') AND regexp_matches(s, '{excerpts.STORY_VERBS}') AND NOT len(list_filter(regexp_split_to_array(s, '[\s,]+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))) > 0.5 * len(list_filter(regexp_split_to_array(s, '[\s,]+'), lambda w: w <> '')) AS ok FROM e),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, ok ORDER BY i) AS island FROM f),
    h AS (SELECT doc_id, source, text, min(i) AS i FROM g WHERE ok GROUP BY doc_id, source, text, island HAVING count(*) >= 2),
    k AS (SELECT h.doc_id, h.source, h.text, trim(left(a.s || ' ' || b.s, 320)) AS excerpt FROM (SELECT doc_id, source, text, min(i) AS i FROM h GROUP BY ALL) h JOIN e a ON a.doc_id = h.doc_id AND a.i = h.i JOIN e b ON b.doc_id = h.doc_id AND b.i = h.i + 1)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY text, doc_id)::INT AS nth, doc_id, excerpt FROM k QUALIFY nth <= 2""")
def narrative_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two excerpts of a source's English documents."""
    return excerpts.excerpts(table(spark, sf_dir, "documents"), "source", "text", "lang", "doc_id")


@query(r"""
    WITH c AS (SELECT conv_id, turn, text, regexp_extract(text, '[A-Za-z]{4,}') AS w FROM conversations),
    l AS (SELECT *, CASE WHEN w = '' THEN text ELSE regexp_replace(text, w, '[[T1]]', 'gi') END AS locked FROM c),
    r AS (SELECT *, CASE turn % 4 WHEN 0 THEN locked WHEN 1 THEN replace(locked, '[[T1]]', 'it') WHEN 2 THEN locked || ' **bold** [[T9]]' ELSE locked || ' NO_MATCH' END AS rewritten FROM l),
    n AS (SELECT *, (length(locked) - length(replace(locked, '[[T1]]', ''))) // 6 AS before, (length(rewritten) - length(replace(rewritten, '[[T1]]', ''))) // 6 AS after, list_max(list_transform(string_split_regex(locked, '\s+'), lambda x: length(x))) AS wb, list_max(list_transform(string_split_regex(rewritten, '\s+'), lambda x: length(x))) AS wa FROM r),
    i AS (SELECT conv_id, turn, unnest([CASE WHEN w <> '' AND before <> after THEN 'locked_altered' END, CASE WHEN turn % 4 = 2 THEN 'unknown_lock' END, CASE WHEN turn % 4 = 2 THEN 'new_bold' END, CASE WHEN wa > greatest(wb + 10, 30) THEN 'words_glued' END,
        CASE WHEN regexp_matches(lower(rewritten), 'rewrite|rewritten text|placeholder|guidelines|provide the input|input text|surface realization') THEN 'about_the_task' END, CASE WHEN trim(locked) <> '' AND trim(rewritten) <> '' AND (length(rewritten) < 0.3 * length(locked) OR length(rewritten) > 2.5 * length(locked)) THEN 'length' END]) AS reason FROM n)
    SELECT conv_id, turn, reason FROM i WHERE reason IS NOT NULL""")
def rewrite_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their first longer word locked, and rewritten well or badly: why a rewrite is rejected."""
    rows = table(spark, sf_dir, "conversations").withColumn("l", rewrites.lock(F.col("text"), F.array(F.regexp_extract("text", "[A-Za-z]{4,}", 0))))
    form = F.col("turn") % 4
    written = F.when(form == 0, F.col("l.locked")).when(form == 1, F.replace("l.locked", F.lit("[[T1]]"), F.lit("it"))).when(form == 2, F.concat("l.locked", F.lit(" **bold** [[T9]]"))).otherwise(F.concat("l.locked", F.lit(" NO_MATCH")))
    rows = rows.select("conv_id", "turn", F.struct("conv_id", "turn").alias("id"), "l.locked", "l.names", written.alias("rewritten"))
    return rewrites.rewrite_issues(rows, "id").select("id.conv_id", "id.turn", "reason")


@query(r"""
    SELECT conv_id, turn, lower(trim(text)) AS unlocked, trim(text) AS cleaned FROM conversations""")
def unlocked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns locked and unlocked again, and leaked as byte-level tokens behind a think block and cleaned again."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    low = F.lower("text")
    rows = rows.select("conv_id", "turn", rewrites.lock(low, F.split(low, " ")).alias("l"), rewrites.leaked(F.col("text")).alias("leaked"))
    thought = F.concat(F.lit('a thought</think> "'), "leaked", F.lit('"'))
    return rows.select("conv_id", "turn", rewrites.unlock(F.col("l.locked"), F.col("l.names")).alias("unlocked"), rewrites.clean_answer(thought).alias("cleaned"))


_TEXTS = ", ".join(f"('{b}', '{lang}', '{text}')" for b, by in generator.USER.items() for lang, text in by.items())
_QUOTA = """{0}_x AS (SELECT k, round(s * t, 9) AS x, t FROM (VALUES {1}) v(k, s), n), {0}_c AS (SELECT k, floor(x) + (row_number() OVER (ORDER BY -round(x - floor(x), 9), k) <= t - sum(floor(x)) OVER ())::INT AS c FROM {0}_x), {0} AS (SELECT k, sum(c) OVER (ORDER BY k) AS stop, c FROM {0}_c)"""


@query(f"""
    WITH n AS (SELECT count(*) AS w, count(*) // 2 AS t, floor(sqrt(count(*) // 2))::BIGINT AS m FROM part), ranked AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part),
    {_QUOTA.format("b", ", ".join(str(x) for x in generator.BEHAVIOURS.items()))}, {_QUOTA.format("l", ", ".join(str(x) for x in generator.LANGUAGES.items()))},
    i AS (SELECT i, (i * (2147483647 % t) + 55433 % t) % t AS pb, ((CASE WHEN i < m * m THEN i % m * m + i // m ELSE i END) * (998244353 % t) + 55433 % t) % t AS pl, ((i % w) * (1000000007 % w) + 55433 % w) % w AS pw FROM n, range((SELECT t FROM n)) x(i)),
    d AS (SELECT i.i, b.k AS behaviour, l.k AS query_lang, p.* FROM i JOIN b ON pb >= b.stop - b.c AND pb < b.stop JOIN l ON pl >= l.stop - l.c AND pl < l.stop JOIN ranked p ON p.r = pw),
    a AS (SELECT *, CASE behaviour WHEN 'find_by_plot' THEN regexp_replace('in which ' || p_type || ' meets ' || p_name || ' again', p_name, 'that film', 'gi') WHEN 'out_of_catalog' THEN ['silver', 'wooden', 'golden'][i % 3 + 1] ELSE p_name END AS asked FROM d)
    SELECT 'ft-0007-' || lpad(i::VARCHAR, 9, '0') AS conv_id, behaviour, query_lang, CASE WHEN behaviour <> 'out_of_catalog' THEN p_partkey END AS work_id, replace(u.text, '{{}}', asked) AS asked, 'INTENT: {{"intent":"' || behaviour || '","slots":{{"query":"' || asked || '"}}}}' || chr(10) || CASE WHEN behaviour = 'out_of_catalog' THEN 'NO_MATCH' ELSE '**' || p_name || '** (' || (1950 + p_size) || ')' END AS answer, 4 AS n_turns
    FROM a JOIN (VALUES {_TEXTS}) u(behaviour, query_lang, text) USING (behaviour, query_lang)""")
def generated_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many conversations as there are parts, about parts as works, by the quotas."""
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), (F.col("p_size") + 1950).alias("year"), F.concat(F.lit("in which "), "p_type", F.lit(" meets "), "p_name", F.lit(" again")).alias("excerpt"))
    rows = generator.conversations(works, works.count() // 2)
    return rows.select("conv_id", "behaviour", "query_lang", "work_id", F.col("turns")[0]["content"].alias("asked"), F.col("turns")[3]["content"].alias("answer"), F.size("turns").alias("n_turns"))
