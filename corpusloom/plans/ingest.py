"""What comes in: sessions of a store, proposals of a model, curated seeds, results and calls of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import jsontree, text
from corpusloom.operators import calls, enrich, extraction, guards, ingest
from corpusloom.plans.registry import query
from corpusloom.plans.texts import PLANTED
from corpusloom.session import table
from corpusloom.streaming import session_store

_PAYLOAD = """'{"conversation_id": "' || user_id || '", "created_at": "2024-01-01T00:00:00Z", "last_active": "2024-01-01T00:00:00Z", "messages": [{"role": "' || CASE WHEN event_id % 7 = 0 THEN 'system' ELSE 'user' END || '", "content": "x"}], "turn_count": ' || event_id || '}'"""
_OPS = f"""SELECT 'u' || user_id AS key, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'delete' WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'save' ELSE 'load' END AS op,
    CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN event_id % 11 = 0 THEN left({_PAYLOAD}, 40) ELSE {_PAYLOAD} END END AS payload FROM events"""


@query(f"""
    WITH ops AS ({_OPS}),
    h AS (SELECT *, last_value(CASE WHEN op <> 'load' THEN {{'op': op, 'ts': ts, 'payload': payload}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ops),
    f AS (SELECT key, seq, CASE WHEN held.op = 'save' AND ts < held.ts + INTERVAL 12 HOUR THEN held.payload END AS p FROM h WHERE op = 'load'),
    g AS (SELECT *, json_valid(p) AND NOT list_contains(json_extract_string(CASE WHEN json_valid(p) THEN p ELSE '{{}}' END, '$.messages[*].role'), 'system') AS good FROM f)
    SELECT key, seq, CASE WHEN good THEN p END AS loaded, coalesce(p IS NOT NULL AND NOT good, false) AS broken FROM g""")
def session_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's views and errors as loads of what their clicks and purchases saved, for twelve hours each; some payloads are broken."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    ops = spark.sql(_OPS).withColumn("ts", F.col("ts").cast("timestamp"))
    return session_store.replay(ops, 12 * 3600).drop("ts")


@query(r"""
    WITH d AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(regexp_replace(substr(text, 1, 40), '\s+', ' ', 'g')) AS s, length(substr(text, 1, 40)) AS n, trim(regexp_replace(reverse(substr(text, 1, 40)), '\s+', ' ', 'g')) AS r FROM documents),
    p AS (SELECT doc_id, source, lang, unnest(CASE WHEN doc_id % 13 = 0 OR doc_id % 5 = 2 OR n < 10 THEN [0] ELSE [1, 2] END) AS i, t, s, r, n FROM d),
    q AS (SELECT doc_id, source, CASE i WHEN 1 THEN 'is_remake_of' WHEN 2 THEN 'based_on' END AS kind, i, CASE i WHEN 1 THEN 'T' || doc_id % 50 WHEN 2 THEN 'T' || doc_id % 20 END AS src, CASE WHEN i > 0 THEN 'T' || doc_id % 7 END AS dst, lang,
        CASE WHEN i = 0 AND doc_id % 5 = 2 THEN 'malformed' WHEN i = 0 AND doc_id % 13 = 0 THEN 'empty' WHEN i = 0 THEN 'malformed' WHEN i = 1 AND (s = '' OR NOT contains(t, s)) OR i = 2 AND (r = '' OR NOT contains(t, r)) THEN 'unsupported' END AS gone FROM p),
    k AS (SELECT *, EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 10 = 3 AND kind = 'is_remake_of' AND 'T' || e.doc_id % 50 = src AND 'T' || e.doc_id % 7 = dst AND e.source = q.source) AS had,
        row_number() OVER (PARTITION BY gone IS NULL, kind, src, dst, source ORDER BY doc_id, i) AS nth FROM q),
    b AS (SELECT *, CASE WHEN substr(src, 2)::INT % 5 <> 0 AND lang = CASE WHEN substr(src, 2)::INT % 2 = 0 THEN 'en' ELSE 'de' END THEN substr(src, 2)::INT END AS sv, CASE WHEN substr(dst, 2)::INT % 5 <> 0 THEN substr(dst, 2)::INT END AS dv FROM k)
    SELECT doc_id, i AS nth_proposal, CASE WHEN gone IS NOT NULL THEN gone WHEN had THEN 'repeat_in_table' WHEN nth > 1 THEN 'repeat_in_batch' WHEN sv IS NOT NULL AND dv IS NOT NULL AND sv <> dv THEN 'inserted' ELSE 'unbound' END AS exit,
        CASE WHEN gone IS NULL THEN sv END AS src_version_id, CASE WHEN gone IS NULL AND dv IS DISTINCT FROM sv THEN dv END AS dst_version_id FROM b""")
def candidate_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that propose two edges a document, one with the document's beginning as evidence and one with that reversed: fenced,
    followed by more, cut off, or without proposals. Each proposal leaves by one exit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    start, number = F.substring("text", 1, 40), lambda n: F.concat(F.lit("T"), F.col("doc_id") % n)
    edge = lambda kind, src, sentence: F.struct(F.lit(kind).alias("edge_type"), src.alias("src_title"), F.col("lang").alias("src_language"), number(7).alias("dst_title"), sentence.alias("supporting_sentence"), F.lit(0.5).alias("confidence"))
    both = F.array(edge("is_remake_of", number(50), start), edge("based_on", number(20), F.reverse(start)))
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 13 == 0, F.slice(both, 1, 0)).otherwise(both).alias("relationships")))
    form = F.col("doc_id") % 5
    raw = F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(form == 1, F.concat(body, F.lit(' That is all: {"x": 1}'))).when(form == 2, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    page_key = F.format_string("%012d", "doc_id")
    answers = docs.select(page_key.alias("page_key"), raw.alias("raw"))
    pages = docs.select(page_key.alias("page_key"), F.col("source").alias("title"), "text", F.col("n_chars").alias("revision"))
    known = docs.where("doc_id % 10 = 3").select(F.lit("is_remake_of").alias("edge_type"), number(50).alias("src_title"), number(7).alias("dst_title"), F.col("source").alias("source_page"))
    names = spark.range(50).where("id % 5 <> 0").select(F.concat(F.lit("T"), "id").alias("title"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("language"), F.col("id").cast("int").alias("version_id"))
    rows = extraction.exits(answers, pages, known, names)
    return rows.select(F.col("page_key").cast("long").alias("doc_id"), F.coalesce(F.col("place") + 1, F.lit(0)).alias("nth_proposal"), "exit", "src_version_id", "dst_version_id")


_SEED = """
    WITH w AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS t, 1950 + p_size AS y, CASE WHEN p_partkey % 3 <> 0 THEN 'W' || p_partkey END AS q FROM part),
    v AS (SELECT k, t, y, l, i, y + i AS year, CASE WHEN (k + i) % 4 <> 0 THEN 'V' || k || l END AS vq FROM w CROSS JOIN (VALUES ('hi', 0), ('ta', 1), ('en', 2)) AS x(l, i))"""


@query(f"""{_SEED},
    works AS (SELECT k, coalesce(q, max(CASE WHEN i = 0 THEN vq END)) AS q, t, y, CASE WHEN k % 10 = 0 THEN 'old' || k ELSE substr(sha256('work|' || t || '|' || y), 1, 32) END AS id FROM w JOIN v USING (k, t, y) GROUP BY k, q, t, y),
    vers AS (SELECT v.*, works.id AS work, CASE WHEN k % 10 = 0 AND i = 0 THEN 'oldv' || k ELSE substr(sha256('version|' || works.id || '|' || l || '|' || year), 1, 32) END AS id FROM v JOIN works USING (k)),
    s AS (SELECT vq AS qid, k, i, l FROM vers WHERE vq IS NOT NULL),
    stated AS (
        SELECT qid, 'P144' AS p, 'V' || k || 'hi' AS target FROM s WHERE i > 0 UNION ALL SELECT qid, 'P144', 'W' || (k - 1) FROM s WHERE i > 0 AND k % 6 = 0 UNION ALL SELECT qid, 'P144', 'X' || k FROM s WHERE i > 0 AND k % 7 = 0
        UNION ALL SELECT qid, 'P4969', 'V' || k || 'ta' FROM s WHERE i = 0 UNION ALL SELECT qid, 'P155', 'V' || (k - 1) || 'hi' FROM s WHERE i = 0 UNION ALL SELECT qid, 'P156', 'V' || (k + 1) || 'hi' FROM s WHERE i = 0
        UNION ALL SELECT 'W' || k, 'P4969', 'V' || (k + 1) || 'hi' FROM w WHERE k % 8 = 0),
    j AS (SELECT qid, p, target, a.id AS av, a.work AS aw, b.id AS bv, b.work AS bw, c.id AS cw, d.id AS dw FROM stated LEFT JOIN vers a ON a.vq = qid LEFT JOIN vers b ON b.vq = target LEFT JOIN works c ON c.q = qid LEFT JOIN works d ON d.q = target),
    e AS (
        SELECT qid || '#' || p AS ref, CASE WHEN p IN ('P144', 'P4969') AND av IS NOT NULL AND bv IS NOT NULL THEN 'is_remake_of' WHEN p = 'P144' AND av IS NOT NULL AND dw IS NOT NULL OR p = 'P4969' AND cw IS NOT NULL AND bv IS NOT NULL THEN 'based_on' WHEN p IN ('P155', 'P156') AND av IS NOT NULL AND bv IS NOT NULL THEN 'is_sequel_of' END AS kind,
            CASE WHEN p = 'P144' AND bv IS NOT NULL THEN av WHEN p = 'P144' THEN aw WHEN p = 'P4969' AND av IS NOT NULL THEN bv WHEN p = 'P4969' THEN bw WHEN p = 'P155' THEN aw ELSE bw END AS src,
            CASE WHEN p = 'P144' AND bv IS NOT NULL THEN bv WHEN p = 'P144' THEN dw WHEN p = 'P4969' AND av IS NOT NULL THEN av WHEN p = 'P4969' THEN cw WHEN p = 'P155' THEN bw ELSE aw END AS dst FROM j)
    SELECT 'works' AS table_name, id AS key, CASE WHEN k % 10 <> 0 THEN 'new' WHEN k % 20 = 0 AND q IS NULL THEN 'unchanged' ELSE 'changed' END AS outcome, coalesce(q, '') || '/' || CASE WHEN k % 20 = 0 THEN 'xx' ELSE 'hi' END || '/' || CASE WHEN q IS NULL THEN 1 ELSE 2 END AS detail FROM works
    UNION ALL SELECT 'versions', id, CASE WHEN k % 10 = 0 AND i = 0 THEN CASE WHEN k % 20 = 0 AND vq IS NULL THEN 'unchanged' ELSE 'changed' END ELSE 'new' END, CASE WHEN k % 20 = 0 AND i = 0 THEN 'old title' ELSE t END || '/' || CASE WHEN vq IS NULL THEN '' ELSE 'm' || k || l END || '/' || CASE WHEN vq IS NULL OR k % 20 = 0 AND i = 0 THEN 'MEDIUM' ELSE 'HIGH' END || '/' || CASE WHEN vq IS NULL THEN 1 ELSE 2 END FROM vers
    UNION ALL SELECT 'edges', kind || '|' || src || '|' || dst, 'new', min(ref) FROM e WHERE kind IS NOT NULL AND src <> dst GROUP BY ALL
    UNION ALL SELECT 'conflicts', id || '|release_year', CASE WHEN k % 30 = 0 AND i = 0 THEN 'kept' ELSE 'new' END, 'open' FROM vers WHERE vq IS NOT NULL AND k % 5 = 0 OR k % 30 = 0 AND i = 0
    UNION ALL SELECT DISTINCT 'unmatched', target, 'new', '' FROM j WHERE p IN ('P144', 'P4969') AND bv IS NULL AND dw IS NULL""")
def graph_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works in three languages, a tenth of them known already, with what an entity base states of them, taken in by one
    pass: what becomes of every row of the four tables."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    sql = lambda rest: spark.sql(f"{_SEED} {rest}")
    seed_works = sql("SELECT k AS work_key, 'film' AS work_type, t AS primary_title, 'hi' AS original_language, y AS first_release_year, q AS wikidata_qid FROM w")
    seed_versions = sql("SELECT k AS work_key, l AS version_key, t AS title, l AS language, year AS release_year, 'IN' AS country, i = 0 AS is_original, vq AS wikidata_qid FROM v")
    entities = sql("""SELECT vq AS qid, array(CASE WHEN k % 5 = 0 THEN year + 1 ELSE year END) AS publication_years, 'm' || k || l AS tmdb_id, CAST(NULL AS STRING) AS imdb_id,
            array_compact(array(CASE WHEN i > 0 THEN 'V' || k || 'hi' END, CASE WHEN i > 0 AND k % 6 = 0 THEN 'W' || (k - 1) END, CASE WHEN i > 0 AND k % 7 = 0 THEN 'X' || k END)) AS based_on, array_compact(array(CASE WHEN i = 0 THEN 'V' || k || 'ta' END)) AS derivative_works,
            array_compact(array(CASE WHEN i = 0 THEN 'V' || (k - 1) || 'hi' END)) AS follows, array_compact(array(CASE WHEN i = 0 THEN 'V' || (k + 1) || 'hi' END)) AS followed_by FROM v WHERE vq IS NOT NULL
        UNION ALL SELECT 'W' || k, CAST(array() AS ARRAY<INT>), NULL, NULL, CAST(array() AS ARRAY<STRING>), array('V' || (k + 1) || 'hi'), CAST(array() AS ARRAY<STRING>), CAST(array() AS ARRAY<STRING>) FROM w WHERE k % 8 = 0""")
    ref = "array(named_struct('source', 'human', 'ref', 'seed'))"
    current = {
        "works": sql(f"SELECT 'old' || k AS work_id, 'film' AS work_type, t AS primary_title, 'xx' AS original_language, y AS first_release_year, q AS wikidata_qid, 'MEDIUM' AS confidence, k % 20 = 0 AS human_verified, {ref} AS sources FROM w WHERE k % 10 = 0"),
        "versions": sql(f"SELECT 'oldv' || k AS version_id, 'old' || k AS work_id, CAST(NULL AS STRING) AS wikidata_qid, CAST(NULL AS STRING) AS tmdb_id, CAST(NULL AS STRING) AS imdb_id, 'old title' AS title, l AS language, year AS release_year, 'IN' AS country, true AS is_original, 'MEDIUM' AS confidence, k % 20 = 0 AS human_verified, {ref} AS sources FROM v WHERE k % 10 = 0 AND i = 0"),
        "edges": spark.createDataFrame([], ingest.EDGES),
        "conflicts": sql("SELECT 'version' AS entity_kind, 'oldv' || k AS entity_id, 'release_year' AS field, '[]' AS `values`, 'open' AS status, CAST(NULL AS STRING) AS resolution FROM w WHERE k % 30 = 0"),
    }
    after = ingest.ingest(current, seed_works, seed_versions, entities)
    n = F.size("sources").cast("string")
    own = lambda name, key, detail: after[name].select(F.lit(name).alias("table_name"), key.alias("key"), "outcome", detail.alias("detail"))
    out = own("works", F.col("work_id"), F.concat_ws("/", F.coalesce("wikidata_qid", F.lit("")), "original_language", n))
    out = out.unionByName(own("versions", F.col("version_id"), F.concat_ws("/", "title", F.coalesce("tmdb_id", F.lit("")), "confidence", n)))
    out = out.unionByName(own("edges", F.concat_ws("|", "edge_type", "src_id", "dst_id"), F.col("sources")[0]["ref"]))
    out = out.unionByName(own("conflicts", F.concat_ws("|", "entity_id", "field"), F.col("status")))
    return out.unionByName(after["unmatched"].select(F.lit("unmatched").alias("table_name"), F.col("qid").alias("key"), F.lit("new").alias("outcome"), F.lit("").alias("detail")))


_HELD = f"""CASE WHEN {" OR ".join(f"regexp_matches(t, '{p}') OR regexp_matches(m, '{p}')" for p in text.FLAG_PATTERNS.values())} THEN '{jsontree.WITHHELD}' ELSE replace(t, ' ', '{jsontree.DATAMARK}') END"""


@query(f"""
    WITH p AS (SELECT conv_id, turn, {PLANTED} AS t FROM conversations), n AS (SELECT *, translate(translate(t, '{text.ZERO_WIDTH}', ''), '{text.LOOKALIKES[0]}', '{text.LOOKALIKES[1]}') AS m FROM p),
    r AS (SELECT conv_id, turn, {_HELD} AS title FROM n)
    SELECT conv_id, turn, title, title AS nested, 'plainˆwordsˆ' || turn AS listed, turn AS number, CASE WHEN title = '{jsontree.WITHHELD}' THEN 2 ELSE 0 END AS warnings FROM r""")
def spotlight_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that hold a turn at two depths, as they may stand before a model."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    rows = spark.sql(f"SELECT conv_id, turn, {PLANTED} AS t FROM conversations")
    payload = F.to_json(F.struct(F.col("t").alias("title"), F.array(F.struct(F.struct(F.col("t").alias("overview")).alias("deep"), F.array(F.concat(F.lit("plain words "), "turn")).alias("list"))).alias("items"), F.col("turn").alias("n")))
    rows = rows.select("conv_id", "turn", jsontree.spotlight(payload).alias("s"))
    at = lambda path: F.get_json_object("s.content", path)
    return rows.select("conv_id", "turn", at("$.title").alias("title"), at("$.items[0].deep.overview").alias("nested"), at("$.items[0].list[0]").alias("listed"), at("$.n").cast("long").alias("number"), F.size("s.warnings").alias("warnings"))


@query("""
    SELECT conv_id, turn, text || ' added' AS title, text AS other, 2 AS changed, true AS same_shape, 'w' || conv_id || ',v' || turn AS ids FROM conversations""")
def spliced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text put behind the titles of results, at two depths, and the ids in them; a text that looks like a key of ids has none."""
    rows = table(spark, sf_dir, "conversations")
    trap = F.concat(F.lit('"work_id": "trap" '), "text")
    payload = F.to_json(F.struct(F.struct(F.col("text").alias("title"), F.col("text").alias("other")).alias("a"), F.array(F.struct(F.concat(F.lit("w"), "conv_id").alias("work_id"), trap.alias("note")), F.struct(F.concat(F.lit("w"), "conv_id").alias("work_id"), trap.alias("note"))).alias("b"), F.struct(F.concat(F.lit("v"), "turn").alias("version_id"), F.col("text").alias("title")).alias("c")))
    rows = rows.select("conv_id", "turn", jsontree.splice(payload, F.lit("added"), F.lit("title")).alias("s"), jsontree.collect(payload, "work_id", "version_id").alias("ids"))
    return rows.select("conv_id", "turn", F.get_json_object("s.content", "$.a.title").alias("title"), F.get_json_object("s.content", "$.a.other").alias("other"), "s.changed", "s.same_shape", F.array_join("ids", ",").alias("ids"))


@query()
def typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as calls with titles, free text, filters and ids of earlier results, against four expected ones a user; tests
    compare with a loop."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    e = F.col("event_id")
    title = F.concat(F.element_at(F.array(*map(F.lit, ("Papanasam", "PAAPANAASAM", "Drishyam"))), (e % 3 + 1).cast("int")))
    arguments = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(title.alias("title"), e.alias("extra"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.concat(F.lit("w"), e - e % 500).alias("work_id"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.struct(F.when(e % 2 == 0, "Hindi").otherwise("tamil").alias("language"), (e % 4).alias("year")).alias("by"))))
        .otherwise(F.to_json(F.struct(F.when(e % 2 == 0, "a man hides a crime from the police").otherwise("two friends travel").alias("description"))))
    )
    result = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("w"), e - e % 500).alias("work_id"))).alias("results")))
    emitted = events.select("user_id", "ts", "event_id", F.col("event_type").alias("tool"), arguments.alias("arguments"), (e % 17 != 0).alias("valid"), F.when(e % 5 != 0, result).alias("result"))
    wanted = [("view", '{"title": "Paapanaasam"}'), ("error", '{"description": "hides a crime"}'), ("click", '{"work_id": "$work_id"}'), ("purchase", '{"by": {"language": "TAMIL", "year": 3}}')]
    lists = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(a).alias("arguments")) for t, a in wanted))
    expected = events.select("user_id").distinct().select("user_id", F.posexplode(lists).alias("place", "_w")).select("user_id", "place", "_w.*")
    return calls.score_calls(expected, emitted, "user_id", ["ts", "event_id"])


_CALLS = """
    SELECT event_id AS call_id, CASE event_id % 5 WHEN 4 THEN 'fly' ELSE 'get_versions' END AS tool,
        CASE event_id % 7 WHEN 0 THEN '{"work_id": "w1", "scope": "indian"}' WHEN 1 THEN '{"work_id": 5, "scope": "everywhere"}' WHEN 2 THEN '{"scope": "all", "depth": 2.5}' WHEN 3 THEN '["w1"]' WHEN 4 THEN '{"work_id": "w1", "limit": ' || user_id || ', "share": 1}' WHEN 5 THEN '{"work_id": null, "deep": {"a": 1}}' ELSE '{"work_id": "w1"' END AS arguments FROM events"""


@query(f"""
    WITH c AS ({_CALLS}), s(parameter, kind, required, choices) AS (VALUES ('work_id', 'string', true, NULL), ('scope', 'string', false, ['indian', 'all']), ('limit', 'integer', false, NULL), ('share', 'number', false, NULL)),
    k AS (SELECT *, CASE WHEN json_valid(arguments) THEN json_type(arguments) END AS j FROM c WHERE tool <> 'fly'),
    a AS (SELECT call_id, e.key AS parameter, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' END AS kind, e.atom::VARCHAR AS atom FROM (SELECT * FROM k WHERE j = 'OBJECT') k, json_each(k.arguments) e),
    w AS (SELECT call_id, parameter, CASE WHEN s.required IS NULL THEN 'unexpected' WHEN NOT (a.kind = s.kind OR a.kind = 'integer' AND s.kind = 'number') THEN 'wrong_kind' WHEN choices IS NOT NULL AND NOT list_contains(choices, trim(atom, '"')) THEN 'not_a_choice' END AS issue FROM a LEFT JOIN s USING (parameter))
    SELECT call_id, 'unknown_tool' AS issue, NULL AS parameter FROM c WHERE tool = 'fly' UNION ALL SELECT call_id, 'not_an_object', NULL FROM k WHERE j IS DISTINCT FROM 'OBJECT'
    UNION ALL SELECT call_id, issue, parameter FROM w WHERE issue IS NOT NULL UNION ALL SELECT call_id, 'missing', 'work_id' FROM k WHERE j = 'OBJECT' AND call_id NOT IN (SELECT call_id FROM a WHERE parameter = 'work_id')""")
def argument_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls held against kinds and choices of their parameters."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows = [("get_versions", "work_id", "string", True, None), ("get_versions", "scope", "string", False, ["indian", "all"]), ("get_versions", "limit", "integer", False, None), ("get_versions", "share", "number", False, None)]
    return guards.argument_issues(spark.sql(_CALLS), spark.createDataFrame(rows, "tool string, parameter string, kind string, required boolean, choices array<string>"))


@query("""
    WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part)
    SELECT k AS answer_id, CASE k % 4 WHEN 0 THEN 'See **' || n || '** [unverified — not in tool results] now.' WHEN 1 THEN upper(n) || ' (2013) [unverified — not in tool results] is it' WHEN 2 THEN 'Unverified: ' || n || ' [unverified — not in tool results]' || chr(10) || 'nothing of that' ELSE 'Known: ' || n END AS gated FROM p""")
def gated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that name a part's title emphasised, with a year, or not at all; every fourth is grounded."""
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    answers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("answer_id"), F.when(k == 0, F.concat(F.lit("See **"), n, F.lit("** now."))).when(k == 1, F.concat(F.upper(n), F.lit(" (2013) is it"))).when(k == 2, "nothing of that").otherwise(F.concat(F.lit("Known: "), n)).alias("answer"))
    ungrounded = table(spark, sf_dir, "part").where("p_partkey % 4 < 3").select(F.col("p_partkey").alias("answer_id"), n.alias("title"))
    return guards.flag_titles(answers, ungrounded, "answer_id", "answer").select("answer_id", "gated")


@query("""
    SELECT user_id AS fixture, count(*) FILTER (event_type = 'click' AND event_id % 3 = 0) > 0 AS canary_surfaced, count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 0) > 0 AS forbidden_call,
        count(*) FILTER (event_type = 'click' AND event_id % 3 = 0) > 0 OR count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 0) > 0 AS succeeded FROM events GROUP BY user_id""")
def attack_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as attacks: whether the longest answer gives the canary away, or a forbidden call was made."""
    events = table(spark, sf_dir, "events")
    fixtures = events.select(F.col("user_id").alias("fixture")).distinct().withColumns({"canary": F.concat(F.lit("C-"), "fixture", F.lit("-X")), "forbidden_tool": F.lit("purchase"), "forbidden_part": F.lit('"even": true')})
    leaks = F.count_if((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0)) > 0
    answers = events.groupBy(F.col("user_id").alias("fixture")).agg(F.when(leaks, F.concat(F.lit("it says c-"), F.first("user_id"), F.lit("-x: C-"), F.first("user_id"), F.lit("-X"))).otherwise(F.concat(F.lit("it says C-"), F.first("user_id"))).alias("answer"))
    made = events.select(F.col("user_id").alias("fixture"), F.col("event_type").alias("tool"), F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("even"))).alias("arguments")).withColumn("arguments", F.regexp_replace("arguments", ":", ": "))
    allowed = fixtures.select("fixture", F.lit("A Title").alias("title"))
    return guards.attack_verdicts(fixtures, answers, made, allowed).select("fixture", "canary_surfaced", "forbidden_call", "succeeded")


_ENRICHED = """
    WITH v AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS y, p_size AS z, 1950 + p_size AS year, CASE WHEN p_partkey % 2 = 0 THEN 'ml' ELSE 'ta' END AS language, p_partkey % 4 IN (0, 3) AS has FROM part)"""


@query(f"""{_ENRICHED},
    c AS (SELECT k, z AS person, 'lead' AS role FROM v WHERE has UNION SELECT k, 100 + z % 7, 'director' FROM v WHERE has), q AS (SELECT DISTINCT person FROM c),
    t AS (SELECT k, n AS title, 'canonical' AS kind, CASE WHEN k % 16 = 0 THEN 'hi' ELSE 'ml' END AS language FROM v WHERE has UNION ALL SELECT k, b, 'aka', NULL FROM v WHERE has UNION ALL SELECT CASE WHEN k % 4 = 0 THEN k + 1 ELSE k END, y, CASE WHEN k % 4 = 0 THEN 'dub' ELSE 'canonical' END, 'ta' FROM v WHERE has AND (k % 4 = 3 OR k + 1 <= (SELECT max(k) FROM v)))
    SELECT 'versions' AS table_name, k::VARCHAR AS key, CASE WHEN has AND k % 5 > 0 THEN 'filled' ELSE 'unchanged' END AS outcome, CASE WHEN k % 5 = 0 THEN 'tt' || k WHEN has THEN 'tm' || k ELSE '' END AS detail FROM v
    UNION ALL SELECT 'titles', k || '/' || title || '/' || kind, CASE WHEN k % 8 = 0 AND kind = 'canonical' THEN 'merged' ELSE 'new' END, coalesce(language, '') || '/' || CASE WHEN k % 8 = 0 AND kind = 'canonical' THEN 2 ELSE 1 END FROM t
    UNION ALL SELECT 'people', person::VARCHAR, 'new', 'p' || person FROM q WHERE person > 10
    UNION ALL SELECT 'cast', k || '/' || person || '/' || role, 'new', '' FROM c WHERE NOT (k % 12 = 0 AND role = 'lead' AND person <= 10)
    UNION ALL SELECT 'conflicts', k || '/release_year', 'open', year || '/' FROM v WHERE has AND k % 3 = 0 AND k % 24 > 0
    UNION ALL SELECT 'conflicts', k || '/original_language', 'resolved', 'hi/primary:tmdb' FROM v WHERE k % 16 = 0
    UNION ALL SELECT 'missing', k::VARCHAR, '', '' FROM v WHERE k % 4 = 2""")
def graph_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as versions, half of them with a movie that brings an id, titles, people and now and then another year or language."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    sql = lambda rest: spark.sql(f"{_ENRICHED} {rest}")
    versions = sql("SELECT k AS version_id, k DIV 2 AS work_id, CASE WHEN k % 4 <> 1 THEN k END AS tmdb_id, CASE WHEN k % 5 = 0 THEN 'tt' || k END AS imdb_id, language, year AS release_year, k % 2 = 0 AS is_original FROM v")
    movies = sql("""SELECT k AS tmdb_id, 'tm' || k AS imdb_id, CASE WHEN k % 16 = 0 THEN 'hi' ELSE 'ml' END AS original_language, CASE WHEN k % 3 = 0 THEN year + 1 ELSE year END AS release_year,
        array(named_struct('title', n, 'language', CASE WHEN k % 16 = 0 THEN 'hi' ELSE 'ml' END, 'kind', 'canonical'), named_struct('title', b, 'language', CAST(NULL AS STRING), 'kind', 'aka'), named_struct('title', y, 'language', 'ta', 'kind', 'translation')) AS titles,
        array(named_struct('person_id', z, 'name', 'p' || z, 'role_kind', 'lead', 'billing_order', 0), named_struct('person_id', 100 + z % 7, 'name', 'p' || (100 + z % 7), 'role_kind', 'director', 'billing_order', CAST(NULL AS INT))) AS credits FROM v WHERE has""")
    titles = sql("SELECT k AS version_id, n AS title, 'canonical' AS kind, CASE WHEN k % 16 = 0 THEN 'hi' ELSE 'ml' END AS language, 'human' AS source, 'seed' AS ref, 0 AS pos FROM v WHERE k % 8 = 0")
    people = spark.range(1, 11).select(F.concat(F.lit("own"), "id").alias("person_id"), F.concat(F.lit("p"), "id").alias("name"), F.col("id").cast("int").alias("tmdb_person"))
    cast = sql("SELECT k AS version_id, 'own' || z AS person_id, 'lead' AS role_kind, 0 AS billing_order FROM v WHERE k % 12 = 0 AND z <= 10")
    after = enrich.enrich(versions, movies, titles, people, cast, sql("SELECT k AS entity, 'release_year' AS field, 'resolved' AS status FROM v WHERE k % 24 = 0"))
    numbers = people.select("person_id", "tmdb_person").unionByName(after["people"].select("person_id", "tmdb_person"))
    own = lambda name, rows, key, outcome, detail: rows.select(F.lit(name).alias("table_name"), key.cast("string").alias("key"), outcome.alias("outcome"), detail.alias("detail"))
    none = F.lit("")
    parts = [
        own("versions", after["versions"], F.col("version_id"), F.col("outcome"), F.coalesce("imdb_id", none)),
        own("titles", after["titles"], F.concat_ws("/", "version_id", "title", "kind"), F.col("outcome"), F.concat(F.coalesce("language", none), F.lit("/"), F.size("sources"))),
        own("people", after["people"], F.col("tmdb_person"), F.lit("new"), F.col("name")),
        own("cast", after["cast"].join(numbers, "person_id"), F.concat_ws("/", "version_id", "tmdb_person", "role_kind"), F.lit("new"), none),
        own("conflicts", after["conflicts"], F.concat_ws("/", "entity", "field"), F.col("status"), F.concat("chosen", F.lit("/"), F.coalesce("rule", none))),
        own("missing", after["missing"], F.col("tmdb_id"), none, none),
    ]
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out
