"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, exact_dedup, filter_audit, langid, line_dedup, merkle, packing, quality, secrets, sharding, simhash, substring_dedup, warc
from corpusloom.llm.common import materialize, read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode_documents(bpe.encode_documents(docs).select("doc_id", "ids"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(read_table(spark, sf_dir, "documents"))
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(pieces)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"), shingle_words=4, distance=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = line_dedup.dedup_lines(docs)
    return lines.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept_text", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.scan(docs, secrets.train(spark)).drop("text_hash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = read_table(spark, sf_dir, "pages"), warc.archive_path(spark)
    warc.write_warc(pages, path)
    captures = warc.assemble(materialize(warc.read_warc(spark, path).drop("payload")))
    page = F.col("metadata.fields")["page-id"].cast(pages.schema["page_id"].dataType)
    flat = captures.select("capture_id", page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.refers_to").alias("referred"), F.col("request.target_uri").alias("requested_uri"))
    flat = materialize(flat)  # small columns only; a revisit gets page and length from the response that it refers to
    referred = flat.where("record_type = 'response'").select(F.col("capture_id").alias("referred"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("full_bytes"))
    out = flat.join(referred, "referred", "left")
    return out.select("page_id", F.coalesce("own_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "requested_uri")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.learn(docs.where("NOT held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(read_table(spark, sf_dir, "documents"))
    return filter_audit.audit(masks, read_table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(merkle.document_leaves(read_table(spark, sf_dir, "documents")), carry="tampered")
    folded = merkle.fold_proofs(rows, "tampered")
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2("proof_hex", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_packing, op3_substring_dedup, op4_simhash, op5_line_dedup, op6_exact_dedup, op7_sharding, op8_quality, op9_secrets, op10_warc, op11_language_id, op12_filter_audit, op13_merkle)}

#: DuckDB SQL of those that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op5_line_dedup": """
        WITH lines AS (
            SELECT doc_id, p AS pos, s[p] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
        keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op12_filter_audit": """
        WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
        judged AS (
            SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
                   coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f FROM words),
        flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        masks AS (
            SELECT part, f, list_count(list_filter(f, lambda x: x)) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged LEFT JOIN flags USING (doc_id) GROUP BY ALL),
        one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        steps AS (SELECT o, list_aggregate(list_transform(o, lambda x: 'ABCDE'[x]), 'string_agg', '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
        r AS (SELECT part, filter_order, step, n, good, toxic, fails, f[o[step]] AS own, len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS gone FROM masks, steps)
        SELECT part, filter_order, step::INT AS step, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
               sum(CASE WHEN own THEN n * 120 // fails ELSE 0 END)::BIGINT AS shapley
        FROM r GROUP BY ALL""",
    "op13_merkle": """
        WITH RECURSIVE bytes AS (SELECT doc_id, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS b FROM (SELECT DISTINCT doc_id FROM documents)),
        crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS crc FROM bytes),
        d AS (SELECT documents.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed,
              coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
              FROM documents LEFT JOIN crc USING (doc_id)),
        leaves AS (
            SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
                   sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered FROM d),
        up AS (SELECT src, 0 AS lvl, pos, n, leaf AS h FROM leaves UNION ALL SELECT src, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY src, lvl, pos // 3, n),
        tops AS (SELECT src, lvl, h FROM up WHERE n = 1),
        over_ AS (SELECT 0 AS lvl, src - 1 AS pos, (SELECT count(*) FROM tops) AS n, h FROM tops UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY lvl, pos // 3, n),
        nodes AS (SELECT src, lvl, pos, n, h FROM up WHERE n > 1 UNION ALL SELECT tops.src, tops.lvl + over_.lvl, over_.pos, over_.n, over_.h FROM tops, over_ WHERE over_.n > 1),
        way AS (SELECT doc_id, src, 0 AS lvl, pos, n, 0 AS above FROM leaves UNION ALL
                SELECT way.doc_id, way.src, CASE WHEN way.n > 1 THEN way.lvl + 1 ELSE way.lvl END, CASE WHEN way.n > 1 THEN way.pos // 3 ELSE way.src - 1 END, CASE WHEN way.n > 1 THEN (way.n + 2) // 3 ELSE (SELECT count(*) FROM tops) END, CASE WHEN way.n > 1 THEN above ELSE 1 END
                FROM way WHERE way.n > 1 OR (above = 0 AND (SELECT count(*) FROM tops) > 1)),
        sides AS (
            SELECT way.doc_id, way.lvl, coalesce(string_agg(h, '' ORDER BY nodes.pos) FILTER (nodes.pos < way.pos), '') AS l, coalesce(string_agg(h, '' ORDER BY nodes.pos) FILTER (nodes.pos > way.pos), '') AS r
            FROM way JOIN nodes ON nodes.src = way.src AND nodes.lvl = way.lvl AND nodes.n = way.n AND nodes.pos // 3 = way.pos // 3 WHERE way.n > 1 GROUP BY way.doc_id, way.lvl, way.pos),
        proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof, max(lvl) AS last FROM sides GROUP BY doc_id),
        folds AS (SELECT doc_id, 0 AS lvl, tampered AS h FROM leaves UNION ALL SELECT folds.doc_id, folds.lvl + 1, sha256(l || h || r) FROM folds JOIN sides ON sides.doc_id = folds.doc_id AND sides.lvl = folds.lvl),
        folded AS (SELECT doc_id, arg_max(h, lvl) AS folded_root FROM folds GROUP BY doc_id),
        root AS (SELECT h AS root FROM over_ WHERE n = 1)
        SELECT doc_id, leaf, tops.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN tops USING (src) CROSS JOIN root LEFT JOIN proofs USING (doc_id) JOIN folded USING (doc_id)""",
}
