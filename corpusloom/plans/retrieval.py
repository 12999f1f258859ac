"""Search: every 50th row is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, versions
from corpusloom.plans.registry import query
from corpusloom.session import table, written

THETA = 0.9

_DENSE = """
    v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
    dp AS (SELECT q.vec_id AS query, d.vec_id AS item, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (q.norm * d.norm), 9) AS score FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM dp QUALIFY rank <= 50)"""
_SPARSE = r"""
    w AS (SELECT doc_id AS id, word, least(1.0, round(0.2 * count(*), 6))::DOUBLE AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
    sp AS (SELECT a.id AS query, b.id AS item, round(sum(a.w * b.w), 9) AS score FROM w a JOIN w b ON a.word = b.word AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM sp QUALIFY rank <= 50)"""
_FUSED = """
    fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (
        SELECT coalesce(d.query, s.query) AS query, coalesce(d.item, s.item) AS item, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score FROM dense d FULL JOIN sparse s ON d.query = s.query AND d.item = s.item))"""
_RERANKED = """
    scored AS (SELECT query, item, ('0x' || sha256(query::VARCHAR || chr(0) || item::VARCHAR)[1:8])::BIGINT::DOUBLE / 4294967296.0 AS score FROM fused WHERE rank <= 20),
    works AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rank FROM (SELECT query, label, max(score) AS score FROM scored JOIN embeddings ON vec_id = item GROUP BY ALL) QUALIFY rank <= 10)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_channel(vectors.where("id % 50 = 0"), vectors)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = written(retrieval.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return retrieval.sparse_channel(weights.where("id % 50 = 0"), weights)


@query(f"WITH {_DENSE} SELECT query, item, rank, round(score, 6) AS score FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query", "item", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_SPARSE} SELECT query, item, rank, round(score, 6) AS score FROM sparse")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("query", "item", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_DENSE}, {_SPARSE}, {_FUSED} SELECT query, item, rank, score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse([_dense(spark, sf_dir), _sparse(spark, sf_dir)])


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title channel: a query's title is the name of the part of its number, cards are those of two parts in three."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), (F.col("p_partkey") % 97).alias("work_id"), F.col("p_name").alias("title"), F.lit("en").alias("language"))
    asked = parts.where("version_id % 50 = 0").select(F.col("version_id").alias("id"), F.col("title").alias("text"))
    chunks = parts.where("version_id % 3 > 0").select(F.col("version_id").alias("chunk_id"), "version_id", F.lit("metadata_card").alias("kind"))
    hits = versions.card_hits(versions.resolve_titles(asked.select(F.col("text").alias("query")), parts), chunks)
    return hits.join(asked, F.col("query") == F.col("text")).select(F.col("id").alias("query"), "item", "score", "rank")


def _works(spark: SparkSession, sf_dir: str, with_titles: bool = False) -> DataFrame:
    channels = [_dense(spark, sf_dir), _sparse(spark, sf_dir), *([_titles(spark, sf_dir)] if with_titles else [])]
    fused = retrieval.fuse(channels).where("rank <= 20")
    scored = fused.select("query", "item", retrieval.pair_score(F.col("query"), F.col("item")).alias("score"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label")
    # items that the gate doesn't show are dropped by the inner join
    return retrieval.best_groups(scored.join(labels, "item"), "label", k=10, theta=THETA)


@query(f"WITH {_DENSE}, {_SPARSE}, {_FUSED}, {_RERANKED} SELECT query, label, rank, round(score, 6) AS score, max(score) OVER (PARTITION BY query) < {THETA} AS abstain FROM works")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse channel, rank fusion, cut to 20, rerank, best per work, top 10, abstain under the threshold."""
    return _works(spark, sf_dir).select("query", "label", "rank", F.round("score", 6).alias("score"), "abstain")


@query()
def three_channel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the title channel as the third: names resolved to versions, whose cards are fused in. A test fuses the three
    channels by hand."""
    return _works(spark, sf_dir, with_titles=True).select("query", "label", "rank", F.round("score", 6).alias("score"), "abstain")


@query(f"""
    WITH {_DENSE}, r AS (SELECT query, label AS grp, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, label) AS rank FROM dense JOIN embeddings ON vec_id = item GROUP BY query, label),
    f AS (SELECT e.vec_id AS query, e.label % 3 AS slice, (SELECT min(rank) FROM r WHERE r.query = e.vec_id AND grp = e.label AND rank <= 10) AS first FROM embeddings e WHERE vec_id % 50 = 0)
    SELECT coalesce(slice::VARCHAR, 'all') AS slice, count(*) AS n, round(avg(coalesce(first <= 1, false)::INT), 4) AS recall_1, round(avg(coalesce(first <= 5, false)::INT), 4) AS recall_5, round(avg(coalesce(first <= 10, false)::INT), 4) AS recall_10, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr_10
    FROM f GROUP BY GROUPING SETS ((slice), ())""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 5, 10 and MRR of the dense channel's works, per slice and overall; the query's own label is expected."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    dense = _dense(spark, sf_dir).join(vectors.select(F.col("vec_id").alias("item"), "label"), "item")
    ranked = retrieval.best_groups(dense, "label", k=10).withColumnRenamed("label", "group")
    expected = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"))
    rows = retrieval.first_rank(ranked, expected).join(expected, "query").withColumn("slice", F.col("expected") % 3)
    mean = lambda c: F.round(F.avg(c), 4)
    out = rows.groupingSets([["slice"], []], "slice").agg(F.count("*").alias("n"), mean("r1").alias("recall_1"), mean("r5").alias("recall_5"), mean("r10").alias("recall_10"), mean("rr").alias("mrr_10"))
    return out.withColumn("slice", F.coalesce(F.col("slice").cast("string"), F.lit("all")))
