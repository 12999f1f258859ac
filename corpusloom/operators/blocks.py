"""A stated set of queries against all rows, in blocks: the pairing that scoring without an index needs.

Queries and rows are gathered in blocks of bounded size, and each pair of blocks is one unit of work with array
operations inside; what comes out is the best of each query within the block, so no pair is ever a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import matching

BLOCK = 1024
#: Tasks over the blocks of one side, at most.
MAX_TASKS = 20_000


def in_blocks(rows: DataFrame, count: int, block: int, key: str, *columns: str) -> DataFrame:
    """(rows array<struct>): `count` rows dealt by hash of `key` over as many parts as blocks of that size need, each a task
    of its own as long as there are not too many."""
    parts = max(1, -(-count // block))
    grouped = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(key, *columns)).alias("rows"))
    return grouped.repartition(min(parts, MAX_TASKS), "part").select("rows")


def top_pairs(queries: DataFrame, rows: DataFrame, score: Callable[[pa.StructArray, pa.StructArray], np.ndarray], key: str, columns: list[str], k: int, floor: float | None = None, block: int = BLOCK, skip_self: bool = True) -> DataFrame:
    """(query, item, score, rank): the `k` best rows of each query by (score rounded to 9 digits, item), scores at or under
    `floor` left out. `score`: a matrix from a block of queries and a block of rows. Keys are integers. Both sides are
    counted and then read again, so give tables or what is cheap to compute."""
    left = in_blocks(queries, queries.count(), block // 4, key, *columns).select(F.col("rows").alias("q"))
    right = in_blocks(rows, rows.count(), block, key, *columns).select(F.col("rows").alias("r"))
    pairs = right.join(left, how="cross")  # blocks, not rows

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, q in zip(batch.column(0), batch.column(1), strict=True):
                r, q = r.values, q.values
                order = np.argsort(r.field(key).to_numpy())
                items, own_keys = r.field(key).to_numpy()[order], q.field(key).to_numpy()
                matrix = np.round(score(q, r), 9)[:, order]
                for own, x in zip(matrix, own_keys.tolist(), strict=True):
                    good = np.flatnonzero((own > floor if floor is not None else np.isfinite(own)) & ((items != x) if skip_self else True))
                    best = good[np.argsort(-own[good], kind="stable")[:k]]
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), x)), pa.array(items[best]), pa.array(own[best])], names=["query", "item", "score"])

    found = pairs.mapInArrow(work, "query long, item long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")))
    return ranked.where(F.col("rank") <= k)


def near_texts(queries: DataFrame, rows: DataFrame, key: str, text: str, threshold: float, block: int = 2 * BLOCK) -> DataFrame:
    """(`key`, `text`, score): every row's text with a fuzzy ratio of `threshold` or more to that of a query, and those with the
    best ratio to each query in each block, however low. `rows`: different texts. Where there are fewer blocks of rows than
    cores, each is a task for several shares of the queries."""
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shares = max(1, 2 * cores // max(1, -(-count // block)))
    right = in_blocks(rows, count, block, text).select(F.col("rows").alias("r"))
    if shares == 1:
        pairs = right.join(in_blocks(queries, queries.count(), BLOCK // 4, key, text).select(F.col("rows").alias("q")), how="cross")
    else:
        left = queries.groupBy(F.pmod(F.xxhash64(key, F.lit(2)), F.lit(shares)).alias("share"), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(max(1, queries.count() // BLOCK))).alias("part")).agg(F.collect_list(F.struct(key, text)).alias("q"))
        dealt = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(2 * cores, "share")
        pairs = dealt.join(left, "share").select("r", "q")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, q in zip(batch.column(0), batch.column(1), strict=True):
                names = r.values.field(text)
                texts = matching.Texts(names.to_pylist())
                for own, mine in zip(q.values.field(key).to_pylist(), q.values.field(text).to_pylist(), strict=True):
                    score = texts.ratios(mine)
                    at = np.flatnonzero(score >= min(threshold, score.max(initial=0)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own)), names.take(pa.array(at)), pa.array(score[at])], names=[key, text, "score"])

    return pairs.mapInArrow(work, f"{key} long, {text} string, score double")
