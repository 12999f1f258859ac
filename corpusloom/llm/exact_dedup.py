"""Exact dedup by two passes over the documents with a Bloom filter between them.

Pass 1 sets bits for 64-bit hashes of the texts and keeps those that were set again (repeat_filter): no row and no hash is
sent for it. Pass 2 goes over the rows, which are ids, hashes and SHA-256 by then: those whose bit isn't among them are
unique and pass straight through; only the others are shuffled and grouped exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, text_of
from corpusloom.llm.repeat_filter import filter_bits, may_repeat, repeated_hashes


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, text_sha256, keep_id (largest id of the equal texts), group_size, kept.

    A null text counts as empty; empty texts are equal to each other. Of rows that share the keeping id, all are marked
    kept. Null ids are smaller than any other. Other columns are ignored, whatever their names. An empty table gives none.
    """
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    hashed = texts.select("_id", F.xxhash64("_text").alias("h"), F.unhex(F.sha2("_text", 256)).alias("sha"))
    # sorted within files: no row moves, and a slice of the filter reads the part of each file that it is about
    hashed = materialize(hashed.sortWithinPartitions("h"))
    rows = hashed.count()
    found = materialize(repeated_hashes(hashed, "h", rows))
    marked = materialize(may_repeat(hashed, "h", found, filter_bits(rows)).drop("h"))
    maybe = marked.where("maybe").select("_id", "sha")
    # partial aggregation reduces a text that a third of the rows hold before anything moves; groups
    # are read from a table, so both sides of the join are plain shuffles and a hot text's rows may be split
    groups = materialize(maybe.groupBy("sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")))
    joined = maybe.join(groups, "sha").select("_id", "sha", "keep_id", "group_size")
    alone = marked.where("NOT maybe").select("_id", "sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return joined.unionByName(alone).select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
