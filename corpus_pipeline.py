"""From raw documents to packed token sequences: five stages, each one operator of corpusloom.llm over all that the stage
before it kept, with Parquet between them.

No stage fails over nulls in any column, empty or very long texts, ties, repeated rows, an empty table, or further columns,
whatever their names; what becomes of each is said at the stage, or at the operator that it calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, packing, quality, secrets, simhash
from corpusloom.llm.common import free_name, materialize, read_table, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go. The list is learned from the labelled documents in `docs`;
    without labels, the base rules alone judge. A null or empty text has no words and goes; repeated rows stay or go together."""
    return quality.keep_clean(docs, quality.learn_rules(docs, read_table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that 5 documents have stay in the last of them only. A null text becomes an empty one;
    a document without an id keeps its lines."""
    lines = line_dedup.dedup_lines(docs)
    return lines.withColumns({"text": F.col("_kept_text"), "n_chars": F.length("_kept_text").cast("long")}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on 5-word shingles, the one with the smallest id stays. Documents
    without an id stay, and link no others."""
    groups = simhash.near_duplicate_groups(docs, **simhash.NEAR_COPIES)
    name = free_name(docs, "_gone")
    gone = materialize(groups.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays, a null text as it is. Rows with one id are told apart by text."""
    masked = secrets.redact(docs, secrets.scan(docs, secrets.train(spark)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens; a null or empty text is one end token. Null and repeated ids
    have their pieces placed like any others."""
    pieces = packing.cut_pieces(docs)
    return packing.pack(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [("quality_rules", quality_rules), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("secrets_masked", secrets_masked), ("packed", packed)]

#: SQL can express neither the learned rules nor the fingerprints, the forest or the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
