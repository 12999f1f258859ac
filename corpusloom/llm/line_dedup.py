"""Line dedup with DataFrame functions only, deciding on hashes and returning bitmaps instead of text.

Lines become 128-bit hashes of their keys. They are range-partitioned by hash and document and sorted within by hash, then
document and position, so that a line which a third of the documents hold is dealt over as many ranges as its rows fill.
Each range is streamed and its rows numbered in that order: of each hash, the first row and the number of documents come
out, once per range, and of the ranges that share a hash the first one's row is the first of all. Lines to drop come back as sparse bitmaps: 64 line numbers a word, only words
with a dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, free_name, hash128, lower_ascii, materialize, text_of

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _lines(text_col: str) -> Column:
    return F.split(text_of(text_col), "\n")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, dropped map<long, long>) for each document that loses lines: bit b of word w stands for line 64 w + b.

    A line goes if its key has at least `min_chars` code points, is found in at least `min_docs` documents and another
    document with it has a larger id. Rows of one id count as one document. A row with a null id keeps its lines.
    """
    text = F.posexplode(_lines(text_col)).alias("pos", "line")
    lines = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars)).select(F.col(id_col).alias("_id"), text)
    keyed = lines.where(F.length("line") >= min_chars).select("_id", "pos", line_key(F.col("line")).alias("key"))
    h = hash128(F.col("key"))
    found = materialize(keyed.where(F.length("key") >= min_chars).select("_id", "pos", h[0].alias("h1"), h[1].alias("h2")))
    keepers = materialize(first_occurrences(found).where(F.col("docs") >= min_docs).drop("docs"))
    gone = found.join(keepers, ["h1", "h2"]).where(F.col("_id") != F.col("keeper"))
    words = gone.groupBy("_id", F.floor(F.col("pos") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))).alias("bits"))
    return words.groupBy("_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped")).withColumnRenamed("_id", id_col)


def first_occurrences(lines: DataFrame) -> DataFrame:
    """(h1, h2, keeper, docs): of each hash in `lines` (h1, h2, _id, pos), the document of its first row by document
    descending, then position, and how many documents have it.

    The ranges are by hash and document, so all lines of one document with one hash are in one range, next to each other:
    reducing them to one row moves nothing. Rows are numbered as they stream by, ranges one after another."""
    ranged = lines.repartitionByRange("h1", "h2", F.col("_id").desc()).sortWithinPartitions("h1", "h2", F.col("_id").desc(), "pos")
    per_document = ranged.withColumn("at", F.monotonically_increasing_id()).groupBy("h1", "h2", "_id").agg(F.min("at").alias("at"))
    return per_document.groupBy("h1", "h2").agg(F.min_by("_id", "at").alias("keeper"), F.count("*").alias("docs"))


def drop_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with _n_lines, _n_dropped and _kept_text: its lines without those that the bitmaps drop, joined by \\n."""
    drop_id, bits = free_name(docs, "_drop_id"), free_name(docs, "_dropped")
    bitmaps = dropped.select(F.col(id_col).alias(drop_id), F.col("dropped").alias(bits))
    lines = _lines(text_col)
    word = lambda i: F.coalesce(F.element_at(bits, F.floor(i / 64).cast("long")), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda x, i: word(i).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) == 0)
    joined = docs.join(bitmaps, F.col(id_col) == F.col(drop_id), "left")
    out = joined.withColumns({"_n_lines": F.size(lines).cast("long"), "_kept_text": F.when(F.col(bits).isNull(), text_of(text_col)).otherwise(F.array_join(kept, "\n")), "_n_dropped": F.aggregate(F.coalesce(F.map_values(bits), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))})
    return out.drop(drop_id, bits)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with _n_lines, _n_dropped and _kept_text added.

    A null or empty text is one empty line. Lines of a document that repeat within it stay or go together. Nulls and
    clashing names in other columns don't matter, but columns with one of the three names
    are replaced; an empty table gives an empty one.
    """
    return drop_lines(docs, dropped_lines(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
