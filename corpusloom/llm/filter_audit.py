"""Which filters do the same work: what each of five filters removes at each place of each of the 120 orders.

Exact duplicates, the one filter that looks at other rows, are found by sorting: rows are dealt over ranges of (text
fingerprint, id) and sorted by fingerprint, whole text and id, so equal texts are neighbours and a row is compared with its
predecessor. Where a range begins inside a fingerprint's rows, its first rows are settled by what the ranges before it said
of that text. A document is then a mask of the filters that it fails, and everything asked for is a sum over masks: counters
of (part, mask) add up, whatever task they come from.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CLASS, materialize, text_of

FILTERS = "ABCDE"
#: Bit of E, which is judged last.
DUPLICATE = 1 << FILTERS.index("E")
_NO_ID = np.iinfo(np.int64).max


def own_failures(text: Column) -> Column:
    """Bits 0 to 3 of the mask: under 50 words; fewer than 65 % of the words different; over 5 % of code points in A-Z; a
    character of `#$%&*|`. An empty text has no words and fails the first alone."""
    words = F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 50, 100 * different < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, id, part, mask) of one range with E set in their masks. Rows that an earlier range may still make
    duplicates (the least ids of texts under the range's first fingerprint) come out with fp and text; texts under its last
    fingerprint are told to later ranges by rows without a mask."""
    names = ["id", "part", "mask", "fp", "text", "least"]
    first = None
    fp_now, text_now, least_now = None, None, _NO_ID  # of the last row so far
    told: list[tuple[str, int]] = []  # texts under fp_now, with their least ids
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, text = batch.column("fp").to_numpy(), batch.column("text")
        known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("id").fill_null(_NO_ID).to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = ~((fp[1:] == fp[:-1]) & pc.equal(text.slice(1), text.slice(0, len(fp) - 1)).to_numpy(zero_copy_only=False))
        new[0] = fp_now is None or fp_now != fp[0] or text_now != text[0].as_py()
        starts = np.flatnonzero(new)
        least = np.concatenate([[least_now], ids[starts]])
        again = known & (ids > least[np.cumsum(new)])
        first = fp[0] if first is None else first
        open_ = known & ~again & (fp == first)
        if fp_now != fp[-1]:
            told = []
        told += [(text[int(i)].as_py(), int(ids[i])) for i in starts[fp[starts] == fp[-1]] if known[i]]
        fp_now, text_now, least_now = fp[-1], text[len(fp) - 1].as_py(), int(least[-1])
        mask = batch.column("mask").to_numpy() | np.where(again, DUPLICATE, 0).astype(np.int32)
        none = pa.nulls(len(fp), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(mask), pa.array(fp, mask=~open_), pc.if_else(pa.array(open_), text, pa.scalar(None, text.type)), none], names=names)
    if told and fp_now != first:
        n = len(told)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([fp_now] * n, pa.int64()), pa.array([t for t, _ in told], pa.string()), pa.array([i for _, i in told], pa.int64())], names=names)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask), one row per row of `docs`: bit i is set if the document fails filter i of A to E.

    A null text counts as empty, a null part as the empty string. E: an equal text has a smaller id anywhere in the table, so
    rows that repeat an id don't make each other duplicates, and a row without an id neither is a duplicate nor makes one.
    Other columns are ignored, whatever their names; an empty table gives no rows. Ids are integers.
    """
    text = text_of(text_col)
    rows = docs.select(F.xxhash64(text).alias("fp"), text.alias("text"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # ranges by fingerprint and id: the texts themselves aren't sampled to the driver, and a text that a third of the rows share is dealt by id
    # masks are made after that, as Spark runs what is before it twice, once for the ranges
    by_id = F.col("id").asc_nulls_last()
    ranged = rows.repartitionByRange("fp", by_id).withColumn("mask", own_failures(F.col("text"))).sortWithinPartitions("fp", "text", by_id)
    marked = materialize(ranged.mapInArrow(_mark, "id long, part string, mask int, fp long, text string, least long"))
    edges = marked.where("fp IS NOT NULL")
    heads = edges.groupBy("fp", "text").agg(F.min(F.coalesce("least", "id")).alias("head"))
    settled = edges.where("mask IS NOT NULL").join(heads, ["fp", "text"]).select("id", "part", F.col("mask").bitwiseOR(F.when(F.col("head") < F.col("id"), DUPLICATE).otherwise(0)).alias("mask"))
    return marked.where("fp IS NULL").select("id", "part", "mask").unionByName(settled)


def audit(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What each filter does at each place of each order, per part: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    `masks`: what failure_masks gave. `labels`: `id_col`, quality, toxic; a document with several rows there is good, or toxic,
    if one of them says so. Counters have at most 32 rows a part; the orders are unfolded from them, not from documents.
    """
    flags = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    zero = F.lit(0).cast("long")
    every = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    labelled = masks.join(flags.where("good = 1 OR toxic = 1"), "id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).select("part", "mask", zero.alias("n"), "good", "toxic")
    counters = every.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    per_part = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    orders = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            orders.append({"filter_order": "".join(order), "step": step, "own": 1 << FILTERS.index(name), "before": before})
            before |= 1 << FILTERS.index(name)
    steps = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = per_part.select("part", "counts", F.inline(steps))
    own, before = F.col("own"), F.col("before")

    def total(what: str, where, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate("counts", zero, lambda a, c: a + F.when(where(c["mask"]), c[what] * weight(c["mask"])).otherwise(zero))

    fails = lambda m: m.bitwiseAND(own) != 0
    reaches = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & reaches(m)
    # of the orders, a document that fails k filters is removed by each of them in one of k
    share = lambda m: (F.lit(len(orders) // len(FILTERS)) / F.bit_count(m)).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: reaches(m) & ~fails(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & ~reaches(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("n", fails, share).alias("shapley"),
    )
