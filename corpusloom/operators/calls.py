"""Recorded calls held against expected ones.

Matching is greedy and in order, so of the calls before it a call needs to know one number: how many expected ones are found
already. A range of a fixture's calls is therefore a function of that number, worked out from its last call to its first; the
ranges of a fixture are put together by applying one function after the other. A fixture with most of the calls is dealt over
many ranges like any others, and nothing is gathered but an expected list and a number per expected call and range.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import arguments, jsontree
from corpusloom.session import written

_REMEMBERED = 100_000
#: Whether what is expected (text) fits what was given (text), whose strings `known` are ids of earlier results.
Fits = Callable[[str | None, str | None, tuple[str, ...]], bool]


def found_in_order(expected: DataFrame, emitted: DataFrame, key: str, position: list[str], fits: Fits) -> DataFrame:
    """(key, matched): how many of the expected calls are found in order among the emitted ones, greedily, per key that has both.

    `expected`: key, place, tool, want; `emitted`: key, the columns of `position`, tool, given, known array<string>. Positions of a
    key's calls are different. Only calls of an expected one's tool are held against it. A null key is a key like any other."""
    rows = emitted.select(F.col(key).alias("key"), *(F.col(p).alias(f"_at{i}") for i, p in enumerate(position)), "tool", "given", "known")
    order = [f"_at{i}" for i in range(len(position))]
    placed = written(rows.repartitionByRange("key", *order).withColumn("_pid", F.spark_partition_id()))
    want = expected.select(F.col(key).alias("_key"), F.col("place").cast("long").alias("place"), "tool", F.col("want").alias("given"))
    lists = placed.select("key", "_pid").distinct().join(want, F.col("key").eqNullSafe(F.col("_key"))).drop("_key").withColumns({c: F.lit(None).cast(placed.schema[c].dataType) for c in [*order, "known"]})
    both = placed.withColumn("place", F.lit(None).cast("long")).unionByName(lists)
    # a range's expected calls first, then its calls, the last one first
    ranged = both.repartition("key", "_pid").sortWithinPartitions("key", "_pid", F.col("place").asc_nulls_last(), *(F.col(c).desc_nulls_first() for c in order))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said = None, {}
        tools: dict[str | None, list[int]] = {}
        wants: list[str | None] = []
        after = np.zeros(0, np.int32)
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "_pid", "place", "tool", "given", "known")]
            for k, pid, place, tool, given, known in zip(*columns, strict=True):
                if now != (k, pid):
                    if now and wants:
                        done.append((*now, after.tolist()))
                    now, tools, wants, after = (k, pid), {}, [], np.zeros(1, np.int32)
                if place is not None:
                    tools.setdefault(tool, []).append(len(wants))
                    wants.append(given)
                    after = np.arange(len(wants) + 1, dtype=np.int32)
                    continue
                ids = tuple(known or ())
                hits = []
                for i in tools.get(tool, ()):
                    asked = (wants[i], given, ids)
                    if asked not in said:
                        if len(said) >= _REMEMBERED:
                            said.clear()
                        said[asked] = fits(*asked)
                    if said[asked]:
                        hits.append(i)
                if hits:
                    at = np.array(hits)
                    after[at] = after[at + 1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((batch.schema.field("key").type, pa.int32(), pa.list_(pa.int32())))], names=["key", "_pid", "after"])
                kind, done = batch.schema.field("key").type, []
            kind = batch.schema.field("key").type
        if now and wants:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([now[1]], pa.int32()), pa.array([after.tolist()], pa.list_(pa.int32()))], names=["key", "_pid", "after"])

    schema = T.StructType([T.StructField("key", placed.schema["key"].dataType), T.StructField("_pid", T.IntegerType()), T.StructField("after", T.ArrayType(T.IntegerType()))])
    steps = ranged.mapInArrow(run, schema).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("_pid", "after"))).alias("steps"))
    reached = F.aggregate("steps", F.lit(0), lambda at, s: F.get(s["after"], at))
    return steps.select(F.col("key").alias(key), reached.cast("long").alias("matched"))


def _typed(want: str | None, given: str | None, known: tuple[str, ...]) -> bool:
    try:
        asked, got = jsontree.parse(want if want is not None else "{}"), jsontree.parse(given)
    except ValueError:
        return False
    return isinstance(asked, dict) and isinstance(got, dict) and arguments.fits(asked, got, set(known))


def _strings(given: str | None) -> list[str]:
    """Strings among the arguments, and among those that are lists: what may be an id."""
    try:
        got = jsontree.parse(given)
    except ValueError:
        return []
    values = got.values() if isinstance(got, dict) else ()
    return [x for v in values for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]


@F.arrow_udf(T.ArrayType(T.StringType()))
def strings_of(given: pa.Array) -> pa.Array:
    return pa.array([list(dict.fromkeys(_strings(g))) for g in given.to_pylist()], pa.list_(pa.string()))


def score_calls(expected: DataFrame, emitted: DataFrame, key: str, position: list[str]) -> DataFrame:
    """(key, expected_n, emitted_n, matched, sequence_match, call_level, schema_validity) per key of either side.

    `expected`: key, place, tool, arguments (JSON); `emitted`: key, the columns of `position`, tool, arguments (JSON), valid, result
    (JSON). An invalid call, or one whose arguments aren't an object, matches nothing; further arguments of a valid one don't
    matter. Where an id is expected, any id that the result of an earlier call of the key has will do. Nothing expected is all
    matched; nothing emitted is all valid. Rows with a null key are passed over."""
    numbered = written(emitted.where(F.col(key).isNotNull()).withColumn("_at", F.struct(*position)))
    given = numbered.select(F.col(key).alias("_k"), F.explode(jsontree.collect(F.col("result"), "work_id", "version_id")).alias("_id"), "_at")
    first = given.groupBy("_k", "_id").agg(F.min("_at").alias("_since"))
    asked = numbered.where("valid").select(F.col(key).alias("_k"), "_at", F.explode(strings_of(F.col("arguments"))).alias("_id"))
    known = asked.join(first, ["_k", "_id"]).where("_since < _at").groupBy("_k", "_at").agg(F.sort_array(F.collect_set("_id")).alias("known"))
    calls = numbered.where("valid").join(known, (F.col(key) == F.col("_k")) & (numbered["_at"] == known["_at"]), "left").select(key, *position, "tool", F.col("arguments").alias("given"), "known")
    want = expected.where(F.col(key).isNotNull()).select(key, "place", "tool", F.col("arguments").alias("want"))
    found = found_in_order(want, calls, key, position, _typed)
    zero = F.lit(0).cast("long")
    counts = want.groupBy(key).agg(F.count("*").alias("expected_n")).select(key, "expected_n", zero.alias("emitted_n"), zero.alias("invalid_n"))
    counts = counts.unionByName(numbered.groupBy(key).agg(F.count("*").alias("emitted_n"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid_n")).select(key, zero.alias("expected_n"), "emitted_n", "invalid_n"))
    totals = counts.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("expected_n", "emitted_n", "invalid_n"))).join(found, key, "left")
    matched = F.coalesce("matched", zero)
    level = F.when(F.col("expected_n") > 0, F.round(matched / F.col("expected_n"), 4)).otherwise(0.0)
    valid = F.when(F.col("emitted_n") > 0, F.round(1 - F.col("invalid_n") / F.col("emitted_n"), 4)).otherwise(1.0)
    return totals.select(key, "expected_n", "emitted_n", matched.alias("matched"), (matched == F.col("expected_n")).alias("sequence_match"), level.alias("call_level"), valid.alias("schema_validity"))
