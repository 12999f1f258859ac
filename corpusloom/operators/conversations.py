"""Conversations: turn segments, carried state, sessions, and matching of recorded calls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.calls import found_in_order
from corpusloom.session import written


def user_turns(messages: DataFrame, conversation: str, position: str, role: str) -> DataFrame:
    """`messages` with user_turn: how many user messages there are up to each, 0 before the first."""
    up_to = Window.partitionBy(conversation).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("user_turn", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(up_to))


def carry_forward(rows: DataFrame, key: str, position: list[str], value: Column) -> DataFrame:
    """`rows` with carried: the last value that isn't null up to each row."""
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*position).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def carried_before(rows: DataFrame, key: str, position: list[str], value: Column) -> DataFrame:
    """`rows` with carried: the last value that isn't null before each row, its own left out. Rows are dealt over ranges of key and
    position, so a key with most of the rows is split; what a range's earlier ones end with comes from a row per key and range."""
    placed = written(rows.withColumn("_value", value).repartitionByRange(key, *position).withColumn("_pid", F.spark_partition_id()))
    ends = placed.where(F.col("_value").isNotNull()).groupBy(key, "_pid").agg(F.max_by("_value", F.struct(*position)).alias("_end"))
    chunks = placed.select(key, "_pid").distinct().join(ends, [key, "_pid"], "left")
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    within = F.last("_value", ignorenulls=True).over(Window.partitionBy(key, "_pid").orderBy(*position).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("_within", within).join(chunks.select(key, "_pid", earlier.alias("_earlier")), [key, "_pid"])
    return joined.withColumn("carried", F.coalesce("_within", "_earlier")).drop("_value", "_pid", "_within", "_earlier")


def sessions(events: DataFrame, user: str, ts: str, ttl_seconds: int, order: str) -> DataFrame:
    """`events` with session: it goes on as long as each event comes within the time to live of the one before."""
    by_user = Window.partitionBy(user).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by_user).cast("timestamp"))
    opens = F.when(gap.isNull() | (gap > ttl_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_opens")


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Requests per key and minute, and how many go over the limit. Works on streams as on tables."""
    counted = events.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), key, "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("over_limit"))


def match_calls(calls: DataFrame, schema_key: str = "fixture") -> DataFrame:
    """(fixture, matched, expected_n, emitted_n): expected calls found in order among the emitted ones, greedily.

    `calls`: fixture, kind (expected or emitted), position, tool, argument, result_id. An expected argument `$id` matches an
    argument that an earlier emitted call returned. Emitted calls of a fixture have different positions; rows without a
    fixture are those of one more. No fixture is gathered in a task."""
    key = F.col(schema_key)
    got = calls.where("kind = 'emitted'")
    want = calls.where("kind = 'expected'").select(key, F.row_number().over(Window.partitionBy(schema_key).orderBy("position")).alias("place"), "tool", F.col("argument").alias("want"))
    returned = got.groupBy(key.alias("_g"), F.col("result_id").alias("_r")).agg(F.min("position").alias("_returned"))
    got = got.join(returned, key.eqNullSafe(F.col("_g")) & F.col("argument").eqNullSafe(F.col("_r")), "left")
    known = F.when(F.col("_returned") < F.col("position"), F.array("argument"))
    fits = lambda want, given, known: bool(known) if want == "$id" else want == given
    matched = found_in_order(want, got.select(key, "position", "tool", F.col("argument").alias("given"), known.alias("known")), schema_key, ["position"], fits)
    counts = calls.groupBy(schema_key).agg(F.count_if(F.col("kind") == "expected").alias("expected_n"), F.count_if(F.col("kind") == "emitted").alias("emitted_n"))
    return counts.join(matched.select(key.alias("_m"), "matched"), key.eqNullSafe(F.col("_m")), "left").select(schema_key, F.coalesce("matched", F.lit(0)).alias("matched"), "expected_n", "emitted_n")


def lock_entities(texts: DataFrame, text_col: str, entities_col: str) -> DataFrame:
    """`texts` with locked: each entity replaced by a sentinel of its number in [[T1]], the longest first, whole numbers only."""
    import re

    def lock(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, entities in zip(rows[text_col], rows[entities_col], strict=True):
                if text is None:
                    out.append(None)
                    continue
                names = sorted({e for e in (entities if entities is not None else []) if e}, key=lambda e: (-len(e), e))
                number = {e: i + 1 for i, e in enumerate(names)}
                pattern = "|".join(rf"(?<!\d){re.escape(e)}(?!\d)" if e.isdigit() else re.escape(e) for e in names)
                out.append(re.sub(pattern, lambda m, n=number: f"[[T{n[m.group(0)]}]]", text) if names else text)
            yield rows.assign(locked=out)

    from pyspark.sql import types as T

    return texts.mapInPandas(lock, T.StructType([*texts.schema.fields, T.StructField("locked", T.StringType())]))
