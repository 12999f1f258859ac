"""Streaming forms: request limits and counters by event time, sessions with a sliding expiry, last samples per status."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.conversations import rate_limit


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over event files. Times without a zone are read as UTC."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def limited(events: DataFrame, limit: int = 10, late: str = "10 minutes") -> DataFrame:
    """Requests per user and minute; a window is final once the watermark has passed it."""
    return rate_limit(events.withWatermark("ts", late), "user_id", "ts", limit)


def session_windows(events: DataFrame, ttl: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: each event puts off the end."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_events")


def last_samples(events: DataFrame, keep: int = 1000) -> DataFrame:
    """Counts per status over all time and percentiles of the last `keep` values, updated with each batch. State per status
    is a counter and `keep` numbers."""

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, values = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        values = (list(values) + rows["value"].tolist())[-keep:]
        count += len(rows)
        state.update((count, values))
        ordered = sorted(values)
        at = lambda q: float(ordered[round(q * (len(ordered) - 1))])
        yield pd.DataFrame({"status": [key[0]], "requests": [count], "p50": [at(0.5)], "p95": [at(0.95)]})

    return events.groupBy("event_type").applyInPandasWithState(update, "status string, requests long, p50 double, p95 double", "count long, samples array<double>", "update", GroupStateTimeout.NoTimeout)
