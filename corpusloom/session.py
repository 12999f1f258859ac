"""Sessions and tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def make_session(name: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the operators assume: UTC, adaptive execution. Cluster settings stay the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def conf_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what runs within."""
    had = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def written(df: DataFrame, *by: str) -> DataFrame:
    """`df` written to the folder that driver and executors share, spark.checkpoint.dir, and read again: loops don't grow their
    plans, nothing is computed twice, and a lost executor costs a re-read. Where the session names no folder, one is made in
    local mode only; on a cluster executors would write to their own disks. `by`: columns whose values have folders of their own."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/corpusloom-tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
