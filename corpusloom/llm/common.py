"""What the operators share: reading tables, writing intermediate tables where every executor sees them, byte-level words."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition `[^\x20\x09-\x0D]+`; `bytes.split()` splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names none, one is made in local
    mode, in which all share the driver's disk; on a cluster that is an error, since executors would write to their own."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpusloom"


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: the lineage ends there, nothing is computed
    twice, and a lost executor costs only a re-read. (checkpoint() would compute the rows twice.)"""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, what a query shuffled is deleted as soon as the query ends; elsewhere it stays until the driver happens to collect
    its garbage. For steps that write many tables one after the other."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `docs` has it, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(column, upper, upper.lower())


def hash128(column: Column) -> list[Column]:
    """Two 64-bit hashes of one value under different seeds: as a pair, collisions are out of reach at any corpus size."""
    return [F.xxhash64(column), F.xxhash64(F.lit(0x5EED), column)]
