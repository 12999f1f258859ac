"""Sealed folders of tables: all of a version is there, or none of it is seen.

Data is written first and the manifest, a hash of every file, last; a folder without one is a write that broke. Opening holds
the files against the manifest and fails on anything missing, stray or changed. Files are hashed where Spark reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import manifest_issues


class RunError(ValueError):
    """A folder that isn't a sealed run, or is no longer what was sealed."""


def _hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of every file below the folder of tables; names begin below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/tables")
    return files.select(F.element_at(F.split("path", "/tables/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark knows; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def seal(tables: dict[str, DataFrame], path: str) -> None:
    """Write `tables` (without rows or with) to a new folder and seal it. A folder that exists, and no tables at all, are errors."""
    if not tables:
        raise RunError(f"nothing to seal in {path}")
    spark = next(iter(tables.values())).sparkSession
    if _children(spark, path):
        raise RunError(f"{path} is there already")
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/tables/{name}")
    _hashes(spark, path).coalesce(1).write.json(f"{path}/manifest")  # Spark's own marker of a finished write comes last


def is_sealed(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in _children(spark, f"{path}/manifest")


def open_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a sealed folder, its files checked."""
    if not is_sealed(spark, path):
        raise RunError(f"{path} isn't sealed")
    sealed = spark.read.schema("name string, sha256 string").json(f"{path}/manifest")
    amiss = manifest_issues(_hashes(spark, path), sealed)
    if found := [f"{r['issue']}: {r['name']}" for r in amiss.orderBy("name").limit(20).collect()]:
        raise RunError(f"{path} differs from its manifest, {'; '.join(found)}")
    return {name: spark.read.parquet(f"{path}/tables/{name}") for name in _children(spark, f"{path}/tables")}


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the sealed versions below `base`, ascending. What was begun and not sealed isn't one."""
    return [int(n[1:]) for n in _children(spark, base) if n[:1] == "v" and n[1:].isdigit() and is_sealed(spark, f"{base}/{n}")]


def latest(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    known = versions(spark, base)
    if not known:
        raise RunError(f"no sealed version in {base}")
    return open_run(spark, f"{base}/v{known[-1]:06d}")


def commit(tables: dict[str, DataFrame], base: str) -> int:
    """Seal `tables` together as the next version and give its number. A number that a broken write has used isn't used again."""
    spark = next(iter(tables.values())).sparkSession
    used = [int(n[1:]) for n in _children(spark, base) if n[:1] == "v" and n[1:].isdigit()]
    number = max(used, default=0) + 1
    seal(tables, f"{base}/v{number:06d}")
    return number
