"""Files in: tab-separated dumps, entity and page snapshots, sealed directories, conversations. All lazily, by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the columns of a dump of titles, in order
AKA_COLUMNS = ("titleId", "ordering", "title", "region", "language", "types", "attributes", "isOriginalTitle")
NULL_MARK = "\\N"
ENTITY_SCHEMA = "id string, missing string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>>>, sitelinks map<string,struct<title:string>>"
CONVERSATION_SCHEMA = "conv_id string, behaviour string, query_lang string, turns array<struct<role:string,content:string>>, entity_ids array<string>"


def parse_akas(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of AKA_COLUMNS from tab-separated lines. Lines of another width and the header are dropped; \\N is null; an
    ordering that isn't digits is 0; only 1 is an original title."""
    x = lines.select(F.split(column, "\t", -1).alias("x")).where((F.size("x") == len(AKA_COLUMNS)) & (F.get("x", F.lit(0)) != AKA_COLUMNS[0]))
    field = lambda i: F.nullif(F.get("x", F.lit(i)), F.lit(NULL_MARK))
    plain = {name: field(i) for i, name in enumerate(AKA_COLUMNS)}
    plain["ordering"] = F.when(field(1).rlike(r"^\d+$"), F.expr("try_cast(get(x, 1) AS int)")).otherwise(0)
    plain["isOriginalTitle"] = F.coalesce(field(7) == "1", F.lit(False))
    return x.select(*(c.alias(n) for n, c in plain.items()))


def filter_akas(spark: SparkSession, path: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Titles of the wanted ids only. The first field is looked at before the rest of a line is parsed; a .gz file is one task."""
    lines = spark.read.text(path).withColumn("_first", F.substring_index("value", "\t", 1))
    return parse_akas(lines.join(ids.select(F.col(id_col).alias("_first")).distinct(), "_first", "left_semi"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON-lines snapshot without the missing ones: id, label, description, years, lineage."""
    raw = spark.read.schema(ENTITY_SCHEMA).json(path).where(F.col("missing").isNull())
    return raw.select("id", F.col("labels")["en"]["value"].alias("label"), F.col("descriptions")["en"]["value"].alias("description"), claim_years("P577").alias("years"), claim_items("P144").alias("based_on"), claim_items("P4969").alias("derivatives"), wiki_titles().alias("titles"))


def _values(prop: str, kind: str) -> Column:
    claims = F.coalesce(F.col("claims")[prop], F.expr("cast(array() AS array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>>)"))
    typed = F.filter(claims, lambda c: c["mainsnak"]["datavalue"]["type"] == kind)
    return F.transform(typed, lambda c: c["mainsnak"]["datavalue"]["value"])


def claim_items(prop: str) -> Column:
    ids = F.transform(_values(prop, "wikibase-entityid"), lambda v: F.get_json_object(v, "$.id"))
    return F.filter(ids, lambda v: v.isNotNull())


def claim_years(prop: str) -> Column:
    """Distinct years, ascending; a time that doesn't start with one is skipped."""
    years = F.transform(_values(prop, "time"), lambda v: F.substring(F.regexp_replace(F.get_json_object(v, "$.time"), r"^\++", ""), 1, 4))
    return F.sort_array(F.array_distinct(F.transform(F.filter(years, lambda y: y.rlike(r"^\d{4}$")), lambda y: y.cast("int"))))


def wiki_titles() -> Column:
    """Language to title of the site links whose key ends in wiki and has it once."""
    entries = F.filter(F.map_entries("sitelinks"), lambda e: e["key"].rlike("^((?!wiki).)*wiki$"))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.regexp_replace(e["key"], "wiki$", ""), e["value"]["title"])))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of a JSON-lines file; a malformed line fails the read."""
    return spark.read.schema(CONVERSATION_SCHEMA).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of every file below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def manifest_issues(found: DataFrame, sealed: DataFrame) -> DataFrame:
    """(name, issue) where a directory differs from its sealed manifest: missing, stray or changed."""
    joined = found.select("name", F.col("sha256").alias("_now")).join(sealed.select("name", F.col("sha256").alias("_then")), "name", "full_outer")
    issue = F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "stray").when(F.col("_now") != F.col("_then"), "changed")
    return joined.select("name", issue.alias("issue")).where("issue IS NOT NULL")


def lookup_or_fail(rows: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """`rows` joined to their entries in a bank; a row without one fails the job, it never gets a made-up value."""
    joined = rows.join(bank.withColumn("_in_bank", F.lit(True)), key, "left")
    checked = F.when(F.col("_in_bank"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not in the bank: "), F.col(key).cast("string"))))
    return joined.withColumn(key, checked).drop("_in_bank")
