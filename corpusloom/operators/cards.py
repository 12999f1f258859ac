"""Headers and cards of versions, the choice among their sources, and worksheets without names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: names of languages, and words for edges
LANGUAGE_NAMES = {"ml": "Malayalam", "ta": "Tamil", "te": "Telugu", "hi": "Hindi", "kn": "Kannada", "bn": "Bengali", "si": "Sinhala", "zh": "Chinese", "en": "English"}
RELATIONSHIP_WORDS = {"is_remake_of": "remake of", "is_official_dub_of": "official dub of", "is_unofficial_remake_of": "unofficial remake of"}


def _named(code: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def language_name(code: Column) -> Column:
    """The language's name; an unknown code stays as it is, none is named as unknown."""
    return F.coalesce(_named(F.coalesce(code, F.lit("")), LANGUAGE_NAMES), code, F.lit("unknown language"))


def _described(title: Column, language: Column, year: Column) -> Column:
    return F.concat(title, F.lit(" ("), language_name(language), F.coalesce(F.concat(F.lit(", "), year.cast("string")), F.lit("")), F.lit(")"))


def with_origin(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """`versions` (id, title, language, year, ...) with relationship and origin: the struct of the version that an edge
    (src, kind, dst) of one of the known kinds leads to. Of several edges to versions that are there, the one with the least
    (dst, kind) counts. Both are null where there is none."""
    origins = versions.select(F.col("id").alias("dst"), F.struct("title", "language", "year").alias("origin"))
    known = edges.where(F.col("kind").isin(*RELATIONSHIP_WORDS)).join(origins, "dst")
    first = known.groupBy(F.col("src").alias("id")).agg(F.min_by(F.struct("kind", "origin"), F.struct("dst", "kind")).alias("e"))
    return versions.join(first, "id", "left").withColumns({"relationship": F.col("e.kind"), "origin": F.col("e.origin")}).drop("e")


def header() -> Column:
    """`Title (Language, year) — remake of Title (Language, year).` over the columns of with_origin(); what is null is left out."""
    own = _described(F.col("title"), F.col("language"), F.col("year"))
    lineage = F.concat(F.lit(" — "), _named(F.col("relationship"), RELATIONSHIP_WORDS), F.lit(" "), _described(F.col("origin.title"), F.col("origin.language"), F.col("origin.year")))
    return F.concat(own, F.coalesce(lineage, F.lit("")), F.lit(". "))


def card() -> Column:
    """One text per version over the columns of with_origin(), is_original, and the arrays akas, directors and leads."""
    said = lambda before, names, joint: F.when(F.size(names) > 0, F.concat(F.lit(before), F.array_join(names, joint), F.lit(".")))
    original = F.when(F.col("is_original"), "This is the original version of this story.")
    language = F.concat(F.lit("A "), language_name(F.col("language")), F.lit(" film."))
    return F.concat_ws(" ", F.trim(header()), original, said("Also known as: ", "akas", "; "), said("Directed by ", "directors", ", "), said("Starring ", "leads", ", "), language)


def preferred_rows(rows: DataFrame, group: str, is_preferred: Column, order: list[Column]) -> DataFrame:
    """The preferred rows of each group, or all of a group that has none, with seq from 0 in `order`."""
    seen = rows.withColumn("_preferred", F.coalesce(is_preferred, F.lit(False)))
    marked = seen.withColumn("_any", F.max("_preferred").over(Window.partitionBy(group))).where("_preferred OR NOT _any").drop("_preferred", "_any")
    return marked.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def shuffled_numbers(items: DataFrame, keys: list[str], name: str, seed: int = 7) -> DataFrame:
    """`items` with `name`: their numbers from 1 in an order that depends on `seed` and the keys alone.

    Items fall into 4096 ranges of their hashes; each is numbered on its own, from the count of those before it."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))
    hashed = items.withColumn("_hash", h).withColumn("_range", F.substring("_hash", 1, 3))
    counts = hashed.groupBy("_range").agg(F.count("*").alias("_n"))  # 4096 rows at most
    up_to = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *keys))
    return hashed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + place).drop("_hash", "_range", "_before")


def rule_backed(rows: DataFrame, sources: str = "sources", confidence: str = "confidence", verified: str = "human_verified") -> DataFrame:
    """Rows of medium confidence that nobody has verified and that a rule is among the sources of."""
    return rows.where((F.col(confidence) == "MEDIUM") & ~F.coalesce(F.col(verified), F.lit(False)) & F.exists(sources, lambda s: s == "rule"))


def limit_reason(turns: Column, text: Column, max_turns: int = 20, max_bytes: int = 8000) -> Column:
    """Why a message isn't taken: `turns` if as many turns were taken as there may be, `bytes` if it is too long, else null."""
    return F.when(turns >= max_turns, "turns").when(F.octet_length(text) > max_bytes, "bytes")
