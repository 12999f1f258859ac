"""Scores of answers and recorded runs against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import matching, stats
from corpusloom.operators import metrics

# fixed values: words that don't make a title of a phrase, small words within titles, and slices by the start of an id
NON_TITLE_WORDS = ["telugu", "tamil", "hindi", "malayalam", "kannada", "bengali", "sinhala", "chinese", "english", "indian", "original", "remake", "dub", "version", "wikidata", "tmdb", "imdb"]
_SMALL = "a|an|the|of|and|ka|ki|ke|e|o"
RETRIEVAL_SLICES = {"GS-01": "flagship", "GS-03": "plot_only", "GS-06": "franchise", "GS-07": "code_mixed", "GS-11": "fuzzy_title", "GS-02": "negative", "GS-04": "dub_regression", "GS-05": "source_regression", "GS-10": "collision_regression"}
GENERATION_SLICES = {"GS-07": "code_mixed", "GS-08": "backtracking", "GS-02": "negative"}
# fixed values: forms in which an answer asserts a title, in bold and before a year
_BOLD = r"\*\*(.+?)\*\*"
_BEFORE_YEAR = r"(?U)(?<!\*)\b([A-Z][\w'.:-]*(?:\s+[\w'.:-]+){0,6})\s*\(\d{4}"


def _title_like(phrase: Column) -> Column:
    """The end of a phrase that may be a title: tokens with a capital or a digit first, and small words, but not first."""
    tail = F.regexp_extract(phrase, rf"(?U)(?:^|\s)((?:(?:[\p{{Lu}}\p{{Nd}}]\S*|(?i:{_SMALL}))(?:\s+|$))+)$", 1)
    return F.trim(F.regexp_replace(tail, rf"(?iU)^(?:(?:{_SMALL})(?:\s+|$))+", ""))


def asserted_titles(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id_col`, pos, title, key): titles that an answer asserts, in order, each key once: bold spans without a bracket at the
    end or quotes, and phrases before a year in brackets, unless they are made of NON_TITLE_WORDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bold = F.transform(F.regexp_extract_all(text, F.lit(_BOLD), F.lit(1)), lambda x: F.btrim(F.trim(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")), F.lit("\"'")))
    phrases = F.transform(F.regexp_extract_all(F.regexp_replace(text, _BOLD, " "), F.lit(_BEFORE_YEAR), F.lit(1)), _title_like)
    plain = F.filter(phrases, lambda x: F.exists(F.split(F.lower(x), r"\s+"), lambda w: ~w.isin(NON_TITLE_WORDS)))
    rows = answers.select(id_col, F.posexplode(F.filter(F.concat(bold, plain), lambda x: x != "")).alias("pos", "title"))
    keyed = rows.withColumn("key", matching.match_key("title")).where("key <> ''")
    return keyed.groupBy(id_col, "key").agg(F.min(F.struct("pos", "title")).alias("first")).select(id_col, "first.pos", "first.title", "key")


def inventions(asserted: DataFrame, allowed: DataFrame, id_col: str) -> DataFrame:
    """`asserted` titles with grounded: whether a title in `allowed` (`id_col`, title) of the same conversation has their key, or
    one within the ratio. Only titles of one conversation meet, each different key once."""
    keys = allowed.select(id_col, matching.match_key("title").alias("allowed_key")).distinct()
    pairs = asserted.join(keys, id_col).where(matching.length_bound(F.col("key"), F.col("allowed_key"), matching.MATCH_THRESHOLD))
    good = pairs.where((F.col("key") == F.col("allowed_key")) | (matching.fuzzy_ratio("key", "allowed_key") >= matching.MATCH_THRESHOLD)).select(id_col, "key").distinct()
    return asserted.join(good.withColumn("grounded", F.lit(True)), [id_col, "key"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def version_set_recall(fixtures: DataFrame, expected: DataFrame, got: DataFrame) -> DataFrame:
    """(fixture, recall): of each fixture's expected versions (fixture, title, language, year, relationship, is_original), repeats
    included, the share that a recorded one equals by title, language and year, with the same relationship if one is expected
    and original if that is; 1 where none is expected."""
    seen = got.groupBy("fixture", "title", "language", "year", "relationship").agg(F.max(F.coalesce("is_original", F.lit(False))).alias("got_original")).withColumnRenamed("relationship", "got_relationship")
    wanted = expected.groupBy("fixture", "title", "language", "year", "relationship", F.coalesce("is_original", F.lit(False)).alias("is_original")).agg(F.count("*").alias("n"))
    same = F.lit(True)
    g, w = seen.alias("g"), wanted.alias("w")
    for c in ("fixture", "title", "language", "year"):
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}"))
    fits = (F.col("relationship").isNull() | (F.col("relationship") == F.col("got_relationship"))) & (~F.col("is_original") | F.col("got_original"))
    joined = w.join(g, same, "left").groupBy("w.fixture", "w.title", "w.language", "w.year", "relationship", "is_original").agg(F.first("n").alias("n"), F.max(F.coalesce(fits & F.col("g.fixture").isNotNull(), F.lit(False))).alias("hit"))
    per = joined.groupBy("fixture").agg((F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
    return fixtures.select("fixture").distinct().join(per, "fixture", "left").select("fixture", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def coverage_of_edges(curated: DataFrame, visible: DataFrame) -> DataFrame:
    """(edge_type, expected, present, coverage): curated edges (edge_type, src, dst) that are among the visible ones."""
    there = visible.select("edge_type", "src", "dst").distinct().withColumn("there", F.lit(1))
    joined = curated.join(there, ["edge_type", "src", "dst"], "left")
    return joined.groupBy("edge_type").agg(F.count("*").alias("expected"), F.count("there").alias("present")).withColumn("coverage", F.round(F.col("present") / F.col("expected"), 4))


def intent_matches(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(fixture, turn, matches): whether the intent predicted for a turn is the expected one; a turn without one is wrong."""
    got = predicted.select("fixture", "turn", F.col("intent").alias("predicted"))
    return expected.join(got, ["fixture", "turn"], "left").select("fixture", "turn", F.coalesce(F.col("predicted") == F.col("intent"), F.lit(False)).alias("matches"))


def metric_block(results: DataFrame) -> DataFrame:
    """One row per slice and one for all (slice null) of results (fixture, slice, sequence_match, call_level, schema_validity,
    intents, intents_right, asserted, invented, completed): means over the fixtures that have a score, rates over sums;
    hallucinated_rate 0 where nothing is asserted, and faithfulness what it leaves."""
    rate = F.when(F.sum("asserted") > 0, F.sum("invented") / F.sum("asserted")).otherwise(0.0)
    block = results.groupingSets([["slice"], []], "slice").agg(
        F.count("*").alias("n"), F.count_if("completed").alias("completed"), F.avg(F.col("sequence_match").cast("int")).alias("sequence_accuracy"), F.avg("call_level").alias("call_level"), F.avg("schema_validity").alias("schema_validity"),
        F.try_divide(F.sum("intents_right"), F.sum("intents")).alias("intent_accuracy"), F.sum("asserted").alias("asserted"), F.sum("invented").alias("invented"), rate.alias("hallucinated_rate"), (1 - rate).alias("faithfulness"),
    )
    return block


def retest(original: DataFrame, blind: DataFrame, id_map: DataFrame) -> DataFrame:
    """(kind, n, agreement, kappa) per kind and over all (kind null) of labels given twice: `original` (item_id, kind, label), `blind`
    (blind_id, label), `id_map` (blind_id, item_id). kappa is 1 where chance alone would agree and all do, else 0."""
    second = blind.join(id_map, "blind_id").select("item_id", F.col("label").alias("again"))
    pairs = original.join(second, "item_id")
    sums = pairs.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("again")).alias("same"), F.sum("label").alias("first"), F.sum("again").alias("second"))
    return sums.select("kind", "n", F.round(F.col("same") / F.col("n"), 6).alias("agreement"), F.round(stats.kappa(F.col("n"), F.col("same"), F.col("first"), F.col("second")), 6).alias("kappa"))


def slice_of(fixture_id: Column, slices: dict[str, str]) -> Column:
    """The slice that the first five characters of an id name, null for others."""
    return F.create_map(*(F.lit(x) for pair in slices.items() for x in pair))[F.substring(fixture_id, 1, 5)]


def generation_slice(fixture_id: Column) -> Column:
    """The generation slice of an id; those of GS-02 before d are none."""
    early = fixture_id.startswith("GS-02") & (F.substring(fixture_id, 6, 1000) < "d")
    return F.when(~early, slice_of(fixture_id, GENERATION_SLICES))


def number_of(fixture_id: Column) -> Column:
    """The number after the hyphen of an id, which tells the first suite (up to 14) from later additions."""
    return F.regexp_extract(fixture_id, r"-(\d+)", 1).try_cast("int")


def dataset_issues(conversations: DataFrame, known: DataFrame, fixtures: DataFrame, categories: list[str]) -> DataFrame:
    """(subject, issue, detail): ids that a conversation (conv_id, entity_ids) uses and that aren't in `known` (id); fixture ids
    (fixture) that repeat; categories that no fixture's id starts with."""
    used = conversations.select("conv_id", F.explode(F.array_distinct("entity_ids")).alias("id"))
    unknown = used.join(known.select("id").distinct(), "id", "left_anti").select(F.col("conv_id").cast("string").alias("subject"), F.lit("unknown entity").alias("issue"), F.col("id").cast("string").alias("detail"))
    repeated = fixtures.groupBy("fixture").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fixture").alias("subject"), F.lit("duplicate fixture id").alias("issue"), F.col("n").cast("string").alias("detail"))
    listed = fixtures.sparkSession.createDataFrame([(c,) for c in categories], "subject string")
    bare = listed.join(fixtures.select(F.substring("fixture", 1, 5).alias("subject")).distinct(), "subject", "left_anti").select("subject", F.lit("scenario category uncovered").alias("issue"), F.lit("").alias("detail"))
    return unknown.unionByName(repeated).unionByName(bare)


def run_block(results: DataFrame, turns: DataFrame) -> DataFrame:
    """What metric_block leaves out, one row per slice and one for all (slice null): slot_micro_f1 over sums (null without slots),
    code_mixed_intent_accuracy, negative_inventions, means of the judges' scores over the fixtures that have one, and of the turns
    p50 and p95 of the latency by the exclusive method and tokens a second over the turns' whole time (null without either).

    `results`: fixture, slice, tp, fp, fn, intents, intents_right, invented, coherence, ragas_faithfulness, answer_relevancy; `turns`:
    fixture, slice, latency_ms, completion_tokens. No slice's turns are gathered or sorted in one task."""
    own = lambda name, what: F.sum(F.when(F.col("slice") == name, F.col(what)))
    mean = lambda c: F.avg(c).alias(c)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    block = results.withColumn("_s", F.col("slice")).groupingSets([["_s"], []], "_s").agg(
        F.when(F.count("tp") > 0, stats.f1(tp, fp, fn)).alias("slot_micro_f1"), F.try_divide(own("code_mixed", "intents_right"), own("code_mixed", "intents")).alias("code_mixed_intent_accuracy"), F.coalesce(own("negative", "invented"), F.lit(0)).alias("negative_inventions"),
        mean("coherence"), mean("ragas_faithfulness"), mean("answer_relevancy"),
    )
    # every turn counts for its slice and for all; the rows of either are numbered over ranges of their values
    both = turns.select(F.explode(F.array(F.struct(F.col("slice").alias("g"), F.lit(0).alias("all")), F.struct(F.lit(None).cast(results.schema["slice"].dataType).alias("g"), F.lit(1).alias("all")))).alias("_who"), F.col("latency_ms").cast("double").alias("latency_ms"), "completion_tokens")
    sums = both.groupBy("_who").agg(F.sum("completion_tokens").alias("tokens"), F.sum("latency_ms").alias("ms"))
    cuts = {i: stats.exclusive_position(F.col("n"), i, 100) for i in (50, 95)}
    found = metrics.order_statistics(both, "_who", "latency_ms", {f"{name}{i}": j.cast("long") + step for i, (j, _) in cuts.items() for name, step in (("low", -1), ("high", 0))})
    at = {i: F.when(F.col("n") >= 2, (F.col(f"low{i}") * (100 - delta) + F.col(f"high{i}") * delta) / 100).otherwise(F.col(f"low{i}")) for i, (_, delta) in cuts.items()}
    speed = F.when((F.col("tokens") > 0) & (F.col("ms") > 0), F.round(F.col("tokens") / (F.col("ms") / 1000), 2))
    timed = sums.join(found, "_who", "left").select(F.col("_who.g").alias("_t"), *(F.round(v, 2).alias(f"latency_p{i}_ms") for i, v in at.items()), speed.alias("tokens_per_sec"))
    return block.join(timed, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t").withColumnRenamed("_s", "slice")
