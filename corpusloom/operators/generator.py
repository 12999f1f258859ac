"""Synthetic conversations by quotas, made where Spark puts their numbers.

A conversation is a number. Its behaviour and its language are those of the number's place under two fixed permutations, of
which each kind takes as many places as its quota, so quotas are met exactly without any row being seen; its work, and the
works that its search result ranks below, are places of two more. The same numbers give the same rows at any partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.metrics import running_sums

# fixed values: shares of behaviours and of languages
BEHAVIOURS = {"find_by_plot": 0.30, "find_by_title": 0.15, "list_versions": 0.10, "refine": 0.25, "disambiguate": 0.05, "out_of_catalog": 0.15}
LANGUAGES = {"ta-latin": 0.09, "hi-latin": 0.09, "kn-latin": 0.09, "te-latin": 0.09, "ml-latin": 0.09, "native": 0.15, "en": 0.40}
#: Multipliers of the permutations: primes, so that they permute any number of places but a multiple of them.
_PRIMES = {"behaviour": 2_147_483_647, "language": 998_244_353, "work": 1_000_000_007, "other": 1_000_000_009}
#: Works that a search result ranks below the right one.
DISTRACTORS = 3
USER = {
    "find_by_plot": {"en": "Which film is it where {}?", "hi-latin": "woh film kaun si hai jisme {}?", "ta-latin": "andha padam edhu, {}?", "te-latin": "aa cinema edi, {}?", "kn-latin": "aa chitra yaavudu, {}?", "ml-latin": "aa padam etha, {}?", "native": "वह कौन सी फिल्म है: {}"},
    "find_by_title": {"en": "Tell me about {}.", "hi-latin": "{} ke baare mein batao", "ta-latin": "{} pathi sollu", "te-latin": "{} gurinchi cheppu", "kn-latin": "{} bagge heli", "ml-latin": "{} ne kurichu parayu", "native": "{} के बारे में बताओ"},
    "list_versions": {"en": "List every version of {}.", "hi-latin": "{} ke saare versions dikhao", "ta-latin": "{} oda ella versions um kaattu", "te-latin": "{} versions anni chupinchu", "kn-latin": "{} ella versions torisu", "ml-latin": "{} ellaa versions um kaanikku", "native": "{} के सभी संस्करण दिखाओ"},
    "refine": {"en": "Of {}, only the newer one.", "hi-latin": "{} mein se sirf naya wala", "ta-latin": "{} la pudhusu mattum", "te-latin": "{} lo kottadi matrame", "kn-latin": "{} alli hosadu maatra", "ml-latin": "{} il puthiyathu maathram", "native": "{} में से केवल नया"},
    "disambiguate": {"en": "I mean one of those called {}.", "hi-latin": "{} naam ki kaun si?", "ta-latin": "{} nu pera ulla endha padam?", "te-latin": "{} ane peru unna edi?", "kn-latin": "{} hesarina yaavudu?", "ml-latin": "{} ennu peru ulla etha?", "native": "{} नाम की कौन सी?"},
    "out_of_catalog": {"en": "Is there a film of a talking {} spoon?", "hi-latin": "bolne wale {} chammach ki film hai?", "ta-latin": "pesum {} karandi padam irukka?", "te-latin": "matladé {} chemcha cinema unda?", "kn-latin": "maataduva {} chamacha chitra ideya?", "ml-latin": "samsarikkunna {} spoon padam undo?", "native": "बोलने वाले {} चम्मच की फिल्म है?"},
}


@dataclass(frozen=True)
class Mix:
    behaviours: dict[str, float] = field(default_factory=lambda: dict(BEHAVIOURS))
    languages: dict[str, float] = field(default_factory=lambda: dict(LANGUAGES))
    seed: int = 7


def quotas(shares: dict[str, float], total: int) -> dict[str, int]:
    """How many of `total` each kind gets: the whole part of its share, and one more for the largest remainders, equal ones by name.
    The counts sum to the total. Remainders are compared to nine places, so that 0.3 and 0.1 x 3 are alike."""
    whole = sum(shares.values())
    exact = {k: round(s / whole * total, 9) for k, s in shares.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-round(exact[k] - int(exact[k]), 9), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def place(number: Column, total: int, of: str, seed: int) -> Column:
    """The number's place among `total` under one of the permutations."""
    prime = _PRIMES[of]
    if total % prime == 0:
        raise ValueError(f"{total} places can't be permuted by {prime}")
    return F.pmod(number * (prime % total) + F.lit(seed * 7919 % total), F.lit(total))


def transposed(number: Column, total: int) -> Column:
    """The number's place when as many as fill a square are written by rows and read by columns: what keeps one permutation of the
    numbers from going in step with another."""
    side = math.isqrt(total)
    inside = F.pmod(number, F.lit(max(1, side))) * side + F.floor(number / max(1, side)).cast("long")
    return F.when(number < side * side, inside).otherwise(number)


def _kind(at: Column, counts: dict[str, int]) -> Column:
    """Kinds take the places one after the other, by name."""
    out, end = None, 0
    for name in sorted(counts):
        end += counts[name]
        out = F.when(at < end, name) if out is None else out.when(at < end, name)
    return out


def masked(excerpt: Column, title: Column) -> Column:
    """An excerpt in which the title, in any case, doesn't give the film away."""
    return F.regexp_replace(excerpt, F.concat(F.lit("(?iu)"), F.regexp_replace(title, r"([^\p{L}\p{N}\s])", r"\\$1")), F.lit("that film"))


def conversations(works: DataFrame, total: int, mix: Mix | None = None) -> DataFrame:
    """(conv_id, behaviour, query_lang, work_id, turns array<struct<role, name, content>>, intent, plan_hash): `total` conversations
    about `works` (work_id, title, year, excerpt; ids are different, none null).

    Quotas of behaviours and of languages are exact, each for itself. A user asks in their language's words; a tool call and its
    result follow, whose ranking has the right work first and three others below; the answer names the work, or declines where
    nothing is asked for that the catalogue has. Without works there are no conversations.
    """
    mix = mix or Mix()
    spark, n_works = works.sparkSession, works.count()
    total = total if n_works else 0
    ranked = running_sums(works.select("work_id", "title", "year", "excerpt").withColumn("one", F.lit(1).cast("long")), [], "work_id", ["one"]).withColumnRenamed("before_one", "_rank")
    numbers = spark.range(total).withColumnRenamed("id", "i")
    i = F.col("i")
    spots = {"behaviour": place(i, total, "behaviour", mix.seed), "language": place(transposed(i, total), total, "language", mix.seed)} if total else {"behaviour": i, "language": i}
    shift = lambda of, k: F.pmod(place(F.pmod(i, F.lit(max(1, n_works))), max(1, n_works), of, mix.seed + k), F.lit(max(1, n_works)))
    rows = numbers.select("i", _kind(spots["behaviour"], quotas(mix.behaviours, total)).alias("behaviour"), _kind(spots["language"], quotas(mix.languages, total)).alias("query_lang"), shift("work", 0).alias("_work"), *(shift("other", k).alias(f"_other{k}") for k in range(DISTRACTORS)))
    slots = F.array(F.struct(F.lit(0).alias("slot"), F.col("_work").alias("_rank")), *(F.struct(F.lit(k + 1).alias("slot"), F.col(f"_other{k}").alias("_rank")) for k in range(DISTRACTORS)))
    drawn = rows.select("i", "behaviour", "query_lang", F.explode(slots).alias("s")).select("i", "behaviour", "query_lang", "s.slot", "s._rank")
    met = drawn.join(ranked.select("_rank", "work_id", "title", "year", "excerpt"), "_rank")
    # four works a conversation; of its ranking those that aren't the right one again
    score = F.round(F.when(F.col("slot") == 0, 0.95 - F.pmod(i, F.lit(35)) / 100).otherwise(0.55 - F.col("slot") * 0.04 - F.pmod(i, F.lit(3)) / 100), 4)
    entry = F.struct(F.col("slot"), F.col("work_id"), F.col("title"), F.col("year"), score.alias("score"))
    per = met.groupBy("i", "behaviour", "query_lang").agg(F.sort_array(F.collect_list(entry)).alias("_all"), F.max(F.when(F.col("slot") == 0, F.col("excerpt"))).alias("_excerpt"))
    own = F.col("_all")[0]
    others = F.filter(F.slice("_all", 2, DISTRACTORS), lambda x: x["work_id"] != own["work_id"])
    asked = F.when(F.col("behaviour") == "find_by_plot", masked(F.col("_excerpt"), own["title"])).when(F.col("behaviour") == "out_of_catalog", F.element_at(F.array(*map(F.lit, ("silver", "wooden", "golden"))), (F.pmod(i, F.lit(3)) + 1).cast("int"))).otherwise(own["title"])
    words = F.create_map(*(F.lit(x) for b, by in USER.items() for lang, text in by.items() for x in (f"{b}/{lang}", text)))
    user = F.replace(words[F.concat_ws("/", "behaviour", "query_lang")], F.lit("{}"), asked)
    tool = F.when(F.col("behaviour").isin("find_by_plot", "out_of_catalog"), "search_by_plot").otherwise("resolve_title")
    out_of = F.col("behaviour") == "out_of_catalog"
    shown = lambda x: F.struct(x["work_id"].alias("work_id"), x["title"].alias("title"), x["year"].alias("year"), x["score"].alias("score"))
    result = F.to_json(F.struct(F.when(out_of, F.transform(others, shown)).otherwise(F.transform(F.concat(F.array(own), others), shown)).alias("results"), out_of.alias("abstain")))
    intent = F.to_json(F.struct(F.col("behaviour").alias("intent"), F.struct(asked.alias("query")).alias("slots")))
    answer = F.concat(F.lit("INTENT: "), intent, F.lit("\n"), F.when(out_of, "NO_MATCH").otherwise(F.concat(F.lit("**"), own["title"], F.lit("** ("), F.coalesce(own["year"].cast("string"), F.lit("?")), F.lit(")"))))
    turn = lambda role, name, content: F.struct(F.lit(role).alias("role"), (name if isinstance(name, Column) else F.lit(name).cast("string")).alias("name"), content.alias("content"))
    turns = F.array(turn("user", None, user), turn("call", tool, F.to_json(F.struct(asked.alias("query")))), turn("tool", tool, result), turn("assistant", None, answer))
    plan = F.sha2(F.to_json(F.struct("behaviour", "query_lang", own["work_id"].alias("work"), "i", F.lit(mix.seed).alias("seed"))), 256)
    return per.select(F.format_string(f"ft-{mix.seed:04d}-%09d", i).alias("conv_id"), "behaviour", "query_lang", F.when(~out_of, own["work_id"]).alias("work_id"), turns.alias("turns"), F.col("behaviour").alias("intent"), plan.alias("plan_hash"))
