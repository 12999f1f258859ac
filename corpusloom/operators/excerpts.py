"""Excerpts that tell a story: the first two neighbouring sentences of a text that do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: what sentences about a film have and sentences of its story haven't; verbs of a story, in the present
ABOUT_THE_FILM = r"directed|produced|co-written|written by|starring|distributed|box office|is a \d{4}|language film|film stars|screenplay|award|grossing|theatrical|soundtrack|principal photography|filming|remake|remade|released|collaboration|budget|sequel to|premiered|film adaptation|\bstars\b|\bcast\b|supporting role|guest appearance|lead role|ensemble|reboot|cinematography|editing|comeback|commercial cinema|status as a star|version had|conceived|based the film|homage|success|making of|shot at|shot in|\bfilmed\b|notable for"
STORY_VERBS = r"\b(is|are|has|works|follows|revolves|lives|moves|meets|finds|discovers|decides|refuses|begins|tries|falls|helps|kills|saves|returns|realises|realizes|becomes|leads|joins|plans|escapes|hides|leaves|takes|goes|comes|sees|learns)\b"
# fixed values: the least length of a sentence and of a text or excerpt, the most of an excerpt, the share of names in a list of them
SENTENCE, LEAST, MOST, NAMES = 40, 60, 320, 0.5


def sentences(text: Column) -> Column:
    """Sentences of a text without what stands in brackets."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s*\([^)]*\)", "")
    return F.split(plain, r"(?U)(?<=[.!?])\s+|\n+")


def is_narrative(sentence: Column) -> Column:
    """Longer than 40 characters, in the present, not about the film, and not mostly words with a capital."""
    words = F.filter(F.split(sentence, r"(?U)[\s,]+"), lambda w: w != "")
    names = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.length(sentence) > SENTENCE) & ~sentence.rlike(f"(?iU){ABOUT_THE_FILM}") & ~((F.size(words) > 0) & (names > NAMES * F.size(words))) & sentence.rlike(f"(?U){STORY_VERBS}")


def first_pair(text: Column) -> Column:
    """The first two narrative sentences in a row, with a blank between them; null where there are none. One pass over the sentences,
    each judged once and none after the pair."""
    none = F.lit(None).cast("string")
    state = lambda last, pair: F.struct(last.alias("last"), pair.alias("pair"))
    step = lambda had, s: F.when(had["pair"].isNotNull(), had).when(is_narrative(s), state(s, F.concat(had["last"], F.lit(" "), s))).otherwise(state(none, none))
    return F.aggregate(sentences(text), state(none, none), step, lambda had: had["pair"])


def excerpts(texts: DataFrame, work: str, text: str, language: str, order: str, limit: int = 2) -> DataFrame:
    """(`work`, nth, `order`, excerpt): of each work's English texts, in the order of their text and then of `order`, the first
    `limit` that have two narrative sentences in a row, each with the first such pair. Texts of under 60 characters, and null ones,
    have none. Only excerpts are numbered, of which Spark keeps the first of each task before it deals them by work."""
    rows = texts.where((F.col(language) == "en") & (F.length(text) >= LEAST))
    # a generator, which no condition on the excerpt is pushed through: sentences are read once
    rows = rows.select(work, order, text, F.explode(F.array_compact(F.array(first_pair(F.col(text))))).alias("_pair"))
    found = rows.select(work, order, text, F.regexp_replace(F.substring("_pair", 1, MOST), r"(?U)^\s+|\s+$", "").alias("excerpt")).where(F.length("excerpt") >= LEAST)
    nth = F.row_number().over(Window.partitionBy(work).orderBy(text, order))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit).select(work, "nth", order, "excerpt")
