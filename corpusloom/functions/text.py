"""Text functions that Spark's built-ins can express."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: code-point ranges of the scripts that titles are written in
SCRIPTS = {"deva": "\\x{0900}-\\x{097F}", "beng": "\\x{0980}-\\x{09FF}", "taml": "\\x{0B80}-\\x{0BFF}", "telu": "\\x{0C00}-\\x{0C7F}", "knda": "\\x{0C80}-\\x{0CFF}", "mlym": "\\x{0D00}-\\x{0D7F}", "sinh": "\\x{0D80}-\\x{0DFF}", "hani": "\\x{4E00}-\\x{9FFF}"}
# fixed values: characters without width, and Cyrillic and Greek letters with the Latin ones that they look like
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
LOOKALIKES = ("аеорсхіѕАВЕКМНОРСТХІοΑΒΕΗΙΚΜΝΟΡΤΧ", "aeopcxisABEKMHOPCTXIoABEHIKMNOPTX")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def detect_script(text: Column) -> Column:
    """The script with most characters; of equal ones, that met first; `latn` where there is none of them."""
    best = F.array(*(F.struct(F.regexp_count(text, F.lit(f"[{r}]")).alias("n"), (-F.regexp_instr(text, F.lit(f"[{r}]"))).alias("at"), F.lit(name).alias("script")) for name, r in SCRIPTS.items()))
    top = F.array_max(best)
    return F.when(F.coalesce(top["n"], F.lit(0)) == 0, F.lit("latn")).otherwise(top["script"])


def estimate_tokens(text: Column) -> Column:
    """Latin characters / 4 + others / 2, halves to even, 1 at least; 0 for a blank text. A character over U+024F isn't Latin."""
    other = F.regexp_count(text, F.lit("[^\\x{0000}-\\x{024F}]"))
    raw = (F.length(text) - other) / 4.0 + other / 2.0
    return F.when(F.coalesce(F.length(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(raw, 0).cast("int")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n[ \t]*\n"), strip), lambda x: x != "")


def split_sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(paragraph, r"(?U)(?<=[.!?।॥])\s+"), strip), lambda x: x != "")


def is_supported(sentence: Column, source: Column) -> Column:
    """Whether the sentence stands word for word in the source, white space apart."""
    found = F.instr(collapse_space(source), collapse_space(sentence)) > 0
    return F.coalesce((collapse_space(sentence) != "") & found, F.lit(False))


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, for which Spark has no function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def plain_letters(text: Column) -> Column:
    """Compatibility forms composed, zero-width characters removed, lookalike letters as Latin ones."""
    return F.translate(F.translate(compatible(text), ZERO_WIDTH, ""), *LOOKALIKES)


# fixed values: patterns of instructions that don't belong in data, by class
FLAG_PATTERNS = {
    "ignore_previous_instructions": r"(?is)\b(ignore|disregard|forget)\b.{0,40}\b(previous|above|prior|earlier|all)\b.{0,20}\b(instructions?|prompts?|rules?)\b",
    "ignore_previous_instructions_hinglish": r"(?is)\b(instructions?|niyam)\b.{0,20}\b(ko|ke)\b.{0,20}\b(ignore|bhool|bhul|chhod)\b",
    "ignore_previous_instructions_devanagari": r"निर्देश\S*\s+को\s+(अनदेखा|भूल)",
    "ignore_previous_instructions_tamil": r"வழிமுறைக\S*\s+(புறக்கணி|மற)",
    "role_coercion": r"(?i)\b(you are now|pretend (that )?you are|you must (now )?act as|from now on,? you)\b",
    "system_prompt_exfiltration": r"(?is)\b(reveal|print|show|repeat|output)\b.{0,30}\b(system prompt|your (instructions|prompt)|everything above)\b",
    "echo_demand": r"(?is)\b(print|repeat|output|echo|reply with|say)\b.{0,40}\b(verbatim|token|the following|below)\b|\bconfirm (that )?you (have )?read\b",
    "chat_syntax_lookalike": r"(?i)(<\|im_start\|>|\[INST\]|<start_of_turn>|<tool_call>|\"role\"\s*:\s*\"system\")",
    "new_instructions_header": r"(?i)\bnew (instructions?|task|objective)\s*:",
}


def instruction_classes(text: Column) -> Column:
    """Names of the classes whose pattern matches the text, as it is or normalised, in the order of the classes."""
    plain = plain_letters(text)
    names = [F.when(text.rlike(f"(?U){p}") | plain.rlike(f"(?U){p}"), F.lit(n)) for n, p in FLAG_PATTERNS.items()]
    return F.array_compact(F.array(*names))


def title_perturbations(title: Column) -> Column:
    """Spellings that a title is also written in: doubled consonants single, aa as a, the first i as ee, no blanks. Each
    once, none equal to the title but for case."""
    forms = F.array(F.regexp_replace(title, r"(?i)([b-df-hj-np-tv-z])\1", "$1"), F.regexp_replace(title, "(?i)aa", "a"), F.regexp_replace(title, "^([^iI]*)[iI]", "$1ee"), F.replace(title, F.lit(" "), F.lit("")))
    return F.filter(F.array_distinct(F.transform(forms, lambda x: F.lower(x))), lambda x: x != F.lower(title))


def parse_intent(text: Column) -> Column:
    """struct(intent, slots) of a first line `INTENT: {json}`; null where there is none or it has no intent."""
    line = F.trim(F.get(F.split(F.ltrim(text), "\n"), 0))
    body = F.when(line.startswith("INTENT:"), F.regexp_replace(line, "^INTENT:", ""))
    parsed = F.from_json(body, "intent string, slots map<string,string>")
    return F.when(parsed["intent"].isNotNull(), parsed)


def parse_verdict(text: Column) -> Column:
    """Score of the JSON object in a judge's answer; null where there is none or it lies outside 0 to 1."""
    score = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "score double, rationale string")["score"]
    return F.when(score.between(0, 1), score)


def read_verdict(text: Column) -> Column:
    """struct(score, criteria map<string, boolean>, rationale, error) of the JSON object in a judge's answer. error tells why there is no
    score: no object, none in it, or one outside 0 to 1; criteria that aren't an object are none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    keys = F.json_object_keys(found)
    score = F.get_json_object(found, "$.score")
    number = F.when(score.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), score.try_cast("double"))
    error = F.when(keys.isNull(), "no JSON object").when(number.isNull(), "no score").when(~number.between(0, 1), "score out of range")
    criteria = F.coalesce(F.from_json(F.get_json_object(found, "$.criteria"), "map<string, boolean>"), F.from_json(F.lit("{}"), "map<string, boolean>"))
    ok = error.isNull()
    return F.struct(F.when(ok, number).alias("score"), F.when(ok, criteria).alias("criteria"), F.when(ok, F.get_json_object(found, "$.rationale")).alias("rationale"), error.alias("error"))


def datamark(text: Column, mark: str = "ˆ") -> Column:
    return F.replace(text, F.lit(" "), F.lit(mark))
