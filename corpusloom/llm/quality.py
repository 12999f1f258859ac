"""Quality rules with DataFrame functions only: statistics of whole texts, and a decision list learned from labels.

The list is learned by sequential covering on a bounded sample of labelled rows: a conjunction of threshold conditions is
grown on two thirds of the rows by information gain, pruned on the rest, and what it covers is set aside for the next
rule. The result is an ordered list of Spark conditions; the first that holds decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, SPACE_CLASS, materialize, text_of

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Labelled rows that are learned from, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
#: What rules may test: ratios, so that a rule means the same for a short and a long text.
FEATURES = {
    "symbol_ratio": "n_symbols / greatest(1, word_chars)",
    "repeat_ratio": "n_repeat_words / greatest(1, n_words)",
    "dup_line_ratio": "n_dup_lines / greatest(1, n_lines)",
    "upper_ratio": "n_upper / greatest(1, word_chars)",
    "mark_ratio": "n_marks / greatest(1, n_words)",
    "digit_ratio": "n_digits / greatest(1, word_chars)",
    "mean_word": "word_chars / greatest(1, n_words)",
    "words": "cast(n_words AS double)",
}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with STATISTICS (longs) of the whole text added, in place of columns of those names. A null text has none
    of anything, like an empty one. n_repeat_words: words in 5-word windows found twice or more in the text."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    out = docs.drop(*STATISTICS).withColumns({"_words": F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != ""), "_lines": lines})
    out = out.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    out = out.withColumns({"n_symbols": _count(text, r"[#*$%&|<>]"), "n_upper": _count(text, r"\p{Lu}"), "n_marks": _count(text, r"[!?]"), "n_digits": _count(text, r"[0-9]")}).drop("_words", "_lines")
    window = F.transform("_hashes", lambda x, i: F.xxhash64(x, *(F.get("_hashes", i + k) for k in range(1, WINDOW))))
    out = out.withColumn("_windows", F.slice(window, F.lit(1), F.greatest(F.lit(0), F.size("_hashes") - (WINDOW - 1)))).drop("_hashes")
    # only texts with a window twice go on: windows sorted by hash, those equal to a neighbour, then the words under them
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    twins = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)))
    out = out.withColumn("_starts", F.sort_array(F.transform(twins, lambda x: x["i"]))).drop("_sorted")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    under = F.aggregate("_starts", zero, lambda s, p: F.struct((s["n"] + (p + WINDOW) - F.greatest(p, s["reach"])).alias("n"), (p + WINDOW).alias("reach")), lambda s: s["n"])
    return out.withColumn("n_repeat_words", F.coalesce(under, F.lit(0).cast("long"))).drop("_starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold), with what it covered when learned."""

    conditions: tuple[tuple[str, str, float], ...]
    rejected: int
    kept: int

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.conditions)


def _covers(rows: dict[str, np.ndarray], conditions, n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for feature, op, threshold in conditions:
        held &= rows[feature] <= threshold if op == "<=" else rows[feature] > threshold
    return held


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> list[tuple[str, str, float]]:
    """Conditions added one by one, each with the largest gain, until the rule covers no kept row or nothing gains."""
    conditions: list[tuple[str, str, float]] = []
    held = np.ones(len(bad), bool)
    while len(conditions) < most:
        p0, n0 = int(bad[held].sum()), int((~bad[held]).sum())
        if not p0 or not n0:
            break
        best = (0.0, None)
        for feature, values in rows.items():
            own = np.unique(values[held & bad] if len(values) else values)
            grid = np.unique(np.quantile(np.unique(values[held]), np.linspace(0, 1, cuts), method="lower"))
            grid = np.unique(np.concatenate([grid, own[:: max(1, len(own) // cuts)]]))
            order = np.sort(values[held & bad]), np.sort(values[held & ~bad])
            p, n = (np.searchsorted(x, grid, "right") for x in order)
            for op, ps, ns in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - math.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (feature, op, float(grid[i])))
        if best[1] is None:
            break
        feature, op, threshold = best[1]
        above = rows[feature][held & (rows[feature] > threshold)]
        if len(above):  # half-way to the next value that was seen
            best = (best[0], (feature, op, (threshold + float(above.min())) / 2))
        conditions.append(best[1])
        held &= _covers(rows, [best[1]], len(bad))
    return conditions


def learn_list(rows: dict[str, np.ndarray], bad: np.ndarray, in_grow: np.ndarray, min_precision: float = 0.9, min_covered: int = 3, max_rules: int = 12, max_conditions: int = 4, cuts: int = 64) -> list[Rule]:
    """Ordered rules that reject. A rule enters the list only if at least `min_precision` of all remaining rows that it
    covers are bad, counted with one more kept row than there is, and it covers `min_covered` bad ones."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules and bad[left].any():
        grow, prune = left & in_grow, left & ~in_grow
        conditions = _grow({f: v[grow] for f, v in rows.items()}, bad[grow], max_conditions, cuts)
        if not conditions:
            break

        def worth(kept, prune=prune) -> float:
            held = _covers(rows, kept, len(bad)) & prune
            p, n = int(bad[held].sum()), int((~bad[held]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        held = _covers(rows, conditions, len(bad)) & left
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        if p < min_covered or p / (p + n + 1) < min(min_precision, p / (p + 1)):
            break
        rules.append(Rule(tuple(conditions), p, n))
        left &= ~held
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Rules for rows of quality 0, learned from at most `max_labelled` labelled rows that pass the base. None if there
    are no labelled rows of either kind. Rows with a null label or id aren't learned from; of several labels of one id, the
    least counts."""
    chosen = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.min(quality_col).alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))  # max_labelled small rows
    # no filter on statistics in the plan: it would be pushed below them and have them computed again and again
    found = with_statistics(joined, "_text")
    names = list(FEATURES)
    rows = found.select(base_failed().alias("failed"), (F.col("_quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(3)) > 0).alias("grow"), F.xxhash64("_id").alias("h"), *(F.expr(sql).alias(f) for f, sql in FEATURES.items())).orderBy("h").limit(max_labelled).collect()
    rows = [r for r in rows if not r["failed"]]
    if not rows:
        return []
    bad, grow = (np.array([r[k] for r in rows], bool) for k in ("bad", "grow"))
    return learn_list({f: np.array([r[f] for r in rows], float) for f in names}, bad, grow, **options)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """`docs` with STATISTICS, base_failed, rule int (number of the first rule that holds, else null) and kept boolean."""
    out = with_statistics(docs, text_col).withColumn("base_failed", base_failed())
    first = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        first = F.when(F.expr(rules[i].sql()), F.lit(i)).otherwise(first)
    return out.withColumn("rule", first).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_clean(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of `docs` that judge() keeps, with the columns of `docs`; these may have names that judge() gives. The verdicts
    are written with the rows before the filter, which is otherwise pushed below the statistics."""
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.select(*(F.col(c).alias(n) for c, n in own.items())), rules, own[text_col])
    return materialize(judged.select(*own.values(), "kept")).where("kept").select(*(F.col(n).alias(c) for c, n in own.items()))
