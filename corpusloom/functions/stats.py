"""Percentiles, agreement and cost, each by its own pinned definition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(samples: Column, q: float) -> Column:
    """Sorted sample at index round(q (n - 1)), halves to even; null without samples."""
    a = F.sort_array(samples)
    return F.get(a, F.bround(F.lit(q) * (F.size(a) - 1), 0).cast("int"))


def exclusive_position(size: Column, i: int, n: int) -> tuple[Column, Column]:
    """(j, delta) of cut point i of n by the exclusive method over `size` sorted samples."""
    m = size + 1
    j = F.greatest(F.lit(1), F.least(F.floor(F.lit(i) * m / n), size - 1))
    return j, F.lit(i) * m - j * n


def exclusive_quantile(samples: Column, i: int, n: int) -> Column:
    """Cut point i of n by the exclusive method, which may lie outside the sample; null under two samples."""
    a = F.transform(F.sort_array(samples), lambda x: x.cast("double"))
    j, delta = exclusive_position(F.size(a), i, n)
    return F.when(F.size(a) >= 2, (F.get(a, j.cast("int") - 1) * (n - delta) + F.get(a, j.cast("int")) * delta) / n)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Micro-F1 of counts; 1 where there is nothing to find and nothing was."""
    total = 2 * tp + fp + fn
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * tp / F.nullif(total, F.lit(0)))


def kappa(n: Column, agree: Column, pos_a: Column, pos_b: Column) -> Column:
    """Cohen's kappa of two binary raters from counts; with chance agreement of 1, it is 1 if they agree fully, else 0."""
    size = F.nullif(n, F.lit(0)).cast("double")
    po, a, b = agree / size, pos_a / size, pos_b / size
    pe = a * b + (1 - a) * (1 - b)
    return F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))


def request_cost(latency_ms: Column, hourly_usd: float) -> Column:
    """Share of an hourly price that a request took; null without a positive latency."""
    return F.when(latency_ms > 0, F.lit(hourly_usd) * (latency_ms / 1000.0) / 3600.0)


def recall_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def reciprocal_rank(rank: Column, cutoff: int = 10) -> Column:
    return F.when(rank <= cutoff, 1.0 / rank).otherwise(0.0)
