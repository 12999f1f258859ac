"""Evaluation over recorded results: thresholds, allocations, agreement, decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import written


def running_sums(rows: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """`rows` with before_<c> for each of `sums`: its sum over the rows of the group that come before. Rows are dealt by ranges of
    group and order, so a group may fill many tasks: sums run within a range, then over the few ranges of each group. The
    ranges are written once, since both steps must see the same ones."""
    ranged = written(rows.repartitionByRange(*groups, order).withColumn("_range", F.spark_partition_id()))
    start = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy(*groups, "_range").agg(*(F.sum(c).alias(c) for c in sums))  # a row per group and range that meet
    over = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range")
    bases = totals.select(*(F.col(g).alias(f"_of_{g}") for g in groups), F.col("_range").alias("_of"), *(start(c, over).alias(f"_base_{c}") for c in sums))
    within = Window.partitionBy(*groups, "_range").orderBy(order)
    run = ranged.withColumns({f"_run_{c}": start(c, within) for c in sums})
    same = F.col("_range") == F.col("_of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return run.join(bases, same).select(*rows.columns, *((F.col(f"_base_{c}") + F.col(f"_run_{c}")).alias(f"before_{c}") for c in sums))


def sweep_thresholds(scores: DataFrame, score: str, is_positive: str) -> DataFrame:
    """For each distinct score as threshold t: negatives under t (true abstains), negatives at or over it (false accepts),
    positives under it (false rejects), and F1 of abstaining. One pass over counts per score, no join of rows with rows."""
    per = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(is_positive)).alias("p"), F.count_if(~F.col(is_positive)).alias("n"))
    run = running_sums(per, [], score, ["p", "n"])
    negatives = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))  # one row
    out = run.join(F.broadcast(negatives)).select(F.col(score).alias("threshold"), F.col("before_n").alias("true_abstains"), (F.col("all_n") - F.col("before_n")).alias("false_accepts"), F.col("before_p").alias("false_rejects"))
    total = 2 * F.col("true_abstains") + F.col("false_accepts") + F.col("false_rejects")
    return out.withColumn("f1", F.round(2.0 * F.col("true_abstains") / F.nullif(total, F.lit(0)), 6))


def allocate(shares: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """Largest-remainder allocation of `total` over shares; equal remainders by key. One row per key of a small table."""
    exact = shares.withColumn("_exact", F.col(share) / F.sum(share).over(Window.partitionBy(F.lit(0))) * total)
    floored = exact.withColumns({"_floor": F.floor("_exact"), "_rest": F.round(F.col("_exact") - F.floor("_exact"), 9)})
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), F.asc(key)))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    return floored.select(key, (F.col("_floor") + F.when(order <= left, 1).otherwise(0)).alias("allocated"))


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 7) -> DataFrame:
    """`rows` with is_validation: in each stratum, the max(1, round(n share)) rows of the smallest seeded hashes.

    The threshold hash of a stratum is found over counted hash buckets, so that no task sorts a large stratum as a whole."""
    hashed = rows.withColumns({"_h": F.xxhash64(F.lit(seed), F.col(key).cast("string")), "_b": F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1024))})
    buckets = hashed.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))  # 1024 rows a stratum at most
    run = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    want = F.greatest(F.lit(1), F.bround(F.sum("_n").over(Window.partitionBy(stratum)) * share, 0).cast("long"))
    bases = buckets.select(F.col(stratum).alias("_s"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"), want.alias("_want"))
    joined = hashed.join(bases, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")))
    rank = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))
    return joined.withColumn("is_validation", F.col("_before") + rank <= F.col("_want")).select(*rows.columns, "is_validation")


def keep_verdict(base: dict[str, Column], other: dict[str, Column], guard_ok: Column, step: float = 0.05) -> Column:
    """Keep the other run iff two metrics at least improved, one of them by `step`, none got worse and no guard failed."""
    up = [F.when(other[m] > base[m], 1).otherwise(0) for m in base]
    big = [other[m] - base[m] >= step - 1e-9 for m in base]
    down = [other[m] < base[m] for m in base]
    any_of = lambda xs: F.coalesce(F.greatest(*(x.cast("int") for x in xs)), F.lit(0)) == 1
    return (sum(up[1:], up[0]) >= 2) & any_of(big) & ~any_of(down) & guard_ok


def flatten_metrics(rows: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """(keys, metric, value double): one row per numeric or boolean field, nested ones by dotted name; nulls are left out."""
    from pyspark.sql import types as T

    leaves: list[tuple[str, Column]] = []

    def walk(schema: T.StructType, path: str, name: str) -> None:
        for f in schema.fields:
            if not path and f.name in keys:
                continue
            full, shown = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, full, shown)
            elif isinstance(f.dataType, T.NumericType):
                leaves.append((shown, F.col(full).cast("double")))
            elif isinstance(f.dataType, T.BooleanType):
                leaves.append((shown, F.col(full).cast("int").cast("double")))

    walk(rows.schema, "", prefix)
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in leaves)))
    return rows.select(*keys, pairs.alias("_m")).select(*keys, "_m.metric", "_m.value").where("value IS NOT NULL")


def order_statistics(rows: DataFrame, group: str, value: str, wanted: dict[str, Column]) -> DataFrame:
    """Per group, the sorted sample's value at each 0-based index in `wanted`, an expression over the sample size n; null for a
    null index. Values are counted first and running counts go over ranges of them: no sample and no group is in one task."""
    per = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    sizes = per.groupBy(F.col(group).alias("_g")).agg(F.sum("_c").alias("n"))
    run = running_sums(per, [group], value, ["_c"]).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    at = lambda i: F.max(F.when((F.col("before__c") <= i) & (F.col("before__c") + F.col("_c") > i), F.col(value)))
    return run.groupBy(group, "n").agg(*(at(i).alias(name) for name, i in wanted.items()))
