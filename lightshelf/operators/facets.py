"""Counts and summaries by facet, and percentiles that need no single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.scans import group_total, in_parts, running_sum


def counts_by(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    return df.select(bucket.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, terms: Column, name: str = "term", least: int = 1) -> DataFrame:
    """How many rows hold each member of an array column."""
    return df.select(F.explode(F.array_distinct(terms)).alias(name)).groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def values_by_kind(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The most frequent values of several columns, in one pass: kind, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    counted = df.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").groupBy("kind", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    return counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def _mid_rank(before: Column, ties: Column, n: Column) -> Column:
    """Mid-rank percentile: ranks before, plus half of the ties, of n; 50 for a single value."""
    return F.when(n == 1, 50.0).otherwise(F.round((before + (ties - 1) / 2.0 + 0.5) * F.lit(100.0).cast("double") / n, 3))


def percentile_within(df: DataFrame, value: str, by: list[str], out: str, part_rows: int | None = None) -> DataFrame:
    """Mid-rank percentile of `value` within each group; rows without a value get NULL.

    Counts of a group's distinct values are summed in order, a large group in parts, and come back
    to the rows by group and value.
    """
    held = df.where(F.col(value).isNotNull())
    counted = held.groupBy(*by, value).agg(F.count("*").alias("_t"))
    parts = in_parts(counted, by, [value], rows=part_rows)
    summed = group_total(running_sum(parts, F.col("_t"), "_u"), F.col("_t"), "_n").done()
    ranks = summed.select(*[F.col(c).alias(f"_{c}_") for c in [*by, value]], _mid_rank(F.col("_u") - F.col("_t"), F.col("_t"), F.col("_n")).alias(out))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*by, value]]
    return df.join(ranks, same, "left").drop(*[f"_{c}_" for c in [*by, value]])


def running_counts(df: DataFrame, value: str, n_ranges: int = 64) -> DataFrame:
    """value, its count `ties`, the count `before` of smaller values and the total `n`, without a global window.

    Distinct values are dealt to ranges by approximate quantiles; counts run
    within ranges, and the totals of the (few) ranges before are added.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    bounds = counted.agg(F.percentile_approx(value, F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)]), 1000).alias("q"))
    ranged = counted.crossJoin(F.broadcast(bounds)).withColumn("_r", F.size(F.filter("q", lambda x: x <= F.col(value)))).drop("q")  # one row of quantiles
    totals = ranged.groupBy("_r").agg(F.sum("ties").alias("_s"))
    w = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_r", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(F.lit(1))).alias("n"))  # n_ranges rows
    inner = Window.partitionBy("_r").orderBy(value)
    return ranged.withColumn("_run", F.sum("ties").over(inner) - F.col("ties")).join(F.broadcast(before), "_r").select(value, "ties", (F.col("_run") + F.col("_before")).alias("before"), "n")


def percentile_overall(df: DataFrame, value: str, out: str) -> DataFrame:
    """Mid-rank percentile of `value` among all rows; rows without one get NULL."""
    ranks = running_counts(df, value).select(F.col(value).alias("_v"), _mid_rank(F.col("before"), F.col("ties"), F.col("n")).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def weighted_mean(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not NULL, weights scaled to sum to 1; rounded to 3 places, NULL without any."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in parts.items()), F.lit(0.0))
    return F.when(total > 0, F.round(value / total, 3))


def duplicates_by(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Groups of rows with equal non-empty keys: ids in order, and how many are redundant."""
    grouped = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids"))
    return grouped.where("n > 1").withColumn("redundant", F.col("n") - 1)


def confidence_bucket(c) -> Column:
    c = S.col(c)
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c >= 0.2, "low").otherwise("very_low")


def above_and_below(scores: Column, above: int = 3, below: int = 2) -> tuple[Column, Column]:
    """Names of the best scores above the mean, and of the worst ones below the best, of a map of scores."""
    entries = F.map_entries(scores)
    mean = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["value"]) / F.size(entries)
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    keyed = lambda sign: lambda e: F.struct((e["value"] * sign).alias("v"), e["key"].alias("k"))
    strong = F.slice(F.array_sort(F.transform(F.filter(entries, lambda e: e["value"] > mean), keyed(-1))), 1, above)
    weak = F.slice(F.array_sort(F.transform(F.filter(entries, lambda e: e["value"] < best), keyed(1))), 1, below)
    return F.transform(strong, lambda s: s["k"]), F.transform(weak, lambda s: s["k"])


def outlier_floor(df: DataFrame, by: str, value: str, spread: float = 1.5) -> DataFrame:
    """Median less `spread` population standard deviations of each group."""
    return df.groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev_pop(value).alias("deviation")).withColumn("floor", F.col("median") - F.col("deviation") * spread)
