"""Exact ranks, running totals and quantiles that stay distributed on a hot group.

Spark's exact ``percentile`` and an unbucketed window both hold a whole group in one task.
Here each value falls into a bucket fixed by the value alone (its power of two, cut into
1024 parts), so only bucket totals are ordered per group and only the bucket a rank falls in
is sorted. Equal values are counted before any shuffle, so repeats cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS_PER_OCTAVE = 1024


def value_bucket(value: Column) -> Column:
    """A bucket number that never decreases as the value grows, from the value alone."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * PARTS_PER_OCTAVE)
    bucket = (octave + 1100) * PARTS_PER_OCTAVE + part + 1
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * bucket).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value) with ``n`` and any extra sums, plus its bucket."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(*aggs)
    return counted.withColumn("bucket", value_bucket(F.col("value")))


def running_totals(counts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_upto`` (running sum by value), ``<c>_all`` (group sum) and ``next_value``."""
    totals = counts.groupBy(*keys, "bucket").agg(
        *[F.sum(c).alias(f"{c}_b") for c in columns], F.min("value").alias("first_value_b")
    )
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "bucket",
        *[F.coalesce(F.sum(f"{c}_b").over(before), F.lit(0)).alias(f"{c}_before") for c in columns],
        *[F.sum(f"{c}_b").over(whole).alias(f"{c}_all") for c in columns],
        F.lead("first_value_b").over(by_bucket).alias("next_bucket_value"),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(offsets, [*keys, "bucket"])
        .withColumns({f"{c}_upto": F.col(f"{c}_before") + F.sum(c).over(upto) for c in columns})
        .withColumn("next_value", F.coalesce(F.lead("value").over(inside), F.col("next_bucket_value")))
        .drop("next_bucket_value", *[f"{c}_before" for c in columns])
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact quantiles per group: one column per entry of ``probs``."""
    counts = value_counts(df, keys, value)
    totals = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n_b"))
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    ranked = totals.select(
        *keys, "bucket",
        F.coalesce(F.sum("n_b").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
        F.sum("n_b").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("n_bucket_end"),
        F.sum("n_b").over(Window.partitionBy(*keys)).alias("n_all"),
    )

    def spots(name):
        place = (F.col("n_all") - 1) * F.lit(float(probs[name]))
        return F.floor(place), F.ceil(place), place - F.floor(place)

    wanted = F.lit(False)
    for name in probs:
        lo, hi, _ = spots(name)
        for spot in (lo, hi):
            wanted = wanted | ((spot >= F.col("n_before")) & (spot < F.col("n_bucket_end")))
    hit = counts.join(ranked.filter(wanted), [*keys, "bucket"])
    inside = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("upto", F.col("n_before") + F.sum("n").over(inside)).withColumn("from", F.col("upto") - F.col("n"))

    def at(spot):
        return F.max(F.when((spot >= F.col("from")) & (spot < F.col("upto")), F.col("value")))

    picks, out = [], []
    for name in probs:
        lo, hi, frac = spots(name)
        picks += [at(lo).alias(f"{name}_lo"), at(hi).alias(f"{name}_hi"), F.max(frac).alias(f"{name}_w")]
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * F.col(f"{name}_w")).alias(name))
    return hit.groupBy(*keys).agg(*picks).select(*keys, *out) if keys else hit.agg(*picks).select(*out)


def row_ranks(df: DataFrame, keys: Sequence[str], bucket_cols: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """Global 1-based rank in (bucket_cols, order) order; only one bucket is ever sorted at once."""
    totals = df.groupBy(*keys, *bucket_cols).agg(F.count(F.lit(1)).alias("n_b"))
    w = Window.partitionBy(*keys).orderBy(*bucket_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *bucket_cols, F.coalesce(F.sum("n_b").over(w), F.lit(0)).alias("rank_before"))
    inside = Window.partitionBy(*keys, *bucket_cols).orderBy(*order)
    return (
        df.join(offsets, [*keys, *bucket_cols])
        .withColumn(name, F.col("rank_before") + F.row_number().over(inside))
        .drop("rank_before")
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group: a salted pre-cut leaves at most ``n * salts`` to sort."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts))
    pre = Window.partitionBy(*keys, "salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("salt", salt)
        .withColumn("rank_in_salt", F.row_number().over(pre)).filter(F.col("rank_in_salt") <= n)
        .withColumn("rank_in_group", F.row_number().over(last)).filter(F.col("rank_in_group") <= n)
        .drop("salt", "rank_in_salt", "rank_in_group")
    )
