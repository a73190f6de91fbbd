"""Data profiling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from watchfold.scale import exact_quantiles


def label_profile(df: DataFrame, label: str, amount: str) -> DataFrame:
    """One row: row and column counts, label rate and count, mean and exact median amount."""
    median = exact_quantiles(df, amount, {"q": 0.5}).select("q").scalar()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.avg(label).alias("label_rate"),
        F.sum(label).cast("bigint").alias("label_count"),
        F.avg(amount).alias("mean_amount"),
    ).withColumn("median_amount", median)


def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: share of left rows whose key occurs on the right."""
    known = right.select(F.col(key)).distinct().withColumn("__hit", F.lit(1))
    return left.select(key).join(known, key, "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("__hit").alias("matched"),
        F.avg(F.col("__hit").isNotNull().cast("int")).alias("coverage"),
    )


def null_rates(df: DataFrame, k: int = 20) -> DataFrame:
    """The k columns with the highest share of nulls, columns without any left out."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in df.columns])
    return (
        rates.select(F.inline(pairs))
        .where(F.col("null_rate") > 0)
        .orderBy(F.desc("null_rate"), "column")
        .limit(k)
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    seen = df.where(F.col(col).isNotNull())
    return seen.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def quantiles(df: DataFrame, col: str, probabilities: Mapping[str, float], exact: bool = True) -> DataFrame:
    """Quantiles of a column, interpolated; ``exact=False`` is one pass of sketches."""
    if exact:
        return exact_quantiles(df, col, probabilities)
    return df.agg(*[F.percentile_approx(col, float(p), 10_000).alias(n) for n, p in probabilities.items()])


def describe_by(df: DataFrame, key: str, col: str, groups: int | None = None) -> DataFrame:
    """Per group: count, mean, sample deviation, minimum, quartiles, maximum.

    With a bound on the number of ``groups`` only values near a quartile are shuffled.
    """
    seen = df.where(F.col(key).isNotNull() & F.col(col).isNotNull())
    basic = seen.groupBy(key).agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    quarters = exact_quantiles(seen, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [key], groups=groups)
    return basic.join(quarters, key)


def columns_like(df: DataFrame, pattern: str) -> Sequence[str]:
    import re

    return [c for c in df.columns if re.fullmatch(pattern, c)]
