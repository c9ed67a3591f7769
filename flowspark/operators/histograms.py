"""Histograms and entropy over long tables of (group columns, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON_DIGITS = 12  # entropies are rounded here, so that summation order cannot move a bucket


def unpivot(df: DataFrame, columns: list[str], keep=()) -> DataFrame:
    """One row per (feature, value)."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")


def log2(x: Column) -> Column:
    return F.log2(x)


def with_range(df: DataFrame, by: list[str], value: str = "value", small_groups: bool = False,
               few_groups: bool = False) -> DataFrame:
    """Add ``low`` and ``high``, the range of the value per group.

    Groups of bounded size (row windows) are ranged in place; others (a whole feature) by a
    partial aggregate joined back, so that no task holds a whole group. With ``few_groups`` the caller
    vouches that the groups are as few as columns of a table: their ranges are broadcast, and the rows
    are not shuffled by a handful of hot keys.
    """
    if small_groups:
        group = Window.partitionBy(*by)
        return df.withColumns({"low": F.min(value).over(group), "high": F.max(value).over(group)})
    ranges = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return df.join(F.broadcast(ranges) if few_groups else ranges, by)


def bucket_of(num_ranges: int, value: str = "value") -> Column:
    """Bucket of a value inside the range [low, high] of its group."""
    x, low, high = F.col(value), F.col("low"), F.col("high")
    return F.when(high == low, 0).otherwise(F.floor((x - low) / (high - low) * num_ranges)).cast("int")


def entropy_of(n: int, count: str = "n") -> Column:
    """Entropy in bits over bucket counts, as shares of n rows."""
    share = F.col(count) / F.lit(float(n))
    return F.round(-F.sum(share * log2(share)), EPSILON_DIGITS) + 0.0


def value_histogram(
    df: DataFrame, num_ranges: int, by: list[str], value: str = "value", small_groups: bool = False,
    few_groups: bool = False,
) -> DataFrame:
    """Counts per bucket floor((x - min) / (max - min) * num_ranges) of each group.

    The maximum falls into bucket ``num_ranges``; a constant group has the single bucket 0.
    """
    return (
        with_range(df.where(F.col(value).isNotNull()), by, value, small_groups, few_groups)
        .groupBy(*by, bucket_of(num_ranges, value).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )


def even_histogram(df: DataFrame, num_ranges: int, by: list[str], value: str = "value",
                   few_groups: bool = False) -> DataFrame:
    """Counts of ``num_ranges`` even buckets over [min, max] with their edges, empty ones included.

    The last bucket is closed; a constant group has the single bucket [min, min].
    """
    present = df.where(F.col(value).isNotNull())
    ranges = present.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    x, low, high = F.col(value), F.col("low"), F.col("high")
    position = F.floor((x - low) / (high - low) * num_ranges)
    bucket = F.when(high == low, 0).otherwise(F.least(position, F.lit(num_ranges - 1)))
    counts = (
        present.join(F.broadcast(ranges) if few_groups else ranges, by).groupBy(*by, bucket.cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    last = F.when(high == low, 0).otherwise(num_ranges - 1)
    edge = lambda i: low + (i * (high - low)) / num_ranges
    layout = ranges.withColumn("bucket", F.explode(F.sequence(F.lit(0), last)))
    return (
        layout.join(counts, [*by, "bucket"], "left")
        .select(
            *by, "bucket", edge(F.col("bucket")).alias("lower"),
            F.when(F.col("bucket") == last, high).otherwise(edge(F.col("bucket") + 1)).alias("upper"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def top_bucket(histogram: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent bucket of each group, the first of them on ties."""
    best = F.max_by(F.struct("bucket", *[c for c in ("lower", "upper") if c in histogram.columns], "n"),
                    F.struct(F.col("n"), -F.col("bucket")))
    return histogram.groupBy(*by).agg(best.alias("top")).select(*by, "top.*")


def entropy(
    df: DataFrame, num_ranges: int, n: int, by: list[str], value: str = "value", small_groups: bool = True
) -> DataFrame:
    """Entropy in bits of each group's value histogram; n is the nominal number of rows."""
    counts = value_histogram(df, num_ranges, by, value, small_groups)
    return counts.groupBy(*by).agg(entropy_of(n).alias("entropy"))
