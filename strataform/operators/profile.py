"""Counts, profiles and top-k lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.functions.columns import NUMERIC, columns_of
from strataform.functions.order_stats import exact_quantiles, long_values


def count_of_counts(df: DataFrame, key: str, column: str | None = None) -> DataFrame:
    """How many keys have a given number of rows (or of distinct values of ``column``)."""
    size = F.count_distinct(column) if column else F.count(F.lit(1))
    sizes = df.groupBy(key).agg(size.alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("keys"))


def group_size_summary(df: DataFrame, key: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of the group sizes."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return summary(sizes, ["size"])


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column, quartiles exact."""
    columns = list(columns or columns_of(df, *NUMERIC))
    values = long_values(df, [], columns)
    moments = values.groupBy("col").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(values, ["col"], [0.25, 0.5, 0.75], few_groups=True).select(
        "col", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return moments.join(quartiles, "col", "left").select(
        "col", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def sample_values(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first non-null value of each column, as text; ``order`` makes it repeatable."""
    columns = [c for c in df.columns if c not in order]
    by = F.struct(*order)
    one = df.agg(*[
        F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns
    ])
    return one.unpivot([], columns, "col", "sample")


def value_frequencies(
    df: DataFrame, column: str, with_nulls: bool = False, where: Column | None = None
) -> DataFrame:
    """Rows per value, most frequent first."""
    rows = df if where is None else df.where(where)
    if not with_nulls:
        rows = rows.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), F.asc_nulls_last(column)
    )


def null_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of null flags."""
    flags = df.select(*[F.col(c).isNull().alias(c) for c in columns])
    return flags.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def prefix_histogram(df: DataFrame, column: str, length: int = 7) -> DataFrame:
    """Rows per leading text, year and month for a date."""
    part = F.substring(F.col(column).cast("string"), 1, length)
    rows = df.where(F.col(column).isNotNull()).groupBy(part.alias("prefix"))
    return rows.agg(F.count(F.lit(1)).alias("count")).orderBy("prefix")


def distinct_profile(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Distinct non-null values of every column of a slice.

    Unpivoted and deduplicated, so the plan has one branch however many columns.
    """
    rows = df if where is None else df.where(where)
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "col", "value"
    ).distinct()
    return long.groupBy("col").agg(F.count("value").alias("nunique"))


def null_shares(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Share of nulls of every column of a slice."""
    rows = df if where is None else df.where(where)
    one = rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "col", "null_share")


def complete_columns(df: DataFrame, where: Column | None = None) -> list[str]:
    """Columns of a slice without a null."""
    return [r["col"] for r in null_shares(df, where).where("null_share = 0").collect()]


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """O2: the ``k`` most frequent non-null values per column (col, value, count, rank).

    Counts are combined before the shuffle, and Spark pushes the rank limit to the
    map side (WindowGroupLimit), so a column with very many values stays spread out.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "col", "value"
    ).where("value IS NOT NULL")
    counts = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("count"), F.asc("value")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def top_importances(pairs: DataFrame, k: int) -> DataFrame:
    """O3: the ``k`` largest importances of (feature, importance) rows."""
    return pairs.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def split_importances(
    importances: dict[str, float], continuous: Sequence[str], k: int
) -> tuple[list[str], list[str]]:
    """O3: top ``k`` feature names as (continuous, categorical)."""
    top = sorted(importances, key=lambda c: (-importances[c], c))[:k]
    numbers = set(continuous)
    return [c for c in top if c in numbers], [c for c in top if c not in numbers]


def rows_of_key(df: DataFrame, key: str, value, order: str) -> DataFrame:
    """The rows of one key in date order; the key test reaches the scan."""
    return df.where(F.col(key) == value).orderBy(order)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)
