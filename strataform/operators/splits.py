"""Samples, folds and hold-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform import rules
from strataform.functions.columns import key_bucket
from strataform.functions.order_stats import running_before
from strataform.operators.projections import bucket_split, month_label, week_group
from strataform.session import materialise

BUCKETS = 10000
# Groups that are dealt one by one.
HEADS = 10_000


def fraction_split(
    df: DataFrame, fraction: float, key: str = rules.KEY, salt: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(sampled rows, the other rows) by a hash of the key."""
    inside = key_bucket(key, buckets=BUCKETS, salt=salt) < int(round(fraction * BUCKETS))
    return df.where(inside), df.where(~inside)


def fold_table(df: DataFrame, folds: int, group: str = "WEEK_NUM", heads: int = HEADS) -> DataFrame:
    """``_g, fold`` per group, null included; a stored table, so that a recomputed task sees the same folds.

    The ``heads`` largest groups go one by one, each to the fold with the fewest rows; only they reach the driver.
    Each other group has at most 1 / ``heads`` of the rows: they are laid out by a hash of the group and cut where
    a fold reaches its share, so that no fold is off by more than one of them.
    """
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    sizes = materialise(df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    order = [F.col("n").desc(), F.col("_g").asc_nulls_first()]
    top = sizes.orderBy(*order).limit(heads).collect()
    load = [0] * folds
    dealt = []
    for row in top:
        fold = min(range(folds), key=lambda f: (load[f], f))
        dealt.append((row["_g"], fold))
        load[fold] += row["n"]
    table = spark.createDataFrame(dealt, f"_g {kind}, fold int")
    if len(top) < heads:
        return table
    known = F.broadcast(table.select(F.col("_g").alias("_k")))  # ``heads`` rows
    rest = sizes.join(known, F.col("_g").eqNullSafe(F.col("_k")), "left_anti")
    rest = rest.select("_g", "n", F.xxhash64("_g").alias("_h"))
    total = rest.agg(F.sum("n")).first()[0] or 0
    # Fill the folds to one level: those above it get nothing.
    open_folds = sorted(range(folds), key=lambda f: (load[f], f))
    while total + sum(load[f] for f in open_folds) < load[open_folds[-1]] * len(open_folds):
        open_folds.pop()
    level = (total + sum(load[f] for f in open_folds)) / len(open_folds)
    edge, fold = 0.0, F.lit(open_folds[-1])
    edges = []
    for f in open_folds[:-1]:
        edge += level - load[f]
        edges.append((edge, f))
    for edge, f in reversed(edges):
        fold = F.when(F.col("before_n") < edge, F.lit(f)).otherwise(fold)
    # One row per hash: groups that share one go the same way.
    ranked = running_before(rest.groupBy("_h").agg(F.sum("n").alias("n")), [], "_h", ["n"])
    others = rest.join(ranked.select("_h", "before_n"), "_h").select("_g", fold.cast("int").alias("fold"))
    return materialise(table.unionByName(others), "folds")


def with_fold(
    df: DataFrame, folds: int, group: str = "WEEK_NUM", sizes: DataFrame | None = None, heads: int = HEADS
) -> DataFrame:
    """Rows with ``fold``; all rows of a group share one. ``sizes``: a cheaper frame
    with the same groups to count. The size of the table of groups decides how it is joined."""
    table = fold_table(df if sizes is None else sizes, folds, group, heads)
    return df.join(table, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def time_split(df: DataFrame, train: int, parts: int = 5, weeks: int = 92):
    """T4: (train, test) where train is one slice of the week axis."""
    grouped = df.withColumn("week_group", week_group(F.col("WEEK_NUM"), parts, weeks))
    return bucket_split(grouped, "week_group", train)


def month_split(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T5: (development, validation, test) by month."""
    labelled = df.withColumn("devval", month_label(F.col("MONTH")))
    return tuple(labelled.where(F.col("devval") == i).drop("devval") for i in range(3))
