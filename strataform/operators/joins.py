"""Keyed joins (J1-J13). All are equi-joins; the strategy is left to AQE."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform import rules


def _no_clash(names: Sequence[str]) -> None:
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names clash after the join: {clash}")


def left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] = (rules.KEY,), suffix: str = "_right"
) -> DataFrame:
    """Left join in which a clashing right column gets ``suffix``."""
    on = list(on)
    renames = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    right = right.withColumnsRenamed(renames)
    _no_clash([*left.columns, *[c for c in right.columns if c not in on]])
    return left.join(right, on, "left")


def join_topics(base: DataFrame, topics: Iterable[DataFrame], key: str = rules.KEY) -> DataFrame:
    """Base with all topics, in order; clashes in topic ``i`` get ``_{i}``.

    Every topic has one row per key, so all joins share the key partitioning.
    """
    for i, topic in enumerate(topics):
        base = left_join(base, topic, [key], f"_{i}")
    return base


def join_static(base: DataFrame, static: DataFrame, static_cb: DataFrame, key: str = rules.KEY) -> DataFrame:
    """Clashes of base and static get ``_base``/``_static`` on both sides; clashes
    with the bureau table leave the left name alone and get ``_static_cb`` on the right."""
    clash = [c for c in static.columns if c in base.columns and c != key]
    left = base.withColumnsRenamed({c: f"{c}_base" for c in clash})
    right = static.withColumnsRenamed({c: f"{c}_static" for c in clash})
    return left_join(left_join(left, right, [key]), static_cb, [key], "_static_cb")


def join_nested(depth1: DataFrame, nested: DataFrame) -> DataFrame:
    """Depth-1 rows with one row per (case, num_group1)."""
    return left_join(depth1, nested, [rules.KEY, "num_group1"])


def with_decision(topic: DataFrame, base: DataFrame, train: bool = True) -> DataFrame:
    """Topic rows of known cases, with the decision date and, for training, the target."""
    carried = [rules.KEY, "date_decision", *(["target"] if train else [])]
    return topic.join(base.select(*carried), rules.KEY, "inner")


def join_batches(base: DataFrame, batches: Iterable[DataFrame], key: str = rules.KEY) -> DataFrame:
    """Base with feature batches; the target they repeat is left out."""
    for batch in batches:
        base = left_join(base, batch.drop("target"), [key])
    return base


def ensemble_join(frames: Sequence[DataFrame], score: str = "score", key: str = rules.KEY) -> DataFrame:
    """The first model's rows with every model's score, and the mean of them."""
    out = frames[0].withColumnRenamed(score, f"{score}_0")
    for i, frame in enumerate(frames[1:], 1):
        out = out.join(frame.select(key, F.col(score).alias(f"{score}_{i}")), key, "left")
    names = [f"{score}_{i}" for i in range(len(frames))]
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return out.withColumn(score, total / len(frames)).drop(*names)


def with_group_totals(df: DataFrame, by: str, columns: Sequence[str], suffix: str = "_total") -> DataFrame:
    """Rows with the totals of their group.

    Totals are aggregated first and joined back, so a large group is not gathered
    in one window partition.
    """
    totals = df.groupBy(by).agg(*[F.sum(c).alias(c + suffix) for c in columns])
    return df.join(totals, by, "left")


def attach_label(topic: DataFrame, base: DataFrame, label: str = "target", key: str = rules.KEY) -> DataFrame:
    """Topic aggregate with its label."""
    return left_join(topic, base.select(key, label), [key], "_base")


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of distinct keys found in both tables."""
    common = a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")
    return common.agg(F.count(F.lit(1)).alias("common_keys"))


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")

