"""Wide tables: suffix plan (R7), generated-feature plan (R4), serving plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform import rules
from strataform.operators.aggregates import suffix_aggregate
from strataform.operators.joins import join_batches, join_topics, left_join, with_decision
from strataform.operators.projections import (
    calendar_parts, date_to_period, days_since_decision, narrow_types, project, suffix_cast, tag_clashing,
)
from strataform.operators.setops import concat_relaxed, unique_by_key
from strataform.operators.splits import fraction_split, with_fold
from strataform.plans.definition import Feature, compute_features, feature_batches
from strataform.session import materialise


def topic_rows(parts: Sequence[DataFrame], depth: int, table: Mapping = rules.TRAIN_RULES,
               requested: Sequence[str] | None = None) -> DataFrame:
    """All parts of a topic, cast by suffix and reduced to one row per case.

    Aggregating over all parts at once is what keeps a case that spans parts whole.
    """
    rows = suffix_cast(concat_relaxed(parts) if len(parts) > 1 else parts[0])
    if depth == 0:
        return unique_by_key(rows) if len(parts) > 1 else rows
    return suffix_aggregate(rows, table, requested)


def suffix_matrix(
    base: DataFrame, depth0: Sequence[DataFrame], children: Sequence[DataFrame],
    table: Mapping = rules.TRAIN_RULES, requested: Sequence[str] | None = None,
) -> DataFrame:
    """R7 up to the wide table: calendar parts, ordered joins, dates as days."""
    static = [suffix_cast(t) for t in depth0]
    reduced = [topic_rows([c], 1, table, requested) for c in children]
    wide = join_topics(calendar_parts(suffix_cast(base)), [*static, *reduced])
    return days_since_decision(wide)


def folds(
    wide: DataFrame, train_ratio: float, count: int, base: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """R7 splits: (training rows with ``fold``, test rows).

    With ``base`` the week sizes are counted there and not over the wide plan.
    """
    train, test = fraction_split(wide, train_ratio)
    sizes = None if base is None else fraction_split(base, train_ratio)[0]
    return with_fold(train, count, sizes=sizes), test


def feature_matrix(
    base: DataFrame, depth0: Sequence[DataFrame], topics: Mapping[str, DataFrame],
    features: Mapping[str, Sequence[Feature]], narrow: bool = False,
) -> DataFrame:
    """Base with static topics and the selected features of each child topic."""
    wide = base.select(rules.KEY, "target", "date_decision")
    for table in depth0:
        wide = left_join(wide, table, [rules.KEY])
    frames = []
    for name, rows in topics.items():
        if not features.get(name):
            continue
        data = compute_features(with_decision(rows, base), features[name], sizes=rows).drop("target")
        frames.append(tag_clashing(data, name))
    wide = date_to_period(join_batches(wide, frames))
    return narrow_types(materialise(wide, "matrix")) if narrow else wide


def serving_matrix(
    base: DataFrame, depth0: Sequence[DataFrame], topics: Mapping[str, DataFrame],
    features: Mapping[str, Sequence[Feature]], wanted: Sequence[str],
    batch_size: int | None = None,
) -> DataFrame:
    """The same for rows without a target, cut to the model's feature list.

    One scan per topic, unless ``batch_size`` asks for slices of features.
    """
    wide = base.select(rules.KEY, "date_decision")
    for table in depth0:
        kept = [c for c in table.columns if c == rules.KEY or c in wanted]
        wide = left_join(wide, table.select(*kept), [rules.KEY])
    frames = []
    for name, rows in topics.items():
        if features.get(name):
            joined = with_decision(rows, base, train=False)
            size = batch_size or len(features[name])
            batches = feature_batches(joined, features[name], size, train=False, sizes=rows)
            frames += [tag_clashing(b, name) for b in batches]
    wide = date_to_period(join_batches(wide, frames), serving=True)
    return project(wide, wanted, keep=(rules.KEY,))


def fold_frames(train: DataFrame, count: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) per fold of a frame with ``fold``."""
    return [
        (train.where(F.col("fold") != i).drop("fold"), train.where(F.col("fold") == i).drop("fold"))
        for i in range(count)
    ]
