"""From fold folders to evaluated models (V11), and from a wide table to selected features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform import rules
from strataform.operators import metrics, models
from strataform.operators.encode import fit_standardise, standardise
from strataform.operators.profile import split_importances
from strataform.operators.splits import fraction_split
from strataform.operators.windows import back_fill
from strataform.session import materialise
from strataform.sources.writers import write_report, write_scores


def evaluation(scored: DataFrame, name: str, label: str = "target", week: str = "WEEK_NUM") -> DataFrame:
    """One row: ``model, rows, auc, log_loss, stability`` of a stored score frame."""
    one = F.lit(1).alias("_one")
    rows = scored.select(one, label, "score", week)
    out = (
        rows.groupBy("_one").agg(F.count(F.lit(1)).alias("rows"))
        .join(metrics.auc(rows, ["_one"], label), "_one", "left")
        .join(metrics.log_loss(rows, ["_one"], label), "_one", "left")
        .join(metrics.stability(rows, week, label).select(one, "stability"), "_one", "left")
    )
    return out.select(F.lit(name).alias("model"), "rows", "auc", "log_loss", "stability")


def train_and_evaluate(
    ensemble: Sequence[tuple[str, Mapping, DataFrame, DataFrame]], features: Sequence[str], test: DataFrame, out_dir: str,
    label: str = "target", week: str = "WEEK_NUM", key: str = rules.KEY,
) -> tuple[DataFrame, DataFrame]:
    """``(scores, report)`` of an ensemble of models ``(name, tree settings, train, validation)``.

    Each model stops early on its validation rows, scores the test rows and is
    saved below ``out_dir/models``; its scores stay in ``out_dir/scores``. The ensemble's score is the mean. ``scores`` has key, week, label
    and score; ``report`` has one row per model and one for the ensemble, which are also written as
    CSV, as are the ensemble's AUC by week and its scores.
    """
    names = [name for name, *_ in ensemble]
    if not names or len(set(names)) < len(names):
        raise ValueError(f"an ensemble needs models of different names, not {names}")
    features = list(features)
    spark = test.sparkSession
    frames, reports = [], []
    for name, settings, train, held in ensemble:
        model = models.train_trees(train.select(*features, label), features, label, held.select(*features, label), settings)
        path = f"{out_dir}/scores/{name}"
        models.score_frame(model, test, features, [key, week, label]).write.mode("overwrite").parquet(path)
        frames.append(spark.read.parquet(path))
        reports.append(evaluation(frames[-1], name, label, week))
        models.save_model(model, {}, features, f"{out_dir}/models/{name}")
    mean = metrics.ensemble_mean(frames, key)
    scores = materialise(test.select(key, week, label).join(mean, key, "left"), "ensemble")
    report = reports[0]
    for more in [*reports[1:], evaluation(scores, "ensemble", label, week)]:
        report = report.unionByName(more)
    report = materialise(report, "evaluation")
    write_report(report, f"{out_dir}/report")
    write_report(metrics.auc(scores, [week], label), f"{out_dir}/auc_by_week")
    write_scores(scores, f"{out_dir}/submission", key)
    return scores, report


@dataclass(frozen=True)
class Selection:
    """What a selection dropped as correlated, and the features it kept."""

    dropped: tuple[str, ...]
    continuous: tuple[str, ...]
    categorical: tuple[str, ...]


def select_features(
    df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], top: int, fraction: float = 1.0,
    label: str = "target", key: str = rules.KEY, threshold: float = 0.9, params: Mapping | None = None,
) -> Selection:
    """The ``top`` features by importance, of those that do not repeat an earlier one.

    Takes a share of the keys, fills nulls from the next row in key order (an integer), standardises
    the continuous features, drops what correlates with an earlier feature, and trains trees on the
    rest. A continuous feature without deviation is null throughout and has no importance.
    """
    features = [*continuous, *categorical]
    rows, _ = fraction_split(df.select(key, label, *features), fraction, key, "selection")
    rows = materialise(back_fill(rows, features, key), "selection")
    spec = fit_standardise(rows, continuous)
    scale = {c: entry["properties"] for c, entry in spec.items()}
    rows = rows.select(key, label, *categorical, *[
        standardise(c, scale[c]["mean"], scale[c]["stddev"]) if c in scale else F.lit(None).cast("double").alias(c)
        for c in continuous
    ])
    dropped = set(models.correlated_columns(rows, continuous, categorical, label, threshold))
    left = [c for c in features if c not in dropped]
    found = models.importances(models.train_trees(rows, left, label, params=params), left)
    kept = split_importances(found, continuous, top)
    return Selection(tuple(c for c in features if c in dropped), *map(tuple, kept))
