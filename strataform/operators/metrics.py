"""Score metrics (V1-V5) and score averaging (V8)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.columns import ratio
from strataform.functions.order_stats import running_before

FALLING_RATE_WEIGHT = 88.0
RESIDUAL_WEIGHT = -0.5


def _judged(df: DataFrame, label: str, score: str) -> DataFrame:
    number = F.col(score).cast("double")
    return df.where(F.col(label).isNotNull() & number.isNotNull() & ~F.isnan(number))


def auc(
    df: DataFrame, by: Sequence[str] = (), label: str = "target", score: str = "score"
) -> DataFrame:
    """V1 / V5: exact area under the ROC curve, ties counting half; null for one class.

    A positive beats every negative with a smaller score, so the area is a sum over
    distinct scores of positives * (negatives below + half the negatives beside).
    Rows without a label or a score do not count; NaN is no score.
    """
    by = list(by)
    is_one = (F.col(label) == 1).cast("long")
    counts = _judged(df, label, score).groupBy(
        *by, F.col(score).cast("double").alias("_score")
    ).agg(F.sum(is_one).alias("_pos"), F.sum(1 - is_one).alias("_neg"))
    ranked = running_before(counts, by, "_score", ["_neg"])
    wins = F.sum(F.col("_pos").cast("double") * (F.col("before__neg") + F.col("_neg") / 2))
    return ranked.groupBy(*by).agg(
        ratio(wins, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc")
    )


def log_loss(
    df: DataFrame, by: Sequence[str] = (), label: str = "target", score: str = "score",
    edge: float = 2.220446049250313e-16,
) -> DataFrame:
    """V2: mean negative log likelihood, scores clipped away from 0 and 1; rows count as in ``auc``."""
    df = _judged(df, label, score)
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(edge)), F.lit(1 - edge))
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log1p(-p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def gini_by(
    df: DataFrame, by: str = "WEEK_NUM", label: str = "target", score: str = "score",
    keep_single_class: bool = False,
) -> DataFrame:
    """V3: 2 * AUC - 1 per week; weeks of one class are skipped or kept as null."""
    weeks = auc(df, [by], label, score).select(by, (2 * F.col("auc") - 1).alias("gini"))
    return weeks if keep_single_class else weeks.where("gini IS NOT NULL")


def stability(
    df: DataFrame, week: str = "WEEK_NUM", label: str = "target", score: str = "score",
    order: str | None = None,
) -> DataFrame:
    """V4: mean gini, plus 88 * min(0, slope), minus half the deviation from the trend.

    Weeks are numbered from 0 in week order, or by their first row when ``order``
    names a row position. Everything after ``gini_by`` has one row per week.
    """
    weeks = gini_by(df, week, label, score)
    if order:
        first = df.groupBy(week).agg(F.min(order).alias("_at"))
        weeks = weeks.join(first, week)
    at = Window.partitionBy(F.lit(0)).orderBy("_at" if order else week)
    points = weeks.withColumn("_x", (F.row_number().over(at) - 1).cast("double"))
    whole = Window.partitionBy(F.lit(0))
    fitted = points.select(
        "gini", "_x",
        F.regr_slope("gini", "_x").over(whole).alias("slope"),
        F.regr_intercept("gini", "_x").over(whole).alias("_base"),
    )
    gap = F.col("gini") - (F.col("slope") * F.col("_x") + F.col("_base"))
    out = fitted.agg(
        F.count(F.lit(1)).alias("weeks"), F.avg("gini").alias("avg_gini"),
        F.max("slope").alias("slope"), F.stddev_pop(gap).alias("residual_std"),
    )
    return out.withColumn(
        "stability",
        F.col("avg_gini") + FALLING_RATE_WEIGHT * F.least(F.lit(0.0), F.col("slope"))
        + RESIDUAL_WEIGHT * F.col("residual_std"),
    )


def ensemble_mean(
    frames: Sequence[DataFrame], key: str = "case_id", score: str = "score"
) -> DataFrame:
    """V8: sum of all models' scores over the number of models, per case.

    A case that one model did not score is null, as its sum would be.
    """
    stacked = reduce(DataFrame.unionByName, [f.select(key, score) for f in frames])
    return stacked.groupBy(key).agg(
        F.when(F.count(score) == len(frames), F.sum(score) / len(frames)).alias(score)
    )
