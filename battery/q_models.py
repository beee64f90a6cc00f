"""Models V6-V11 and selection B8-B10, on a target the features carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import metrics, models
from strataform.operators.splits import fraction_split, with_fold
from strataform.plans.training import select_features, train_and_evaluate
from strataform.session import materialise, scratch_path
from strataform.sources.writers import write_folds

FEATURES = ["mean_price", "max_price", "mean_quantity", "n_lines", "max_flag"]
SMALL = {"maxIter": 5, "maxDepth": 3}


def matrix(spark, sf_dir):
    """Case aggregates, stored as every training reads them often; the target asks whether a case has a large quantity."""
    rows = v.child1(spark, sf_dir, False).groupBy("case_id").agg(
        F.avg("price_A").alias("mean_price"), F.max("price_A").alias("max_price"),
        F.avg("quantity_A").alias("mean_quantity"), F.count(F.lit(1)).alias("n_lines"),
        F.max("flag_M").alias("max_flag"), (F.max("quantity_A") >= 40).cast("int").alias("target"),
    )
    return materialise(rows.join(v.base(spark, sf_dir).select("case_id", "WEEK_NUM"), "case_id"), "matrix")


def parts(spark, sf_dir):
    return fraction_split(matrix(spark, sf_dir), 0.75, salt="model")


def trained(spark, sf_dir, params=None):
    train, test = parts(spark, sf_dir)
    return models.train_trees(train, FEATURES, params=params or SMALL), test


QUALITY = """
SELECT count(DISTINCT l_orderkey) AS rows, true AS learned, true AS in_range FROM lineitem
WHERE ('0x' || substr(md5('model|' || CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10000 >= 7500"""


@query("v6_train_trees", QUALITY)
def v6(spark, sf_dir):
    # trained with early stopping on the held-out part, which it must rank well
    train, test = parts(spark, sf_dir)
    model = models.train_trees(train, FEATURES, validation=test, params=SMALL)
    scored = models.score_frame(model, test, FEATURES, ["case_id", "target"])
    area = metrics.auc(scored).first()["auc"]
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(area > 0.8).alias("learned"),
        F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
    )


@query("v7_batch_score")
def v7(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    return v.rounded(models.score_frame(model, test, FEATURES))


@query("v7_score_report")
def v7_report(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    return v.rounded(models.score_report(models.score_frame(model, test, FEATURES, ["target"])))


@query("v9_parameter_search")
def v9(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    grid = models.sampled_grid({"maxDepth": [2, 3], "maxIter": [2, 4]}, 2)
    _, best, values = models.search(train, test, FEATURES, grid)
    rows = [(g["maxDepth"], g["maxIter"], value, g == best) for g, value in zip(grid, values)]
    return v.rounded(spark.createDataFrame(rows, "max_depth int, max_iter int, auc double, best boolean"))


@query("v9_search_by_stability")
def v9_stability(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    grid = [{"maxDepth": 2, "maxIter": 3}]
    _, _, values = models.search(train, test, FEATURES, grid, metric="stability")
    return v.rounded(spark.createDataFrame([(values[0],)], "stability double"))


@query("v10_save_and_load", QUALITY.replace("learned", "same_scores"))
def v10(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    path = scratch_path(spark, "model")
    models.save_model(model, {"mean_price": {"type": "raw"}}, FEATURES, path)
    loaded, meta = models.load_model(spark, path)
    before = models.score_frame(model, test, FEATURES, name="before")
    after = models.score_frame(loaded, test, meta["features"], name="after")
    return before.join(after, "case_id").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("before") == F.col("after")).alias("same_scores"),
        F.bool_and(F.col("after").between(0, 1)).alias("in_range"),
    )


@query("v11_fold_ensemble")
def v11(spark, sf_dir):
    """A model per configured fold; scores averaged over the models (V8)."""
    train, test = parts(spark, sf_dir)
    folds = fraction_split(train, 0.5, salt="fold")
    scored = [
        models.score_frame(models.train_trees(folds[i], FEATURES, validation=folds[1 - i], params=SMALL), test, FEATURES)
        for i in range(2)
    ]
    return v.rounded(metrics.ensemble_mean(scored))


DECIDED = "CAST(max(l_quantity) >= 40 AS DOUBLE)"


def decided(spark, sf_dir):
    """Case aggregates with one feature, ``large``, that decides the target."""
    return matrix(spark, sf_dir).withColumn("large", F.col("target").cast("double"))


@query("v11_train_and_evaluate", f"""
WITH test AS (
  SELECT l_orderkey, {DECIDED} AS large FROM lineitem
  WHERE ('0x' || substr(md5('model|' || CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10000 >= 7500 GROUP BY l_orderkey)
SELECT model, count(*) AS rows, sum(large) AS positives, 1.0::DOUBLE AS auc, 1.0::DOUBLE AS stability,
       true AS is_mean, true AS confident
FROM test, (VALUES ('ensemble'), ('m0'), ('m1')) AS names(model) GROUP BY model""")
def v11_evaluate(spark, sf_dir):
    # one feature decides the target, so each model must rank every week without a fault
    train, test = fraction_split(decided(spark, sf_dir), 0.75, salt="model")
    folder, out = scratch_path(spark, "fold-folders"), scratch_path(spark, "evaluated")
    write_folds(with_fold(train, 2), test, folder, 2)
    settings = [{"maxIter": 10}, {"maxIter": 8, "maxDepth": 2}]
    ensemble = [
        (f"m{i}", settings[i], *(spark.read.parquet(f"{folder}/{part}{i}") for part in ("train", "val"))) for i in (0, 1)]
    scores, report = train_and_evaluate(
        ensemble, ["large", "n_lines", "max_flag"], spark.read.parquet(f"{folder}/test"), out)
    stored = [spark.read.parquet(f"{out}/scores/m{i}").select("case_id", F.col("score").alias(f"s{i}")) for i in (0, 1)]
    one = F.lit(1).alias("_one")
    told = scores.join(stored[0], "case_id").join(stored[1], "case_id").groupBy(one).agg(
        F.sum("target").cast("double").alias("positives"),
        F.bool_and(F.abs(F.col("score") - (F.col("s0") + F.col("s1")) / 2) < 1e-12).alias("is_mean"))
    return v.rounded(report.select("*", one).join(told, "_one").select(
        "model", "rows", "positives", "auc", "stability", "is_mean", (F.col("log_loss") < 0.3).alias("confident")))


@query("b7_selection_chain", f"""
SELECT l_orderkey AS case_id, {DECIDED} AS large, 'twice' AS dropped FROM lineitem GROUP BY l_orderkey""")
def b7_chain(spark, sf_dir):
    # "twice" repeats another feature and "large" decides the target: one goes, the other comes first
    rows = decided(spark, sf_dir).withColumn("twice", F.col("mean_price") * 2)
    found = select_features(
        rows, ["mean_price", "twice", "n_lines", "large"], ["max_flag"], top=1, params={"maxIter": 5, "maxDepth": 2})
    return rows.select("case_id", *found.continuous, *found.categorical, F.lit(",".join(found.dropped)).alias("dropped"))


@query("b8_importance_selection")
def b8(spark, sf_dir):
    rows = matrix(spark, sf_dir).withColumn("constant", F.lit(1.0))
    kept = models.select_by_importance(rows, [*FEATURES, "constant"], params=SMALL)
    return rows.select("case_id", *kept)


@query("b9_mean_threshold_selection")
def b9(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    return rows.select("case_id", *models.select_above_mean(rows, FEATURES, trees=5, most=3))


@query("b10_selection_rounds")
def b10(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    kept, log = models.select_in_rounds(
        lambda names: rows.select("case_id", "target", *names), FEATURES, [3, 5], params={"maxIter": 2, "maxDepth": 2},
        store=scratch_path(spark, "slices"),
    )
    named = [(turn, part, name, name in kept) for (turn, part), names in log.items() for name in names]
    return spark.createDataFrame(named, "turn int, part int, feature string, final boolean")


# -- targets that features decide, so that the outcome is certain ---------------------------

HELD = "('0x' || substr(md5('model|' || CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10000 >= 7500"


@query("v7_decided_scores", f"""
SELECT l_orderkey AS case_id, CAST(max(l_quantity) >= 40 AS INT) AS predicted, 1.0::DOUBLE AS auc
FROM lineitem WHERE {HELD} GROUP BY l_orderkey""")
def v7_decided(spark, sf_dir):
    train, test = fraction_split(decided(spark, sf_dir), 0.75, salt="model")
    names = ["large", *FEATURES]
    scored = materialise(models.score_frame(
        models.train_trees(train, names, params=SMALL), test, names, ["case_id", "target"]), "decided-scores")
    one = F.lit(1).alias("_one")
    told = models.score_report(scored).select(one, "auc")
    return v.rounded(scored.select("case_id", (F.col("score") >= 0.5).cast("int").alias("predicted"), one).join(
        told, "_one").drop("_one"))


@query("v9_search_decided", f"""
SELECT l_orderkey AS case_id, CAST((max(l_quantity) >= 40) <> (count(*) >= 4) AS INT) AS predicted, 2 AS max_depth
FROM lineitem WHERE {HELD} GROUP BY l_orderkey""")
def v9_decided(spark, sf_dir):
    # either of two features but not both: single splits cannot rank it, trees of depth 2 can
    rows = decided(spark, sf_dir).withColumn("many", (F.col("n_lines") >= 4).cast("double")).withColumn(
        "target", (F.col("large") != F.col("many")).cast("int"))
    train, test = fraction_split(rows, 0.75, salt="model")
    names = ["large", "many"]
    grid = models.sampled_grid({"maxDepth": [1, 2], "maxIter": [3, 6]}, 4)
    model, best, _ = models.search(train, test, names, [{**g, "subsamplingRate": 1.0} for g in grid])
    return models.score_frame(model, test, names).select(
        "case_id", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(best["maxDepth"]).alias("max_depth"))


@query("b8_decided_importance", f"""
SELECT l_orderkey AS case_id, {DECIDED} AS large FROM lineitem GROUP BY l_orderkey""")
def b8_decided(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return rows.select("case_id", *models.select_by_importance(rows, ["n_lines", "large", "max_flag"], params=SMALL))


@query("b9_decided_mean_threshold", f"""
SELECT l_orderkey AS case_id, {DECIDED} AS large FROM lineitem GROUP BY l_orderkey""")
def b9_decided(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return rows.select("case_id", *models.select_above_mean(rows, ["n_lines", "large", "max_flag"], most=1))


@query("b10_decided_rounds", f"""
SELECT l_orderkey AS case_id, {DECIDED} AS large FROM lineitem GROUP BY l_orderkey""")
def b10_decided(spark, sf_dir):
    rows = decided(spark, sf_dir)
    kept, _ = models.select_in_rounds(
        lambda names: rows.select("case_id", "target", *names), ["mean_price", "n_lines", "large", "max_flag"], [2, 4],
        params=SMALL, store=scratch_path(spark, "slices"))
    return rows.select("case_id", *kept)
