"""Metrics V1-V5, V8; splits T1-T5."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import metrics as m
from strataform.operators import splits

# Ranks with ties halved give the area directly (Mann-Whitney).
def auc_sql(by=""):
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""
WITH r AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {lead} score) - 1) / 2.0 AS r FROM fx_base)
SELECT {lead}round((sum(CASE WHEN target = 1 THEN r END) - sum(target) * (sum(target) + 1) / 2.0)
  / nullif(sum(target) * 1.0 * sum(1 - target), 0), 6) AS auc FROM r {tail}"""


@query("v1_auc", auc_sql(), "fx_base")
def v1(spark, sf_dir):
    return v.rounded(m.auc(v.base(spark, sf_dir)))


@query("v2_log_loss", """
SELECT round(avg(CASE WHEN target = 1 THEN -ln(greatest(score, 2.220446049250313e-16)) ELSE -ln(1 - score) END), 6) AS log_loss
FROM fx_base""", "fx_base")
def v2(spark, sf_dir):
    return v.rounded(m.log_loss(v.base(spark, sf_dir)))


GINI = auc_sql("WEEK_NUM").replace("SELECT WEEK_NUM, round((", "SELECT WEEK_NUM, ((").replace(", 6) AS auc", ") AS auc")
GINI = "g AS (SELECT WEEK_NUM, 2 * auc - 1 AS gini FROM (" + GINI.strip() + ") WHERE auc IS NOT NULL)"


@query("v3_gini_by_week", "WITH " + GINI + " SELECT WEEK_NUM, round(gini, 6) AS gini FROM g", "fx_base")
def v3(spark, sf_dir):
    return v.rounded(m.gini_by(v.base(spark, sf_dir)))


def stability_sql(order):
    return "WITH " + GINI + f""",
o AS (SELECT WEEK_NUM, min(case_id) AS first_case FROM fx_base GROUP BY WEEK_NUM),
x AS (SELECT gini, row_number() OVER (ORDER BY {order}) - 1 AS x FROM g JOIN o USING (WEEK_NUM)),
f AS (SELECT regr_slope(gini, x) AS a, regr_intercept(gini, x) AS b FROM x),
e AS (SELECT count(*) AS weeks, avg(gini) AS avg_gini, max(a) AS slope, stddev_pop(gini - (a * x + b)) AS residual_std FROM x, f)
SELECT weeks, round(avg_gini, 6) AS avg_gini, round(slope, 6) AS slope, round(residual_std, 6) AS residual_std,
  round(avg_gini + 88.0 * least(0, slope) - 0.5 * residual_std, 6) AS stability FROM e"""


@query("v4_stability", stability_sql("WEEK_NUM"), "fx_base")
def v4(spark, sf_dir):
    return v.rounded(m.stability(v.base(spark, sf_dir)))


@query("v4_stability_first_seen", stability_sql("first_case"), "fx_base")
def v4_first(spark, sf_dir):
    return v.rounded(m.stability(v.base(spark, sf_dir), order="case_id"))


@query("v5_auc_by_month", auc_sql("MONTH"), "fx_base")
def v5(spark, sf_dir):
    return v.rounded(m.auc(v.base(spark, sf_dir), ["MONTH"]))


@query("v8_ensemble_mean", """
SELECT case_id, CASE WHEN score < 0.9 THEN round((score + 1 - score / 2) / 2, 6) END AS score FROM fx_base""", "fx_base")
def v8(spark, sf_dir):
    first = v.base(spark, sf_dir).select("case_id", "score")
    second = first.where("score < 0.9").select("case_id", (1 - F.col("score") / 2).alias("score"))
    return v.rounded(m.ensemble_mean([first, second]))


BUCKET = "('0x' || substr(md5({}), 1, 8))::BIGINT % 10000"


@query("t1_fraction_sample", f"""
SELECT case_id, target FROM fx_base WHERE {BUCKET.format("CAST(case_id AS VARCHAR)")} < 7000""", "fx_base")
def t1(spark, sf_dir):
    return splits.fraction_split(v.base(spark, sf_dir).select("case_id", "target"), 0.7)[0]


@query("t2_grouped_folds", """
SELECT 5 AS folds, count(*) AS rows, count(DISTINCT WEEK_NUM) AS weeks, 0 AS split_weeks, true AS balanced FROM fx_base""",
       "fx_base")
def t2(spark, sf_dir):
    # each week in one fold, folds within two per cent of each other
    rows = splits.with_fold(v.base(spark, sf_dir).select("case_id", "WEEK_NUM"), 5)
    weeks = rows.groupBy("WEEK_NUM").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.agg(F.count(F.lit(1)).cast("int").alias("folds"), (F.max("n") <= F.min("n") * 1.02).alias("balanced"))
    return weeks.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("weeks"),
        F.count_if(F.col("folds") > 1).cast("int").alias("split_weeks"),
    ).withColumn("_k", F.lit(1)).join(ends.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("t3_random_split", f"""
SELECT case_id, CASE WHEN {BUCKET.format("'43|' || CAST(case_id AS VARCHAR)")} < 2000 THEN 'test' ELSE 'train' END AS part
FROM fx_base""", "fx_base")
def t3(spark, sf_dir):
    test, train = splits.fraction_split(v.base(spark, sf_dir).select("case_id"), 0.2, salt="43")
    return test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))


@query("t4_time_split", """
SELECT case_id, week_group, CASE WHEN week_group = 3 THEN 'train' ELSE 'test' END AS part
FROM (SELECT case_id, CAST(floor(WEEK_NUM / 344.0 * 5) AS INT) AS week_group FROM fx_base)""", "fx_base")
def t4(spark, sf_dir):
    rows = v.base(spark, sf_dir).select("case_id", "WEEK_NUM")
    train, test = splits.time_split(rows, 3, 5, 344)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.drop("WEEK_NUM")


@query("t5_month_split", """
SELECT part, count(*) AS rows FROM (SELECT CASE WHEN MONTH + 2000 BETWEEN 201909 AND 202008 THEN 'dev'
  WHEN MONTH + 2000 BETWEEN 201901 AND 201908 THEN 'val' ELSE 'test' END AS part FROM fx_base) GROUP BY part""", "fx_base")
def t5(spark, sf_dir):
    # the given orders end in 2001: shifted by twenty years they meet the fixed ranges
    rows = v.base(spark, sf_dir).select("case_id", (F.col("MONTH") + 2000).alias("MONTH"))
    parts = splits.month_split(rows)
    named = [part.withColumn("part", F.lit(n)) for part, n in zip(parts, ("dev", "val", "test"))]
    both = named[0].unionByName(named[1]).unionByName(named[2])
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
