"""Windows W1-W5, set operations X2-X4."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import setops, windows
from strataform.operators.joins import with_group_totals


def events(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def group_sql(how):
    return f"""
SELECT event_id, user_id, event_type, round(value, 6) AS value,
       {how}(value) OVER (PARTITION BY user_id, event_type) AS value_gb{how},
       {how}(event_id) OVER (PARTITION BY user_id, event_type) AS event_id_gb{how} FROM events"""


@query("w1_group_count", group_sql("count"))
def w1(spark, sf_dir):
    return v.rounded(windows.group_back(events(spark, sf_dir), "count", ["user_id", "event_type"], ["value", "event_id"]))


@query("w2_group_min", group_sql("min"))
def w2(spark, sf_dir):
    return v.rounded(windows.group_back(events(spark, sf_dir), "min", ["user_id", "event_type"], ["value", "event_id"]))


@query("w3_group_max", group_sql("max"))
def w3(spark, sf_dir):
    return v.rounded(windows.group_back(events(spark, sf_dir), "max", ["user_id", "event_type"], ["value", "event_id"]))


@query("w4_back_fill", """
SELECT case_id, num_group1, round(first_value(discount_P IGNORE NULLS) OVER w, 6) AS "discount_P",
       CAST(first_value(ship_D IGNORE NULLS) OVER w AS VARCHAR) AS "ship_D"
FROM fx_child1 WINDOW w AS (PARTITION BY case_id ORDER BY num_group1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
       "fx_child1")
def w4(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", "discount_P", "ship_D")
    return v.rounded(windows.back_fill(rows, ["discount_P", "ship_D"], "num_group1", ["case_id"]))


@query("w4_back_fill_table", """
SELECT event_id, round(first_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (
  ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value FROM events""")
def w4_table(spark, sf_dir):
    # one order over the whole table, cut into spans
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("value"))
    return v.rounded(windows.back_fill(rows, ["value"], "event_id", span=1000))


@query("w5_share_by_column", """
SELECT priority_M AS "priority_M", target, n, round(n * 1.0 / sum(n) OVER (PARTITION BY priority_M), 6) AS share
FROM (SELECT priority_M, target, count(*) AS n FROM fx_base GROUP BY ALL)""", "fx_base")
def w5(spark, sf_dir):
    counts = v.base(spark, sf_dir).groupBy("priority_M", "target").agg(F.count(F.lit(1)).alias("n"))
    totals = with_group_totals(counts, "priority_M", ["n"])
    return v.rounded(totals.select("priority_M", "target", "n", (F.col("n") / F.col("n_total")).alias("share")))


@query("x2_concat_relaxed", """
SELECT case_id, num_group1, round(price_A, 6) AS "price_A", CASE WHEN num_group1 % 2 = 0 THEN flag_M END AS "flag_M"
FROM fx_child1""", "fx_child1")
def x2(spark, sf_dir):
    rows = v.child1(spark, sf_dir)
    even = rows.where("num_group1 % 2 = 0").select("case_id", "num_group1", "price_A", "flag_M")
    odd = rows.where("num_group1 % 2 = 1").select(
        F.col("num_group1").cast("int").alias("num_group1"), "case_id", "price_A"
    )
    return v.rounded(setops.concat_relaxed([even, odd]))


@query("x3_unique_by_key", """
SELECT case_id, num_group1, round(price_A, 6) AS "price_A", flag_M AS "flag_M" FROM fx_child1 WHERE num_group1 = 0""",
       "fx_child1")
def x3(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", "price_A", "flag_M")
    return v.rounded(setops.unique_by_key(rows, order=["num_group1"]))


@query("x4_distinct_pairs", """
SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS line FROM lineitem""")
def x4(spark, sf_dir):
    rows = v.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line")
    )
    return setops.distinct_keys(rows, ["case_id", "line"])
