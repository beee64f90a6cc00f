"""Scalar functions F1-F16, each over all child rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.functions.columns import as_date
from strataform.operators import binning, encode, projections as p
from strataform.plans.definition import day_gap_sql
from strataform.plans.depth2 import year_start


def scalar(name, items, sql, views="fx_child1"):
    """A query that adds columns to (case_id, num_group1) of the child rows."""
    @query(name, f"SELECT case_id, num_group1, {sql} FROM fx_child1", views)
    def run(spark, sf_dir):
        rows = v.child1(spark, sf_dir)
        return v.rounded(rows.select("case_id", "num_group1", *items()))

    return run


scalar("f1_case_when", lambda: [F.expr("CASE WHEN flag_M = 'A' THEN price_A ELSE NULL END").alias("x")],
       "round(CASE WHEN flag_M = 'A' THEN price_A END, 6) AS x")
scalar("f2_cast", lambda: [
    F.col("quantity_A").try_cast("int").alias("i"), F.col("flag_M").try_cast("double").alias("d"),
    F.col("num_group1").cast("string").alias("s")],
    "CAST(quantity_A AS INT) AS i, TRY_CAST(flag_M AS DOUBLE) AS d, CAST(num_group1 AS VARCHAR) AS s")


@query("f3_date_difference", """
SELECT c.case_id, c.num_group1, CAST(b.date_decision - c.ship_D AS INT) AS days
FROM fx_child1 c JOIN fx_base b ON c.case_id = b.case_id""", "fx_base fx_child1")
def f3(spark, sf_dir):
    rows = v.child1(spark, sf_dir).join(v.base(spark, sf_dir).select("case_id", "date_decision"), "case_id")
    return rows.select("case_id", "num_group1", F.expr(day_gap_sql("date(date_decision) - date(ship_D)")).alias("days"))


scalar("f4_month_and_weekday", lambda: [F.month("ship_D").alias("m"), (F.weekday("ship_D") + 1).alias("w")],
       "CAST(month(ship_D) AS INT) AS m, CAST(isodow(ship_D) AS INT) AS w")


@query("f5_year_start", """
SELECT case_id, num_group1, CAST(year(ship_D) AS VARCHAR) || '-01-01' AS x FROM fx_child1""", "fx_child1")
def f5(spark, sf_dir):
    rows = v.child1(spark, sf_dir).withColumn("y", F.year("ship_D").cast("double"))
    return rows.select("case_id", "num_group1", F.expr(year_start("y")).alias("x"))


scalar("f6_arithmetic", lambda: [F.floor(F.col("num_group1") / 92 * 5).alias("g"), F.try_divide("price_A", "tax_T").alias("r")],
       "CAST(floor(num_group1 / 92.0 * 5) AS BIGINT) AS g, round(CASE WHEN tax_T <> 0 THEN price_A / tax_T END, 6) AS r")
scalar("f7_comparisons", lambda: [F.expr(
    "(discount_P IS NULL OR discount_P >= 0.05) AND flag_M != 'a55475b1' AND num_group1 <= 3").alias("x")],
    "((discount_P IS NULL OR discount_P >= 0.05) AND flag_M <> 'a55475b1' AND num_group1 <= 3) AS x")
scalar("f8_between", lambda: [p.month_label(F.col("quantity_A"), (10, 20), (1, 9)).alias("x")],
       "CASE WHEN quantity_A BETWEEN 10 AND 20 THEN 0 WHEN quantity_A BETWEEN 1 AND 9 THEN 1 ELSE 2 END AS x")
scalar("f9_guarded_log", lambda: [F.expr(binning.share_log_text("tax_T", "discount_P")).alias("x")],
       "round(CASE WHEN tax_T > 0 AND discount_P > 0 THEN (tax_T - discount_P) * ln(tax_T / discount_P) ELSE 0 END, 6) AS x")
scalar("f10_round_half_even", lambda: [F.bround(F.col("quantity_A") / 2, 0).alias("x")],
       "round_even(quantity_A / 2, 0) AS x")
scalar("f11_prefix", lambda: [F.substring(F.col("ship_D").cast("string"), 1, 7).alias("x")],
       "substr(CAST(ship_D AS VARCHAR), 1, 7) AS x")


@query("f12_date_parse", """
SELECT case_id, num_group1, CASE WHEN num_group1 % 2 = 0 THEN CAST(ship_D AS VARCHAR) END AS x FROM fx_child1""", "fx_child1")
def f12(spark, sf_dir):
    text = F.when(F.col("num_group1") % 2 == 0, F.col("ship_D").cast("string")).otherwise("not a date")
    rows = v.child1(spark, sf_dir).withColumn("t", text)
    return v.rounded(rows.select("case_id", "num_group1", as_date("t").alias("x")))


scalar("f13_days_to_anchor", lambda: [F.datediff(F.lit("2020-10-19").cast("date"), "ship_D").alias("x")],
       "CAST(DATE '2020-10-19' - ship_D AS INT) AS x")
scalar("f14_special_values", lambda: [F.col("quantity_A").isin(1, 2, 50).alias("x")], "(quantity_A IN (1, 2, 50)) AS x")
scalar("f15_lower_edge", lambda: [F.get(F.array(*[F.lit(float(e)) for e in (0, 10, 20, 40)]), encode.bin_index(
    "quantity_A", [10, 20, 40])).alias("x")],
    "CAST(CASE WHEN quantity_A < 10 THEN 0 WHEN quantity_A < 20 THEN 10 WHEN quantity_A < 40 THEN 20 ELSE 40 END AS DOUBLE) AS x")
scalar("f16_boolean_to_int", lambda: [F.col("bundle_L").cast("int").alias("x")], "CAST(bundle_L AS INT) AS x")


@query("e7_raw", "SELECT case_id, num_group1, round(price_A, 6) AS \"price_A\" FROM fx_child1", "fx_child1")
def e7(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", "price_A")
    return v.rounded(encode.apply_spec(rows, encode.check_spec({"transformations": {"price_A": {"type": "raw"}}})))


@query("o1_sort_by_case", "SELECT case_id, num_group1, round(price_A, 6) AS \"price_A\" FROM fx_child1", "fx_child1")
def o1(spark, sf_dir):
    from strataform.session import scratch_path
    from strataform.sources.writers import write_sorted

    path = scratch_path(spark, "sorted")
    write_sorted(v.child1(spark, sf_dir).select("case_id", "num_group1", "price_A"), path)
    return v.rounded(spark.read.parquet(path))
