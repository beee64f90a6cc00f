"""Profiles A26-A31, A37; sorts and top-k O1-O5."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import profile as pr


@query("a26_count_of_counts", """
SELECT size, count(*) AS keys FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size""")
def a26(spark, sf_dir):
    return pr.count_of_counts(v.child1(spark, sf_dir, False), "case_id")


@query("a26_distinct_counts", """
SELECT size, count(*) AS keys FROM (SELECT count(DISTINCT flag_M) AS size FROM fx_child1 GROUP BY case_id) GROUP BY size""",
       "fx_child1")
def a26_distinct(spark, sf_dir):
    return pr.count_of_counts(v.child1(spark, sf_dir, False), "case_id", "flag_M")


@query("a26_group_size_summary", """
WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT 'size' AS col, count(*) AS count, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std,
  CAST(min(size) AS DOUBLE) AS min, round(quantile_cont(size, 0.25), 6) AS p25, round(quantile_cont(size, 0.5), 6) AS p50,
  round(quantile_cont(size, 0.75), 6) AS p75, CAST(max(size) AS DOUBLE) AS max FROM s""")
def a26_summary(spark, sf_dir):
    return v.rounded(pr.group_size_summary(v.child1(spark, sf_dir, False), "case_id"))


@query("a27_value_counts", """
SELECT type_1M AS "type_1M", count(*) AS count FROM fx_depth2 WHERE price_A > 1000 GROUP BY type_1M""", "fx_depth2")
def a27(spark, sf_dir):
    return pr.value_frequencies(v.depth2(spark, sf_dir, False), "type_1M", True, F.col("price_A") > 1000)


@query("a28_null_patterns", """
SELECT discount_P IS NULL AS "discount_P", ship_D IS NULL AS "ship_D", count(*) AS count FROM fx_child1 GROUP BY ALL""",
       "fx_child1")
def a28(spark, sf_dir):
    return pr.null_patterns(v.child1(spark, sf_dir, False), ["discount_P", "ship_D"])


@query("a29_prefix_histogram", """
SELECT substr(CAST(ship_D AS VARCHAR), 1, 7) AS prefix, count(*) AS count FROM fx_child1
WHERE ship_D IS NOT NULL GROUP BY ALL""", "fx_child1")
def a29(spark, sf_dir):
    return pr.prefix_histogram(v.child1(spark, sf_dir, False), "ship_D")


PROFILED = ("total_A", "status_L", "priority_M", "order_D")


@query("a30_column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) AS nunique FROM fx_depth1 WHERE num_group1 = 0" for c in PROFILED
), "fx_depth1")
def a30(spark, sf_dir):
    rows = v.depth1(spark, sf_dir).where("num_group1 = 0").select(*PROFILED)
    return pr.distinct_profile(rows)


SLICED = ("price_A", "discount_P", "ship_D", "flag_M")


@query("a37_null_shares", " UNION ALL ".join(
    f"""SELECT {s} AS slice, '{c}' AS col, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share
FROM fx_child1 WHERE num_group1 {op} 0""" for s, op in (("0", "="), ("1", "<>")) for c in SLICED
), "fx_child1")
def a37(spark, sf_dir):
    rows = v.child1(spark, sf_dir)
    first = pr.null_shares(rows.where("num_group1 = 0").select(*SLICED)).withColumn("slice", F.lit(0))
    rest = pr.null_shares(rows.where("num_group1 <> 0").select(*SLICED)).withColumn("slice", F.lit(1))
    return v.rounded(first.unionByName(rest))


@query("a37_complete_columns", "SELECT case_id, round(price_A, 6) AS \"price_A\", flag_M AS \"flag_M\" FROM fx_child1",
       "fx_child1")
def a37_complete(spark, sf_dir):
    rows = v.child1(spark, sf_dir, False).select("case_id", "price_A", "discount_P", "flag_M", "ship_D")
    return v.rounded(rows.select(*pr.complete_columns(rows)))


@query("a31_summary", " UNION ALL ".join(f"""
SELECT '{c}' AS col, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM fx_child1""" for c in
    ("price_A", "quantity_A", "discount_P")), "fx_child1")
def a31(spark, sf_dir):
    return v.rounded(pr.summary(v.child1(spark, sf_dir, False), ["price_A", "quantity_A", "discount_P"]))


@query("a31_sample_values", " UNION ALL ".join(f"""
SELECT '{c}' AS col, (SELECT CAST({c} AS VARCHAR) FROM fx_child1 WHERE {c} IS NOT NULL
  ORDER BY case_id, num_group1 LIMIT 1) AS sample""" for c in ("flag_M", "ship_D", "status_L")), "fx_child1")
def a31_samples(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", "flag_M", "ship_D", "status_L")
    return pr.sample_values(rows, ["case_id", "num_group1"])



@query("o2_top_values", """
WITH l AS (
""" + " UNION ALL ".join(f"SELECT '{c}' AS col, {e} AS value FROM fx_child1" for c, e in
                         (("flag_M", "flag_M"), ("status_L", "status_L"), ("quantity_T", "CAST(CAST(quantity_A AS INT) AS VARCHAR)"))) + """),
n AS (SELECT col, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY col, value),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY count DESC, value) AS rank FROM n)
SELECT col, value, count, rank FROM r WHERE rank <= 10""", "fx_child1")
def o2(spark, sf_dir):
    rows = v.child1(spark, sf_dir, False).withColumn("quantity_T", F.col("quantity_A").cast("int").cast("string"))
    return pr.top_values(rows, ["flag_M", "status_L", "quantity_T"])


@query("o3_top_importances", """
SELECT l_suppkey AS feature, round(sum(l_extendedprice), 2) AS importance FROM lineitem GROUP BY l_suppkey
ORDER BY round(sum(l_extendedprice), 2) DESC, feature LIMIT 20""")
def o3(spark, sf_dir):
    pairs = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("importance")
    )
    return pr.top_importances(pairs, 20)


@query("o4_ordered_report", """
SELECT status_L AS "status_L", count(*) AS count FROM fx_depth1 GROUP BY status_L ORDER BY count DESC""", "fx_depth1")
def o4(spark, sf_dir):
    return pr.value_frequencies(v.depth1(spark, sf_dir, False), "status_L")


@query("o5_rows_of_key", """
SELECT o_custkey AS case_id, CAST(o_orderdate AS VARCHAR)[1:10] AS "order_D", round(o_totalprice, 6) AS "total_A"
FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_custkey > 100)""")
def o5(spark, sf_dir):
    rows = v.depth1(spark, sf_dir, False).select("case_id", "order_D", "total_A")
    key = rows.where("case_id > 100").agg(F.min("case_id")).first()[0]
    return v.rounded(pr.rows_of_key(rows, "case_id", key, "order_D"))
