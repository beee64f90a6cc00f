"""Projections, casts and predicates P1-P25."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import projections as p
from strataform.operators.windows import fill_by_type

CHILD_TEXT = """case_id, num_group1, round(price_A, 6) AS "price_A", round(quantity_A, 6) AS "quantity_A",
  round(discount_P, 6) AS "discount_P", round(tax_T, 6) AS "tax_T", flag_M AS "flag_M", status_L AS "status_L",
  bundle_L AS "bundle_L", CAST(ship_D AS VARCHAR) AS "ship_D\""""


@query("p1_suffix_cast", f"SELECT {CHILD_TEXT} FROM fx_child1", "fx_child1")
def p1(spark, sf_dir):
    child = v.child1(spark, sf_dir)
    stored = child.select(
        F.col("case_id").cast("string").alias("case_id"), F.col("num_group1").cast("double").alias("num_group1"),
        F.col("price_A").cast("string").alias("price_A"), F.col("quantity_A").cast("int").alias("quantity_A"),
        "discount_P", "tax_T", "flag_M", "status_L", "bundle_L", F.col("ship_D").cast("string").alias("ship_D"),
    )
    return v.rounded(p.suffix_cast(stored))


@query("p2_days_since_decision", """
SELECT b.case_id, b.WEEK_NUM, c.num_group1, CAST(c.ship_D - b.date_decision AS INT) AS "ship_D"
FROM fx_base b JOIN fx_child1 c ON b.case_id = c.case_id""", "fx_base fx_child1")
def p2(spark, sf_dir):
    rows = v.base(spark, sf_dir).select("case_id", "date_decision", "MONTH", "WEEK_NUM")
    return p.days_since_decision(rows.join(v.child1(spark, sf_dir).select("case_id", "num_group1", "ship_D"), "case_id"))


@query("p3_date_to_period", """
SELECT b.case_id, CAST(b.date_decision AS VARCHAR) AS date_decision, c.num_group1,
       CAST(coalesce(CAST(b.date_decision - c.ship_D AS INT), 0) AS DOUBLE) AS "ship_D"
FROM fx_base b JOIN fx_child1 c ON b.case_id = c.case_id""", "fx_base fx_child1")
def p3(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", F.col("ship_D").cast("string").alias("ship_D"))
    return v.rounded(p.date_to_period(v.base(spark, sf_dir).select("case_id", "date_decision").join(rows, "case_id")))


@query("p3_date_to_period_serving", """
SELECT b.case_id, CAST(b.date_decision AS VARCHAR) AS date_decision,
       CAST(coalesce(CAST(b.date_decision - max(c.ship_D) AS INT), 0) AS DOUBLE) AS "max__if_x_ship_d__"
FROM fx_base b LEFT JOIN fx_child1 c ON b.case_id = c.case_id GROUP BY b.case_id, b.date_decision""", "fx_base fx_child1")
def p3_serving(spark, sf_dir):
    latest = v.child1(spark, sf_dir, False).groupBy("case_id").agg(
        F.max("ship_D").cast("string").alias("max__if_x_ship_d__")
    )
    rows = v.base(spark, sf_dir).select("case_id", "date_decision").join(latest, "case_id", "left")
    return v.rounded(p.date_to_period(rows, serving=True))


@query("p4_calendar_parts", """
SELECT case_id, CAST(date_decision AS VARCHAR) AS date_decision, month(date_decision) AS month_decision,
       isodow(date_decision) AS weekday_decision FROM fx_base""", "fx_base")
def p4(spark, sf_dir):
    return v.rounded(p.calendar_parts(v.base(spark, sf_dir).select("case_id", "date_decision")))


@query("p5_drop_sparse", """
SELECT case_id, round(acctbal_A, 6) AS "acctbal_A", nation_M AS "nation_M" FROM fx_static0""", "fx_static0")
def p5(spark, sf_dir):
    # the bureau score is missing for nearly all customers, so it is dropped
    rows = v.static0(spark, sf_dir).drop("segment_M").join(
        v.static_cb0(spark, sf_dir).select("case_id", "cbscore_A"), "case_id", "left"
    )
    return v.rounded(p.drop_sparse(rows))


@query("p6_drop_by_cardinality", """
SELECT o_orderkey AS case_id, o_orderpriority AS "priority_M" FROM orders""")
def p6(spark, sf_dir):
    rows = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("priority_M"),
        F.lit("same").alias("constant_M"), F.col("o_orderkey").cast("string").alias("wide_M"),
    )
    return p.drop_by_cardinality(rows)


@query("p7_narrow_types", """
SELECT CAST(case_id AS INT) AS case_id, CAST(num_group1 AS INT) AS num_group1,
  round(CAST(CAST(price_A AS FLOAT) AS DOUBLE), 2) AS "price_A", CAST(discount_P AS FLOAT) IS NULL AS no_discount,
  flag_M AS "flag_M", CAST(CAST(bundle_L AS INT) AS DOUBLE) AS "bundle_L", CAST(ship_D AS VARCHAR) AS "ship_D",
  'int,int,float,float,string,float,string' AS kinds
FROM fx_child1""", "fx_child1")
def p7(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select(
        "case_id", "num_group1", "price_A", "discount_P", "flag_M", "bundle_L", "ship_D"
    )
    small = p.narrow_types(rows)
    kinds = ",".join(f.dataType.simpleString() for f in small.schema.fields)
    return v.rounded(small, 2).withColumn("no_discount", F.col("discount_P").isNull()).drop("discount_P").withColumn(
        "kinds", F.lit(kinds)
    )


@query("p8_shrink_numbers", """
SELECT case_id, num_group1, round(CAST(CAST(price_A AS FLOAT) AS DOUBLE), 2) AS "price_A", flag_M AS "flag_M",
  CASE WHEN (SELECT max(case_id) FROM fx_child1) < 32767 THEN 'smallint' ELSE 'int' END || ',tinyint,float,string' AS kinds
FROM fx_child1""", "fx_child1")
def p8(spark, sf_dir):
    small = p.shrink_numbers(v.child1(spark, sf_dir).select("case_id", "num_group1", "price_A", "flag_M"))
    kinds = ",".join(f.dataType.simpleString() for f in small.schema.fields)
    return v.rounded(small, 2).withColumn("kinds", F.lit(kinds))


@query("p9_integral_floats", """
SELECT case_id, CAST(quantity_A AS BIGINT) AS "quantity_A", round(price_A, 6) AS "price_A", round(discount_P, 6) AS "discount_P"
FROM fx_child1""", "fx_child1")
def p9(spark, sf_dir):
    rows = v.child1(spark, sf_dir, False).select("case_id", "quantity_A", "price_A", "discount_P")
    return v.rounded(p.promote_integral_floats(rows))


@query("p10_numeric_only", """
SELECT case_id, MONTH, WEEK_NUM, target, round(score, 6) AS score, round(total_A, 6) AS "total_A" FROM fx_base""", "fx_base")
def p10(spark, sf_dir):
    return v.rounded(p.numeric_only(v.base(spark, sf_dir)))


@query("p11_fill_constant", """
SELECT case_id, round(coalesce(discount_P, -99999999), 6) AS "discount_P" FROM fx_child1""", "fx_child1")
def p11(spark, sf_dir):
    return v.rounded(p.fill_constant(v.child1(spark, sf_dir, False).select("case_id", "discount_P")))


@query("p12_fill_text", """
SELECT case_id, num_group1, coalesce(type_1M, 'NA') AS "type_1M", round(dpd_1P, 6) AS "dpd_1P" FROM fx_depth2""", "fx_depth2")
def p12(spark, sf_dir):
    rows = v.depth2(spark, sf_dir, False).select("case_id", "num_group1", "type_1M", "dpd_1P")
    return v.rounded(p.fill_text(rows))


@query("p12_fill_by_type", """
SELECT case_id, num_group1, coalesce(CASE WHEN flag_M <> 'A' THEN flag_M END, 'NA') AS "flag_M",
       round(first_value(discount_P IGNORE NULLS) OVER w, 6) AS "discount_P"
FROM fx_child1 WINDOW w AS (PARTITION BY case_id ORDER BY num_group1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
       "fx_child1")
def p12_by_type(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select(
        "case_id", "num_group1", F.when(F.col("flag_M") != "A", F.col("flag_M")).alias("flag_M"), "discount_P")
    return v.rounded(fill_by_type(rows, "num_group1", ["case_id"]))


@query("p13_infinite_to_null", """
SELECT case_id, round(CASE WHEN tax_T > 0 THEN price_A END, 6) AS "price_A" FROM fx_child1""", "fx_child1")
def p13(spark, sf_dir):
    rows = v.child1(spark, sf_dir, False).select(
        "case_id", F.when(F.col("tax_T") > 0, F.col("price_A")).otherwise(float("inf")).alias("price_A")
    )
    return v.rounded(p.infinite_to_null(rows))


@query("p14_clean_score", """
SELECT case_id, round(CASE WHEN WEEK_NUM % 5 = 0 THEN 0.3 ELSE least(greatest(score * 1.5 - 0.2, 0), 1) END, 6) AS score
FROM fx_base""", "fx_base")
def p14(spark, sf_dir):
    raw = F.when(F.col("WEEK_NUM") % 10 == 0, F.lit(float("nan"))).when(
        F.col("WEEK_NUM") % 5 == 0, F.lit(None)
    ).otherwise(F.col("score") * 1.5 - 0.2)
    return v.rounded(v.base(spark, sf_dir).select("case_id", p.clean_score(raw).alias("score")))


@query("p15_project", """
SELECT case_id, priority_M AS "priority_M", round(total_A, 6) AS "total_A" FROM fx_base""", "fx_base")
def p15(spark, sf_dir):
    return v.rounded(p.project(v.base(spark, sf_dir), ["priority_M", "total_A"], keep=["case_id"]))


@query("p17_first_child", """
SELECT case_id, num_group1, round(price_A, 6) AS "price_A", CAST(ship_D AS VARCHAR) AS "ship_D"
FROM fx_depth2 WHERE num_group2 = 0""", "fx_depth2")
def p17(spark, sf_dir):
    return v.rounded(p.first_child(v.depth2(spark, sf_dir)).select("case_id", "num_group1", "price_A", "ship_D"))


@query("p18_month_label", """
SELECT case_id, MONTH, CASE WHEN MONTH BETWEEN 199909 AND 200008 THEN 0 WHEN MONTH BETWEEN 199901 AND 199908 THEN 1
  ELSE 2 END AS devval FROM fx_base""", "fx_base")
def p18(spark, sf_dir):
    # the given orders end in 2001, so the two ranges lie twenty years earlier
    label = p.month_label(F.col("MONTH"), (199909, 200008), (199901, 199908))
    return v.base(spark, sf_dir).select("case_id", "MONTH", label.alias("devval"))


@query("p19_week_group", """
SELECT case_id, CAST(floor(WEEK_NUM / 344.0 * 5) AS INT) AS week_group FROM fx_base""", "fx_base")
def p19(spark, sf_dir):
    return v.base(spark, sf_dir).select("case_id", p.week_group(F.col("WEEK_NUM"), 5, 344).alias("week_group"))


@query("p20_bucket_split", """
SELECT CASE WHEN g = 2 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, CAST(sum(target) AS BIGINT) AS bad
FROM (SELECT *, floor(WEEK_NUM / 344.0 * 5) AS g FROM fx_base) GROUP BY ALL""", "fx_base")
def p20(spark, sf_dir):
    rows = v.base(spark, sf_dir).withColumn("week_group", p.week_group(F.col("WEEK_NUM"), 5, 344))
    train, test = p.bucket_split(rows, "week_group", 2)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("bad"))


@query("p21_tag_clashing", """
SELECT case_id, count(num_group1) AS "count__if_1_eq_1_then_num_group1__orders", max(num_group1) AS max_position
FROM fx_depth1 GROUP BY case_id""", "fx_depth1")
def p21(spark, sf_dir):
    rows = v.depth1(spark, sf_dir).groupBy("case_id").agg(
        F.count("num_group1").alias("count__if_1_eq_1_then_num_group1_"), F.max("num_group1").alias("max_position")
    )
    return p.tag_clashing(rows, "orders")


@query("p22_feature_columns", """
SELECT o_orderpriority AS "priority_M", dense_rank() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS position
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)""")
def p22(spark, sf_dir):
    from strataform.operators.models import feature_stages

    rows = v.base(spark, sf_dir)
    features, _, _ = p.feature_columns(rows, ("case_id", "target", "date_decision", "MONTH"))
    stages, _ = feature_stages(rows, features)
    indexed = stages[0].fit(rows).transform(rows)
    return indexed.select("priority_M", F.col("priority_M__index").cast("long").alias("position")).distinct()


@query("p23_parse_dates", """
SELECT case_id, num_group1, CAST(ship_D AS VARCHAR) AS "ship_D", strftime(ship_D, '%Y-%m-%d %H:%M:%S') AS "ship_D_dt"
FROM fx_child1""", "fx_child1")
def p23(spark, sf_dir):
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", F.col("ship_D").cast("string").alias("ship_D"))
    return p.parse_dates(rows, "ship_D").withColumn("ship_D_dt", F.date_format("ship_D_dt", "yyyy-MM-dd HH:mm:ss"))


@query("p25_promote_numeric_text", """
SELECT case_id, round(price_A, 6) AS price_text, flag_M AS "flag_M" FROM fx_child1""", "fx_child1")
def p25(spark, sf_dir):
    rows = v.child1(spark, sf_dir, False).select("case_id", F.col("price_A").cast("string").alias("price_text"), "flag_M")
    return v.rounded(p.promote_numeric_text(rows))
