"""Joins J1-J13."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import joins as j
from strataform.operators.aggregates import Measure, aggregate
from strataform.operators.projections import first_child
from strataform.operators.splits import fraction_split


@query("j1_join_topics", """
SELECT b.case_id, b.target, s.segment_M AS "segment_M", round(s.acctbal_A, 6) AS "acctbal_A", s.nation_M AS "nation_M",
       c.segment_M AS "segment_M_1", round(c.cbscore_A, 6) AS "cbscore_A", d.segment_M AS "segment_M_2", d.n_orders
FROM fx_base2 b LEFT JOIN fx_static0 s ON b.case_id = s.case_id LEFT JOIN fx_static_cb0 c ON b.case_id = c.case_id
LEFT JOIN (SELECT case_id, max(priority_M) AS segment_M, count(*) AS n_orders FROM fx_depth1 GROUP BY case_id) d
  ON b.case_id = d.case_id""", "fx_base2 fx_static0 fx_static_cb0 fx_depth1")
def j1(spark, sf_dir):
    orders = aggregate(v.depth1(spark, sf_dir, False), ["case_id"], [
        Measure("segment_M", "max(priority_M)"), Measure("n_orders", "count(1)"),
    ])
    topics = [v.static0(spark, sf_dir), v.static_cb0(spark, sf_dir), orders]
    return v.rounded(j.join_topics(v.base2(spark, sf_dir).drop("date_decision"), topics))


@query("j2_join_static", """
SELECT b.case_id, b.segment AS "segment_M_base", s.segment_M AS "segment_M_static", round(s.acctbal_A, 6) AS "acctbal_A",
       s.nation_M AS "nation_M", c.segment_M AS "segment_M", round(c.cbscore_A, 6) AS "cbscore_A"
FROM (SELECT c_custkey AS case_id, c_name AS segment FROM customer) b
LEFT JOIN fx_static0 s ON b.case_id = s.case_id LEFT JOIN fx_static_cb0 c ON b.case_id = c.case_id""",
       "fx_static0 fx_static_cb0")
def j2(spark, sf_dir):
    base = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_name").alias("segment_M")
    )
    return v.rounded(j.join_static(base, v.static0(spark, sf_dir), v.static_cb0(spark, sf_dir)))


@query("j3_join_nested_aggregate", """
SELECT d.case_id, d.num_group1, round(d.total_A, 6) AS "total_A", round(n.price, 6) AS price, n.lines
FROM fx_depth1 d LEFT JOIN (SELECT case_id, num_group1, sum(price_A) AS price, count(*) AS lines FROM fx_depth2 GROUP BY ALL) n
  ON d.case_id = n.case_id AND d.num_group1 = n.num_group1""", "fx_depth1 fx_depth2")
def j3(spark, sf_dir):
    nested = aggregate(v.depth2(spark, sf_dir, False), ["case_id", "num_group1"], [
        Measure("price", "sum(price_A)"), Measure("lines", "count(1)"),
    ])
    return v.rounded(j.join_nested(v.depth1(spark, sf_dir).select("case_id", "num_group1", "total_A"), nested))


@query("j4_join_first_child", """
SELECT d.case_id, d.num_group1, round(d.total_A, 6) AS "total_A", round(n.price_A, 6) AS "price_A", n.type_1M AS "type_1M"
FROM fx_depth1 d LEFT JOIN (SELECT * FROM fx_depth2 WHERE num_group2 = 0) n
  ON d.case_id = n.case_id AND d.num_group1 = n.num_group1""", "fx_depth1 fx_depth2")
def j4(spark, sf_dir):
    first = first_child(v.depth2(spark, sf_dir)).select("case_id", "num_group1", "price_A", "type_1M")
    return v.rounded(j.join_nested(v.depth1(spark, sf_dir).select("case_id", "num_group1", "total_A"), first))


@query("j5_with_decision", """
SELECT c.case_id, c.num_group1, round(c.price_A, 6) AS "price_A", CAST(b.date_decision AS VARCHAR) AS date_decision, b.target
FROM (SELECT case_id, num_group1, price_A FROM fx_child1 UNION ALL SELECT -1 - case_id, num_group1, price_A FROM fx_child1) c
JOIN fx_base b ON c.case_id = b.case_id""", "fx_base fx_child1")
def j5(spark, sf_dir):
    # each row also under a case that does not exist
    rows = v.child1(spark, sf_dir).select("case_id", "num_group1", "price_A")
    strays = rows.withColumn("case_id", -1 - F.col("case_id"))
    return v.rounded(j.with_decision(rows.unionByName(strays), v.base(spark, sf_dir)))


@query("j6_join_batches", """
SELECT b.case_id, b.target, x.lines, round(y.price, 6) AS price
FROM fx_base b LEFT JOIN (SELECT case_id, count(*) AS lines FROM fx_child1 GROUP BY case_id) x ON b.case_id = x.case_id
LEFT JOIN (SELECT case_id, sum(price_A) AS price FROM fx_child1 GROUP BY case_id) y ON b.case_id = y.case_id""",
       "fx_base fx_child1")
def j6(spark, sf_dir):
    base = v.base(spark, sf_dir).select("case_id", "target", "date_decision")
    rows = j.with_decision(v.child1(spark, sf_dir, False), base)
    batches = [
        aggregate(rows, ["case_id", "target"], [Measure("lines", "count(1)")]),
        aggregate(rows, ["case_id", "target"], [Measure("price", "sum(price_A)")]),
    ]
    return v.rounded(j.join_batches(base.select("case_id", "target"), batches))


@query("j7_iterated_join", """
SELECT b.case_id, b.target, round(x.avg_total, 6) AS "total_A", x.status AS "status_L", x.priority AS "priority_M",
       x.day AS "order_D", round(y.acctbal_A, 6) AS "acctbal_A", y.segment_M AS "segment_M"
FROM fx_base2 b
LEFT JOIN (SELECT case_id, avg(total_A) AS avg_total, max(status_L) AS status, max(priority_M) AS priority,
                  CAST(max(order_D) AS VARCHAR) AS day FROM fx_depth1 GROUP BY case_id) x ON b.case_id = x.case_id
LEFT JOIN fx_static0 y ON b.case_id = y.case_id""", "fx_base2 fx_depth1 fx_static0")
def j7(spark, sf_dir):
    from strataform.operators.aggregates import type_aggregate

    topics = [
        type_aggregate(v.depth1(spark, sf_dir, False)),
        type_aggregate(v.static0(spark, sf_dir).drop("nation_M")),
    ]
    return v.rounded(j.join_topics(v.base2(spark, sf_dir).drop("date_decision"), topics))


@query("j8_ensemble_join", """
SELECT case_id, WEEK_NUM, round((score + (1 - score / 2)) / 2, 6) AS score FROM fx_base""", "fx_base")
def j8(spark, sf_dir):
    first = v.base(spark, sf_dir).select("case_id", "WEEK_NUM", "score")
    second = first.select("case_id", (1 - F.col("score") / 2).alias("score"))
    return v.rounded(j.ensemble_join([first, second]))


@query("j9_group_totals", """
SELECT priority_M AS "priority_M", MONTH, n, CAST(sum(n) OVER (PARTITION BY priority_M) AS BIGINT) AS n_total
FROM (SELECT priority_M, MONTH, count(*) AS n FROM fx_base GROUP BY ALL)""", "fx_base")
def j9(spark, sf_dir):
    counts = v.base(spark, sf_dir).groupBy("priority_M", "MONTH").agg(F.count(F.lit(1)).alias("n"))
    return j.with_group_totals(counts, "priority_M", ["n"])


@query("j10_attach_label", """
SELECT x.case_id, x.lines, b.target FROM (SELECT case_id, count(*) AS lines FROM fx_child1 GROUP BY case_id) x
LEFT JOIN fx_base b ON x.case_id = b.case_id""", "fx_base fx_child1")
def j10(spark, sf_dir):
    lines = aggregate(v.child1(spark, sf_dir, False), ["case_id"], [Measure("lines", "count(1)")])
    return j.attach_label(lines, v.base(spark, sf_dir))


@query("j11_key_overlap", """
SELECT count(*) AS common_keys FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)""")
def j11(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    return j.key_overlap(orders, v.child1(spark, sf_dir, False), ["case_id"])


@query("j12_missing_keys", """
SELECT o_orderkey AS case_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem""")
def j12(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    return j.missing_keys(orders, v.child1(spark, sf_dir, False), ["case_id"])


@query("j13_sample_complement", """
SELECT case_id, target FROM fx_base
WHERE ('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 8))::BIGINT % 10000 >= 7000""", "fx_base")
def j13(spark, sf_dir):
    return fraction_split(v.base(spark, sf_dir).select("case_id", "target"), 0.7)[1]
