"""Preparation and wide tables R1-R7."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from battery import q_aggregates as qa, q_generator as qg, views as v
from battery.registry import query
from strataform.plans import definition as d, depth2 as nested, matrix, prepare
from strataform.session import materialise, scratch_path
from strataform.sources.catalog import Catalog

DEPTH1_ITEMS = ['d.case_id', 'd.num_group1', 'round(d.total_A, 6) AS "total_A"', 'd.status_L AS "status_L"',
                'd.priority_M AS "priority_M"', 'CAST(d.order_D AS VARCHAR) AS "order_D"']
ON = "ON d.case_id = {0}.case_id AND d.num_group1 = {0}.num_group1"


def quoted_names(items):
    return [i.rsplit(' AS "', 1)[1].rstrip('"') for i in items]


R2_SQL = qa.oracle_view(qa.APPLICATION_VIEW.replace("num_group1,", "num_group1, num_group2,", 1)) + f""",
a AS (SELECT case_id, num_group1, {", ".join(qa.A14_ITEMS)} FROM n GROUP BY case_id, num_group1)
SELECT {", ".join(DEPTH1_ITEMS)}, {", ".join(f'a."{c}"' for c in quoted_names(qa.A14_ITEMS))},
  z.cacccardblochreas_147M AS "cacccardblochreas_147M", z.conts_type_509L AS "conts_type_509L",
  z.credacc_cards_status_52L AS "credacc_cards_status_52L"
FROM fx_depth1 d LEFT JOIN a {ON.format("a")} LEFT JOIN (SELECT * FROM n WHERE num_group2 = 0) z {ON.format("z")}"""


@query("r2_flatten_nested", R2_SQL, "fx_depth1 fx_depth2")
def r2(spark, sf_dir):
    rows = qa.nested_view(spark, sf_dir, qa.APPLICATION_VIEW.replace("num_group1,", "num_group1, num_group2,", 1), True)
    return v.rounded(prepare.flatten(v.depth1(spark, sf_dir), rows, nested.application_measures()))


BUREAU_TEXTS = [c for c in dict.fromkeys(x for pair in nested.BUREAU_PAIRS.values() for x in pair)]
BUREAU_NUMBERS = [c for c in BUREAU_TEXTS if not c.endswith("M")]
R3_SQL = qa.oracle_view(qa.BUREAU_A_VIEW.replace("num_group1,", "num_group1, num_group2,", 1)) + qa.stacked_sql() + f""",
a AS (SELECT case_id, num_group1, {", ".join(qa.A17_ITEMS)} FROM s GROUP BY case_id, num_group1)
SELECT {", ".join(DEPTH1_ITEMS)}, {", ".join(f'a."{c}"' for c in quoted_names(qa.A17_ITEMS))},
  {", ".join(f'round(z."{c}", 6) AS "{c}"' if c in BUREAU_NUMBERS else f'z."{c}" AS "{c}"' for c in BUREAU_TEXTS)}
FROM fx_depth1 d LEFT JOIN a {ON.format("a")} LEFT JOIN (SELECT * FROM n WHERE num_group2 = 0) z {ON.format("z")}"""


@query("r3_flatten_stacked", R3_SQL, "fx_depth1 fx_depth2")
def r3(spark, sf_dir):
    rows = qa.nested_view(spark, sf_dir, qa.BUREAU_A_VIEW.replace("num_group1,", "num_group1, num_group2,", 1), True)
    out = prepare.flatten(v.depth1(spark, sf_dir), rows, nested.bureau_a_measures(), nested.BUREAU_PAIRS)
    return v.rounded(out)


@query("r1_prepare_topics", """
SELECT 'applprev_1' AS topic, count(*) AS rows, CAST(sum(lines) AS BIGINT) AS checked FROM (SELECT d.case_id, d.num_group1,
  coalesce(n.lines, 0) AS lines FROM fx_depth1 d LEFT JOIN (SELECT case_id, num_group1, count(*) FILTER (type_1M = 'A') AS lines FROM fx_depth2
  GROUP BY ALL) n ON d.case_id = n.case_id AND d.num_group1 = n.num_group1)
UNION ALL SELECT 'credit_bureau_b_1', count(*), (SELECT count(*) FROM fx_depth2) FROM fx_depth1
UNION ALL SELECT 'static_0', count(*), CAST(sum(case_id) AS BIGINT) FROM fx_static0""", "fx_depth1 fx_depth2 fx_static0")
def r1(spark, sf_dir):
    root = scratch_path(spark, "prepare")
    folder = f"{root}/parquet_files/train"
    wide = qa.APPLICATION_VIEW.replace("num_group1,", "num_group1, num_group2,", 1)
    v.static0(spark, sf_dir).write.parquet(f"{folder}/train_static_0_0.parquet")
    depth1 = materialise(v.depth1(spark, sf_dir), "depth1")  # positions of both topics are numbered once
    depth2 = materialise(v.depth2(spark, sf_dir, True), "depth2")
    for topic, text in (("applprev", wide), ("credit_bureau_b", qa.BUREAU_B_VIEW)):
        depth1.write.parquet(f"{folder}/train_{topic}_1.parquet")
        spark.sql(text, fx_depth2=depth2).write.parquet(f"{folder}/train_{topic}_2.parquet")
    catalog = Catalog(spark, root)
    topics = [("static", 0), ("applprev", 1), ("applprev", 2), ("credit_bureau_b", 1), ("credit_bureau_b", 2)]
    prepare.prepare_all(catalog, "train", topics)
    checks = (
        ("applprev", 1, "sum(count__if__cacccardblochreas_147m_eq_p33_145_161__then_1__L)"),
        ("credit_bureau_b", 1, "sum(count__num_group2__L)"), ("static", 0, "sum(case_id)"),
    )
    out = None
    for topic, depth, text in checks:
        part = catalog.read_prepared(topic, depth).agg(
            F.count(F.lit(1)).alias("rows"), F.expr(text).cast("bigint").alias("checked")
        ).select(F.lit(f"{topic}_{depth}").alias("topic"), "rows", "checked")
        out = part if out is None else out.unionByName(part)
    return out


R4_FEATURES = [
    f for f in qg.a18_features()
    if f.agg.logic.startswith(("sum", "max")) and (not f.filters or "flag_M" in f.filters[0].logic)
] + [
    d.Feature("orders", "int", d.Aggregation((qg.source("num_group1", "int64"),), "count({0})", "int")),
    d.Feature("orders", "string", d.Aggregation((qg.source("ship_D", "object"),), "max({0})", "string")),
]


def r4_items():
    keep = {f.name for f in R4_FEATURES}
    items = [(n, t) for n, t in qg.a18_items() if n in keep]
    return items


R4_NAMES = [n for n, _ in r4_items()]


def r4_sql(lead, tail):
    return qg.FRAME + f""",
t AS (SELECT case_id, {", ".join(f'{t} AS "{n}"' for n, t in r4_items())}, count(num_group1) AS positions, max(ship_D) AS latest
  FROM f GROUP BY case_id)
SELECT b.case_id, {lead} round(b.total_A, 6) AS "total_A", b.priority_M AS "priority_M", {", ".join(f't."{n}"' for n in R4_NAMES)},
  t.positions AS "count__if_1_eq_1_then_num_group1___orders",
  CAST(coalesce(CAST(b.date_decision - t.latest AS INT), 0) AS DOUBLE) AS "max__if_1_eq_1_then_ship_d__"
FROM fx_base b LEFT JOIN t ON b.case_id = t.case_id {tail}"""


def r4_parts(spark, sf_dir):
    base = v.base(spark, sf_dir)
    static = base.select("case_id", "total_A", "priority_M")
    rows = v.child1(spark, sf_dir).withColumn("ship_D", F.col("ship_D").cast("string"))
    return base, static, rows


@query("r4_feature_matrix", r4_sql("b.target, CAST(b.date_decision AS VARCHAR) AS date_decision,", ""), "fx_base fx_child1")
def r4(spark, sf_dir):
    base, static, rows = r4_parts(spark, sf_dir)
    return v.rounded(matrix.feature_matrix(base, [static], {"orders": rows}, {"orders": R4_FEATURES}))


@query("r5_serving_matrix", r4_sql("", ""), "fx_base fx_child1")
def r5(spark, sf_dir):
    base, static, rows = r4_parts(spark, sf_dir)
    wanted = ["total_A", "priority_M", *R4_NAMES, "count__if_1_eq_1_then_num_group1___orders", "max__if_1_eq_1_then_ship_d__"]
    out = matrix.serving_matrix(
        base.drop("target"), [static], {"orders": rows}, {"orders": R4_FEATURES}, wanted, 8
    )
    return v.rounded(out)


@query("r6_declared_types", """
SELECT case_id, target, CAST(NULL AS SMALLINT) AS "pmtamount_36A", CAST(WEEK_NUM AS SMALLINT) AS WEEK_NUM FROM fx_base""", "fx_base")
def r6(spark, sf_dir):
    rows = v.base(spark, sf_dir).select("case_id", "target", F.lit(None).alias("pmtamount_36A"), "WEEK_NUM")
    return prepare.declare(rows, {"pmtamount_36A": "smallint", "WEEK_NUM": "smallint"})


def r7_sql():
    aggregate = qa.suffix_sql(False)
    names = re.findall(r' AS "([^"]+)"', aggregate)
    shown = []
    for n in names:
        if n in ("last_ship_D", "max_ship_D"):
            shown.append(f"CAST(CAST(a.\"{n}\" AS DATE) - b.date_decision AS INT) AS \"{n}\"")
        elif n == "medianship_D":
            shown.append("round(a.\"medianship_D\" - CAST(b.date_decision - DATE '1970-01-01' AS INT), 6) AS \"medianship_D\"")
        else:
            shown.append(f'a."{n}"')
    return f"""
WITH a AS ({aggregate.strip()})
SELECT b.case_id, b.WEEK_NUM, b.target, round(b.score, 6) AS score, round(b.total_A, 6) AS "total_A", b.priority_M AS "priority_M",
  month(b.date_decision) AS month_decision, isodow(b.date_decision) AS weekday_decision,
  s.o_orderstatus AS "status_M", {", ".join(shown)}
FROM fx_base b LEFT JOIN orders s ON b.case_id = s.o_orderkey LEFT JOIN a ON b.case_id = a.case_id"""


@query("r7_suffix_matrix", r7_sql(), "fx_base fx_child1")
def r7(spark, sf_dir):
    static = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status_M")
    )
    return v.rounded(matrix.suffix_matrix(v.base(spark, sf_dir), [static], [v.child1(spark, sf_dir)]))
