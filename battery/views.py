"""Test views over the given tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.order_stats import value_block
from strataform.operators.windows import row_positions

VIEW_SQL = {
    "fx_base": """
SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS date_decision,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS MONTH,
       CAST(floor(CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) / 7) AS BIGINT) AS WEEK_NUM,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
       CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000 AS score,
       o_totalprice AS total_A, o_orderpriority AS priority_M
FROM orders""",
    "fx_child1": """
SELECT l_orderkey AS case_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS num_group1,
       l_extendedprice AS price_A, l_quantity AS quantity_A, nullif(l_discount, 0) AS discount_P, l_tax AS tax_T,
       CASE WHEN l_returnflag = 'N' THEN 'a55475b1' ELSE l_returnflag END AS flag_M,
       l_linestatus AS status_L, (l_partkey % 7 = 0) AS bundle_L,
       CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS ship_D
FROM lineitem""",
    "fx_base2": """
SELECT c_custkey AS case_id, DATE '2001-12-01' AS date_decision,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target
FROM customer""",
    "fx_static0": """
SELECT c_custkey AS case_id, c_acctbal AS acctbal_A, c_mktsegment AS segment_M, n_name AS nation_M
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_static_cb0": """
SELECT c_custkey AS case_id, c_mktsegment AS segment_M, s_acctbal AS cbscore_A
FROM customer JOIN supplier ON c_custkey = s_suppkey * 2""",
    "fx_depth1": """
SELECT o_custkey AS case_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS BIGINT) AS num_group1,
       o_totalprice AS total_A, o_orderstatus AS status_L, o_orderpriority AS priority_M, CAST(o_orderdate AS DATE) AS order_D
FROM orders""",
    "fx_depth2": """
SELECT k.case_id, k.num_group1,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS num_group2,
       CASE WHEN l_linestatus = 'O' THEN l_discount END AS dpd_1P, CASE WHEN l_linestatus = 'F' THEN l_discount END AS dpd_2P,
       CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS type_1M, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS type_2M,
       l_extendedprice AS price_A, CAST(l_shipdate AS DATE) AS ship_D
FROM lineitem JOIN (
  SELECT o_orderkey, o_custkey AS case_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS BIGINT) AS num_group1
  FROM orders) k ON l_orderkey = k.o_orderkey""",
}

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_view(spark: SparkSession, sf_dir: str, name: str, *tables: str) -> DataFrame:
    text = VIEW_SQL[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def base(spark, sf_dir) -> DataFrame:
    return _sql_view(spark, sf_dir, "fx_base", "orders")


def base2(spark, sf_dir) -> DataFrame:
    return _sql_view(spark, sf_dir, "fx_base2", "customer")


def static0(spark, sf_dir) -> DataFrame:
    return _sql_view(spark, sf_dir, "fx_static0", "customer", "nation")


def static_cb0(spark, sf_dir) -> DataFrame:
    return _sql_view(spark, sf_dir, "fx_static_cb0", "customer", "supplier")


def _lines(spark, sf_dir, name: str) -> DataFrame:
    coarse = F.struct("l_linenumber", value_block(F.col("l_partkey")))
    return row_positions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, coarse, name)


def child1(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    """Child rows of orders; without ``positions`` no window is needed to read them."""
    rows = _lines(spark, sf_dir, "num_group1") if positions else table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("case_id"), *(["num_group1"] if positions else []),
        F.col("l_extendedprice").alias("price_A"), F.col("l_quantity").alias("quantity_A"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount_P"),
        F.col("l_tax").alias("tax_T"),
        F.when(F.col("l_returnflag") == "N", "a55475b1").otherwise(F.col("l_returnflag")).alias("flag_M"),
        F.col("l_linestatus").alias("status_L"), (F.col("l_partkey") % 7 == 0).alias("bundle_L"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_shipdate").cast("date")).alias("ship_D"),
    )


def _numbered_orders(spark, sf_dir) -> DataFrame:
    day = -F.unix_date(F.col("o_orderdate").cast("date"))
    order = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    return row_positions(table(spark, sf_dir, "orders"), ["o_custkey"], order, day, "num_group1")


def depth1(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    rows = _numbered_orders(spark, sf_dir) if positions else table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_custkey").alias("case_id"), *(["num_group1"] if positions else []),
        F.col("o_totalprice").alias("total_A"), F.col("o_orderstatus").alias("status_L"),
        F.col("o_orderpriority").alias("priority_M"), F.col("o_orderdate").cast("date").alias("order_D"),
    )


def depth2(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    rows = _lines(spark, sf_dir, "num_group2") if positions else table(spark, sf_dir, "lineitem")
    keys = _numbered_orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("case_id"), "num_group1")
    open_, closed = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    return rows.join(keys, rows["l_orderkey"] == keys["o_orderkey"]).select(
        "case_id", "num_group1", *(["num_group2"] if positions else []),
        F.when(open_, F.col("l_discount")).alias("dpd_1P"), F.when(closed, F.col("l_discount")).alias("dpd_2P"),
        F.when(open_, F.col("l_returnflag")).alias("type_1M"), F.when(closed, F.col("l_returnflag")).alias("type_2M"),
        F.col("l_extendedprice").alias("price_A"), F.col("l_shipdate").cast("date").alias("ship_D"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text: the form that results are compared in."""
    out = []
    for f in df.schema.fields:
        kind, name = f.dataType.typeName(), f"`{f.name}`"
        if kind in ("double", "float"):
            exact = f.name.startswith("var")  # squares of cents often end in a 5: float avoids the ties
            text = f"CAST({name} AS FLOAT)" if exact else f"round(CAST({name} AS DOUBLE), {digits})"
            out.append(f"CAST({text} AS DOUBLE) AS {name}")
        else:
            out.append(f"CAST({name} AS STRING) AS {name}" if kind == "date" else name)
    return df.selectExpr(*out)
