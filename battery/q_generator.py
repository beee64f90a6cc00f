"""Generated features: A18, A19, G1-G16."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators.joins import join_batches, with_decision
from strataform.plans import definition as d
from strataform.plans import generator as g

JOINED = """f AS (SELECT c.*, b.date_decision, b.target, CAST(b.date_decision - c.ship_D AS INT) AS gap
  FROM fx_child1 c JOIN fx_base b ON c.case_id = b.case_id)"""
FRAME = "WITH " + JOINED + "\n"


def frame(spark, sf_dir, positions=True) -> DataFrame:
    base = v.base(spark, sf_dir)
    return with_decision(v.child1(spark, sf_dir, positions), base)


def source(name, kind="float64"):
    return d.Source(name, kind)


FILTERS = {  # logic -> (text in the name, SQL on the joined frame)
    None: ("1_eq_1", "true"),
    "flag_M = 'A'": ("_flag_m_eq_a_", "flag_M = 'A'"),
    "num_group1 < 2": ("_num_group1_lt_2_", "num_group1 < 2"),
    "discount_P is null": ("_discount_p_is_null_", "discount_P IS NULL"),
    "date(date_decision)-date(ship_D) < 8": ("_date_date_decision_subdate_ship_d__lt_8_", "gap < 8"),
}
PLAIN = [("count", "price_A", "int"), ("sum", "price_A", "float"), ("min", "price_A", "float"),
         ("max", "price_A", "float"), ("avg", "price_A", "float"), ("stddev", "price_A", "float"),
         ("sum", "quantity_A", "int")]
SQL_OF = {"count": "count({})", "sum": "round(sum({}), 6)", "min": "round(min({}), 6)", "max": "round(max({}), 6)",
          "avg": "round(avg({}), 6)", "stddev": "round(stddev_samp({}), 4)"}


def a18_features() -> list[d.Feature]:
    aggs = [d.Aggregation((source(c),), f"{how}({{0}})", kind) for how, c, kind in PLAIN]
    aggs += [
        d.Aggregation((source("flag_M", "object"),), "count(distinct {0})", "int"),
        d.Aggregation((source("flag_M", "object"),), "max({0})", "string"),
        d.Aggregation((source("ship_D", "object"),), "max(DATE(date_decision) - DATE({0}))", "int"),
        d.Aggregation((source("ship_D", "object"),), "stddev(DATE(date_decision) - DATE({0}))", "float"),
    ]
    filters = [None if text is None else d.Condition((source(column),), text) for text, column in zip(
        FILTERS, (None, "flag_M", "num_group1", "discount_P", "ship_D"))]
    out = []
    for agg in aggs:
        for f in filters:
            same = f is not None and f.columns[0].name == agg.columns[0].name
            if not same:
                out.append(d.Feature("orders", agg.data_type, agg, () if f is None else (f,)))
    return out


def a18_items() -> list[tuple[str, str]]:
    out = []
    for (text, (label, cond)), column in zip(FILTERS.items(), (None, "flag_M", "num_group1", "discount_P", "ship_D")):
        for how, c, _ in PLAIN:
            body = SQL_OF[how].format(f"CASE WHEN {cond} THEN {c} END")
            body = f"CAST(sum(CASE WHEN {cond} THEN {c} END) AS BIGINT)" if c == "quantity_A" else body
            out.append((f"{how}__if_{label}_then_{c.lower()}__", body))
        if column != "flag_M":
            case = f"CASE WHEN {cond} THEN flag_M END"
            out.append((f"count_distinct__if_{label}_then_flag_m__", f"count(DISTINCT {case})"))
            out.append((f"max__if_{label}_then_flag_m__", f"max({case})"))
        if column != "ship_D":
            case = f"CASE WHEN {cond} THEN gap END"
            name = f"date_date_decision__sub_date__if_{label}_then_ship_d___"
            out.append((f"max_{name}", f"max({case})"))
            out.append((f"stddev_{name}", f"round(stddev_samp({case}), 4)"))
    return out


A18_SQL = FRAME + "SELECT case_id, target, " + ",\n ".join(f'{t} AS "{n}"' for n, t in a18_items()) + \
    "\nFROM f GROUP BY case_id, target"


def a18_form(df: DataFrame) -> DataFrame:
    spread = {c: F.round(c, 4) for c in df.columns if c.startswith("stddev")}
    return v.rounded(df.withColumns(spread))


@query("a18_generated_features", A18_SQL, "fx_base fx_child1")
def a18(spark, sf_dir):
    return a18_form(d.compute_features(frame(spark, sf_dir), a18_features()))


@query("a19_feature_batches", A18_SQL, "fx_base fx_child1")
def a19(spark, sf_dir):
    rows = frame(spark, sf_dir)
    keys = rows.select("case_id", "target").distinct()
    return a18_form(join_batches(keys, d.feature_batches(rows, a18_features(), 20)))


@query("g13_feature_from_store", FRAME + """
SELECT case_id, count(CASE WHEN price_A >= 50000 AND flag_M != 'a55475b1' THEN price_A END)
  AS "count__if__price_a_gteq_50000__flag_m_ne_a55475b1__then_price_a__" FROM f GROUP BY case_id""", "fx_base fx_child1")
def g13(spark, sf_dir):
    # through the JSON store and back: two conditions in one feature
    feature = d.Feature("orders", "int", d.Aggregation((source("price_A"),), "count({0})", "int"), (
        d.Condition((source("price_A"),), "price_A >= 50000"),
        d.Condition((source("flag_M", "object"),), "flag_M != 'a55475b1'"),
    ))
    stored = d.from_json(d.to_json([feature]))
    return d.compute_features(frame(spark, sf_dir, False), stored, train=False)


# -- generator ------------------------------------------------------------------

STATS_COLUMNS = ("num_group1", "price_A", "quantity_A", "discount_P", "tax_T", "flag_M", "status_L", "ship_D")


def stats_of(spark, sf_dir, period=("ship_D",)):
    rows = v.child1(spark, sf_dir).select("case_id", *STATS_COLUMNS)
    return g.column_stats(rows, period)


KINDS = {"num_group1": "int64", "quantity_A": "int64", "flag_M": "object", "status_L": "object", "ship_D": "object"}


def stat_row(c):
    kind = KINDS.get(c, "float64")
    number = kind != "object"
    code = "false" if number or c == "ship_D" else f"coalesce(bool_or({c} = 'a55475b1'), false)"
    low = f"coalesce(bool_or({c} <= 0), false)" if number else "false"
    high = f"round(CAST(max({c}) AS DOUBLE), 6)" if number else "NULL"
    old = "max(CAST(DATE '2020-10-19' - ship_D AS INT))" if c == "ship_D" else "NULL"
    return f"""SELECT '{c}' AS col, '{kind}' AS kind, bool_or({c} IS NULL) AS has_null, {code} AS has_code,
  {low} AS has_low, {high} AS greatest, {old} AS oldest_days FROM fx_child1"""


@query("g1_column_statistics", "\nUNION ALL ".join(stat_row(c) for c in STATS_COLUMNS), "fx_child1")
def g1(spark, sf_dir):
    found = [
        (s.name, s.kind, s.has_null, s.has_code, s.has_low, s.greatest, s.oldest_days)
        for s in stats_of(spark, sf_dir)
    ]
    schema = "col string, kind string, has_null boolean, has_code boolean, has_low boolean, greatest double, oldest_days int"
    return v.rounded(spark.createDataFrame(found, schema))


def totals(df: DataFrame) -> DataFrame:
    """(feature, total): each feature summed over all cases."""
    names = [c for c in df.columns if c not in ("case_id", "target")]
    one = df.agg(*[F.round(F.sum(F.col(f"`{c}`").cast("double")), 2).alias(c) for c in names])
    return one.unpivot([], [f"`{c}`" for c in names], "feature", "total")


def under(spark, sf_dir, conditions) -> DataFrame:
    """Rows per case under each filter, summed over all cases."""
    counted = d.Aggregation((d.Source(None, "int", "1"),), "count({0})", "int")
    return totals(d.compute_features(frame(spark, sf_dir), g.cross("orders", [counted], conditions)))


@query("g2_categorical_filters", """
WITH l AS (SELECT 'flag_m' AS col, flag_M AS value FROM fx_child1 UNION ALL SELECT 'status_l', status_L FROM fx_child1),
n AS (SELECT col, value, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS r FROM n)
SELECT 'count__if__' || col || '_eq_' || lower(value) || '__then_1__' AS feature, CAST(n AS DOUBLE) AS total
FROM r WHERE r <= 10 AND value <> 'a55475b1'""", "fx_child1")
def g2(spark, sf_dir):
    return under(spark, sf_dir, g.categorical_filters(stats_of(spark, sf_dir)))


STEPS = "(VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(
    (2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711, 28657))) + ") t(i, x)"


def steps_sql(greatest):
    """Limits: the first, and each one whose predecessor is below the greatest value."""
    return f"""k AS (SELECT i, x FROM (SELECT i, x, lag(x) OVER (ORDER BY i) AS before FROM {STEPS})
  WHERE before IS NULL OR before < ({greatest}))"""


@query("g3_period_filters", "WITH " + JOINED + ", " + steps_sql(
    "SELECT max(CAST(DATE '2020-10-19' - ship_D AS INT)) FROM fx_child1") + """
SELECT 'count__if__date_date_decision_subdate_ship_d__lt_' || x || '__then_1__' AS feature,
  CAST((SELECT count(*) FROM f WHERE gap < x) AS DOUBLE) AS total FROM k WHERE i >= 3""", "fx_base fx_child1")
def g3(spark, sf_dir):
    return under(spark, sf_dir, g.period_filters(stats_of(spark, sf_dir), ["ship_D"]))


@query("g4_null_filters", FRAME + "\nUNION ALL ".join(
    f"SELECT 'count__if__{label}__then_1__' AS feature, CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE) AS total FROM f"
    for label, cond in (
        ("flag_m_eq_a55475b1", "flag_M = 'a55475b1'"), ("flag_m_ne_a55475b1", "flag_M <> 'a55475b1'"),
        ("discount_p_is_null", "discount_P IS NULL"), ("discount_p_is_not_null", "discount_P IS NOT NULL"),
        ("ship_d_is_null", "ship_D IS NULL"), ("ship_d_is_not_null", "ship_D IS NOT NULL"),
        ("tax_t_gt_0", "tax_T > 0"), ("tax_t_lteq_0", "tax_T <= 0"),
        ("num_group1_gt_0", "num_group1 > 0"), ("num_group1_lteq_0", "num_group1 <= 0"))), "fx_base fx_child1")
def g4(spark, sf_dir):
    return under(spark, sf_dir, g.null_filters(stats_of(spark, sf_dir)))


@query("g5_order_filters", "WITH " + JOINED + ", " + steps_sql("SELECT max(num_group1) FROM fx_child1") + """
SELECT 'count__if__num_group1_lt_' || x || '__then_1__' AS feature,
  CAST((SELECT count(*) FROM f WHERE num_group1 < x) AS DOUBLE) AS total FROM k
UNION ALL SELECT 'count__if__num_group1_eq_' || x || '__then_1__',
  CAST((SELECT count(*) FROM f WHERE num_group1 = x) AS DOUBLE) FROM (VALUES (0), (1)) e(x)""", "fx_base fx_child1")
def g5(spark, sf_dir):
    return under(spark, sf_dir, g.order_filters(stats_of(spark, sf_dir), "num_group1"))


def bare(spark, sf_dir, aggs) -> DataFrame:
    return a18_form(d.compute_features(frame(spark, sf_dir), g.cross("orders", aggs, [None]), train=False))


def bare_sql(items):
    return FRAME + "SELECT case_id, " + ",\n ".join(f'{t} AS "{n}"' for n, t in items) + " FROM f GROUP BY case_id"


@query("g7_count_features", bare_sql([
    (f"count__if_1_eq_1_then_{c.lower()}__", f"count({c})") for c in STATS_COLUMNS]), "fx_base fx_child1")
def g7(spark, sf_dir):
    return bare(spark, sf_dir, g.count_aggregations(stats_of(spark, sf_dir)))


NUMBERS = ("num_group1", "price_A", "quantity_A", "discount_P", "tax_T")


@query("g8_numeric_features", bare_sql([
    *[(f"{how}__if_1_eq_1_then_{c.lower()}__",
       f"CAST({how}({c}) AS BIGINT)" if c in KINDS else f"round({how}({c}), 6)")
      for c in NUMBERS for how in ("sum", "min", "max")],
    *[(f"{how}__if_1_eq_1_then_{c.lower()}__", f"round({sql}({c}), {digits})")
      for c in NUMBERS for how, sql, digits in (("avg", "avg", 6), ("stddev", "stddev_samp", 4))]]), "fx_base fx_child1")
def g8(spark, sf_dir):
    return bare(spark, sf_dir, g.numeric_aggregations(stats_of(spark, sf_dir)))


@query("g9_categorical_features", bare_sql([
    *[(f"count_distinct__if_1_eq_1_then_{c.lower()}__", f"count(DISTINCT {c})") for c in ("flag_M", "status_L", "ship_D")],
    *[(f"max__if_1_eq_1_then_{c.lower()}__", f"CAST(max({c}) AS VARCHAR)") for c in ("flag_M", "status_L", "ship_D")]]),
    "fx_base fx_child1")
def g9(spark, sf_dir):
    return bare(spark, sf_dir, g.categorical_aggregations(stats_of(spark, sf_dir)))


GAP = "date_date_decision__sub_date__if_1_eq_1_then_ship_d___"


@query("g10_date_features", bare_sql([
    (f"max_{GAP}", "max(gap)"), (f"min_{GAP}", "min(gap)"),
    (f"avg_{GAP}", "CAST(trunc(avg(gap)) AS BIGINT)"), (f"stddev_{GAP}", "CAST(trunc(stddev_samp(gap)) AS BIGINT)")]),
    "fx_base fx_child1")
def g10(spark, sf_dir):
    return bare(spark, sf_dir, g.date_aggregations(stats_of(spark, sf_dir)))


@query("g11_cross_product", FRAME + "\nUNION ALL ".join(
    f"SELECT 'count__if_{label}_then_{c.lower()}__' AS feature, CAST(count(CASE WHEN {cond} THEN {c} END) AS DOUBLE) AS total FROM f"
    for c in ("status_L", "ship_D")
    for own, label, cond in (
        ("status_L", "_status_l_eq_o_", "status_L = 'O'"), ("status_L", "_status_l_eq_f_", "status_L = 'F'"),
        ("ship_D", "_ship_d_is_null_", "ship_D IS NULL"), ("ship_D", "_ship_d_is_not_null_", "ship_D IS NOT NULL"),
        ("", "1_eq_1", "true"))
    if c != own), "fx_base fx_child1")
def g11(spark, sf_dir):
    rows = frame(spark, sf_dir).select("case_id", "target", "date_decision", "status_L", "ship_D")
    stats = g.column_stats(rows.drop("target", "date_decision"))
    conditions = [*g.filters(stats, None), None]
    return totals(d.compute_features(rows, g.cross("orders", g.count_aggregations(stats), conditions)))


@query("g12_simple_features", FRAME + "\nUNION ALL ".join([
    f"SELECT 'count__if_{label}_then_{what}__' AS feature, CAST(count({case}) AS DOUBLE) AS total FROM f"
    for label, what, case in [
        ("_flag_m_eq_a_", "1", "CASE WHEN flag_M = 'A' THEN 1 END"), ("_flag_m_eq_r_", "1", "CASE WHEN flag_M = 'R' THEN 1 END"),
        ("_status_l_eq_f_", "1", "CASE WHEN status_L = 'F' THEN 1 END"), ("_status_l_eq_o_", "1", "CASE WHEN status_L = 'O' THEN 1 END"),
        ("1_eq_1", "flag_m", "flag_M"), ("1_eq_1", "status_l", "status_L"), ("1_eq_1", "discount_p", "discount_P")]]),
    "fx_base fx_child1")
def g12(spark, sf_dir):
    rows = frame(spark, sf_dir).select("case_id", "target", "num_group1", "flag_M", "status_L", "discount_P")
    stats = g.column_stats(rows.drop("target"))
    return totals(d.compute_features(rows, g.define_simple_features("orders", stats)))
