"""Aggregates A1-A24, A32-A36."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform import rules
from strataform.operators import aggregates as agg
from strataform.plans import depth2 as nested
from strataform.plans.matrix import topic_rows

RANKED = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY num_group1 DESC) AS back,
                  row_number() OVER (PARTITION BY case_id ORDER BY num_group1) AS front
           FROM fx_child1)
"""


def one(name, columns, sql):
    """A query for a single aggregate over some child columns."""
    @query(name, sql, "fx_child1")
    def run(spark, sf_dir, how=name.split("_")[1]):
        child = v.child1(spark, sf_dir, positions=how in ("last", "first"))
        types = {f.name: f.dataType for f in child.schema.fields}
        found = [agg.measure(how, c, ["num_group1"], types[c]) for c in columns]
        return v.rounded(agg.aggregate(child, ["case_id"], found))

    return run


one("a1_max", ["price_A", "flag_M", "ship_D", "status_L"], """
SELECT case_id, round(max(price_A), 6) AS "max_price_A", max(flag_M) AS "max_flag_M",
       CAST(max(ship_D) AS VARCHAR) AS "max_ship_D", max(status_L) AS "max_status_L"
FROM fx_child1 GROUP BY case_id""")
one("a2_min", ["price_A", "flag_M", "ship_D"], """
SELECT case_id, round(min(price_A), 6) AS "min_price_A", min(flag_M) AS "min_flag_M",
       CAST(min(ship_D) AS VARCHAR) AS "min_ship_D"
FROM fx_child1 GROUP BY case_id""")
one("a3_last", ["price_A", "discount_P", "flag_M", "ship_D"], RANKED + """
SELECT case_id, round(max(CASE WHEN back = 1 THEN price_A END), 6) AS "last_price_A",
       round(max(CASE WHEN back = 1 THEN discount_P END), 6) AS "last_discount_P",
       max(CASE WHEN back = 1 THEN flag_M END) AS "last_flag_M",
       CAST(max(CASE WHEN back = 1 THEN ship_D END) AS VARCHAR) AS "last_ship_D"
FROM c GROUP BY case_id""")
one("a4_first", ["price_A", "discount_P", "flag_M"], RANKED + """
SELECT case_id, round(max(CASE WHEN front = 1 THEN price_A END), 6) AS "first_price_A",
       round(max(CASE WHEN front = 1 THEN discount_P END), 6) AS "first_discount_P",
       max(CASE WHEN front = 1 THEN flag_M END) AS "first_flag_M"
FROM c GROUP BY case_id""")
one("a5_sum", ["price_A", "discount_P"], """
SELECT case_id, round(coalesce(sum(price_A), 0), 6) AS "sum_price_A",
       round(coalesce(sum(discount_P), 0), 6) AS "sum_discount_P"
FROM fx_child1 GROUP BY case_id""")
one("a6_count", ["price_A", "discount_P", "ship_D"], """
SELECT case_id, count(price_A) AS "count_price_A", count(discount_P) AS "count_discount_P",
       count(ship_D) AS "count_ship_D"
FROM fx_child1 GROUP BY case_id""")
one("a7_mean", ["price_A", "discount_P"], """
SELECT case_id, round(avg(price_A), 6) AS "mean_price_A", round(avg(discount_P), 6) AS "mean_discount_P"
FROM fx_child1 GROUP BY case_id""")
one("a8_median", ["price_A", "discount_P", "ship_D"], """
SELECT case_id, round(median(price_A), 6) AS "medianprice_A", round(median(discount_P), 6) AS "mediandiscount_P",
       round(median(CAST(ship_D - DATE '1970-01-01' AS DOUBLE)), 6) AS "medianship_D"
FROM fx_child1 GROUP BY case_id""")
one("a9_var", ["price_A", "quantity_A"], """
SELECT case_id, CAST(CAST(var_samp(price_A) AS FLOAT) AS DOUBLE) AS "varprice_A", CAST(CAST(var_samp(quantity_A) AS FLOAT) AS DOUBLE) AS "varquantity_A"
FROM fx_child1 GROUP BY case_id""")


def mode_cte(column):
    return f"""mode_{column} AS (SELECT case_id, {column} AS mode_value FROM (
  SELECT case_id, {column}, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, {column}) AS r
  FROM fx_child1 WHERE {column} IS NOT NULL GROUP BY case_id, {column}) WHERE r = 1)"""


one("a10_mode", ["flag_M", "status_L"], f"""
WITH {mode_cte("flag_M")}, {mode_cte("status_L")}
SELECT k.case_id, f.mode_value AS "mode_flag_M", s.mode_value AS "mode_status_L"
FROM (SELECT DISTINCT case_id FROM fx_child1) k
LEFT JOIN mode_flag_M f ON f.case_id = k.case_id LEFT JOIN mode_status_L s ON s.case_id = k.case_id""")


def _last(c):
    return f"max(CASE WHEN back = 1 THEN {c} END)"


DAY = "CAST({} - DATE '1970-01-01' AS DOUBLE)"


def suffix_sql(serving: bool) -> str:
    """Text of the suffix aggregate over fx_child1 for one of the rule tables."""
    out = []
    for c in ("price_A", "quantity_A", "discount_P"):
        out += [(f"last_{c}", f"round({_last(c)}, 6)"), (f"max_{c}", f"round(max({c}), 6)"),
                (f"mean_{c}", f"round(avg({c}), 6)"), (f"median{c}", f"round(median({c}), 6)")]
        out.append((f"min_{c}", f"round(min({c}), 6)") if serving else (f"var{c}", f"CAST(CAST(var_samp({c}) AS FLOAT) AS DOUBLE)"))
    day = DAY.format("ship_D")
    out += [("last_ship_D", f"CAST({_last('ship_D')} AS VARCHAR)"), ("max_ship_D", "CAST(max(ship_D) AS VARCHAR)"),
            ("medianship_D", f"round(median({day}), 6)")]
    if serving:
        out += [("min_ship_D", "CAST(min(ship_D) AS VARCHAR)"), ("mean_ship_D", f"round(avg({day}), 6)")]
    out += [("last_flag_M", _last("flag_M")), ("max_flag_M", "max(flag_M)")]
    out.append(("min_flag_M", "min(flag_M)") if serving else ("mode_flag_M", "any_value(mode_value)"))
    for c in ("tax_T", "status_L", "bundle_L", "num_group1"):
        for name, text in ((f"last_{c}", _last(c)), (f"max_{c}", f"max({c})"), (f"min_{c}", f"min({c})")):
            out.append((name, f"round({text}, 6)" if c == "tax_T" else text))
    body = ",\n  ".join(f'{text} AS "{name}"' for name, text in out)
    return f"""
WITH {mode_cte("flag_M")},
c AS (SELECT f.*, m.mode_value, row_number() OVER (PARTITION BY f.case_id ORDER BY num_group1 DESC) AS back
      FROM fx_child1 f LEFT JOIN mode_flag_M m ON m.case_id = f.case_id)
SELECT case_id, {body} FROM c GROUP BY case_id"""


@query("a11_suffix_aggregate", suffix_sql(False), "fx_child1")
def a11(spark, sf_dir):
    return v.rounded(agg.suffix_aggregate(v.child1(spark, sf_dir)))


@query("a12_serving_aggregate", suffix_sql(True), "fx_child1")
def a12(spark, sf_dir):
    return v.rounded(agg.suffix_aggregate(v.child1(spark, sf_dir), rules.SERVE_RULES))


@query("p16_requested_outputs", RANKED + """
SELECT case_id, round(max(price_A), 6) AS "max_price_A", round(avg(price_A), 6) AS "mean_price_A",
       max(CASE WHEN back = 1 THEN flag_M END) AS "last_flag_M"
FROM c GROUP BY case_id""", "fx_child1")
def p16(spark, sf_dir):
    wanted = ["max_price_A", "mean_price_A_3", "last_flag_M"]
    return v.rounded(agg.suffix_aggregate(v.child1(spark, sf_dir), requested=wanted))


@query("a13_parts_aggregate", RANKED + """
SELECT case_id, round(max(price_A), 6) AS "max_price_A", round(avg(price_A), 6) AS "mean_price_A",
       max(CASE WHEN back = 1 THEN status_L END) AS "last_status_L", max(num_group1) AS "max_num_group1"
FROM c GROUP BY case_id""", "fx_child1")
def a13(spark, sf_dir):
    # two parts that share cases and store the amount in different types
    child = v.child1(spark, sf_dir)
    even = child.where("num_group1 % 2 = 0")
    odd = child.where("num_group1 % 2 = 1").withColumn("price_A", F.col("price_A").cast("string"))
    wanted = ["max_price_A", "mean_price_A", "last_status_L", "max_num_group1"]
    return v.rounded(topic_rows([even, odd], 1, requested=wanted))


# -- nested tables under their own column names ---------------------------------

APPLICATION_VIEW = """
SELECT case_id, num_group1,
  CASE type_1M WHEN 'A' THEN 'P33_145_161' WHEN 'R' THEN 'P201_63_60' ELSE type_1M END AS cacccardblochreas_147M,
  CASE WHEN price_A < 20000 THEN 'PRIMARY_MOBILE' WHEN price_A < 40000 THEN 'HOME_PHONE'
       WHEN price_A < 60000 THEN 'EMPLOYMENT_PHONE' END AS conts_type_509L,
  CASE WHEN type_2M = 'A' THEN 'CANCELLED' WHEN type_2M = 'N' THEN 'ACTIVE' WHEN type_2M = 'R' THEN 'BLOCKED'
       WHEN price_A < 30000 THEN 'RENEWED' WHEN price_A < 50000 THEN 'INACTIVE' ELSE 'UNCONFIRMED' END
       AS credacc_cards_status_52L
FROM {fx_depth2}"""
PERSON_VIEW = """
SELECT case_id, num_group1,
  CASE type_1M WHEN 'A' THEN 'P125_48_164' WHEN 'R' THEN 'P155_139_77' WHEN 'N' THEN 'P114_74_190' END AS addres_district_368M,
  CASE type_2M WHEN 'A' THEN 'PERMANENT' WHEN 'R' THEN 'CONTACT' WHEN 'N' THEN 'TEMPORARY' ELSE 'REGISTERED' END AS addres_role_871L,
  CASE WHEN price_A < 30000 THEN 'P161_14_174' WHEN price_A < 60000 THEN 'P144_138_111' ELSE 'P46_103_143' END AS addres_zip_823M,
  CASE WHEN dpd_1P > 0.05 THEN 'P38_92_157' WHEN dpd_1P > 0.02 THEN 'P177_137_98' WHEN dpd_1P > 0 THEN 'P7_147_157' END AS conts_role_79M,
  CASE WHEN dpd_2P > 0.08 THEN 'P22_131_138' WHEN dpd_2P > 0.07 THEN 'P164_110_33' WHEN dpd_2P > 0.06 THEN 'P28_32_178'
       WHEN dpd_2P > 0.05 THEN 'P148_57_109' WHEN dpd_2P > 0.04 THEN 'P112_86_147' WHEN dpd_2P > 0.03 THEN 'P191_80_124'
       WHEN dpd_2P > 0.02 THEN 'P7_47_145' WHEN dpd_2P > 0.01 THEN 'P164_122_65' WHEN dpd_2P > 0 THEN 'P82_144_169' END AS empls_economicalst_849M,
  ship_D AS empls_employedfrom_796D,
  CASE WHEN price_A < 25000 THEN 'P114_118_163' WHEN price_A < 50000 THEN 'P179_55_175' WHEN price_A < 70000 THEN 'P26_112_122' END AS empls_employer_name_740M,
  coalesce(type_1M, type_2M) AS relatedpersons_role_762T
FROM {fx_depth2}"""
BUREAU_B_VIEW = """
SELECT case_id, num_group1, num_group2, ship_D AS pmts_date_1107D, dpd_1P AS pmts_dpdvalue_108P,
       price_A AS pmts_pmtsoverdue_635A
FROM {fx_depth2}"""
BUREAU_A_VIEW = """
SELECT case_id, num_group1,
  CASE type_1M WHEN 'A' THEN '9a0c095e' WHEN 'R' THEN '8fd95e4b' ELSE 'a55475b1' END AS collater_typofvalofguarant_298M,
  CASE type_2M WHEN 'A' THEN '9a0c095e' WHEN 'R' THEN '8fd95e4b' ELSE 'a55475b1' END AS collater_typofvalofguarant_407M,
  CASE WHEN type_1M IS NOT NULL THEN price_A END AS collater_valueofguarantee_1124L,
  CASE WHEN type_2M IS NOT NULL THEN price_A END AS collater_valueofguarantee_876L,
  CASE WHEN dpd_1P > 0.05 THEN 'c7a5ad39' WHEN dpd_1P > 0.02 THEN '3cbe86ba' END AS collaterals_typeofguarante_359M,
  CASE WHEN dpd_2P > 0.05 THEN 'c7a5ad39' WHEN dpd_2P > 0.02 THEN '3cbe86ba' END AS collaterals_typeofguarante_669M,
  dpd_1P AS pmts_dpd_1073P, dpd_2P AS pmts_dpd_303P,
  CAST(month(ship_D) AS DOUBLE) AS pmts_month_158T, CAST(month(ship_D) + 1 AS DOUBLE) AS pmts_month_706T,
  price_A / 2 AS pmts_overdue_1140A, price_A / 4 AS pmts_overdue_1152A,
  CASE WHEN type_1M IS NOT NULL THEN CAST(year(ship_D) AS DOUBLE) END AS pmts_year_1139T,
  CASE WHEN type_2M IS NOT NULL THEN CAST(year(ship_D) - 1 AS DOUBLE) END AS pmts_year_507T,
  CASE WHEN type_1M = 'A' THEN 'ab3c25cf' WHEN type_1M = 'R' THEN '15f04f45' END AS subjectroles_name_541M,
  CASE WHEN type_2M = 'A' THEN 'ab3c25cf' WHEN type_2M = 'N' THEN '15f04f45' END AS subjectroles_name_838M
FROM {fx_depth2}"""


def nested_view(spark, sf_dir, text, positions=False):
    return spark.sql(text, fx_depth2=v.depth2(spark, sf_dir, positions))


def oracle_view(text):
    return "WITH n AS (" + text.replace("{fx_depth2}", "fx_depth2") + ")\n"


def count_texts(values, shown=None):
    return [
        f"""count(CASE WHEN {c} = '{x}' THEN 1 END) AS "count__if__{(shown or {}).get(c, c).lower()}_eq_{x.lower()}__then_1__L\""""
        for c, found in values.items() for x in found
    ]


def distinct_texts(columns):
    return [f'count(DISTINCT {c}) AS "count_distinct_{c.lower()}__L"' for c in columns]


def nested_sql(text, items):
    return oracle_view(text) + "SELECT case_id, num_group1,\n  " + ",\n  ".join(items) + "\nFROM n GROUP BY case_id, num_group1"


A14_ITEMS = [*count_texts(nested.APPLICATION_VALUES), *distinct_texts(nested.APPLICATION_VALUES)]


@query("a14_application_aggregate", nested_sql(APPLICATION_VIEW, A14_ITEMS), "fx_depth2")
def a14(spark, sf_dir):
    return nested.reduce_nested(nested_view(spark, sf_dir, APPLICATION_VIEW), nested.application_measures())


A15_ITEMS = [
    *count_texts(nested.PERSON_VALUES),
    'count(DISTINCT addres_district_368M) AS "count_addres_district_368m__L"',
    *distinct_texts([
        "addres_role_871L", "addres_zip_823M", "conts_role_79M", "empls_economicalst_849M",
        "empls_employedfrom_796D", "empls_employer_name_740M", "relatedpersons_role_762T",
    ]),
    'CAST(min(empls_employedfrom_796D) AS VARCHAR) AS "min_empls_employedfrom_796d__D"',
    'CAST(max(empls_employedfrom_796D) AS VARCHAR) AS "max_empls_employedfrom_796d__D"',
]


@query("a15_person_aggregate", nested_sql(PERSON_VIEW, A15_ITEMS), "fx_depth2")
def a15(spark, sf_dir):
    return v.rounded(nested.reduce_nested(nested_view(spark, sf_dir, PERSON_VIEW), nested.person_measures()))


A16_ITEMS = [
    'count(num_group2) AS "count__num_group2__L"',
    'CAST(max(pmts_date_1107D) AS VARCHAR) AS "max_pmts_date_1107d_D"',
    'CAST(min(pmts_date_1107D) AS VARCHAR) AS "min_pmts_date_1107d_D"',
    'round(sum(pmts_dpdvalue_108P), 6) AS "sum_pmts_dpdvalue_108p_P"',
    'round(sum(pmts_pmtsoverdue_635A), 6) AS "sum_pmts_pmtsoverdue_635a_A"',
]


@query("a16_bureau_b_aggregate", nested_sql(BUREAU_B_VIEW, A16_ITEMS), "fx_depth2")
def a16(spark, sf_dir):
    rows = nested_view(spark, sf_dir, BUREAU_B_VIEW, positions=True)
    return v.rounded(nested.reduce_nested(rows, nested.bureau_b_measures()))


def stacked_sql():
    sides = []
    for which in (0, 1):
        items = [f'{pair[which]} AS "{name}"' for name, pair in nested.BUREAU_PAIRS.items()]
        sides.append(f"SELECT case_id, num_group1, {1 - which} AS status, " + ", ".join(items) + " FROM n")
    return ", s AS (" + " UNION ALL ".join(sides) + ")\n"


@query("x1_unify_pairs", oracle_view(BUREAU_A_VIEW) + stacked_sql() + """
SELECT case_id, num_group1, status, "collater_typofvalofguarant_298M407M",
  round("pmts_dpd_1073P303P", 6) AS "pmts_dpd_1073P303P", round("pmts_overdue_1140A1152A", 6) AS "pmts_overdue_1140A1152A",
  round("collater_valueofguarantee_1124L876L", 6) AS "collater_valueofguarantee_1124L876L",
  "collaterals_typeofguarante_359M669M", "pmts_month_158T706T", "pmts_year_1139T507T", "subjectroles_name_541M838M"
FROM s""", "fx_depth2")
def x1(spark, sf_dir):
    return v.rounded(nested.stack_contracts(nested_view(spark, sf_dir, BUREAU_A_VIEW)))


YEAR = "CAST(CAST(\"pmts_year_1139T507T\" AS INT) AS VARCHAR) || '-01-01'"
A17_ITEMS = [
    'count(status) AS "count_status__L"', 'CAST(sum(status) AS BIGINT) AS "sum_status__L"',
    'round(avg(status), 6) AS "avg_status__L"',
    *[f'count(DISTINCT "{c}") AS "count_distinct_{c}__L"' for c in (
        "collater_typofvalofguarant_298M407M", "collaterals_typeofguarante_359M669M", "subjectroles_name_541M838M")],
    *[f'round(sum("{c}"), 6) AS "sum_{c}__{letter}"' for c, letter in (
        ("collater_valueofguarantee_1124L876L", "L"), ("pmts_dpd_1073P303P", "P"),
        ("pmts_month_158T706T", "T"), ("pmts_overdue_1140A1152A", "A"))],
    f'min({YEAR}) AS "min_pmts_year_1139T507T__D"', f'max({YEAR}) AS "max_pmts_year_1139T507T__D"',
    *count_texts(nested.BUREAU_VALUES, {name: pair[0] for name, pair in nested.BUREAU_PAIRS.items()}),
]


@query("a17_contract_aggregate", oracle_view(BUREAU_A_VIEW) + stacked_sql() + "SELECT case_id, num_group1,\n  "
       + ",\n  ".join(A17_ITEMS) + "\nFROM s GROUP BY case_id, num_group1", "fx_depth2")
def a17(spark, sf_dir):
    contracts = nested_view(spark, sf_dir, BUREAU_A_VIEW)
    rows = nested.stack_contracts(contracts)
    return v.rounded(nested.reduce_nested(rows, nested.bureau_a_measures(), sizes=contracts))


# -- A20 ff ---------------------------------------------------------------------

A20_SQL = """
SELECT case_id, round(avg(num_group1), 6) AS num_group1, round(avg(price_A), 6) AS "price_A",
  round(avg(quantity_A), 6) AS "quantity_A", round(avg(discount_P), 6) AS "discount_P",
  round(avg(tax_T), 6) AS "tax_T", max(flag_M) AS "flag_M", max(status_L) AS "status_L",
  round(avg(CAST(bundle_L AS INT)), 6) AS "bundle_L", CAST(max(ship_D) AS VARCHAR) AS "ship_D"
FROM fx_child1 GROUP BY case_id"""


@query("a20_type_aggregate", A20_SQL, "fx_child1")
def a20(spark, sf_dir):
    return v.rounded(agg.type_aggregate(v.child1(spark, sf_dir)))


@query("a21_union_aggregate", A20_SQL, "fx_child1")
def a21(spark, sf_dir):
    from strataform.operators.setops import concat_relaxed

    child = v.child1(spark, sf_dir)
    parts = [child.where(F.col("num_group1") % 3 == i) for i in range(3)]
    return v.rounded(agg.type_aggregate(concat_relaxed(parts)))


@query("a22_filtered_aggregate", """
SELECT case_id, count(num_group1) AS num_group1, round(coalesce(sum(discount_P), 0), 6) AS "discount_P_sum",
  round(avg(discount_P), 6) AS "discount_P_mean",
  round(avg(CASE WHEN num_group1 = 0 THEN discount_P END), 6) AS "num1_0_discount_P_mean",
  round(avg(CASE WHEN num_group1 < 3 THEN discount_P END), 6) AS "num1_3_discount_P_mean",
  round(coalesce(sum(CASE WHEN num_group1 < 3 THEN discount_P END), 0), 6) AS "num1_3_discount_P_sum"
FROM fx_child1 GROUP BY case_id""", "fx_child1")
def a22(spark, sf_dir):
    return v.rounded(agg.filtered_aggregate(v.child1(spark, sf_dir), "discount_P"))


@query("a23_two_level_spread", """
WITH s AS (SELECT case_id, ship_D, sum(price_A) AS x FROM fx_child1 WHERE ship_D IS NOT NULL GROUP BY case_id, ship_D)
SELECT case_id, round(stddev_samp(x), 4) AS "price_A_sum_std" FROM s GROUP BY case_id""", "fx_child1")
def a23(spark, sf_dir):
    return v.rounded(agg.two_level_spread(v.child1(spark, sf_dir, False), "price_A", "ship_D"), 4)


@query("a24_distinct_per_case", """
SELECT case_id, count(DISTINCT flag_M) AS "flag_M_nunique", count(DISTINCT quantity_A) AS "quantity_A_nunique",
       count(DISTINCT ship_D) AS "ship_D_nunique"
FROM fx_child1 GROUP BY case_id""", "fx_child1")
def a24(spark, sf_dir):
    return agg.distinct_per_key(v.child1(spark, sf_dir, False), ["flag_M", "quantity_A", "ship_D"])


@query("a25_rate_by_month", """
SELECT MONTH, count(target) AS count, CAST(sum(target) AS BIGINT) AS sum, round(sum(target) * 1.0 / count(target), 6) AS rate,
       round(count(target) * 1.0 / sum(count(target)) OVER (), 6) AS count_pct
FROM fx_base GROUP BY MONTH""", "fx_base")
def a25(spark, sf_dir):
    return v.rounded(agg.rate_by(v.base(spark, sf_dir), "MONTH", "target"))


@query("a32_mean_by_case", """
SELECT case_id, round(avg(price_A), 6) AS "price_A" FROM fx_child1 GROUP BY case_id""", "fx_child1")
def a32(spark, sf_dir):
    return v.rounded(agg.mean_by(v.child1(spark, sf_dir, False), "price_A"))


@query("a33_class_ratio", """
SELECT round(count(CASE WHEN target = 0 THEN 1 END) * 1.0 / count(CASE WHEN target = 1 THEN 1 END), 6) AS class_ratio
FROM fx_base""", "fx_base")
def a33(spark, sf_dir):
    return v.rounded(agg.class_ratio(v.base(spark, sf_dir)))


@query("a34_class_weights", """
SELECT target, round((SELECT count(*) FROM fx_base) / (2.0 * count(*)), 6) AS weight FROM fx_base GROUP BY target""", "fx_base")
def a34(spark, sf_dir):
    return v.rounded(agg.class_weights(v.base(spark, sf_dir)))


@query("a35_target_means", """
SELECT priority_M AS "priority_M", round(avg(target), 6) AS encoded FROM fx_base GROUP BY priority_M""", "fx_base")
def a35(spark, sf_dir):
    return v.rounded(agg.target_means(v.base(spark, sf_dir), "priority_M"))


@query("a36_correlation", """
SELECT * FROM (
SELECT 'price_A' AS x, 'quantity_A' AS y, round(corr(price_A, quantity_A), 6) AS corr FROM fx_child1 UNION ALL
SELECT 'price_A', 'discount_P', round(corr(price_A, discount_P), 6) FROM fx_child1 UNION ALL
SELECT 'price_A', 'tax_T', round(corr(price_A, tax_T), 6) FROM fx_child1 UNION ALL
SELECT 'quantity_A', 'discount_P', round(corr(quantity_A, discount_P), 6) FROM fx_child1 UNION ALL
SELECT 'quantity_A', 'tax_T', round(corr(quantity_A, tax_T), 6) FROM fx_child1 UNION ALL
SELECT 'discount_P', 'tax_T', round(corr(discount_P, tax_T), 6) FROM fx_child1)""", "fx_child1")
def a36(spark, sf_dir):
    rows = v.child1(spark, sf_dir, False)
    return v.rounded(agg.correlation(rows, ["price_A", "quantity_A", "discount_P", "tax_T"]))
