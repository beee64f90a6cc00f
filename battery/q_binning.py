"""Bins, IV, PSI: B1-B7."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.operators import binning as b
from strataform.operators.models import correlated_columns

# Case features: a numeric column with nulls, one with few values, a text column.
FEATURES = """x AS (SELECT b.case_id, b.target, b.priority_M, b.total_A, CASE WHEN b.WEEK_NUM >= 172 THEN 1 ELSE 0 END AS holdout,
  c.discount, CAST(c.lines % 4 AS BIGINT) AS lines_mod FROM fx_base b LEFT JOIN (SELECT case_id, avg(discount_P) AS discount, count(*) AS lines
  FROM fx_child1 GROUP BY case_id) c ON b.case_id = c.case_id)"""
COLUMNS = ("total_A", "discount", "lines_mod", "priority_M")


def features(spark, sf_dir):
    lines = v.child1(spark, sf_dir, False).groupBy("case_id").agg(
        F.avg("discount_P").alias("discount"), F.count(F.lit(1)).alias("_n")
    ).select("case_id", "discount", (F.col("_n") % 4).alias("lines_mod"))
    base = v.base(spark, sf_dir).select(
        "case_id", "target", "priority_M", "total_A", (F.col("WEEK_NUM") >= 172).cast("int").alias("holdout")
    )
    return base.join(lines, "case_id", "left")


def quantile_bins(column, parts):
    """Bin number: how many inner edges lie below the filled value."""
    probs = ", ".join(str(i / parts) for i in range(1, parts))
    return f"""(SELECT case_id, target, holdout, '{column}' AS col,
  CAST(len(list_filter(q.edges, lambda e: e < coalesce({column}, -99999999) AND e > q.lo)) AS DOUBLE) AS bin_order, '' AS bin
  FROM x, (SELECT list_distinct(quantile_cont(coalesce({column}, -99999999), [{probs}])) AS edges,
    min(coalesce({column}, -99999999)) AS lo FROM x) q)"""


def bins_cte(parts=10, prefix=7):
    return f"""p AS (SELECT * FROM {quantile_bins('total_A', parts)} UNION ALL SELECT * FROM {quantile_bins('discount', parts)}
UNION ALL SELECT case_id, target, holdout, 'lines_mod', coalesce(CAST(lines_mod AS DOUBLE), CAST('inf' AS DOUBLE)),
  coalesce(CAST(lines_mod AS VARCHAR), 'nan') FROM x
UNION ALL SELECT case_id, target, holdout, 'priority_M', 0.0, coalesce(substr(priority_M, 1, {prefix}), 'Missing') FROM x),
k AS (SELECT col, bin, bin_order,
  count(CASE WHEN holdout = 0 AND target = 0 THEN 1 END) AS dev_good, count(CASE WHEN holdout = 0 AND target = 1 THEN 1 END) AS dev_bad,
  count(CASE WHEN holdout = 1 AND target = 0 THEN 1 END) AS val_good, count(CASE WHEN holdout = 1 AND target = 1 THEN 1 END) AS val_bad
  FROM p GROUP BY ALL)"""


def drop_edges(df):
    """Edge text is left out of the comparison; the bin number stays."""
    wide = F.col("col").isin("total_A", "discount")
    clean = df.withColumn("bin", F.when(wide, "").otherwise(F.col("bin")))
    return clean.withColumn("bin_order", F.when(F.col("bin_order") == float("inf"), 99).otherwise(F.col("bin_order")))


ORDER = "CASE WHEN isinf(bin_order) THEN 99 ELSE bin_order END AS bin_order"


@query("b1_bin_counts", f"""
WITH {FEATURES}, {bins_cte()} SELECT col, bin, {ORDER}, dev_good, dev_bad, val_good, val_bad FROM k""", "fx_base fx_child1")
def b1(spark, sf_dir):
    return drop_edges(b.bin_counts(features(spark, sf_dir), COLUMNS, "target", "holdout"))


def share_log(p, q):
    return f"CASE WHEN {p} > 0 AND {q} > 0 THEN ({p} - {q}) * ln({p} / {q}) ELSE 0 END"


REPORT = """t AS (SELECT *, dev_good + dev_bad AS dev_all, val_good + val_bad AS val_all FROM k),
s AS (SELECT *, CAST(sum(dev_all) OVER c AS BIGINT) AS dev_all_total, CAST(sum(dev_good) OVER c AS BIGINT) AS dev_good_total,
  CAST(sum(dev_bad) OVER c AS BIGINT) AS dev_bad_total, CAST(sum(val_all) OVER c AS BIGINT) AS val_all_total,
  CAST(sum(val_good) OVER c AS BIGINT) AS val_good_total, CAST(sum(val_bad) OVER c AS BIGINT) AS val_bad_total
  FROM t WINDOW c AS (PARTITION BY col)),
r AS (SELECT *, dev_good / dev_good_total AS dg, dev_bad / dev_bad_total AS db, val_good / val_good_total AS vg,
  val_bad / val_bad_total AS vb, dev_all / dev_all_total AS da, val_all / val_all_total AS va FROM s),
i AS (SELECT *, """ + share_log("dg", "db") + " AS dev_iv, " + share_log("vg", "vb") + " AS val_iv, " + share_log("va", "da") + " AS psi FROM r)"
REPORT = REPORT.replace(" / dev", " * 1.0 / nullif(dev").replace(" / val", " * 1.0 / nullif(val")
for _total in ("dev_good_total", "dev_bad_total", "val_good_total", "val_bad_total", "dev_all_total", "val_all_total"):
    REPORT = REPORT.replace(f"nullif({_total}", f"nullif({_total}, 0)")


def b2_select(dev_only=False):
    out = ["col", "bin", ORDER, "dev_good", "dev_bad", "dev_all", "round(dev_bad * 1.0 / nullif(dev_all, 0), 6) AS dev_bad_rate",
           "dev_all_total", "dev_good_total", "dev_bad_total", "round(da, 6) AS dev_all_proportion", "round(dg, 6) AS dev_good_proportion",
           "round(db, 6) AS dev_bad_proportion", 'round(dev_iv, 6) AS "dev_IV"',
           'round(sum(dev_iv) OVER (PARTITION BY col), 6) AS "dev_IV_total"']
    if not dev_only:
        out += ["val_good", "val_bad", "val_all", "round(val_bad * 1.0 / nullif(val_all, 0), 6) AS val_bad_rate",
                "val_all_total", "val_good_total", "val_bad_total", "round(va, 6) AS val_all_proportion", "round(vg, 6) AS val_good_proportion",
                "round(vb, 6) AS val_bad_proportion", 'round(val_iv, 6) AS "val_IV"',
                'round(sum(val_iv) OVER (PARTITION BY col), 6) AS "val_IV_total"', 'round(psi, 6) AS "PSI"',
                'round(sum(psi) OVER (PARTITION BY col), 6) AS "PSI_total"']
    return "SELECT " + ", ".join(out) + " FROM i"


@query("b2_fine_class_report", f"WITH {FEATURES}, {bins_cte()}, {REPORT} {b2_select()}", "fx_base fx_child1")
def b2(spark, sf_dir):
    return v.rounded(drop_edges(b.fine_class_report(features(spark, sf_dir), COLUMNS, "target", "holdout")))


@query("b2_development_report", f"WITH {FEATURES.replace('CASE WHEN b.WEEK_NUM >= 172 THEN 1 ELSE 0 END', '0')}, {bins_cte()}, {REPORT} {b2_select(True)}",
       "fx_base fx_child1")
def b2_dev(spark, sf_dir):
    return v.rounded(drop_edges(b.fine_class_report(features(spark, sf_dir), COLUMNS, "target")))


@query("b3_psi_report", f"""WITH {FEATURES}, {bins_cte(20, 8)}, {REPORT}
SELECT col, bin, {ORDER}, dev_all, val_all, round(da, 6) AS dev_all_proportion, round(va, 6) AS val_all_proportion,
  round(psi, 6) AS "PSI", round(sum(psi) OVER (PARTITION BY col), 6) AS "PSI_total" FROM i""", "fx_base fx_child1")
def b3(spark, sf_dir):
    return v.rounded(drop_edges(b.psi_report(features(spark, sf_dir), COLUMNS, "target", "holdout")))


B4_TAIL = """g AS (SELECT bin_order, count(*) AS count, count(CASE WHEN target = 1 THEN 1 END) AS event FROM z GROUP BY bin_order),
h AS (SELECT *, count - event AS non_event, count * 1.0 / sum(count) OVER () AS count_pct, event * 1.0 / count AS event_rate,
  event * 1.0 / sum(event) OVER () AS event_pct, (count - event) * 1.0 / sum(count - event) OVER () AS non_event_pct FROM g)
SELECT bin_order, count, event, non_event, round(count_pct, 6) AS count_pct, round(event_rate, 6) AS event_rate,
  round(event_pct, 6) AS event_pct, round(non_event_pct, 6) AS non_event_pct, round(""" + share_log("event_pct", "non_event_pct") + ", 6) AS iv FROM h"


@query("b4_fine_bins", f"""
WITH {FEATURES}, s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT discount AS v FROM x WHERE discount IS NOT NULL)),
e AS (SELECT list_distinct(list(round_even(v, 4))) AS edges FROM s
  JOIN range(26) k(p) ON i = CAST(round_even(round(p / 25.0, 2) * (n - 1), 0) AS BIGINT)),
z AS (SELECT target, CASE WHEN discount IS NULL THEN 2e9 ELSE CAST(len(list_filter(edges, lambda q: q <= discount)) AS DOUBLE) END
  AS bin_order FROM x, e), {B4_TAIL}""", "fx_base fx_child1")
def b4(spark, sf_dir):
    return v.rounded(b.fine_bins(features(spark, sf_dir), "discount", "target")[0].drop("bin"))


@query("b4_given_splits", f"""
WITH {FEATURES}, z AS (SELECT target, CASE WHEN lines_mod IS NULL THEN 2e9 WHEN lines_mod = 3 THEN 1e9 WHEN lines_mod < 1 THEN 0.0 ELSE 1.0 END
  AS bin_order FROM x), {B4_TAIL}""", "fx_base fx_child1")
def b4_given(spark, sf_dir):
    table, _ = b.fine_bins(features(spark, sf_dir), "lines_mod", "target", special_codes={"Three": 3}, splits=[0, 1, 3])
    return v.rounded(table.drop("bin"))


@query("b4_text_bins", f"""
WITH {FEATURES}, z AS (SELECT target, priority_M AS bin_order FROM x), {B4_TAIL}""".replace(
    "SELECT bin_order, count, event", "SELECT bin_order AS bin, count, event"), "fx_base fx_child1")
def b4_text(spark, sf_dir):
    return v.rounded(b.fine_bins(features(spark, sf_dir), "priority_M", "target")[0].drop("bin_order"))


@query("b5_information_value", f"""WITH {FEATURES}, {bins_cte()}, {REPORT}
SELECT col, round(sum(dev_iv), 6) AS "dev_IV_total" FROM i GROUP BY col""", "fx_base fx_child1")
def b5(spark, sf_dir):
    report = b.fine_class_report(features(spark, sf_dir), COLUMNS, "target", "holdout")
    return v.rounded(report.groupBy("col").agg(F.max("dev_IV_total").alias("dev_IV_total")))


@query("b6_population_stability", f"""WITH {FEATURES}, {bins_cte()}, {REPORT}
SELECT col, round(sum(psi), 6) AS "PSI_total" FROM i GROUP BY col""", "fx_base fx_child1")
def b6(spark, sf_dir):
    report = b.fine_class_report(features(spark, sf_dir), COLUMNS, "target", "holdout")
    return v.rounded(report.groupBy("col").agg(F.max("PSI_total").alias("PSI_total")))


@query("b7_drop_correlated", """
SELECT case_id, round(sum(price_A), 6) AS total, round(sum(quantity_A), 6) AS quantity, round(avg(tax_T), 6) AS tax FROM fx_child1 GROUP BY case_id""", "fx_child1")
def b7(spark, sf_dir):
    # the copy of the total moves with the total and is dropped
    rows = v.child1(spark, sf_dir, False).groupBy("case_id").agg(
        F.sum("price_A").alias("total"), F.sum("quantity_A").alias("quantity"), F.avg("tax_T").alias("tax"),
        F.max("status_L").alias("status_L"), F.max(F.col("bundle_L").cast("int")).alias("label"),
    ).withColumn("copy", F.col("total") * 2 + 1)
    bad = correlated_columns(rows, ["total", "quantity", "tax", "copy"], ["status_L"], "label", 0.95)
    return v.rounded(rows.drop(*bad, "label", "status_L"))
