"""Sources and sinks S1-S17: given tables written under the naming scheme and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from battery import views as v
from battery.registry import query
from strataform.session import scratch_path
from strataform.operators import splits
from strataform.operators.binning import fine_class_report, tagged_report
from strataform.sources import readers, writers
from strataform.sources.catalog import Catalog

BASE_SQL = """SELECT case_id, CAST(date_decision AS VARCHAR) AS date_decision, MONTH, WEEK_NUM, target,
  round(score, 6) AS score, round(total_A, 6) AS "total_A", priority_M AS "priority_M" FROM fx_base"""
STATIC_SQL = """SELECT case_id, round(acctbal_A, 6) AS "acctbal_A", segment_M AS "segment_M", nation_M AS "nation_M" FROM fx_static0"""


def raw_catalog(spark, sf_dir) -> Catalog:
    """Topic files of the customer tables; the static topic has two parts of different types."""
    root = scratch_path(spark, "catalog")
    folder = f"{root}/parquet_files/train"
    static = v.static0(spark, sf_dir)
    static.where("case_id % 2 = 0").write.parquet(f"{folder}/train_static_0_0.parquet")
    odd = static.where("case_id % 2 = 1").withColumn("case_id", F.col("case_id").cast("int"))
    odd.write.parquet(f"{folder}/train_static_0_1.parquet")
    v.static_cb0(spark, sf_dir).write.parquet(f"{folder}/train_static_cb_0.parquet")
    v.base2(spark, sf_dir).write.parquet(f"{folder}/train_base.parquet")
    v.depth1(spark, sf_dir).write.parquet(f"{folder}/train_applprev_1_0.parquet")
    return Catalog(spark, root)


@query("s1_topic_catalog", """
SELECT * FROM (VALUES ('train_base.parquet', 'train', 'base', '', '', 'parquet'),
  ('train_static_0_0.parquet', 'train', 'static', '0', '0', 'parquet'),
  ('train_static_0_1.parquet', 'train', 'static', '0', '1', 'parquet'),
  ('train_static_cb_0.parquet', 'train', 'static_cb', '0', '', 'parquet'),
  ('train_applprev_1_0.parquet', 'train', 'applprev', '1', '0', 'parquet')) t(file_name, split, topic, depth, part, format)""")
def s1(spark, sf_dir):
    rows = [(f.file_name, f.split, f.topic, f.depth, f.part, f.format) for f in raw_catalog(spark, sf_dir).files()]
    return spark.createDataFrame(rows, "file_name string, split string, topic string, depth string, part string, format string")


@query("s2_read_topic", STATIC_SQL, "fx_static0")
def s2(spark, sf_dir):
    return v.rounded(raw_catalog(spark, sf_dir).read("static", 0))


@query("s3_prepared_topic", """
SELECT case_id, num_group1, round(total_A, 6) AS "total_A", status_L AS "status_L", priority_M AS "priority_M",
  CAST(order_D AS VARCHAR) AS "order_D" FROM fx_depth1""", "fx_depth1")
def s3(spark, sf_dir):
    catalog = Catalog(spark, scratch_path(spark, "prepared"))
    catalog.save_prepared(v.depth1(spark, sf_dir), "applprev", 1)
    return v.rounded(catalog.read_prepared("applprev", 1))


@query("s4_read_csv", STATIC_SQL, "fx_static0")
def s4(spark, sf_dir):
    static = v.static0(spark, sf_dir)
    path = scratch_path(spark, "csv")
    static.write.option("header", True).csv(path)
    return v.rounded(readers.read_csv(spark, path, static.schema))


@query("s5_column_listing", """
SELECT * FROM (VALUES ('case_id'), ('acctbal_A'), ('segment_M'), ('nation_M')) t(col)""")
def s5(spark, sf_dir):
    catalog = raw_catalog(spark, sf_dir)
    names = catalog.columns(catalog.find("static", 0)[0])
    return spark.createDataFrame([(n,) for n in names], "col string")


@query("s6_first_files", "SELECT case_id, target FROM fx_base WHERE case_id % 3 < 2", "fx_base")
def s6(spark, sf_dir):
    base, root = v.base(spark, sf_dir).select("case_id", "target"), scratch_path(spark, "parts")
    paths = [f"{root}/train_base_0_{i}.parquet" for i in range(3)]
    for i, path in enumerate(paths):
        base.where(F.col("case_id") % 3 == i).write.parquet(path)
    return readers.read_first_files(spark, paths, 2)


@query("s7_merged_schema", """
SELECT case_id, target, CASE WHEN case_id % 2 = 0 THEN round(score, 6) END AS score FROM fx_base""", "fx_base")
def s7(spark, sf_dir):
    base, path = v.base(spark, sf_dir).select("case_id", "target", "score"), scratch_path(spark, "merged")
    base.where("case_id % 2 = 0").write.parquet(path)
    base.where("case_id % 2 = 1").drop("score").write.mode("append").parquet(path)
    return v.rounded(readers.read_merged(spark, path))


@query("s8_named_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def s8(spark, sf_dir):
    return readers.read_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("s9_folder_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s9(spark, sf_dir):
    return readers.scan_folder(spark, f"{sf_dir}/nation.parquet")


@query("s10_mixed_folder", "SELECT case_id, target, round(score, 6) AS score FROM fx_base", "fx_base")
def s10(spark, sf_dir):
    base, path = v.base(spark, sf_dir), scratch_path(spark, "mixed")
    base.where("case_id % 2 = 0").write.parquet(path)
    half = base.where("case_id % 2 = 1").select("score", "case_id", "target")
    half.write.mode("append").option("header", True).csv(path)
    schema = "score double, case_id bigint, target int"
    return v.rounded(readers.read_mixed(spark, path, ["case_id", "target", "score"], schema))


@query("s11_dictionary", """
WITH d AS (SELECT n_name || '_A' AS name, r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT name AS "column", name || ': ' || text || ' (Transform Amount)' AS description FROM d
UNION ALL SELECT 'unknown_1D', 'unknown_1D: unknown_1D (Transform Date)' UNION ALL SELECT 'case_id', 'case_id: case_id'""")
def s11(spark, sf_dir):
    nation, region = v.table(spark, sf_dir, "nation"), v.table(spark, sf_dir, "region")
    entries = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.concat("n_name", F.lit("_A")).alias("Variable"), F.col("r_name").alias("Description")
    )
    columns = sorted(r[0] for r in entries.select("Variable").collect())
    return readers.describe_columns([*columns, "unknown_1D", "case_id"], entries)


@query("s12_overwrite_prepared", STATIC_SQL, "fx_static0")
def s12(spark, sf_dir):
    catalog = Catalog(spark, scratch_path(spark, "prepared"))
    catalog.save_prepared(v.static_cb0(spark, sf_dir), "static", 0)
    catalog.save_prepared(v.static0(spark, sf_dir), "static", 0)
    return v.rounded(catalog.read_prepared("static", 0))


@query("s13_sorted_write", BASE_SQL, "fx_base")
def s13(spark, sf_dir):
    path = scratch_path(spark, "sorted")
    writers.write_sorted(v.base(spark, sf_dir), path)
    return v.rounded(spark.read.parquet(path))


@query("s14_aggregate_write", """
SELECT case_id, round(avg(price_A), 6) AS "price_A", max(flag_M) AS "flag_M", round(avg(CAST(bundle_L AS INT)), 6) AS "bundle_L"
FROM fx_child1 GROUP BY case_id""", "fx_child1")
def s14(spark, sf_dir):
    path = scratch_path(spark, "aggregate")
    writers.write_type_aggregate(v.child1(spark, sf_dir, False).select("case_id", "price_A", "flag_M", "bundle_L"), path)
    return v.rounded(spark.read.parquet(path))


@query("s15_fold_output", """
WITH b AS (SELECT case_id, ('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 8))::BIGINT % 10000 < 8000 AS is_train FROM fx_base)
SELECT case_id, 'test' AS role, 1 AS copies FROM b WHERE NOT is_train UNION ALL
SELECT case_id, 'train', 2 FROM b WHERE is_train UNION ALL SELECT case_id, 'val', 1 FROM b WHERE is_train""", "fx_base")
def s15(spark, sf_dir):
    path = scratch_path(spark, "folds")
    train, test = splits.fraction_split(v.base(spark, sf_dir).select("case_id", "WEEK_NUM", "target"), 0.8)
    writers.write_folds(splits.with_fold(train, 3), test, path, 3)
    named = [("test", "test"), *[(f"{r}{i}", r) for r in ("train", "val") for i in range(3)]]
    out = None
    for folder, role in named:
        part = spark.read.parquet(f"{path}/{folder}").select("case_id", F.lit(role).alias("role"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("case_id", "role").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("s16_score_output", "SELECT case_id, round(score, 6) AS score FROM fx_base", "fx_base")
def s16(spark, sf_dir):
    path = scratch_path(spark, "scores")
    writers.write_scores(v.base(spark, sf_dir), path)
    return v.rounded(readers.read_csv(spark, path, "case_id bigint, score double"))


@query("s17_report_output", """
WITH k AS (SELECT 'priority_M' AS col, substr(priority_M, 1, 7) AS bin, count(*) AS dev_all, CAST(sum(target) AS BIGINT) AS dev_bad
  FROM fx_base GROUP BY ALL)
SELECT col, bin, dev_all, dev_bad, round(dev_bad * 1.0 / dev_all, 6) AS dev_bad_rate, 'orders_0' AS "table" FROM k""", "fx_base")
def s17(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = fine_class_report(v.base(spark, sf_dir), ["priority_M"], "target")
    writers.write_report(tagged_report(report, "orders_0"), path)
    back = readers.read_csv(spark, path)
    return v.rounded(back.select(
        "col", "bin", F.col("dev_all").cast("bigint").alias("dev_all"), F.col("dev_bad").cast("bigint").alias("dev_bad"),
        F.col("dev_bad_rate").cast("double").alias("dev_bad_rate"), "table",
    ))
