"""Small frames for nulls, ties, clashes, unknown values and bad input."""

import datetime
import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from strataform import rules
from strataform.functions.naming import feature_name
from strataform.operators import aggregates as agg, binning, encode, joins, metrics, models, profile, projections as p, setops, splits
from strataform.plans import definition as d, generator as g
from strataform.plans.training import train_and_evaluate
from strataform.sources.catalog import Catalog, TopicFile


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- names and definitions --------------------------------------------------------

# Names that stored definitions use.
NAMES = {
    "count(case when (status_219L = 'K') then pmtnum_8L else null end)": "count__if__status_219l_eq_k__then_pmtnum_8l__",
    "sum(case when (a_1A <= 0) then b_2A else null end)": "sum__if__a_1a_lteq_0__then_b_2a__",
    "sum(case when (a_1A >= 0) then b_2A else null end)": "sum__if__a_1a_gteq_0__then_b_2a__",
    "avg(case when (num_group1 < 5) then currdebt_94A else null end)": "avg__if__num_group1_lt_5__then_currdebt_94a__",
    "max(case when (x_1M != 'a55475b1') then y_2M else null end)": "max__if__x_1m_ne_a55475b1__then_y_2m__",
    "count(case when 1 = 1 then num_group1 else null end)": "count__if_1_eq_1_then_num_group1__",
}


@pytest.mark.parametrize("query", NAMES)
def test_feature_name(query):
    assert feature_name(query) == NAMES[query]


def feature(*conditions, logic="count({0})", column="x_1A", kind="int"):
    source = d.Source(column, "float64")
    return d.Feature("t", kind, d.Aggregation((source,), logic, kind), tuple(d.Condition((source,), c) for c in conditions))


def test_two_conditions_join_without_and():
    assert feature("x_1A > 1", "y-1 = 'q'").name == "count__if__x_1a_gt_1__ysub1_eq_q__then_x_1a__"


def test_store_round_trip_and_order():
    kept = [feature(), feature("x_1A > 1"), feature(logic="sum({0})", kind="float")]
    assert d.from_json(d.to_json(kept)) == kept
    assert d.from_json(d.to_json(kept), [kept[2].name, kept[0].name]) == [kept[0], kept[2]]


def test_duplicate_names_raise(spark):
    twins = [feature("x_1A = 'K'"), feature("x_1A = 'k'")]
    with pytest.raises(ValueError):
        d.to_json(twins)


def test_quotes_and_braces_in_values(spark):
    df = spark.createDataFrame([(1, 0, "O'Brien {x}\\"), (1, 1, "O'Brien {x}\\"), (2, 0, "b")], "case_id long, num_group1 long, n_1M string")
    stats = g.column_stats(df)
    features = g.define_simple_features("t", stats)
    out = d.compute_features(df, features, train=False)
    found = {r["case_id"]: r.asDict() for r in out.collect()}
    odd = next(n for n in out.columns if "brien" in n)
    assert found[1][odd] == 2 and found[2][odd] == 0


def test_thresholds():
    assert g.thresholds(None) == [2] and g.thresholds(1) == [2]
    assert g.thresholds(13) == [2, 3, 5, 8, 13] and g.thresholds(14)[-1] == 21
    with pytest.raises(ValueError):
        g.thresholds(3, is_text=True)


@pytest.mark.parametrize("values, logic", [
    (["a55475b1", "a55475b1"], ["c = 'a55475b1'", "c != 'a55475b1'"]),
    (["a55475b1", None], ["c is null or c = 'a55475b1'", "c is not null and c != 'a55475b1'"]),
    (["q", None], ["c is null", "c is not null"]),
    (["q", "r"], []),
])
def test_null_filters(spark, values, logic):
    df = spark.createDataFrame([(1, v) for v in values], "case_id long, c string")
    assert [f.logic for f in g.null_filters(g.column_stats(df))] == logic


def test_categorical_filters_cut_before_the_code(spark):
    data = [(1, "a55475b1")] * 50 + [(1, f"v{i:02d}") for i in range(12) for _ in range(20 - i)]
    stats = g.column_stats(spark.createDataFrame(data, "case_id long, c_M string"))
    assert len(g.categorical_filters(stats)) == 9


def test_cross_skips_own_column(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.5)], "case_id long, num_group1 long, x_1A double")
    made = g.define_features("t", g.column_stats(df))
    assert all(not f.filters or f.filters[0].columns[0].name != f.agg.columns[0].name for f in made)
    assert len({f.name for f in made}) == len(made)


# -- aggregates -------------------------------------------------------------------


def test_aggregate_edges(spark):
    df = spark.createDataFrame(
        [(1, 0, 1.0, "b"), (1, 1, None, "a"), (2, 0, None, None), (2, 1, None, None), (3, 0, 4.0, "z")],
        "case_id long, num_group1 long, x_A double, m_M string",
    )
    got = {r["case_id"]: r for r in agg.suffix_aggregate(df).collect()}
    assert got[1]["last_x_A"] is None and got[1]["mode_m_M"] == "a" and got[3]["varx_A"] is None
    assert got[2]["mode_m_M"] is None and got[2]["medianx_A"] is None and got[3]["medianx_A"] == 4.0
    sums = agg.aggregate(df, ["case_id"], [agg.measure("sum", "x_A", [], df.schema["x_A"].dataType)])
    assert rows(sums) == [(1, 1.0), (2, 0.0), (3, 4.0)]


def test_spread_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, "d", 2.0), (2, "d", 1.0), (2, "e", 3.0)], "case_id long, day string, x double")
    assert rows(agg.two_level_spread(df, "x", "day")) == [(1, None), (2, pytest.approx(math.sqrt(2)))]


# -- projections ------------------------------------------------------------------


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(1, 127, "1", "x", True, None, 2.0), (2, 5, "20", "7", False, None, 3.5)],
        "case_id long, a int, num string, txt string, b boolean, nul string, f double",
    ).withColumn("day", F.lit("2020-01-01").cast("date"))
    kinds = {f.name: f.dataType.simpleString() for f in p.narrow_types(df).schema.fields}
    assert kinds == {"case_id": "int", "a": "smallint", "num": "float", "txt": "string", "b": "float",
                     "nul": "float", "f": "float", "day": "string"}


def test_period_of_bad_and_missing_dates(spark):
    df = spark.createDataFrame([("2020-01-10", "2020-01-01"), ("2020-01-10", None), ("2020-01-10", "soon")], "date_decision string, x_D string")
    assert sorted(r["x_D"] for r in p.date_to_period(df).collect()) == [0.0, 0.0, 9.0]


def test_numeric_text(spark):
    df = spark.createDataFrame([("1", "1"), ("2.5", "x")], "n string, t string")
    assert dict(p.promote_numeric_text(df).dtypes) == {"n": "double", "t": "string"}
    assert p.parse_dates(spark.createDataFrame([("bad",)], "d string"), "d").first()["d_dt"] is None


def test_null_blocks_whole_floats(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.5), (2.0, None, 2.0)], "a double, b double, c double")
    assert p.integral_floats(df) == ["a"]


def test_sparse_and_constant_columns(spark):
    df = spark.createDataFrame([(i, None if i < 8 else 1.0, "k", None if i else "k") for i in range(10)], "case_id long, s double, k string, two string")
    assert p.drop_sparse(df).columns == ["case_id", "k"]
    assert p.drop_by_cardinality(df).columns == ["case_id", "s", "two"]


# -- joins, sets ------------------------------------------------------------------


def test_clashes_in_a_chain(spark):
    a = spark.createDataFrame([(1, "a")], "case_id long, x string")
    out = joins.join_topics(a, [a, a, a])
    assert out.columns == ["case_id", "x", "x_0", "x_1", "x_2"]
    with pytest.raises(ValueError):
        joins.left_join(a.withColumn("x_0", F.lit(1)), a, suffix="_0")


def test_case_without_children_and_child_without_case(spark):
    base = spark.createDataFrame([(1,), (2,)], "case_id long")
    child = spark.createDataFrame([(2, 5), (9, 7)], "case_id long, n long")
    assert rows(joins.join_topics(base, [child])) == [(1, None), (2, 5)]


def test_concat_of_unlike_parts(spark):
    a = spark.createDataFrame([(1, 2, True)], "k int, x int, f boolean")
    b = spark.createDataFrame([(2, 2.5, 1)], "k long, x double, f int")
    c = spark.createDataFrame([(3,)], "k long")
    out = setops.concat_relaxed([a, b, c])
    assert dict(out.dtypes) == {"k": "bigint", "x": "double", "f": "double"}
    assert rows(out) == [(1, 2.0, 1.0), (2, 2.5, 1.0), (3, None, None)]


def test_group_back_ignores_null_keys(spark):
    from strataform.operators.windows import group_back

    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, x long")
    assert rows(group_back(df, "count", "k", "x")) == [("a", 1, 2), ("a", 2, 2), (None, 3, None)]
    with pytest.raises(ValueError):
        group_back(df, "sum", "k", "x")


# -- encoders ---------------------------------------------------------------------


def test_bin_index_equals_bucketizer(spark):
    values = [(float(x),) for x in (-5, 0, 1, 1.5, 10, 99)] + [(None,)]
    df = spark.createDataFrame(values, "x double")
    mine = [r["x"] for r in df.select(encode.bin_index("x", [0, 1, 10])).collect()]
    cut = Bucketizer(splits=[-math.inf, 0, 1, 10, math.inf], inputCol="x", outputCol="b", handleInvalid="keep")
    theirs = [None if r["x"] is None else int(r["b"]) for r in cut.transform(df).collect()]
    assert mine == theirs


def test_spec_checks():
    with pytest.raises(ValueError):
        encode.check_spec({"transformations": {"a": {"properties": {}}}})
    with pytest.raises(ValueError):
        encode.check_spec({"transformations": {"a": {"type": "onehot"}}})
    with pytest.raises(ValueError):
        encode.check_spec({"transformations": {"a": {"type": "magic"}}})


def test_unknown_category(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "c string")
    spec = {"c": {"type": "target_encoding", "properties": {"value": ["a"], "encoded": [0.4]}}}
    assert sorted(r[0] for r in encode.apply_spec(df, spec).collect()) == [0.0, 0.0, 0.4]


def test_bin_encoder_orders_risk(spark):
    df = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"), ((F.col("id") % 100) > 70).cast("int").alias("t"))
    noisy = df.withColumn("t", F.when(F.rand(3) < 0.1, 1 - F.col("t")).otherwise(F.col("t")))
    spec = binning.fit_bin_encoder(noisy, ["x"], "t")
    rates = encode.apply_spec(noisy, spec).groupBy("x").agg(F.avg("t").alias("r")).orderBy("x").collect()
    assert len(rates) >= 2 and rates[-1]["r"] > rates[0]["r"] + 0.5


# -- bins, reports ----------------------------------------------------------------


def test_bin_kinds(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), None if i < 95 else float(i)) for i in range(100)], "wide double, few double, rare double")
    bins = binning.fit_bins(df, ["wide", "few", "rare"])
    assert bins["wide"].kind == "edges" and len(bins["wide"].edges) == 11
    assert bins["few"].kind == "value" and bins["rare"].kind in ("edges", "value")


def test_report_with_empty_shares(spark):
    data = [("only_good_x", 0, 0)] * 3 + [("only_bad", 1, 0)] * 2 + [("both", 0, 0), ("both", 1, 0), ("both", 1, 1), ("new", 0, 1)]
    df = spark.createDataFrame(data, "m string, label int, val int")
    got = {r["bin"]: r for r in binning.fine_class_report(df, ["m"], "label", "val").collect()}
    assert set(got) == {"only_go", "only_ba", "both", "new"}
    assert got["only_go"]["dev_IV"] == 0 and got["new"]["PSI"] == 0 and got["both"]["dev_IV"] != 0
    assert all(math.isfinite(r["PSI_total"]) for r in got.values())


def test_special_values_left_out(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)] + [(-99999999.0, 1), (None, 0)], "x double, label int")
    kept = binning.bin_counts(df, ["x"], "label", ignore_special=True)
    assert kept.agg(F.sum("dev_good") + F.sum("dev_bad")).first()[0] == 20


def test_values_outside_given_splits(spark):
    df = spark.createDataFrame([(-1.0, 0), (1.0, 1), (5.0, 0), (None, 1)], "x double, t int")
    table, edges = binning.fine_bins(df, "x", "t", splits=[0, 2, 4])
    assert rows(table.select("bin", "count")) == [("Missing", 1), ("[0, 2)", 1)] and edges == [0, 2, 4]


# -- metrics ----------------------------------------------------------------------


def scored(spark, data):
    return spark.createDataFrame(data, "WEEK_NUM long, target int, score double")


def test_auc_equals_evaluator(spark):
    df = spark.range(500).select(
        F.lit(1).alias("WEEK_NUM"), (F.rand(1) > 0.6).cast("int").alias("target"), F.round(F.rand(2), 2).alias("score")).cache()
    vectors = df.rdd.map(lambda r: (float(r["target"]), Vectors.dense([1 - r["score"], r["score"]]))).toDF(["label", "rawPrediction"])
    want = BinaryClassificationEvaluator(numBins=0).evaluate(vectors)
    assert metrics.auc(df).first()["auc"] == pytest.approx(want)


def test_auc_edges(spark):
    assert metrics.auc(scored(spark, [(0, 1, 0.5), (0, 0, 0.5)])).first()["auc"] == 0.5
    assert metrics.auc(scored(spark, [(0, 1, 1.0), (0, 1, 0.0)])).first()["auc"] is None
    assert metrics.log_loss(scored(spark, [(0, 1, 1.0), (0, 0, 0.0)])).first()["log_loss"] < 1e-12


def test_weeks_of_one_class_are_skipped(spark):
    data = [(w, t, s) for w in (1, 2, 3) for t, s in ((1, 0.9), (0, 0.1), (1, 0.2 * w))] + [(9, 1, 0.5)]
    df = scored(spark, data)
    assert metrics.gini_by(df).count() == 3
    assert metrics.gini_by(df, keep_single_class=True).count() == 4
    assert metrics.stability(df).first()["weeks"] == 3


def test_stability_of_one_week_has_no_trend(spark):
    row = metrics.stability(scored(spark, [(1, 1, 0.9), (1, 0, 0.1)])).first()
    assert row["avg_gini"] == 1.0 and row["slope"] is None


# -- splits, catalog, models ------------------------------------------------------


def test_sample_and_complement(spark):
    df = spark.range(1000).withColumnRenamed("id", "case_id")
    a, b = splits.fraction_split(df, 0.3)
    assert a.union(b).distinct().count() == 1000 and a.intersect(b).count() == 0


def test_folds_keep_weeks_whole(spark):
    df = spark.range(1000).select("id", (F.col("id") % 17).alias("WEEK_NUM"))
    out = splits.with_fold(df, 4)
    assert out.where("fold IS NULL").count() == 0
    assert out.groupBy("WEEK_NUM").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("name, want", [
    ("train_base.parquet", ("train", "base", "", "")),
    ("train_static_cb_0.parquet", ("train", "static_cb", "0", "")),
    ("test_credit_bureau_a_2_11.csv", ("test", "credit_bureau_a", "2", "11")),
])
def test_file_names(name, want):
    f = TopicFile.parse(name)
    assert (f.split, f.topic, f.depth, f.part) == want
    with pytest.raises(ValueError):
        TopicFile.parse("")


def test_catalog_refuses(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "case_id")
    df.write.parquet(f"{tmp_path}/parquet_files/train/train_other_1.parquet")
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.depths("other") == [1] and [f.topic for f in catalog.by_depth(1)] == ["other"]
    with pytest.raises(FileNotFoundError):
        catalog.read("person", 1)
    with pytest.raises(ValueError):
        catalog.save_prepared(df, "other", 3)
    with pytest.raises(ValueError):
        rules.check_topic("unheard")


def test_ensembles_need_different_names(spark, tmp_path):
    df = spark.range(3)
    for ensemble in ([], [("m", {}, df, df), ("m", {}, df, df)]):
        with pytest.raises(ValueError):
            train_and_evaluate(ensemble, ["id"], df, str(tmp_path))


def test_correlated_columns_may_be_dropped_by_dropped_ones(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (-F.col("id")).cast("double").alias("c"), (F.col("id") % 2).alias("t"))
    assert models.correlated_columns(df, ["a", "b", "c"], [], "t") == ["b"]


def test_importance_lists():
    assert profile.split_importances({"a": 1.0, "b": 3.0, "c": 2.0}, ["b"], 2) == (["b"], ["c"])


def test_fill_widens_narrow_columns(spark):
    df = spark.sql("SELECT CAST(NULL AS TINYINT) AS a, CAST(7 AS SMALLINT) AS `b.c`, CAST(NULL AS INT) AS d, 'x' AS e")
    filled = p.fill_constant(df, -99999999)
    assert filled.dtypes == [("a", "int"), ("b.c", "int"), ("d", "int"), ("e", "string")]
    assert tuple(filled.first()) == (-99999999, 7, -99999999, "x")
    assert tuple(p.fill_constant(df, 1 << 40).first()) == (1 << 40, 7, 1 << 40, "x")
    assert p.fill_constant(df, 5).dtypes == df.dtypes


def test_selection_goes_on_from_its_store(spark, tmp_path, monkeypatch):
    asked = []

    def keep_all_but_last(df, features, label="target", params=None):
        asked.append(list(features))
        if len(asked) == 3:
            raise RuntimeError("lost")
        return list(features[:-1])

    monkeypatch.setattr(models, "select_by_importance", keep_all_but_last)
    store, names = str(tmp_path / "slices"), list("abcdef")
    with pytest.raises(RuntimeError):
        models.select_in_rounds(lambda part: None, names, [2, 3], store=store)
    assert asked == [["a", "b"], ["c", "d"], ["e", "f"]]
    kept, log = models.select_in_rounds(lambda part: None, names, [2, 3], store=store)
    assert asked[3:] == [["e", "f"], ["a", "c", "e"]]
    assert kept == ["a", "c"] and log[(0, 0)] == ["a"]
    assert models.select_in_rounds(lambda part: None, names, [2, 3], store=store) == (kept, log)
    assert len(asked) == 5
    with pytest.raises(ValueError):
        models.select_in_rounds(lambda part: None, list("abcxyz"), [2, 3], store=store)


def test_fill_by_type(spark):
    from strataform.operators.windows import fill_by_type

    rows = spark.createDataFrame(
        [(1, None, None, None), (2, "x", float("nan"), None), (3, None, 3.0, 7), (4, "", None, None)],
        "at int, word string, num double, whole int")
    assert [tuple(r) for r in fill_by_type(rows, "at").orderBy("at").collect()] == [
        (1, "NA", 3.0, 7), (2, "x", 3.0, 7), (3, "NA", 3.0, 7), (4, "", None, None)]
    assert fill_by_type(rows.limit(0), "at").count() == 0


def test_listed_means_are_not_joined_by_category(spark):
    """A shuffle by a category of few values would bring a share of all rows to one task."""
    from strataform.operators.encode import apply_spec

    spec = {"flag": {"type": "target_encoding", "properties": {"value": ["A", "R"], "encoded": [0.25, 0.75]}}}
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, "A").otherwise("X").alias("flag"))
    out = apply_spec(rows, spec)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert out.groupBy("flag").count().orderBy("flag").collect() == [(0.0, 250), (0.25, 750)]


def test_a_training_task_holds_a_bounded_number_of_values(spark, monkeypatch):
    from strataform.operators import models

    rows = spark.range(3000).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 6).cast("int").alias("target"))
    small = rows.coalesce(1)
    assert models._spread(small, 1) is small
    monkeypatch.setattr(models, "TASK_VALUES", 900)
    spread = models._spread(small, 1)  # nine fields a row: some 100 rows a task
    assert spread.rdd.getNumPartitions() == 30 and spread.rdd.glom().map(len).max() <= 110  # dealt in turn by each task
    assert sorted(spread.collect()) == sorted(rows.collect())
    model = models.train_trees(rows, ["x"], params={"maxIter": 2, "maxDepth": 2})
    scored = models.score_frame(model, rows, ["x"], ["target"])
    assert scored.where((F.col("score") > 0.5) != (F.col("target") == 1)).count() == 0


def test_tasks_of_a_tuned_session_have_a_bounded_share(spark):
    from strataform.session import LEAST_PARTS, tune

    conf = spark.newSession()
    conf.conf.set("spark.sql.shuffle.partitions", 3)
    out = tune(conf).range(100).groupBy((F.col("id") % 50).alias("g")).count()
    assert len(out.collect()) == 50
    text = out._jdf.queryExecution().executedPlan().toString()
    assert f", {LEAST_PARTS})" in text and ", 3)" not in text


def test_reports_of_bins_run_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.range(60).select(counted("id").alias("x"), (F.col("id") % 2).cast("int").alias("target"))
    report = binning.fine_class_report(rows, ["x"], "target").collect()
    assert len(report) == 10 and {r["dev_all"] for r in report} == {6}
    assert seen.value == 60


def test_prepare_numbers_rows_once(spark, tmp_path, monkeypatch):
    """Both topics of r1 read the stored positions; each view is planned once."""
    from battery import QUERIES, views

    rows = {
        "customer": ("c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey long", [(1, 5.0, "A", 0), (2, 6.0, "B", 0)]),
        "nation": ("n_nationkey long, n_name string", [(0, "X")]),
        "orders": (
            "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz",
            [(n, 1 + n % 2, 10.0 * n, "F", "1-URGENT", datetime.datetime(1995, 1, 1 + n)) for n in range(6)]),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, "
            "l_linestatus string, l_returnflag string, l_discount double",
            [(n % 6, n // 6, n, n, datetime.datetime(1995, 2, 1), 1000.0 * n, "FO"[n % 2], "ARN"[n % 3], 0.05) for n in range(18)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    calls = []
    for name in ("depth1", "depth2"):
        def counted(*args, name=name, made=getattr(views, name)):
            calls.append(name)
            return made(*args)

        monkeypatch.setattr(views, name, counted)
    got = {r.topic: (r.rows, r.checked) for r in QUERIES["r1_prepare_topics"](spark, str(tmp_path)).collect()}
    assert got == {"applprev_1": (6, 3), "credit_bureau_b_1": (6, 18), "static_0": (2, 3)}
    assert sorted(calls) == ["depth1", "depth2"]
