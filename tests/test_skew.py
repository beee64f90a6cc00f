"""Hot groups take another way; the results must be the same."""

import math
import random
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataform import rules
from strataform.functions import order_stats
from strataform.functions.order_stats import exact_quantiles, long_values, order_key, running_before, value_block
from strataform.operators.aggregates import Measure, aggregate, suffix_aggregate
from strataform.operators.skew import split_hot
from strataform.operators.windows import back_fill, row_positions


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(7)
    data = []
    for case in range(40):
        size = 400 if case == 3 else random.randint(1, 6)
        for i in range(size):
            amount = random.choice([None, random.randint(-50, 50) / 4, random.random() * 1e5])
            code = random.choice([None, "a", "b", "c"])
            day = random.choice([None, f"2020-0{random.randint(1, 9)}-11"])
            data.append((case, i, amount, code, day))
    data.append((None, 0, 1.0, "a", None))
    return spark.createDataFrame(data, "case_id long, num_group1 long, price_A double, flag_M string, day string").select(
        "case_id", "num_group1", "price_A", "flag_M", F.col("day").cast("date").alias("ship_D")
    ).cache()


def same(a, b, keys=("case_id",)):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)

    def rows_of(df):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)

    assert rows_of(a) == rows_of(b)


def test_split_is_complete(rows):
    light, hot = split_hot(rows, ["case_id"], 100)
    assert light.count() + hot.count() == rows.count()
    assert [r[0] for r in hot.select("case_id").distinct().collect()] == [3]
    assert light.where("case_id IS NULL").count() == 1


@pytest.mark.parametrize("table", [rules.TRAIN_RULES, rules.SERVE_RULES])
def test_hot_suffix_aggregate(rows, table):
    same(suffix_aggregate(rows, table, hot_rows=100), suffix_aggregate(rows, table))


def test_all_groups_hot(rows):
    same(suffix_aggregate(rows, hot_rows=0), suffix_aggregate(rows))


def test_hot_conditional_measures(rows):
    measures = [
        Measure("n", "count(1)"), Measure("total", "sum(price_A)"),
        Measure("codes", "flag_M", "distinct"), Measure("late_codes", "flag_M", "distinct", "num_group1 > 2"),
        Measure("days", "ship_D", "distinct", "price_A > 0"), Measure("never", "flag_M", "distinct", "false"),
        Measure("mid", "price_A", "median", "flag_M = 'a'"), Measure("most", "flag_M", "mode", "num_group1 > 3"),
    ]
    same(aggregate(rows, ["case_id"], measures, hot_rows=50), aggregate(rows, ["case_id"], measures))


def test_repeated_names_are_refused(rows):
    with pytest.raises(ValueError):
        aggregate(rows, ["case_id"], [Measure("x", "count(1)"), Measure("x", "sum(price_A)")])


def test_hot_back_fill(rows):
    known = rows.where("case_id IS NOT NULL")
    plain = back_fill(known, ["price_A", "flag_M"], "num_group1", ["case_id"])
    same(back_fill(known, ["price_A", "flag_M"], "num_group1", ["case_id"], span=7, hot_rows=20), plain)
    window = Window.partitionBy("case_id").orderBy("num_group1").rowsBetween(0, Window.unboundedFollowing)
    same(plain, known.withColumns({c: F.first(c, ignorenulls=True).over(window) for c in ("price_A", "flag_M")}))


def test_back_fill_without_groups(spark):
    df = spark.createDataFrame([(i, None if i % 5 else float(i)) for i in range(53)], "k long, x double")
    got = [r["x"] for r in back_fill(df, ["x"], "k", span=4).orderBy("k").collect()]
    assert got == [float(-(-i // 5) * 5) if i <= 50 else None for i in range(53)]


@pytest.mark.parametrize("fan", [2, 3, 1000])
def test_back_fill_by_a_tree_of_spans(spark, monkeypatch, fan):
    """Gaps longer than a span and than a node, negative and null orders, groups and none."""
    from strataform.operators import windows

    monkeypatch.setattr(windows, "FAN", fan)
    random.seed(fan)
    made = [(k, g, random.random() if random.random() < 0.04 else None) for g in ("a", None, "b") for k in random.sample(range(-400, 400), 250)]
    df = spark.createDataFrame([*made, (None, "a", None)], "k long, g string, x double")
    window = Window.partitionBy("g").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    want = df.withColumn("x", F.first("x", ignorenulls=True).over(window))
    same(back_fill(df, ["x"], "k", ["g"], span=7, hot_rows=0), want)
    one = df.where("g = 'a'")
    filled = back_fill(one, ["x"], "k", span=7)
    same(filled, one.withColumn("x", F.first("x", ignorenulls=True).over(Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing))))
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    same(back_fill(one.where("false"), ["x"], "k", span=7), one.where("false"))


def test_hot_keys_share_a_bucket_with_others(spark, monkeypatch):
    from strataform.operators import skew

    df = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1800, None).otherwise(F.col("id").cast("string")).alias("k"))
    for buckets in (1, 2, 1 << 20):
        monkeypatch.setattr(skew, "BUCKETS", buckets)
        assert sorted((r["k"] for r in skew.hot_keys(df, ["k"], 500).collect()), key=str) == [None, "hot"]
        assert skew.hot_keys(df, ["k"], 1000) is None
        light, hot = split_hot(df, ["k"], 1000)
        assert light is df and hot is None


@pytest.mark.parametrize("name, most", [
    ("a11_suffix_aggregate", 3), ("a17_contract_aggregate", 10), ("a18_generated_features", 6), ("w4_back_fill", 3),
    ("r2_flatten_nested", 19), ("r3_flatten_stacked", 19), ("r7_suffix_matrix", 19)])
def test_plans_scan_their_tables_few_times(spark, name, most):
    from battery import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [") <= most, plan.count("Relation [")


@pytest.mark.parametrize("by, hot", [([], 1), (["g"], 10 ** 6), (["g"], 0)])
def test_back_fill_carries_its_frame(spark, by, hot):
    """A frame to the end of a span is built anew for each of its rows: 60,000 of them took minutes."""
    df = spark.range(60_000).select(
        F.lit(1).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 29_999 == 0, F.col("id")).alias("x"))
    out = back_fill(df, ["x"], "k", by, hot_rows=hot)
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    want = F.when(F.col("k") <= 59_998, F.ceil(F.col("k") / 29_999) * 29_999)
    assert out.where(~F.col("x").eqNullSafe(want)).count() == 0


def test_hot_positions(rows):
    known = rows.where("case_id IS NOT NULL").drop("num_group1").dropDuplicates(["case_id", "price_A"]).where("price_A IS NOT NULL")
    plain = row_positions(known, ["case_id"], ["price_A"], value_block(F.col("price_A")), "at")
    split = row_positions(known, ["case_id"], ["price_A"], value_block(F.col("price_A")), "at", hot_rows=0)
    same(split, plain)


def test_value_blocks_never_decrease(spark):
    random.seed(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf")]
    values += [random.choice([-1, 1]) * 10 ** random.uniform(-300, 300) for _ in range(500)]
    values += [random.randint(-1000, 1000) / 8 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r["b"] for r in df.select("x", value_block(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got) and None not in got


def test_exact_quantiles_match_percentile(rows):
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    counts = long_values(rows, ["case_id"], ["price_A"])
    got = {r["case_id"]: [r[f"q{i}"] for i in range(len(probs))] for r in
           exact_quantiles(counts, ["case_id", "col"], probs).where("case_id IS NOT NULL").collect()}
    text = ", ".join(str(p) for p in probs)
    want = {r["case_id"]: r["q"] for r in rows.where("price_A IS NOT NULL AND case_id IS NOT NULL").groupBy("case_id").agg(
        F.expr(f"percentile(price_A, array({text}))").alias("q")).collect()}
    assert got.keys() == want.keys()
    for case, values in want.items():
        assert got[case] == pytest.approx(values)


def test_nearest_quantile_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(i),) for i in (10, 20, 30, 40, 50, 60)], "value double")
    row = exact_quantiles(df, [], [0.1, 0.3, 0.5], method="nearest", few_groups=True).first()
    assert (row["q0"], row["q1"], row["q2"]) == (10.0, 30.0, 30.0)  # places 0.5, 1.5, 2.5


def test_running_before(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 5), ("a", -2.0, 7), ("b", 0.0, 1)], "k string, v double, n long")
    got = {(r["k"], r["v"]): r["before_n"] for r in running_before(df, ["k"], "v", ["n"]).collect()}
    assert got == {("a", -2.0): 0, ("a", 1.0): 7, ("a", 3.0): 9, ("b", 0.0): 0}


def test_sizes_from_a_cheaper_frame(rows):
    measures = [Measure("codes", "flag_M", "distinct"), Measure("n", "count(1)")]
    split = aggregate(rows, ["case_id", "num_group1"], measures, hot_rows=100, sizes=rows.select("case_id"))
    same(split, aggregate(rows, ["case_id", "num_group1"], measures))


def test_nan_and_signed_zero_count_alike(spark):
    """NaN is left out and -0.0 is 0.0, however large a group is; by hand, both ways."""
    nan = float("nan")
    values = {1: [nan, 1.0, 2.0], 2: [nan, nan, 1.0], 3: [0.0, -0.0, 5.0], 4: [nan, nan, None], 5: [-0.0, -0.0, None]}
    rows = spark.createDataFrame([(k, v, str(v)) for k, vs in values.items() for v in vs], "case_id long, v double, s string")
    measures = [
        Measure("mid", "v", "median"), Measure("mid_text", "nullif(s, 'None')", "median"), Measure("top", "v", "mode"),
        Measure("kinds", "v", "distinct"), Measure("few", "CAST(v AS FLOAT)", "distinct", where="v < 2"), Measure("n", "count(1)"),
    ]
    want = {1: (1.5, 1.5, 1.0, 2, 1, 3), 2: (1.0, 1.0, 1.0, 1, 1, 3), 3: (0.0, 0.0, 0.0, 2, 1, 3),
            4: (None, None, None, 0, 0, 3), 5: (0.0, 0.0, 0.0, 1, 1, 3)}
    for hot_rows in (0, 1_000_000):
        got = aggregate(rows, ["case_id"], measures, hot_rows).collect()
        assert {r["case_id"]: tuple(r)[1:] for r in got} == want
        assert all("-" not in str(r["top"]) for r in got)


ENDS = [
    0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf,
    1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 1024.0, math.nextafter(1024.0, 0), 0.1, 1e9 + 0.25, -3.5,
]


def test_order_keys_are_the_bits_of_a_double(spark):
    values = ENDS + [random.Random(i).uniform(-1, 1) * 10.0 ** random.Random(-i).randint(-320, 300) for i in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    for row in df.select("i", order_key(F.col("x")).alias("key")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(values[row["i"]])))[0]
        assert row["key"] == (-bits if values[row["i"]] < 0 else bits), values[row["i"]]


def crowded(spark, count=6000):
    """All values in one block of the first level, those of group 1 in one of the second; a group has a third of the rows."""
    place, wide, close = F.col("id") * 7919 % 50000, 2.0 ** -27, 2.0 ** -50
    frame = spark.range(count).withColumn("k", F.when(F.col("id") % 3 != 0, F.col("id") % 4))
    step = F.when(F.col("k") == 1, close).otherwise(wide)
    return frame.select("k", (F.lit(1.0) + F.when(F.col("id") % 5 == 0, 7 * step).otherwise(place * step)).alias("v"))


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("limit", [1, 50, 10 ** 6])
def test_quantiles_of_values_in_one_block(spark, few, limit):
    df = crowded(spark)
    assert df.select(value_block(F.col("v"))).distinct().count() == 1
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, ["k"], probs, value="v", few_groups=few, block_rows=limit)
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", probs).alias("p")).collect()}
    rows = got.collect()
    assert {r["k"] for r in rows} == set(want)
    for r in rows:
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(want[r["k"]], rel=1e-15)


@pytest.mark.parametrize("few", [True, False])
def test_blocks_of_one_value_are_not_split(spark, monkeypatch, few):
    """Copies of few values are ranked from totals, whatever their number; keys of single rows are not made."""
    levels = []
    made = order_stats.value_block
    monkeypatch.setattr(order_stats, "value_block", lambda v, level=0: levels.append(level) or made(v, level))
    zero = F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.lit(-1.0) * F.lit(0.0))
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") < 900, zero).otherwise(
        F.col("id") % 7 / 100).alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], probs, value="v", few_groups=few, block_rows=10).collect()}
    assert set(levels) == {0}
    for r in df.groupBy("k").agg(F.percentile("v", probs).alias("p"), F.count("v").alias("n")).collect():
        assert [got[r["k"]][f"q{i}"] for i in range(6)] == pytest.approx(r["p"]) and got[r["k"]]["rows"] == r["n"]
        assert str(got[r["k"]]["q1"]) == "0.0"


def test_no_window_passes_the_limit(spark, monkeypatch):
    """Of 2000 rows in one block, the last windows hold blocks of at most 50 rows, or of one value."""
    sizes = []
    made = order_stats._before

    def spied(weight, order, by):
        if order == "_v":
            sizes.append(tuple(by))
        return made(weight, order, by)

    monkeypatch.setattr(order_stats, "_before", spied)
    df = crowded(spark).where("k IS NULL").drop("k")
    out = exact_quantiles(df, [], [0.25, 0.5], value="v", block_rows=50)
    assert sizes == [("_key", "_level", "_block")]
    blocks = [df.groupBy(value_block(F.col("v"), level).alias("b")).count().agg(F.max("count")).first()[0] for level in (0, 1)]
    assert blocks[0] == df.count() and blocks[1] <= max(50, df.groupBy("v").count().agg(F.max("count")).first()[0])
    assert out.first()["q1"] == df.agg(F.median("v")).first()[0]


@pytest.mark.parametrize("limit", [1, 50, 10 ** 6])
def test_ranks_of_values_in_one_block(spark, limit):
    counts = crowded(spark).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = running_before(counts, ["k"], "v", ["n"], block_rows=limit)
    window = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = counts.withColumn("before_n", F.coalesce(F.sum("n").over(window), F.lit(0)))
    same(got, want, ("k", "v"))
    parts = order_stats._cut(counts, ["k"], "v", ["n"], limit).where("_key.k IS NULL OR _key.k <> 1")
    most = parts.groupBy("_key", "_block", "_part").count().agg(F.max("count")).first()[0]
    assert most == 1 if limit < 1000 else most > 400
