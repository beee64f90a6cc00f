"""Work that no longer has a cap, a loop of jobs or a plan that grows by column."""

import random

import pytest
from pyspark.sql import functions as F

from strataform.operators import encode, models, splits
from strataform.operators.aggregates import all_target_means, class_weights, correlation, rate_by, target_means
from strataform.sources.writers import write_folds


def loads(out):
    return [r["n"] for r in out.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).orderBy("fold").collect()]


@pytest.mark.parametrize("heads", [0, 1, 100])
def test_folds_of_many_groups(spark, heads):
    """200,000 groups and a null one; a group holds a third of the rows: it fills one fold, the others are level."""
    heads = max(heads, 1)
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") > 5, F.col("id")).alias("g"))
    out = splits.with_fold(df, 3, "g", heads=heads)
    assert out.count() == 300_000 and out.where("fold IS NULL").count() == 0
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert max(loads(out)) - min(loads(out)) <= 10
    wide = splits.with_fold(df, 5, "g", heads=heads)  # five folds: the hot group is more than a share
    assert sorted(loads(wide))[-1] == 100_000 and max(sorted(loads(wide))[:4]) - min(loads(wide)) <= 10


def test_few_groups_go_to_the_emptiest_fold(spark):
    sizes = {1: 50, 2: 30, 3: 20, 4: 10, None: 5}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "WEEK_NUM long")
    got = {r["_g"]: r["fold"] for r in splits.fold_table(df, 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, None: 1}
    assert splits.with_fold(df.limit(0), 2).count() == 0


def test_fold_folders(spark, tmp_path):
    rows = [(i, None if i == 7 else i % 3, f"t{i}") for i in range(30)]
    train = spark.createDataFrame(rows, "case_id long, fold int, text string")
    test = spark.createDataFrame([(100, "x")], "case_id long, text string")
    for _ in range(2):  # the second run takes the place of the first
        write_folds(train, test, str(tmp_path / "out"), 4)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["test"] + [f"train{i}" for i in range(4)] + [
        f"val{i}" for i in range(4)]
    for i in range(4):
        for role, kept in (("train", lambda f: f != i), ("val", lambda f: f == i)):
            part = spark.read.parquet(str(tmp_path / "out" / f"{role}{i}"))
            assert part.columns == ["case_id", "text"]
            want = sorted((a, t) for a, f, t in rows if f is not None and kept(f))
            assert sorted(map(tuple, part.collect())) == want


def wide_frame(spark, columns):
    random.seed(3)
    rows = [(i, i % 2, *[f"c{random.randrange(3)}" for _ in range(columns)]) for i in range(60)]
    return spark.createDataFrame(rows, ["a", "t", *[f"k.{n}" if n == 0 else f"k{n}" for n in range(columns)]])


def test_target_means_of_all_columns(spark):
    df = wide_frame(spark, 3).withColumnRenamed("k.0", "k0").withColumn("d", F.when(F.col("a") > 4, F.col("a") % 3 - 1.0))
    got = {(r["col"], r["value"]): r["encoded"] for r in all_target_means(df, ["k0", "k1", "d"], "t").collect()}
    want = {(c, str(r[c])): r["encoded"] for c in ("k0", "k1", "d") for r in target_means(df, c, "t").collect()}
    assert got == pytest.approx(want)


def test_leaves_grow_with_the_columns(spark, monkeypatch):
    """Each encoded column adds one leaf, a part of the stored means, and none reads the frame again."""
    plans = []
    made = models.Correlation.corr

    def spied(frame, column):
        plans.append(frame._jdf.queryExecution().analyzed().collectLeaves().size())
        return made(frame, column)

    monkeypatch.setattr(models.Correlation, "corr", spied)
    for columns in (4, 8, 16):
        df = wide_frame(spark, columns).withColumnRenamed("k.0", "k0")
        models.correlated_columns(df, ["a"], [f"k{n}" for n in range(columns)], "t")
    assert plans == [5, 9, 17]


def test_spec_of_a_column_with_many_values(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_CATEGORIES", 5)
    df = spark.range(40).select(
        (F.col("id") % 2).alias("t"), F.concat(F.lit("v"), F.col("id") % 8).alias("wide"), F.concat(F.lit("v"), F.col("id") % 4).alias("few"))
    spec = encode.derive_spec(df, [], ["wide", "few"], "t", detailed=True)
    assert spec["few"]["properties"]["value"] == ["v0", "v1", "v2", "v3", "NA"] and spec["wide"]["properties"]["table"]
    assert encode.check_spec({"transformations": spec}) == spec
    unseen = df.unionByName(spark.createDataFrame([(1, "new", "new"), (0, None, None)], "t long, wide string, few string"))
    got = encode.apply_spec(unseen, spec).collect()
    assert {(r["t"], r["wide"], r["few"]) for r in got} == {(0, 0.0, 0.0), (1, 1.0, 1.0), (1, 0.0, 0.0)}


def test_correlation_of_many_columns_is_one_scan(spark, tmp_path):
    """312 columns, a third null each, one constant, one null, one with a dot: all pairs as over the rows that have both."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 1))
    made = pd.DataFrame(base + rng.normal(size=(150, 312)), columns=[f"c{n}" for n in range(312)])
    made = made.mask(rng.random(made.shape) < 0.33)
    made["c7"], made["c9"] = 5.0, np.nan
    made = made.rename(columns={"c311": "c.311"})
    rows = [[None if np.isnan(x) else float(x) for x in r] for r in made.to_numpy()]
    spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in made.columns)).repartition(4).write.parquet(f"{tmp_path}/t")
    out = correlation(spark.read.parquet(f"{tmp_path}/t"))
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # the table, and the list of pairs
    got = {(r.x, r.y): r["corr"] for r in out.collect()}
    want = made.corr(min_periods=2)
    names = list(made.columns)
    assert list(sorted(got)) == sorted((x, y) for i, x in enumerate(names) for y in names[i + 1:])
    for (x, y), value in got.items():
        if {"c7", "c9"} & {x, y}:
            assert value is None or np.isnan(value)
        else:
            assert value == pytest.approx(want.loc[x, y], abs=1e-9)


def test_correlation_of_no_rows(spark):
    empty = spark.createDataFrame([], "a int, b double, c float")
    assert [tuple(r) for r in correlation(empty).orderBy("x", "y").collect()] == [
        ("a", "b", None), ("a", "c", None), ("b", "c", None)]
    with pytest.raises(ValueError):
        correlation(empty, ["a"])


def test_totals_come_from_the_groups(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1), (3, None)], "month int, target int")
    got = {r.month: (r["count"], r["sum"], r["rate"], r["count_pct"]) for r in rate_by(df, "month", "target").collect()}
    assert got[1] == (2, 1, 0.5, 0.5) and got[2] == (1, 0, 0.0, 0.25) and got[None] == (1, 1, 1.0, 0.25)
    assert got[3][:2] == (0, 0) and got[3][3] == 0
    assert rate_by(df.where("false"), "month", "target").count() == 0
    weights = {r.target: r.weight for r in class_weights(df).collect()}
    assert weights == {0: 1.0, 1: 1.0} and class_weights(df.where("false")).count() == 0


def test_best_cuts_match_all_ways_to_part():
    import itertools
    import math

    from strataform.operators.binning import best_cuts

    rng = random.Random(12)
    for _ in range(150):
        counts = [[rng.choice((0, 1, 3, 9, 20)), rng.choice((0, 2, 5, 11))] for _ in range(rng.randint(0, 8))]
        most, least = rng.randint(1, 5), rng.choice((0, 0.05, 0.3))
        goods, bads = sum(c[0] for c in counts), sum(c[1] for c in counts)

        def value(cuts):
            total = 0.0
            for b, e in itertools.pairwise([0, *cuts, len(counts)]):
                g, d = sum(c[0] for c in counts[b:e]), sum(c[1] for c in counts[b:e])
                if not g or not d or g + d < least * (goods + bads):
                    return None
                total += (g / goods - d / bads) * math.log(g / goods / (d / bads))
            return total

        ways = [c for n in range(most) for c in itertools.combinations(range(1, len(counts)), n)]
        fit = {c: value(c) for c in ways if counts and value(c) is not None}
        got = tuple(best_cuts(counts, most, least))
        assert (got in fit and fit[got] == pytest.approx(max(fit.values()))) if fit else got == ()
    assert best_cuts([[5, 5], [5, 5]], 2, 0.0) == []  # nothing is gained by a cut
    assert best_cuts([[9, 1], [1, 9], [9, 1]], 2, 0.0) in ([1], [2])
