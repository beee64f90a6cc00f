"""Reducing child tables to one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform import rules
from strataform.functions.columns import NUMERIC, columns_of, quoted, ratio
from strataform.functions.order_stats import exact_quantiles, long_values
from strataform.operators.skew import HOT_ROWS, split_hot

# Aggregates whose buffer grows with the group; all others keep a fixed-size one.
GROWING = ("median", "mode", "distinct")
ENDS = {"last": "max_by", "first": "min_by"}


@dataclass(frozen=True)
class Measure:
    """One output column of a grouped aggregate, as Spark SQL text.

    ``plain``: ``text`` is the whole aggregate. ``median``, ``mode``, ``distinct``:
    ``text`` is the input, counted only where ``where`` holds. ``last``, ``first``:
    ``text`` is the input, ``order`` the text of the position.
    """

    name: str
    text: str
    kind: str = "plain"
    where: str | None = None
    order: str | None = None

    @property
    def input(self) -> str:
        return f"CASE WHEN {self.where} THEN {self.text} END" if self.where else self.text

    def one_pass(self) -> Column:
        if self.kind == "plain":
            out = F.expr(self.text)
        elif self.kind == "median":
            out = F.expr(f"percentile(CAST({self.input} AS DOUBLE), 0.5)")
        elif self.kind == "mode":
            out = F.mode(F.expr(self.input), deterministic=True)
        elif self.kind == "distinct":
            out = F.size(F.collect_set(F.expr(self.input))).cast("long")
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        return out.alias(self.name)


def aggregate(
    df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """All measures per key.

    Without growing measures this is one scan and one shuffle of partial sums.
    With them, the groups are counted first (``hot_keys``, a job over the keys); ordinary groups
    still take that way, and hot groups, if there are any, go through value counts, whose buffers do not grow. Both leave NaN out of medians, modes and distinct
    counts, as if it were null, and take -0.0 for 0.0. ``sizes``: a cheaper frame to count the
    first key in, such as the table that ``df`` joins with something.
    """
    keys = list(keys)
    repeated = {m.name for m in measures if sum(o.name == m.name for o in measures) > 1}
    if repeated:
        raise ValueError(f"repeated output names: {sorted(repeated)}")
    growing = [m for m in measures if m.kind in GROWING]
    if not growing:
        return _one_pass(df, keys, measures)
    measures = _settled(df, measures)
    light, hot = split_hot(df, keys if sizes is None else keys[:1], hot_rows, sizes)
    names = [*keys, *[m.name for m in measures]]
    done = _one_pass(light, keys, measures)
    if hot is None:
        return done
    return done.union(_hot_groups(hot, keys, measures).select(*names))


def _settled(df: DataFrame, measures: Sequence[Measure]) -> list[Measure]:
    """Measures whose growing inputs hold no NaN and no -0.0, on which aggregates and groupings differ."""
    kinds = df.select(*[F.expr(m.text).alias(f"_t{i}") for i, m in enumerate(measures) if m.kind in GROWING]).schema
    types = iter(kinds.fields)
    out = []
    for m in measures:
        kind = next(types).dataType.simpleString() if m.kind in GROWING else ""
        if m.kind == "median" and kind == "string":
            m, kind = replace(m, text=f"CAST({m.text} AS DOUBLE)"), "double"
        if kind in ("double", "float"):
            m = replace(m, text=f"CASE WHEN NOT isnan({m.text}) THEN ({m.text}) + CAST(0 AS {kind}) END")
        out.append(m)
    return out


def _one_pass(df: DataFrame, keys: list[str], measures: Sequence[Measure]) -> DataFrame:
    """All measures in one grouped aggregate. Columns taken from the same end row travel
    as one struct: one comparison per row, not one per column."""
    ends: dict[tuple[str, str], list[Measure]] = {}
    for m in measures:
        if m.kind in ENDS:
            ends.setdefault((m.kind, m.order), []).append(m)
    aggs = [m.one_pass() for m in measures if m.kind not in ENDS]
    place: dict[str, str] = {}
    for i, ((kind, order), group) in enumerate(ends.items()):
        fields = ", ".join(f"'f{j}', {m.text}" for j, m in enumerate(group))
        aggs.append(F.expr(f"{ENDS[kind]}(named_struct({fields}), {order})").alias(f"_end{i}"))
        place.update({m.name: f"_end{i}.f{j}" for j, m in enumerate(group)})
    out = df.groupBy(*keys).agg(*aggs)
    return out.selectExpr(
        *[quoted(k) for k in keys],
        *[f"{place.get(m.name, quoted(m.name))} AS {quoted(m.name)}" for m in measures],
    )


def _hot_groups(hot: DataFrame, keys: list[str], measures: Sequence[Measure]) -> DataFrame:
    fixed = [m for m in measures if m.kind not in GROWING]
    out = _one_pass(hot, keys, [*fixed, Measure("_rows", "count(1)")])
    parts = []
    by_text: dict[str, list[Measure]] = {}
    for m in measures:
        if m.kind in ("mode", "distinct"):
            by_text.setdefault(m.text, []).append(m)
    for text, group in by_text.items():
        hits = [F.expr(f"count_if({m.where or 'true'})").alias(f"_n{i}") for i, m in enumerate(group)]
        values = hot.groupBy(*keys, F.expr(text).alias("_v")).agg(*hits).where("_v IS NOT NULL")
        picks = []
        for i, m in enumerate(group):
            n = F.col(f"_n{i}")
            if m.kind == "distinct":
                pick = F.count_if(n > 0)
            else:
                pick = F.min_by(F.when(n > 0, F.col("_v")), F.when(n > 0, F.struct(-n, "_v")))
            picks.append(pick.alias(m.name))
        parts.append((values.groupBy(*keys).agg(*picks), group))
    medians = [m for m in measures if m.kind == "median"]
    if medians:
        slots = {f"_m{i}": m for i, m in enumerate(medians)}
        inputs = hot.select(*keys, *[F.expr(m.input).cast("double").alias(s) for s, m in slots.items()])
        found = exact_quantiles(long_values(inputs, keys, list(slots)), [*keys, "col"], [0.5])
        parts.append((
            found.groupBy(*keys).agg(
                *[F.max(F.when(F.col("col") == s, F.col("q0"))).alias(m.name) for s, m in slots.items()]
            ),
            medians,
        ))
    for part, group in parts:
        renamed = part.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[m.name for m in group]
        )
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(renamed, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    zero = {m.name: 0 for m in measures if m.kind == "distinct"}
    return out.fillna(zero) if zero else out


# -- rule driven aggregates ---------------------------------------------------


def measure(how: str, column: str, order: Sequence[str], dtype: T.DataType) -> Measure:
    """The named aggregate of one column.

    ``last`` and ``first`` follow ``order`` and keep a null found there. Dates
    average and rank as days since 1970, which may end in a half.
    """
    name = quoted(column)
    number = f"unix_date({name})" if isinstance(dtype, T.DateType) else name
    position = f"struct({', '.join(quoted(o) for o in order)})" if order else None
    if how in ("last", "first"):
        if position is None:
            raise ValueError(f"{how} needs order columns")
        return Measure(f"{how}_{column}", name, how, order=position)
    if how in ("max", "min"):
        return Measure(f"{how}_{column}", f"{how}({name})")
    if how == "sum":
        return Measure(f"sum_{column}", f"coalesce(sum({name}), 0)")
    if how == "count":
        return Measure(f"count_{column}", f"count({name})")
    if how == "mean":
        return Measure(f"mean_{column}", f"avg({number})")
    if how == "var":
        return Measure(f"var{column}", f"var_samp({number})")
    if how == "median":
        return Measure(f"median{column}", number, "median")
    if how == "mode":
        return Measure(f"mode_{column}", name, "mode")
    raise ValueError(f"unknown aggregate {how!r}")


def wanted(name: str, requested: Sequence[str] | None) -> bool:
    """Keep an output that is requested or starts a requested name."""
    return not requested or name in requested or any(r.startswith(name) for r in requested)


def rule_measures(
    df: DataFrame,
    table: Mapping[str, Sequence[str]],
    requested: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    key: str = rules.KEY,
) -> list[Measure]:
    """Measures that a rule table asks for, family by family."""
    if order is None:
        order = [c for c in ("num_group1", "num_group2") if c in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields if f.name != key}
    found = [
        measure(how, column, order, types[column])
        for group, hows in table.items()
        for how in hows
        for column in types
        if rules.family(column) == group
    ]
    return [m for m in found if wanted(m.name, requested)]


def suffix_aggregate(
    df: DataFrame,
    table: Mapping[str, Sequence[str]] = rules.TRAIN_RULES,
    requested: Sequence[str] | None = None,
    key: str = rules.KEY,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per case by the suffix rules."""
    return aggregate(df, [key], rule_measures(df, table, requested, key=key), hot_rows)


def type_aggregate(df: DataFrame, key: str = rules.KEY) -> DataFrame:
    """Max of text, mean of numbers and booleans, max of the rest."""
    measures = []
    for field in df.schema.fields:
        name = quoted(field.name)
        if field.name == key:
            continue
        if isinstance(field.dataType, T.BooleanType):
            text = f"avg(CAST({name} AS INT))"
        elif isinstance(field.dataType, NUMERIC):
            text = f"avg({name})"
        else:
            text = f"max({name})"
        measures.append(Measure(field.name, text))
    return aggregate(df, [key], measures)


# -- hand written aggregates --------------------------------------------------


def filtered_aggregate(
    df: DataFrame, value: str, key: str = rules.KEY, order: str = "num_group1", recent: int = 3
) -> DataFrame:
    """Totals beside those of the first and of the most recent rows, in one pass."""
    v, o = quoted(value), quoted(order)
    first, last = f"{o} = 0", f"{o} < {recent}"
    return aggregate(df, [key], [
        Measure("num_group1", f"count({o})"),
        Measure(f"{value}_sum", f"coalesce(sum({v}), 0)"),
        Measure(f"{value}_mean", f"avg({v})"),
        Measure(f"num1_0_{value}_mean", f"avg(CASE WHEN {first} THEN {v} END)"),
        Measure(f"num1_{recent}_{value}_mean", f"avg(CASE WHEN {last} THEN {v} END)"),
        Measure(
            f"num1_{recent}_{value}_sum",
            f"CASE WHEN count_if({last}) > 0 THEN coalesce(sum(CASE WHEN {last} THEN {v} END), 0) END",
        ),
    ])


def two_level_spread(df: DataFrame, value: str, inner: str, key: str = rules.KEY) -> DataFrame:
    """Sum by (case, inner key), then sample deviation of the sums by case."""
    sums = df.where(F.col(inner).isNotNull()).groupBy(key, inner).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("_s")
    )
    return sums.groupBy(key).agg(F.stddev_samp("_s").alias(f"{value}_sum_std"))


def distinct_per_key(df: DataFrame, columns: Sequence[str], key: str = rules.KEY) -> DataFrame:
    """Exact number of distinct non-null values of each column per key."""
    return df.groupBy(key).agg(*[F.count_distinct(c).alias(f"{c}_nunique") for c in columns])


def rate_by(df: DataFrame, by: str, label: str) -> DataFrame:
    """Rows, events, event rate and share of all rows per value of ``by``."""
    groups = df.groupBy(by).agg(
        F.count(label).alias("count"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("sum")
    )
    # The total is a sum over the groups, whose exchange it uses again, and travels as a scalar subquery.
    total = groups.agg(F.sum("count").alias("_all"))
    return groups.select(
        by, "count", "sum", ratio(F.col("sum"), F.col("count")).alias("rate"),
        ratio(F.col("count"), total.scalar()).alias("count_pct"),
    )


def mean_by(df: DataFrame, value: str, key: str = rules.KEY) -> DataFrame:
    """Mean per key."""
    return df.groupBy(key).agg(F.avg(value).alias(value))


def class_ratio(df: DataFrame, label: str = "target") -> DataFrame:
    """Negatives per positive."""
    return df.agg(
        ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("class_ratio")
    )


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows / (2 * rows of the class)."""
    counts = df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.select(label, ratio(total.scalar(), 2 * F.col("_n")).alias("weight"))


def target_means(df: DataFrame, column: str, label: str = "target") -> DataFrame:
    """Mean label per category, 0 where a category has no labels."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.coalesce(F.avg(label), F.lit(0.0)).alias("encoded")
    )


def as_category(df: DataFrame, column: str) -> Column:
    """A category as text; both zeros of a floating-point column are one."""
    value = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)
    return value.cast("string")


def all_target_means(df: DataFrame, columns: Sequence[str], label: str = "target") -> DataFrame:
    """A35 for many columns: ``col, value, encoded`` from one scan and one aggregate that combines on the map side."""
    texts = df.select(F.col(quoted(label)).alias("_label"), *[as_category(df, c).alias(c) for c in columns])
    long = texts.unpivot(["_label"], [quoted(c) for c in columns], "col", "value").where("value IS NOT NULL")
    return long.groupBy("col", "value").agg(F.coalesce(F.avg("_label"), F.lit(0.0)).alias("encoded"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all numeric pairs, as rows (x, y, corr) with x before y,
    each over the rows that have both values; null where fewer than two rows or a constant decide.

    One scan and one aggregate for any number of columns: a row gives its pairs of present values, two
    generators inside the task, and co-moments by pair combine on the map side. Buffers and what is
    shuffled grow with the pairs of columns, not of rows; nulls cost nothing.
    """
    columns = list(columns or columns_of(df, *NUMERIC))
    width = len(columns)
    if width < 2:
        raise ValueError("correlation needs two numeric columns")
    values = df.select(F.array(*[F.col(quoted(c)).cast("double") for c in columns]).alias("v"))
    first = values.select("v", F.posexplode("v").alias("i", "a")).where(f"a IS NOT NULL AND i < {width - 1}")
    both = first.select("i", "a", F.posexplode("v").alias("j", "b")).where("j > i AND b IS NOT NULL")
    found = both.groupBy("i", "j").agg(F.try_divide(  # F.corr divides by zero on a constant, which ANSI mode refuses
        F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a")), F.stddev_pop("b")).alias("corr"))
    pairs = df.sparkSession.range(width - 1).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id").cast("int") + 1, F.lit(width - 1))).alias("j"))
    name = F.array(*[F.lit(c) for c in columns])
    return pairs.join(found, ["i", "j"], "left").select(
        F.get(name, "i").alias("x"), F.get(name, "j").alias("y"), "corr")
