"""Casts, date handling, pruning and small column rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform import rules
from strataform.functions.columns import FLOATING, INTEGRAL, NUMERIC, as_date, columns_of, quoted


def suffix_cast(df: DataFrame) -> DataFrame:
    """Cast every column by its name in one projection."""
    def cast(name: str) -> Column:
        if name in rules.KEY_COLUMNS:
            kind = "bigint"
        elif name == "date_decision":
            kind = "date"
        else:
            kind = rules.SUFFIX_TYPE.get(rules.suffix(name))
        return F.col(name).try_cast(kind).alias(name) if kind else F.col(name)

    return df.select(*[cast(c) for c in df.columns])


def days_since_decision(df: DataFrame) -> DataFrame:
    """Date columns become days relative to the decision, the past being negative.

    A day number (median or mean of dates) is moved the same way.
    """
    day = F.unix_date(as_date("date_decision"))
    types = {f.name: f.dataType for f in df.schema.fields}

    def shift(name: str) -> Column:
        if rules.suffix(name) != "D":
            return F.col(name)
        if isinstance(types[name], NUMERIC):
            return (F.col(name) - day).alias(name)
        return F.datediff(as_date(name), as_date("date_decision")).alias(name)

    return df.select(*[shift(c) for c in df.columns if c not in ("date_decision", "MONTH")])


def is_period_column(name: str, serving: bool = False) -> bool:
    if serving:
        return name.endswith("D") or (name.startswith("max__if") and name.endswith("d__"))
    return name.endswith("D") or name.endswith("d__")


def date_to_period(df: DataFrame, serving: bool = False) -> DataFrame:
    """Days before the decision, the past being positive; missing or bad text gives 0."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def period(name: str) -> Column:
        if not is_period_column(name, serving) or not (serving or name in texts):
            return F.col(name)
        days = F.datediff(as_date("date_decision"), as_date(name))
        return F.coalesce(days, F.lit(0)).cast("double").alias(name)

    dates = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.DateType))}
    return df.select(*[period(c) if c in dates else F.col(c) for c in df.columns])


def calendar_parts(df: DataFrame) -> DataFrame:
    """Month and weekday (Monday 1 to Sunday 7) of the decision."""
    day = as_date("date_decision")
    return df.withColumns({
        "month_decision": F.month(day), "weekday_decision": F.weekday(day) + 1,
    })


def column_health(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, int | None]]:
    """Null share of each column and number of values (null included) of text columns.

    One scan for all null shares; distinct text values are counted over an unpivoted
    scan, so the plan does not grow by a branch per column. Only schema-sized rows
    come back.
    """
    columns = list(columns)
    if not columns:
        return {}
    shares = df.agg(*[
        F.avg(F.col(c).isNull().cast("int")).alias(f"_s{i}") for i, c in enumerate(columns)
    ]).first()
    texts = [c for c in columns_of(df, T.StringType) if c in columns]
    values: dict[str, int] = {}
    if texts:
        long = df.select(*texts).unpivot([], texts, "col", "value").distinct()
        values = {r["col"]: r["n"] for r in long.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        c: (shares[i], values.get(c, 0) if c in texts else None) for i, c in enumerate(columns)
    }


def drop_sparse(df: DataFrame, limit: float = 0.7) -> DataFrame:
    """P5: drop columns whose null share is above ``limit``."""
    own = [c for c in df.columns if c not in rules.BASE_COLUMNS]
    bad = {c for c, (share, _) in column_health(df, own).items() if share is not None and share > limit}
    return df.select(*[c for c in df.columns if c not in bad])


def drop_by_cardinality(df: DataFrame, most: int = 200) -> DataFrame:
    """Drop text columns with one value or more than ``most``; null is a value."""
    own = [c for c in columns_of(df, T.StringType) if c not in rules.BASE_COLUMNS]
    bad = {c for c, (_, n) in column_health(df, own).items() if n == 1 or n > most}
    return df.select(*[c for c in df.columns if c not in bad])


# Open ranges of the signed integer types.
INTEGER_RANGES = (
    ("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1), ("bigint", -(2**63), 2**63 - 1),
)
FLOAT_MAX = 3.4028234663852886e38


def _extremes(df: DataFrame) -> dict[str, tuple]:
    """Least and greatest value of each column, from one scan."""
    usable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]
    if not usable:
        return {}
    row = df.agg(*[
        f(quoted(c)).alias(f"_{p}{i}")
        for i, c in enumerate(usable) for p, f in (("a", F.min), ("z", F.max))
    ]).first()
    return {c: (row[f"_a{i}"], row[f"_z{i}"]) for i, c in enumerate(usable)}


def _is_number(value) -> bool:
    try:
        float(value)
        return True
    except (TypeError, ValueError):
        return False


def _integer_type(low, high) -> str:
    for name, least, most in INTEGER_RANGES:
        if low > least and high < most:
            return name
    raise OverflowError(f"no integer type holds {low}..{high}")


def narrow_types(df: DataFrame, keys: Sequence[str] = ("case_id", "num_group1", "num_group2")) -> DataFrame:
    """The narrowest type that holds each column's least and greatest value.

    Integers shrink to 8..64 bits, keys to 32. Anything else becomes a 32-bit
    float (64-bit where a value is out of its range) when every value reads as a number,
    so numeric text and booleans do, and text if not, so dates do. A key beyond 32 bits
    stays as it is.
    """
    found = _extremes(df)
    texts = columns_of(df, T.StringType)
    reads = df.agg(*[
        f(F.expr(f"try_cast({quoted(c)} AS DOUBLE)")).alias(f"_{p}{i}") for i, c in enumerate(texts)
        for p, f in (("n", F.count), ("a", F.min), ("z", F.max))
    ], *[F.count(quoted(c)).alias(f"_k{i}") for i, c in enumerate(texts)]).first() if texts else {}
    as_numbers = {
        c: (reads[f"_a{i}"], reads[f"_z{i}"]) for i, c in enumerate(texts) if reads[f"_n{i}"] == reads[f"_k{i}"]}

    def cast(field: T.StructField) -> Column:
        name = field.name
        low, high = (0 if v is None else v for v in found.get(name, (None, None)))
        if name in keys:
            fits = _is_number(low) and _is_number(high) and -(2**31) <= float(low) and float(high) < 2**31
            kind = "int" if fits else "bigint"
        elif isinstance(field.dataType, T.NullType):
            kind = "string"
        elif isinstance(field.dataType, INTEGRAL):
            kind = _integer_type(low, high)
        else:
            if isinstance(field.dataType, T.StringType):
                low, high = as_numbers.get(name, ("", ""))
                low, high = (0 if v is None else v for v in (low, high))
            wide = _is_number(low) and _is_number(high) and max(abs(float(low)), abs(float(high))) > FLOAT_MAX
            kind = ("double" if wide else "float") if _is_number(low) and _is_number(high) else "string"
        return F.col(quoted(name)).try_cast(kind).alias(name)

    return df.select(*[cast(f) for f in df.schema.fields])


def shrink_numbers(df: DataFrame) -> DataFrame:
    """Shrink numeric columns only. Spark has no half float, so 32 bits is the least."""
    numbers = columns_of(df, *NUMERIC)
    found = _extremes(df.select(*[quoted(c) for c in numbers])) if numbers else {}

    def cast(field: T.StructField) -> Column:
        low, high = found.get(field.name, (None, None))
        column = F.col(quoted(field.name))
        if low is None or high is None:
            return column
        if isinstance(field.dataType, INTEGRAL):
            return column.try_cast(_integer_type(low, high)).alias(field.name)
        kind = "float" if float(low) > -FLOAT_MAX and float(high) < FLOAT_MAX else "double"
        return column.cast(kind).alias(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])


def is_whole(column: str) -> Column:
    """Known, finite and without a fraction."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c == F.rint(c))


def integral_floats(df: DataFrame) -> list[str]:
    """Float columns that hold whole numbers only; one null rules a column out."""
    floats = columns_of(df, *FLOATING)
    if not floats:
        return []
    row = df.agg(*[F.bool_and(is_whole(c)).alias(f"_w{i}") for i, c in enumerate(floats)]).first()
    return [c for i, c in enumerate(floats) if row[f"_w{i}"]]


def promote_integral_floats(df: DataFrame) -> DataFrame:
    """P9 applied: such columns become integers."""
    whole = set(integral_floats(df))
    return df.select(*[F.col(c).try_cast("bigint").alias(c) if c in whole else F.col(c) for c in df.columns])


def numeric_only(df: DataFrame) -> DataFrame:
    """P10: leave out text (and other object-like) columns."""
    return df.select(*columns_of(df, *NUMERIC, T.BooleanType))


def fill_constant(df: DataFrame, value: float = rules.FILL_VALUE) -> DataFrame:
    """Nulls and NaN of numeric columns become one constant.

    Whole-number columns too narrow for it are widened, to 32 bits if those do.
    """
    most = {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31}
    wide = "int" if -(1 << 31) <= value < 1 << 31 else "long"
    narrow = {
        f.name for f in df.schema.fields
        if (size := most.get(type(f.dataType))) is not None and not -size <= value < size
    }
    if narrow:
        df = df.select(*[F.col(quoted(c)).cast(wide).alias(c) if c in narrow else F.col(quoted(c)) for c in df.columns])
    return df.fillna(value)


def fill_text(df: DataFrame, text: str = "NA") -> DataFrame:
    """P12, text half: nulls of text columns become ``text``."""
    return df.fillna(text)


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Plus and minus infinity become null."""
    floats = set(columns_of(df, *FLOATING))
    return df.select(*[
        F.when(F.abs(c) != float("inf"), F.col(c)).alias(c) if c in floats else F.col(c)
        for c in df.columns
    ])


def clean_score(score: Column, missing: float = 0.3) -> Column:
    """Missing to 0.3, then clip to [0, 1]."""
    known = F.coalesce(F.nanvl(score.cast("double"), F.lit(missing)), F.lit(missing))
    return F.least(F.greatest(known, F.lit(0.0)), F.lit(1.0))


def project(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The listed features, in the listed order."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keep, *features)


def first_child(df: DataFrame, index: str = "num_group2") -> DataFrame:
    """The first row of each nested group, without its index."""
    return df.where(F.col(index) == 0).drop(index)


# First and last month of each label.
DEVELOPMENT_MONTHS = (201909, 202008)
VALIDATION_MONTHS = (201901, 201908)


def month_label(month: Column, development=DEVELOPMENT_MONTHS, validation=VALIDATION_MONTHS) -> Column:
    """0 development, 1 validation, 2 test."""
    return (
        F.when(month.cast("int").between(*development), 0)
        .when(month.cast("int").between(*validation), 1).otherwise(2)
    )


def week_group(week: Column, parts: int = 5, weeks: int = 92) -> Column:
    """Equal slices of the week axis, numbered from 0."""
    return F.floor(week / weeks * parts).cast("int")


def bucket_split(df: DataFrame, bucket: str, train: int) -> tuple[DataFrame, DataFrame]:
    """P20: (rows of one bucket, rows of the others): training uses the single bucket."""
    return df.where(F.col(bucket) == train), df.where(F.col(bucket) != train)


CLASHING_NAME = "_if_1_eq_1_then_num_group1_"


def tag_clashing(df: DataFrame, topic: str) -> DataFrame:
    """Unfiltered counts of ``num_group1`` look alike in all topics, so tag them."""
    return df.withColumnsRenamed({c: f"{c}_{topic}" for c in df.columns if CLASHING_NAME in c})


def feature_columns(df: DataFrame, drop: Sequence[str] = ("case_id", "target", "date_decision")):
    """(feature names, names of text features, their positions)."""
    features = [c for c in df.columns if c not in drop]
    texts = set(columns_of(df, T.StringType))
    positions = [i for i, c in enumerate(features) if c in texts]
    return features, [features[i] for i in positions], positions


def parse_dates(df: DataFrame, columns: str | Sequence[str], pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Add ``<col>_dt`` timestamps; text that does not parse gives null."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    return df.withColumns({f"{c}_dt": F.try_to_timestamp(F.col(c), F.lit(pattern)) for c in columns})


def week_first(df: DataFrame) -> DataFrame:
    """``WEEK_NUM`` leads."""
    if "WEEK_NUM" not in df.columns:
        return df
    return df.select("WEEK_NUM", *[c for c in df.columns if c != "WEEK_NUM"])


def promote_numeric_text(df: DataFrame) -> DataFrame:
    """P25: a text column in which every value is a number becomes double."""
    texts = columns_of(df, T.StringType)
    if not texts:
        return df
    row = df.agg(*[
        F.bool_and(F.col(c).try_cast("double").isNotNull()).alias(f"_n{i}") for i, c in enumerate(texts)
    ]).first()
    numbers = {c for i, c in enumerate(texts) if row[f"_n{i}"]}
    return df.select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in df.columns])
