"""Unions and duplicate removal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform import rules
from strataform.functions.columns import INTEGRAL, NUMERIC


def unify_pairs(
    df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]], flag: str = "status"
) -> DataFrame:
    """X1: "active" and "closed" columns stacked in one column each.

    Each input row yields one row with flag 1 (first of every pair) and one with
    flag 0 (second). One scan emits both.
    """
    def side(which: int) -> Column:
        fields = [F.lit(1 - which).alias(flag)]
        fields += [F.col(pair[which]).alias(name) for name, pair in pairs.items()]
        return F.struct(*fields)

    return df.select(*keys, F.inline(F.array(side(0), side(1))))


_WIDENING = ("tinyint", "smallint", "int", "bigint")


def common_type(kinds: Sequence[T.DataType]) -> str:
    """Supertype of the types one column has in several parts."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return "string"
    first = kinds[0]
    if all(k == first for k in kinds):
        return first.simpleString()
    if all(isinstance(k, INTEGRAL) for k in kinds):
        return max((k.simpleString() for k in kinds), key=_WIDENING.index)
    if all(isinstance(k, NUMERIC + (T.BooleanType,)) for k in kinds):
        return "float" if all(isinstance(k, T.FloatType) for k in kinds) else "double"
    if all(isinstance(k, (T.DateType, T.TimestampType)) for k in kinds):
        return "timestamp"
    return "string"


def concat_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name, types widened to a common one.

    A column that a frame lacks is null there.
    """
    kinds: dict[str, list[T.DataType]] = {}
    for frame in frames:
        for field in frame.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)
    target = {name: common_type(found) for name, found in kinds.items()}
    boolean_mix = {
        n for n, found in kinds.items()
        if any(isinstance(k, T.BooleanType) for k in found) and target[n] in ("double", "float")
    }

    def cast(frame: DataFrame, name: str) -> Column:
        if name not in frame.columns:
            return F.lit(None).cast(target[name]).alias(name)
        column = F.col(name)
        if name in boolean_mix and isinstance(frame.schema[name].dataType, T.BooleanType):
            column = column.cast("int")
        return column.cast(target[name]).alias(name)

    return reduce(DataFrame.union, [f.select(*[cast(f, n) for n in target]) for f in frames])


def unique_by_key(df: DataFrame, key: str = rules.KEY, order: Sequence[str] = ()) -> DataFrame:
    """One row per key; with ``order`` it is the least row, so a rerun agrees.

    The winner is found by an aggregate with map-side combine, so copies of a key
    are dropped before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    by = F.struct(*(order or others))
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), by).alias("_row"))
    return best.select(key, "_row.*").select(*df.columns)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations."""
    return df.select(*keys).distinct()



