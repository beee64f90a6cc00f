"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_date(name: str) -> Column:
    """Date from a date, timestamp or ISO text column; bad text gives null."""
    return F.col(name).try_cast("date")


def key_bucket(*keys: str, buckets: int = 10000, salt: str = "") -> Column:
    """Stable pseudo-random bucket of a row key.

    It depends on the key only: a lost task draws the same sample again, and the
    complement is the negated predicate, with no join.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    if salt:
        text = F.concat(F.lit(salt + "|"), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
