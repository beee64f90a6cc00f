"""Splitting off the few groups that are too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import materialise

# A group above this many rows is hot. At most rows / HOT_ROWS groups can be, so
# the list of hot keys stays near 16 MB even for 1e12 rows and may be broadcast.
HOT_ROWS = 1_000_000
# Counters of the sketch that finds them.
BUCKETS = 1 << 20


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys of more than ``hot_rows`` rows as a stored table, or None if there are none.

    Two steps over the key columns alone. A sketch first: rows per hash bucket of the key, counters that combine on
    the map side and whose number is fixed; a hot key's bucket exceeds the limit, so without such a bucket
    no key does and nothing is planned for them. Only keys of such buckets are then counted exactly.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    counted = df.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    full = counted.where(F.col("_rows") > hot_rows).select("_bucket")
    if full.isEmpty():
        return None
    full = materialise(full, "hot-buckets")  # at most BUCKETS rows
    near = df.select(*keys, bucket).join(F.broadcast(full), "_bucket", "left_semi")
    found = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    found = materialise(found.select(*keys), "hot-keys")
    return None if found.isEmpty() else found


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None).

    Groups are counted in ``sizes`` if given, else in ``df``, by ``hot_keys``: that runs a job over
    the key columns. Where no group is hot, the first frame is ``df`` itself and plans stay single.
    """
    hot = hot_keys(df if sizes is None else sizes, keys, hot_rows)
    if hot is None:
        return df, None
    names = [f"_hot_{i}" for i in range(len(keys))]
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    listed = F.broadcast(hot.toDF(*names))
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")
