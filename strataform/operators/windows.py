"""Group values carried back to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.operators.skew import HOT_ROWS, split_hot

_GROUP_AGGREGATES = {"count": F.count, "min": F.min, "max": F.max}


def group_back(
    df: DataFrame, how: str, by: str | Sequence[str], columns: str | Sequence[str]
) -> DataFrame:
    """``<col>_gb<how>`` holds the group's count, min or max; null for null keys.

    Aggregated with map-side combine and joined back: a window would bring a hot
    group into one task, a join lets AQE split it.
    """
    if how not in _GROUP_AGGREGATES:
        raise ValueError("how must be 'count', 'min' or 'max'")
    by = [by] if isinstance(by, str) else list(by)
    columns = [columns] if isinstance(columns, str) else list(columns)
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    groups = known.groupBy(*by).agg(
        *[_GROUP_AGGREGATES[how](c).alias(f"{c}_gb{how}") for c in columns]
    )
    names = [*df.columns, *[f"{c}_gb{how}" for c in columns]]
    return df.join(groups, by, "left").select(*names)


def _next_known(column: str, by: Sequence, order: str, start: int = 0):
    """The first non-null value of ``column`` from ``start`` rows on in ``order``.

    Read from the far end as the last value so far: a frame that runs to the end of its group is summed up anew
    for each row, one that starts there is carried along.
    """
    back = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -start)
    return F.last(column, ignorenulls=True).over(back)


def back_fill(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    by: Sequence[str] = (),
    span: int = 100_000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A null takes the next non-null value in ``order`` (an integer) within ``by``.

    NaN counts as missing. Ordinary groups are one window each. Hot groups, or a table
    without groups, are cut into spans of the order axis: a null looks ahead inside its
    span, then takes the first value of the next span that has one. Which span that is, is found
    by a tree of spans: a window holds the children of one node, and no window holds all spans.
    """
    by, columns = list(by), list(columns)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    df = df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in columns and c in floats else F.col(c)
        for c in df.columns
    ])
    if not by:
        return _back_fill_spans(df, columns, order, by, span)
    light, hot = split_hot(df, by, hot_rows)
    done = light.select(*[
        _next_known(c, by, order).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])
    return done if hot is None else done.unionByName(_back_fill_spans(hot, columns, order, by, span))


def fill_by_type(
    df: DataFrame, order: str, by: Sequence[str] = (), text: str = "NA", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Nulls of text columns become ``text``, those of other columns the next value in ``order``.

    ``order`` and ``by`` stay as they are.
    """
    fixed = {order, *by}
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in fixed]
    others = [c for c in df.columns if c not in fixed and c not in texts]
    filled = back_fill(df, others, order, by, hot_rows=hot_rows) if others else df
    return filled.fillna(text, texts) if texts else filled


FAN = 1000  # spans under one node of the tree


def _same(names: Sequence[str], others: Sequence[str]):
    same = F.lit(True)
    for one, other in zip(names, others):
        same = same & F.col(one).eqNullSafe(F.col(other))
    return same


def _values_after(firsts: DataFrame, by: list[str], slots: list[str], top: int) -> DataFrame:
    """``firsts(by, _span, slots)`` with each slot's next value from later spans of its group; ``_span`` is 0 to ``top``.

    Spans below one node look ahead among themselves; what they miss comes from the later nodes, by the same rule a
    level higher, until one node is left.
    """
    node = F.floor(F.col("_span") / FAN).cast("long")
    near = firsts.select(*by, "_span", *[_next_known(s, [*by, node], "_span", 1).alias(s) for s in slots])
    if top < FAN:
        return near
    nodes = firsts.groupBy(*by, node.alias("_node")).agg(*[
        F.min_by(s, F.when(F.col(s).isNotNull(), F.col("_span"))).alias(s) for s in slots])
    above = _values_after(nodes.withColumnRenamed("_node", "_span"), by, slots, top // FAN)
    keys = [f"_u{i}" for i in range(len(by) + 1)]
    above = above.toDF(*keys, *[f"_a{i}" for i in range(len(slots))])
    marked = near.withColumn("_node", node)
    return marked.join(above, _same([*by, "_node"], keys), "left").select(
        *by, "_span", *[F.coalesce(s, f"_a{i}").alias(s) for i, s in enumerate(slots)])


def _back_fill_spans(
    df: DataFrame, columns: list[str], order: str, by: list[str], span: int
) -> DataFrame:
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:  # no rows, or no order
        low = high = 0
    # nulls of the order come first, as they sort
    cut = df.withColumn("_span", F.coalesce(
        F.floor((F.col(order).cast("decimal(20,0)") - low) / span).cast("long") + 1, F.lit(0)).cast("long"))
    firsts = cut.groupBy(*by, "_span").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order))).alias(f"_f{i}")
        for i, c in enumerate(columns)
    ])
    keys = [f"_k{i}" for i in range(len(by) + 1)]
    nexts = _values_after(firsts, by, [f"_f{i}" for i in range(len(columns))], (high - low) // span + 1).toDF(
        *keys, *[f"_n{i}" for i in range(len(columns))])
    filled = {
        c: F.coalesce(_next_known(c, [*by, "_span"], order), F.col(f"_n{i}"))
        for i, c in enumerate(columns)
    }
    joined = cut.join(nexts, _same([*by, "_span"], keys), "left")
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def row_positions(
    df: DataFrame, by: Sequence[str], order: Sequence, block, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Position of each row in its group, from 0, for tables that lack ``num_groupN``.

    ``order`` must have no ties. ``block`` is a coarse form of it, a column that never
    decreases along the order: hot groups are numbered block by block, in many tasks.
    """
    by = list(by)
    light, hot = split_hot(df, by, hot_rows)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = light.withColumn(name, place.cast("long"))
    if hot is None:
        return numbered

    cut = hot.withColumn("_block", block)
    sizes = cut.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *by, "_block", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)) - 1
    parts = cut.join(starts, [*by, "_block"]).withColumn(name, (F.col("_start") + inside).cast("long"))
    return numbered.unionByName(parts.drop("_block", "_start"))
