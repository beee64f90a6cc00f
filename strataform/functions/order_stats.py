"""Exact ranks and quantiles that never hold one group in one task.

A group may be a third of the table, so a window over the whole group is not an
option. Values are cut into blocks by a fixed monotone function, rows are counted per block with
map-side combine, and only block totals are ordered. A block of more than ``BLOCK_ROWS`` rows is split
by the upper bits of a 64-bit key of the same order, and a part that is still too large by the key itself: a
radix tree of three levels whose lower ones are planned or computed for crowded blocks only. Blocks and
keys depend on nothing but the value, so a recomputed task yields the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataform.session import materialise

BLOCKS_PER_OCTAVE = 1024
_SHIFT = 1100 * BLOCKS_PER_OCTAVE  # above |log2| of the smallest double
_TOP = 2200 * BLOCKS_PER_OCTAVE
#: Levels of the tree below the blocks: how many of a key's low bits each leaves out.
LEVELS = (None, 21, 0)
#: A block of more rows is split. At most rows / BLOCK_ROWS blocks are, so their list may be broadcast.
BLOCK_ROWS = 1 << 20


def order_key(value: Column) -> Column:
    """A long that orders like ``value`` as a double: equal for equal values only, 0 for both zeros.

    Binary exponent and fraction side by side, the sign before both; NaN comes last. All steps are exact but
    the logarithm, which is put right by a comparison with the powers of two beside it.
    """
    number = value.cast("double")
    size = F.abs(number)
    two = F.lit(2.0)
    near = F.floor(F.greatest(F.least(F.log2(size), F.lit(1023.0)), F.lit(-1022.0)))
    low = F.when(F.pow(two, near) > size, 1).otherwise(0)
    high = F.when(F.pow(two, near + 1) <= size, 1).otherwise(0)
    power = F.greatest(near - low + high, F.lit(-1022)).cast("long")
    fraction = F.floor(size / F.pow(two, power) * F.lit(float(1 << 52)))
    key = F.when(size == 0, F.lit(0).cast("long")).when(
        size >= F.lit(float("inf")), F.lit(2047 << 52)
    ).otherwise((power + 1022) * F.lit(1 << 52) + fraction)
    return F.when(number < 0, -key).otherwise(key)


def value_block(value: Column, level: int = 0) -> Column:
    """Block number that never decreases as ``value`` grows: at most ~4.5 million at level 0, which needs
    a logarithm only; below it, parts of a block are told apart by the key."""
    if level:
        return F.shiftright(order_key(value), LEVELS[level])
    size = F.abs(value.cast("double"))
    step = F.floor(F.least(F.log2(size) * BLOCKS_PER_OCTAVE + _SHIFT, F.lit(float(_TOP))))
    return F.when(size == 0, F.lit(0)).otherwise(step * F.signum(value.cast("double")).cast("long"))


def _cut(
    counts: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], block_rows: int
) -> DataFrame:
    """Counts with their block and their part of it, laid out by (group, block, part).

    A block of at most ``block_rows`` rows is one part; others are parted by the upper bits of the key, so that a
    part has at most 2^21 values whatever they are.

    All users of the result and of ``counts`` must see the same rows and columns below their exchange,
    or Spark computes it twice; hence the explicit null test here and the use of every
    column in the totals (weights are never null, so its test drops nothing). The keys travel as one struct, which is
    never null itself, so that a null key joins like any other.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    known = counts.where(F.col(value).isNotNull())
    cut = known.select(
        group.alias("_key"), value, *weights, value_block(F.col(value)).alias("_block")
    ).where(F.col("_block").isNotNull())
    full = _totals(cut, ("_key", "_block"), value, weights, [F.count(F.lit(1)).alias("_rows")])
    full = full.where(F.col("_rows") > block_rows).select("_key", "_block", F.lit(True).alias("_full"))
    parted = cut.join(F.broadcast(full), ["_key", "_block"], "left")
    part = F.when(F.col("_full"), value_block(F.col(value), 1)).otherwise(F.lit(0).cast("long"))
    return parted.select("_key", "_block", part.alias("_part"), value, *weights).repartition("_key", "_block", "_part")


def _totals(
    cut: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], more: Sequence[Column] = ()
) -> DataFrame:
    totals = cut.groupBy(*by).agg(
        F.max(value).alias("_top"), *[F.sum(w).alias(f"_t_{w}") for w in weights], *more
    )
    used = " AND ".join(["_top IS NOT NULL", *[f"_t_{w} IS NOT NULL" for w in weights]])
    return totals.where(used).drop("_top")


_GROUP = ("_key",)  # window over the blocks of a group
_BLOCK = ("_key", "_block")  # window inside one block
_PART = ("_key", "_block", "_part")  # window inside one part of a block


def _before(weight: str, order: str, by: Sequence[str]) -> Column:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(window), F.lit(0))


def _unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"_key.{k}").alias(k) for k in keys]


def running_before(
    counts: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``before_<w>``: the sum of each weight over smaller values of the group.

    ``counts`` holds one row per (keys, value); its other columns are numbers, not null.
    Windows hold the blocks of a group, the parts of a block, or the values of a part.
    """
    carried = [c for c in counts.columns if c not in keys and c != value]
    cut = _cut(counts, keys, value, carried, block_rows)
    parts = _totals(cut, _PART, value, carried)
    blocks = parts.groupBy(*_BLOCK).agg(*[F.sum(f"_t_{w}").alias(f"_b_{w}") for w in weights])
    outer = blocks.select(*_BLOCK, *[_before(f"_b_{w}", "_block", _GROUP).alias(f"_o_{w}") for w in weights])
    inner = parts.select(*_PART, *[_before(f"_t_{w}", "_part", _BLOCK).alias(f"_i_{w}") for w in weights])
    offsets = inner.join(outer, list(_BLOCK)).select(
        *_PART, *[(F.col(f"_o_{w}") + F.col(f"_i_{w}")).alias(f"_o_{w}") for w in weights]
    )
    return cut.join(offsets, list(_PART)).select(
        *_unpacked(keys), value, *carried,
        *[(F.col(f"_o_{w}") + _before(w, value, _PART)).alias(f"before_{w}") for w in weights],
    )


def long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, col, value): numeric columns below each other, from one scan."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "col", "value"
    )


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    value: str = "value",
    method: str = "linear",
    few_groups: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact quantiles per group: ``q0, q1, ..``, the row count and the number of blocks.

    ``linear`` interpolates between neighbours; ``nearest`` takes the value at the
    position rounded half to even. Nulls and NaN are left out.

    The first pass shuffles block totals only and stores the blocks that hold a wanted
    position, 2 * len(probs) per group. Such a block of more than ``block_rows`` rows is split
    by its next bits, in a pass over its rows that again shuffles totals only; two more such passes at
    most, and none where no block is crowded. A block of one value, however many rows it has, is known
    from its totals: it is neither split nor read. The last pass shuffles the values of the found blocks. With
    ``few_groups`` (a number of groups bounded by the schema) the block list is
    broadcast, and that pass drops the other rows before its shuffle.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    levels = "array(" + ", ".join(_number(p) for p in probs) + ")"

    def places(rounding: str) -> str:
        return f"transform({levels}, p -> CAST({rounding}(p * (rows - 1)) AS BIGINT))"

    wanted = places("rint") if method == "nearest" else f"array_union({places('floor')}, {places('ceil')})"
    group = F.struct(*keys) if keys else F.lit(0)
    number = F.col(value).cast("double")
    base = rows.where(number.isNotNull() & ~F.isnan(number)).select(
        group.alias("_key"), number.alias("_v")
    )
    whole = Window.partitionBy("_key")
    here = f"exists({wanted}, t -> t >= _before AND t < _before + _m)"

    def at(level: int) -> DataFrame:
        # keys are dear: below the first level only rows of blocks that are split get one
        inside = at(level - 1).join(
            F.broadcast(crowded_at[level - 1]), list(_BLOCK), "left_semi") if level else base
        return inside.withColumn("_block", value_block(F.col("_v"), level))

    ends = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    blocks = at(0).groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("_m"), *ends).select(
        *_BLOCK, "_m", "_lo", "_hi", _before("_m", "_block", _GROUP).alias("_before"),
        F.sum("_m").over(whole).alias("rows"), F.count("_m").over(whole).alias("blocks"),
    )
    many = F.col("_lo") < F.col("_hi")
    hits, most = _kept(blocks.where(here), many)
    found, crowded_at = [], []  # of each level: the blocks to read, the blocks to split
    for level in range(1, len(LEVELS)):
        if most <= block_rows:
            break
        crowded = hits.where((F.col("_m") > block_rows) & many)
        found.append(hits.where((F.col("_m") <= block_rows) | ~many))
        crowded_at.append(crowded.select(*_BLOCK))
        # A list of at most rows / block_rows blocks.
        inside = at(level - 1).join(F.broadcast(crowded.drop("_m", "_lo", "_hi")), list(_BLOCK)).withColumnRenamed(
            "_block", "_of")
        split = inside.groupBy("_key", "_of", value_block(F.col("_v"), level).alias("_block")).agg(
            F.count(F.lit(1)).alias("_m"), *ends, *[F.max(c).alias(c) for c in ("_before", "rows", "blocks")])
        split = split.withColumn("_before", F.col("_before") + _before("_m", "_block", ("_key", "_of")))
        hits, most = _kept(split.drop("_of").select(*hits.columns).where(here), many)
    found.append(hits)

    def read(level: int, listed: DataFrame) -> DataFrame:
        # of one value, and of both zeros alike, as grouping has them
        known = listed.where(~many).select(
            *_BLOCK, (F.col("_lo") + F.lit(0.0)).alias("_v"), F.col("_m").alias("n"), "_before", "rows", "blocks",
            F.lit(level).alias("_level"))
        listed = listed.where(many).drop("_m", "_lo", "_hi")
        own = at(level)
        if level < len(crowded_at) and not few_groups:  # rows of split blocks, which may be most, are not shuffled by block
            own = own.join(F.broadcast(crowded_at[level]), list(_BLOCK), "left_anti")
        if few_groups or level:  # below the first level: parts of crowded blocks, as few as those
            listed = F.broadcast(listed)
        part = own.join(listed, list(_BLOCK))
        return part.groupBy(*_BLOCK, "_v").agg(F.count(F.lit(1)).alias("n"), *[
            F.max(c).alias(c) for c in ("_before", "rows", "blocks")]).withColumn("_level", F.lit(level)).unionByName(known)

    counts = reduce(DataFrame.unionByName, [read(level, listed) for level, listed in enumerate(found)])
    ranked = counts.withColumn("_first", F.col("_before") + _before("n", "_v", ("_key", "_level", "_block")))
    mine = f"filter(array_distinct({wanted}), t -> t >= _first AND t < _first + n)"
    wanted_values = ranked.select("_key", "rows", "blocks", "_v", F.explode(F.expr(mine)).alias("_at"))
    # The collected list has one entry per wanted position, whatever the group's size.
    picked = wanted_values.groupBy("_key").agg(
        F.max("rows").alias("rows"), F.max("blocks").alias("blocks"),
        F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_values"),
    )
    return picked.selectExpr(
        *[f"_key.`{k}` AS `{k}`" for k in keys], "rows", "blocks",
        *[f"{_quantile_text(p, method)} AS q{i}" for i, p in enumerate(probs)],
    )


def _kept(hits: DataFrame, many: Column) -> tuple[DataFrame, int]:
    """Blocks as a stored table, and the rows of the largest of ``many`` values, seen while it was written."""
    seen = Observation()
    kept = materialise(hits.observe(seen, F.max(F.when(many, F.col("_m"))).alias("most")), "rank-blocks")
    return kept, seen.get["most"] or 0


def _number(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def _quantile_text(p: float, method: str) -> str:
    """SQL text of one quantile, from the map of position to value."""
    at = f"{_number(p)} * (rows - 1)"

    def value(rounding: str) -> str:
        return f"try_element_at(_values, CAST({rounding}({at}) AS BIGINT))"

    if method == "nearest":
        return value("rint")
    lo, hi = value("floor"), value("ceil")
    return f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({at} - floor({at})) END"
