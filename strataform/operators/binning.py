"""Bins, information value, stability of populations, bin encoding."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform import rules
from strataform.functions.columns import FLOATING, columns_of
from strataform.functions.order_stats import exact_quantiles, long_values
from strataform.operators.joins import with_group_totals
from strataform.operators.projections import promote_numeric_text
from strataform.session import materialise

MISSING = "Missing"


@dataclass(frozen=True)
class Bins:
    """How one column is cut: ``text`` prefix, single ``value``, or quantile ``edges``."""

    kind: str
    edges: tuple[float, ...] = field(default=())

    @property
    def inner(self) -> tuple[float, ...]:
        return self.edges[1:-1]


def share_log_text(a: str, b: str) -> str:
    """(a - b) * ln(a / b), 0 where either share is 0."""
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ({a} - {b}) * ln(try_divide({a}, {b})) ELSE 0D END"


def _plain_floats(df: DataFrame) -> DataFrame:
    """NaN counts as missing."""
    floats = set(columns_of(df, *FLOATING))
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def _values(df: DataFrame, columns: Sequence[str], fill: bool) -> DataFrame:
    """(col, value): nulls are put at the fill value or left out."""
    filled = F.coalesce("value", F.lit(float(rules.FILL_VALUE))) if fill else F.col("value")
    return long_values(df, [], columns).select("col", filled.alias("value"))


def _edges_below(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges under a value: its bin where bins are closed on the right."""
    return F.size(F.filter(_double_array(edges), lambda e: e < value))


def _edges_upto(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges under or at a value: its bin where bins are closed on the left."""
    return F.size(F.filter(_double_array(edges), lambda e: e <= value))


def _double_array(values: Sequence[float]) -> Column:
    return F.expr("CAST(array(" + ", ".join(f"'{float(x)!r}'" for x in values) + ") AS ARRAY<DOUBLE>)")


def _edges(values: DataFrame, parts: int) -> tuple[dict, dict]:
    """(edges, number of value blocks) per column; only they reach the driver."""
    probs = [i / parts for i in range(parts + 1)]
    rows = exact_quantiles(values, ["col"], probs, few_groups=True).collect()
    edges = {r["col"]: tuple(sorted({r[f"q{i}"] for i in range(parts + 1)})) for r in rows}
    return edges, {r["col"]: r["blocks"] for r in rows}


def _distinct_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of known values per column."""
    distinct = long_values(df, [], columns).where("value IS NOT NULL").distinct()
    return {r["col"]: r["n"] for r in distinct.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_bins(
    df: DataFrame, columns: Sequence[str], parts: int = 10, finer: int = 200, few: int = 5,
    fill: bool = True,
) -> dict[str, Bins]:
    """B1: equal-frequency bins per column.

    Text is cut to a prefix, at most ``few`` values stay as they are, else
    ``parts`` quantile bins (repeated edges dropped), or ``finer`` ones where those
    come down to a single bin. The driver gets the edges, never the values.
    """
    numbers = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    out = {c: Bins("text") for c in columns if c not in numbers}
    if not numbers:
        return out
    found, blocks = _edges(_values(df, numbers, fill), parts)
    # Values in different blocks differ, so only columns with few blocks need a count.
    narrow = [c for c in numbers if blocks.get(c, 0) <= few + 1]
    sizes = _distinct_sizes(df, narrow) if narrow else {}
    wide = [c for c in numbers if c not in narrow or sizes.get(c, 0) > few]
    flat = [c for c in wide if len(found[c]) <= 2]
    if flat:
        found.update(_edges(_values(df, flat, fill), finer)[0])
    out.update({c: Bins("edges", found[c]) if c in wide else Bins("value") for c in numbers})
    return out


def bin_of(column: str, bins: Bins, prefix: int = 7) -> tuple[Column, Column]:
    """(order, label) of the bin of a value; quantile bins are closed on the right."""
    value = F.col(column)
    if bins.kind == "text":
        return F.lit(0.0), F.coalesce(F.substring(value.cast("string"), 1, prefix), F.lit(MISSING))
    if bins.kind == "value":
        order = F.coalesce(value.cast("double"), F.lit(math.inf))
        return order, F.coalesce(value.cast("string"), F.lit("nan"))
    filled = F.coalesce(value.cast("double"), F.lit(float(rules.FILL_VALUE)))
    index = _edges_below(filled, bins.inner)
    labels = F.array(*[
        F.lit(f"{'(' if n else '['}{lo}, {hi}]") for n, (lo, hi) in enumerate(zip(bins.edges[:-1], bins.edges[1:]))
    ] or [F.lit(f"[{bins.edges[0]}]")])
    return index.cast("double"), F.get(labels, index)


# Codes that ``ignore_special`` leaves out of a report.
SPECIAL_NUMBERS = (-99999999.0, math.inf, -math.inf)
SPECIAL_TEXTS = ("-99999999", "Missing", "Special")


def _is_special(column: str, kind: T.DataType) -> Column:
    value = F.col(column)
    codes = SPECIAL_TEXTS if isinstance(kind, T.StringType) else SPECIAL_NUMBERS
    return value.isNull() | value.isin(*codes)


def bin_counts(
    df: DataFrame, columns: Sequence[str], label: str, holdout: str | None = None,
    bins: Mapping[str, Bins] | None = None, ignore_special: bool = False, prefix: int = 7,
    parts: int = 10, finer: int = 200,
) -> DataFrame:
    """B1 counts: (col, bin, bin_order) with good and bad rows of both samples.

    All columns are counted in one scan: a row turns into one (column, bin) pair per
    column and is summed on the map side, so few rows are shuffled.
    """
    keep = [*columns, label, *([holdout] if holdout else [])]
    df = _plain_floats(df.select(*dict.fromkeys(keep)))
    if bins is None:  # edges, sizes and counts each read the rows: what leads to them is run once
        df = materialise(df, "binned")
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        promoted = promote_numeric_text(df.select(*texts))
        numbers = set(texts) - set(columns_of(promoted, T.StringType))
        df = df.select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in df.columns])
    special = {c: _is_special(c, df.schema[c].dataType) for c in columns}
    if bins is None:
        known = df.select(*[F.when(~special[c], F.col(c)).alias(c) for c in columns])
        bins = fit_bins(known if ignore_special else df, columns, parts, finer, fill=not ignore_special)
    pairs = []
    for column in columns:
        order, text = bin_of(column, bins[column], prefix)
        pair = F.struct(F.lit(column).alias("col"), text.alias("bin"), order.alias("bin_order"))
        pairs.append(F.when(~special[column], pair) if ignore_special else pair)
    sample = F.col(holdout).cast("int") if holdout else F.lit(0)
    flags = df.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 1).alias("_bad"), sample.alias("_part"), F.explode(F.array(*pairs)).alias("_p")
    ).where("_p IS NOT NULL AND _part IN (0, 1)")
    return flags.groupBy("_p.col", "_p.bin", "_p.bin_order").agg(
        F.count_if((F.col("_part") == 0) & ~F.col("_bad")).alias("dev_good"),
        F.count_if((F.col("_part") == 0) & F.col("_bad")).alias("dev_bad"),
        F.count_if((F.col("_part") == 1) & ~F.col("_bad")).alias("val_good"),
        F.count_if((F.col("_part") == 1) & F.col("_bad")).alias("val_bad"),
    )


def fine_class_report(
    df: DataFrame, columns: Sequence[str], label: str = "label", holdout: str | None = None, **options
) -> DataFrame:
    """B2: rates, shares, IV per bin and column, and PSI between the two samples.

    Without a holdout flag only the development columns are returned.
    """
    # a row per bin, which the totals read again and again
    counts = materialise(bin_counts(df, columns, label, holdout, **options), "bin-counts")
    sides = [f"{p}_{k}" for p in ("dev", "val") for k in ("good", "bad")]
    counts = counts.selectExpr("col", "bin", "bin_order", *sides, *[
        text for p in ("dev", "val") for text in (
            f"{p}_good + {p}_bad AS {p}_all",
            f"try_divide({p}_bad, {p}_good + {p}_bad) AS {p}_bad_rate",
        )
    ])
    base = [f"{p}_{k}" for p in ("dev", "val") for k in ("all", "good", "bad")]
    report = with_group_totals(counts, "col", base)
    report = report.selectExpr("*", *[f"try_divide({c}, {c}_total) AS {c}_proportion" for c in base])
    report = report.selectExpr(
        "*",
        f"{share_log_text('dev_good_proportion', 'dev_bad_proportion')} AS dev_IV",
        f"{share_log_text('val_good_proportion', 'val_bad_proportion')} AS val_IV",
        f"{share_log_text('val_all_proportion', 'dev_all_proportion')} AS PSI",
    )
    report = with_group_totals(report, "col", ["dev_IV", "val_IV", "PSI"])
    if holdout is None:
        report = report.select("col", "bin", "bin_order", *[c for c in report.columns if "dev" in c])
    return report


def psi_report(
    df: DataFrame, columns: Sequence[str], label: str, holdout: str, parts: int = 20,
    finer: int = 100, prefix: int = 8,
) -> DataFrame:
    """Shares of both samples per bin and PSI, with finer bins and longer prefixes."""
    report = fine_class_report(
        df, columns, label, holdout, parts=parts, finer=finer, prefix=prefix
    )
    return report.select(
        "col", "bin", "bin_order", "dev_all", "val_all", "dev_all_proportion", "val_all_proportion",
        "PSI", "PSI_total",
    )


# Report columns that the saved report leaves out.
REPORT_DROPS = (
    "dev_all_total", "dev_good_total", "dev_bad_total",
    "dev_bad_proportion", "dev_good_proportion", "dev_IV",
)


def tagged_report(report: DataFrame, table: str) -> DataFrame:
    """The report as saved, with the name of its table."""
    return report.drop(*REPORT_DROPS).withColumn("table", F.lit(table))


# -- B4 -------------------------------------------------------------------------


def fine_edges(df: DataFrame, column: str, parts: int = 25, precision: int = 4) -> list[float]:
    """Nearest-rank quantiles, rounded, without repeats, open at both ends."""
    probs = [round(i / parts, 2) for i in range(parts)] + [1.0]
    values = df.select(F.col(column).alias("value"))
    row = exact_quantiles(values, [], probs, method="nearest", few_groups=True).first()
    inner = sorted({round(row[f"q{i}"], precision) for i in range(len(probs))}) if row else []
    return [-math.inf, *inner, math.inf]


def fine_bins(
    df: DataFrame, column: str, label: str, parts: int = 25, event: object = 1, precision: int = 4,
    special_codes: Mapping[str, object] | None = None, splits: Sequence[float] | None = None,
) -> tuple[DataFrame, list[float]]:
    """(bin table, edges). Bins are closed on the left; special codes and missing
    values have rows of their own; empty bins are left out."""
    special_codes = dict(special_codes or {})
    numeric = not isinstance(df.schema[column].dataType, T.StringType)
    rows = _plain_floats(df.select(column, label))
    value = F.col(column)
    coded = value.isin(*special_codes.values()) if special_codes else F.lit(False)
    edges: list[float] = []
    if numeric:
        edges = list(splits) if splits is not None else fine_edges(
            rows.where(value.isNotNull() & ~coded), column, parts, precision
        )
        index = _edges_upto(value.cast("double"), edges) - 1
        names = F.array(*[F.lit(f"[{lo}, {hi})") for lo, hi in zip(edges[:-1], edges[1:])])
        inside = (index >= 0) & (index < len(edges) - 1)
        text = F.when(inside, F.get(names, index))
        order = index.cast("double")
    else:
        text, order = value.cast("string"), F.lit(0.0)
    for i, (name, code) in enumerate(special_codes.items()):
        text = F.when(value == code, F.lit(name)).otherwise(text)
        order = F.when(value == code, F.lit(1e9 + i)).otherwise(order)
    text = F.when(value.isNull(), F.lit(MISSING)).otherwise(text)
    order = F.when(value.isNull(), F.lit(2e9)).otherwise(order)
    counted = rows.select(
        text.alias("bin"), order.alias("bin_order"), (F.col(label) == F.lit(event)).alias("_hit")
    ).where("bin IS NOT NULL")
    table = counted.groupBy("bin", "bin_order").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("_hit").alias("event")
    ).withColumn("non_event", F.col("count") - F.col("event")).withColumn("_all", F.lit(0))
    table = with_group_totals(table, "_all", ["count", "event", "non_event"])
    table = table.selectExpr(
        "bin", "bin_order", "count", "event", "non_event",
        "try_divide(count, count_total) AS count_pct",
        "try_divide(event, count) AS event_rate",
        "try_divide(event, event_total) AS event_pct",
        "try_divide(non_event, non_event_total) AS non_event_pct",
    )
    return table.selectExpr("*", f"{share_log_text('event_pct', 'non_event_pct')} AS iv"), edges


# -- E10 ------------------------------------------------------------------------


def best_cuts(counts: Sequence[Sequence[float]], most: int, least: float) -> list[int]:
    """Where to part neighbouring bins (goods, bads) so that the IV is greatest: the first bin of each part but the first.

    At most ``most`` parts, each with both classes and ``least`` of all rows; no cut if no parts can have that. Of
    equally good ways the one with fewer parts, then with earlier cuts. Dynamic programming over the last part: what precedes
    it is parted best by itself. Steps grow with ``most`` times the square of the bins, whatever the rows.
    """
    goods, bads = [0, *accumulate(c[0] for c in counts)], [0, *accumulate(c[1] for c in counts)]
    floor = least * (goods[-1] + bads[-1])

    def worth(begin, end):
        g, b = goods[end] - goods[begin], bads[end] - bads[begin]
        if g <= 0 or b <= 0 or g + b < floor:
            return None
        g, b = g / goods[-1], b / bads[-1]
        return (g - b) * math.log(g / b)

    worths = {(b, e): worth(b, e) for e in range(1, len(counts) + 1) for b in range(e)}
    ways: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by end: the best with so many parts, and its parts' begins
    best, found = -math.inf, []
    for _ in range(min(most, len(counts))):
        longer = {}
        for end in range(1, len(counts) + 1):
            tried = [(ways[b][0] + worths[b, end], ways[b][1] + [b]) for b in range(end)
                     if b in ways and worths[b, end] is not None]
            if tried:
                top = max(value for value, _ in tried)
                longer[end] = (top, min(begins for value, begins in tried if value >= top - 1e-12))
        ways = longer
        if len(counts) in ways and ways[len(counts)][0] > best + 1e-12:
            best, found = ways[len(counts)]
    return found[1:]


def fit_bin_encoder(
    df: DataFrame, columns: Sequence[str], label: str, parts: int = 20, most: int = 10,
    least: float = 0.05,
) -> dict:
    """Supervised bins per numeric column, as a binning spec for ``apply_spec``.

    Exact quantile bins of the known values are counted against the label in one job;
    neighbours are then joined to the bins of greatest IV (``best_cuts``), on (column, bin) counts only.
    """
    rows = _plain_floats(df.select(*columns, label)).where(F.col(label).isin(0, 1))
    edges, _ = _edges(_values(rows, columns, fill=False), parts)
    inner = {c: sorted(set(edges.get(c, ())[1:-1])) for c in columns}
    pairs = [
        F.when(F.col(c).isNotNull(), F.struct(
            F.lit(c).alias("col"),
            _edges_upto(F.col(c).cast("double"), inner[c]).alias("bin"),
        ))
        for c in columns
    ]
    table = rows.select(label, F.explode(F.array(*pairs)).alias("_p")).where("_p IS NOT NULL").groupBy(
        "_p.col", "_p.bin"
    ).agg(F.count_if(F.col(label) == 0).alias("good"), F.count_if(F.col(label) == 1).alias("bad"))
    found: dict[str, dict[int, list[int]]] = {c: {} for c in columns}
    for r in table.collect():
        found[r["col"]][r["bin"]] = [r["good"], r["bad"]]
    spec = {}
    for c in columns:
        counts = [found[c].get(i, [0, 0]) for i in range(len(inner[c]) + 1)]
        spec[c] = {"type": "binning", "properties": {"boundaries": [inner[c][cut - 1] for cut in best_cuts(counts, most, least)]}}
    return spec
