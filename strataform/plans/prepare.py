"""Preparation: nested topics folded into depth 1, types narrowed, tables saved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform import rules
from strataform.operators.aggregates import Measure
from strataform.operators.joins import join_nested
from strataform.operators.projections import first_child, narrow_types
from strataform.operators.skew import HOT_ROWS
from strataform.plans.depth2 import BUREAU_PAIRS, FLATTENED, reduce_nested, stack_contracts
from strataform.session import materialise
from strataform.sources.catalog import Catalog


def flatten(
    depth1: DataFrame, depth2: DataFrame, measures: Sequence[Measure],
    pairs: Mapping[str, tuple[str, str]] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Depth 1 with the aggregate of its nested rows and its first nested row.

    With ``pairs`` the nested rows are stacked (X1) before they are aggregated. All
    parts of a topic go through one plan, so a case that spans files counts once.
    """
    rows = depth2 if pairs is None else stack_contracts(depth2, pairs)
    out = join_nested(depth1, reduce_nested(rows, measures, hot_rows, depth2))
    return join_nested(out, first_child(depth2))


def declare(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Force column types, such as that of a column with no values in one split."""
    return df.select(*[
        F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns
    ])


def prepare_topic(catalog: Catalog, name: str, depth: int, split: str, narrow: bool = True) -> DataFrame:
    """One prepared topic.

    ``narrow`` needs the extremes of every column, so the joined rows are written once
    and both the type pass and the result read them back.
    """
    rules.check_topic(name)
    if depth == 2:
        if name not in FLATTENED:
            raise ValueError(f"no reduction known for nested topic {name}")
        measures, stacked = FLATTENED[name]
        out = flatten(
            catalog.read(name, 1, split), catalog.read(name, 2, split), measures(),
            BUREAU_PAIRS if stacked else None,
        )
    else:
        out = catalog.read(name, depth, split)
    return narrow_types(materialise(out, f"prepare-{name}")) if narrow else out


def prepare_all(
    catalog: Catalog, split: str, topics: Sequence[tuple[str, int]] = rules.TOPICS,
    types: Mapping[str, Mapping[str, str]] | None = None,
) -> list[str]:
    """Prepare and save every topic; a nested one is saved as depth 1 of its name.

    The saved tables cut the plans: later steps start from files, and so survive lost
    executors without redoing the joins.
    """
    nested = {name for name, depth in topics if depth == 2}
    saved = []
    for name, depth in topics:
        if depth == 1 and name in nested:
            continue
        out = prepare_topic(catalog, name, depth, split)
        out = declare(out, (types or {}).get(name, {}))
        saved.append(catalog.save_prepared(out, name, min(depth, 1), split))
    return saved
