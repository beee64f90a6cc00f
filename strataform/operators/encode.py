"""Transformation specs and encoders.

A spec is plain metadata, ``{column: {"type": .., "properties": {..}}}``. Fitting
reads the table with aggregates and returns a spec; applying one is a projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.columns import quoted
from strataform.functions.order_stats import exact_quantiles, long_values
from strataform.operators.aggregates import all_target_means, as_category
from strataform.session import scratch_path

# Known transformation types and the properties each one needs.
REQUIRED_PROPERTIES = {
    "character_embedding": {"vocab_size", "embedding_size"},
    "numerical_embedding": {"vocab_size", "embedding_size"},
    "onehot": {"vocab"},
    "binning": {"boundaries"},
    "standardization": {"mean", "stddev"},
    "target_encoding": {"value", "encoded"},
    "raw": set(),
    "categorical": set(),
}
MAX_CATEGORIES = 100_000


def check_spec(conf: Mapping) -> dict:
    """The checked content of ``{"transformations": {..}}``."""
    out = {}
    for column, entry in conf.get("transformations", {}).items():
        if "type" not in entry:
            raise ValueError(f"{column}: no type given")
        if entry["type"] not in REQUIRED_PROPERTIES:
            raise ValueError(f"{column}: unknown type {entry['type']!r}")
        lacking = REQUIRED_PROPERTIES[entry["type"]] - set(entry.get("properties", {}))
        if lacking:
            raise ValueError(f"{column}: missing properties {sorted(lacking)}")
        out[column] = entry
    return out


def one_hot(column: str, vocab: Sequence) -> list[Column]:
    """A 0/1 column ``<col>__<i>`` per vocabulary value."""
    return [
        F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}__{i}") for i, v in enumerate(vocab)
    ]


def bin_index(column: str, boundaries: Sequence[float]) -> Column:
    """Index of the interval with left <= x < right; null stays null.

    The number of inner edges not above x is that index.
    """
    edges = F.array(*[F.lit(float(b)) for b in sorted(boundaries)])
    value = F.col(column).cast("double")
    inside = F.size(F.filter(edges, lambda e: e <= value)) if boundaries else F.lit(0)
    return F.when(value.isNotNull(), inside).cast("int").alias(column)


def standardise(column: str, mean: float, stddev: float) -> Column:
    """E5: (x - mean) / stddev; null for a deviation of zero."""
    return F.try_divide(F.col(column) - F.lit(mean), F.lit(stddev)).alias(column)


def target_encode(df: DataFrame, column: str, means: DataFrame, value: str | None = None) -> DataFrame:
    """Replace a category by its mean in ``means`` (value, encoded); unknown gives 0.

    No broadcast hint: the map grows with the categories, so its size decides.
    """
    value = value or means.columns[0]
    small = means.select(F.col(value).alias("_v"), F.col("encoded").cast("double").alias("_e"))
    joined = df.join(small, F.col(column) == F.col("_v"), "left")
    return joined.select(*[
        F.coalesce(F.col("_e"), F.lit(0.0)).alias(c) if c == column else F.col(c) for c in df.columns
    ])


def apply_spec(df: DataFrame, spec: Mapping) -> DataFrame:
    """Apply every entry whose column is present; ``WEEK_NUM`` leads afterwards."""
    spark = df.sparkSession
    for column, entry in spec.items():
        if entry["type"] == "target_encoding" and column in df.columns:
            prop = entry["properties"]
            pairs = [(str(v), float(e)) for v, e in zip(prop["value"], prop["encoded"])]
            means = spark.createDataFrame(pairs, "value string, encoded double")
            if len(pairs) <= MAX_CATEGORIES:  # few values: a shuffle by them would bring a share of all rows to one task
                means = F.broadcast(means)
            if prop.get("table"):
                means = spark.read.parquet(prop["table"]).where(F.col("col") == column).select("value", "encoded")
            df = target_encode(df.withColumn(column, as_category(df, column)), column, means)
    out: list[Column] = []
    tail: list[Column] = []
    for column in df.columns:
        entry = spec.get(column, {"type": "raw"})
        prop = entry.get("properties", {})
        if entry["type"] == "onehot":
            tail += one_hot(column, prop["vocab"])
        elif entry["type"] == "binning":
            out.append(bin_index(column, prop["boundaries"]))
        elif entry["type"] == "standardization":
            out.append(standardise(column, prop["mean"], prop["stddev"]))
        elif entry["type"] == "categorical":
            out.append(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias(column))
        else:
            out.append(F.col(quoted(column)))
    done = df.select(*out, *tail)
    lead = [c for c in ("WEEK_NUM",) if c in done.columns]
    return done.select(*lead, *[c for c in done.columns if c not in lead])


def fit_standardise(df: DataFrame, columns: Sequence[str]) -> dict:
    """Mean and sample deviation of each column, as a spec."""
    row = df.agg(
        *[F.avg(c).alias(f"_a{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: {"type": "standardization", "properties": {"mean": row[f"_a{i}"], "stddev": row[f"_s{i}"]}}
        for i, c in enumerate(columns)
        if row[f"_s{i}"] is not None
    }


def numeric_shape(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Per numeric column, over rows where it and the label are known: mean, deviation,
    adjusted skewness and the nine decile edges; the plan does not grow with the width."""
    long = long_values(df.where(F.col(label).isNotNull()), [], columns).where("value IS NOT NULL")
    n = F.count("value")
    moments = long.groupBy("col").agg(
        n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
        F.when(n > 2, F.skewness("value") * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))
        .alias("skew"),
    )
    deciles = exact_quantiles(long, ["col"], [i / 10 for i in range(1, 10)], few_groups=True)
    return moments.join(deciles.drop("rows", "blocks"), "col", "left")


def derive_spec(
    df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], label: str,
    detailed: bool = False,
) -> dict:
    """Raw for continuous and categorical for the others.

    ``detailed``: decile binning for a skewed column with nine different edges, else
    standardisation; target means for text with two values or more, else one-hot. The means of all
    categories come from one aggregate; a column of more than ``MAX_CATEGORIES`` values is not listed in the
    spec, which then names the stored table (col, value, encoded) in place of values.
    """
    if not detailed:
        return {
            **{c: {"type": "raw"} for c in continuous},
            **{c: {"type": "categorical"} for c in categorical},
        }
    spec: dict = {}
    if continuous:
        for row in numeric_shape(df, continuous, label).collect():
            edges = [row[f"q{i}"] for i in range(9)]
            if len(set(edges)) >= 9 and row["skew"] is not None and abs(row["skew"]) >= 2.0:
                spec[row["col"]] = {"type": "binning", "properties": {"boundaries": edges}}
            else:
                prop = {"mean": row["mean"], "stddev": row["stddev"]}
                spec[row["col"]] = {"type": "standardization", "properties": prop}
    if not categorical:
        return spec
    path = scratch_path(df.sparkSession, "target-means")
    all_target_means(df.where(F.col(label).isNotNull()), categorical, label).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    sizes = {r["col"]: r["count"] for r in stored.groupBy("col").count().collect()}
    listed = [c for c in categorical if sizes.get(c, 0) <= MAX_CATEGORIES]
    found: dict = {c: {} for c in listed}
    for row in stored.where(F.col("col").isin(listed)).collect():
        found[row["col"]][row["value"]] = float(row["encoded"])
    for column in categorical:
        if column not in found:
            spec[column] = {"type": "target_encoding", "properties": {"value": [], "encoded": [], "table": path}}
            continue
        means = found[column]
        values = [*sorted(means), "NA"]
        if len(values) >= 3:
            encoded = [*[means[v] for v in sorted(means)], 0.0]
            spec[column] = {"type": "target_encoding", "properties": {"value": values, "encoded": encoded}}
        else:
            spec[column] = {"type": "onehot", "properties": {"vocab": values}}
    return spec
