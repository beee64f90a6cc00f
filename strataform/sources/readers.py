"""Readers (S4, S6-S11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform import rules
from strataform.operators.setops import concat_relaxed


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema Spark reads the file once more to infer one."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_file(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    raise ValueError(f"format must be 'parquet' or 'csv', not {fmt!r}")


def read_first_files(spark: SparkSession, paths: Sequence[str], most: int) -> DataFrame:
    """The first files of a list, as asked for by the caller."""
    if not paths:
        raise FileNotFoundError("no files given")
    return spark.read.parquet(*sorted(paths)[:most])


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A folder whose files have different columns."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def read_columns(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """Named columns only; the selection reaches the scan."""
    return spark.read.parquet(folder).select(*dict.fromkeys(columns))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Lazy scan of a folder."""
    return spark.read.parquet(folder)


def read_mixed(spark: SparkSession, folder: str, columns: Sequence[str], schema=None) -> DataFrame:
    """All parquet and CSV files of a folder, cut to the same columns."""
    frames = []
    # The files of one format are one scan, whatever their number.
    listed = spark.read.format("binaryFile").load(folder).select(
        F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("ext")
    ).distinct()
    found = {r["ext"] for r in listed.collect()}
    if "parquet" in found:
        frames.append(spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).select(*columns))
    if "csv" in found:
        reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        frames.append(reader.csv(folder).select(*columns))
    if not frames:
        raise FileNotFoundError(f"no parquet or CSV files in {folder}")
    return concat_relaxed(frames)


def describe_columns(
    columns: Sequence[str], dictionary: DataFrame, variable: str = "Variable", text: str = "Description"
) -> DataFrame:
    """(column, description) with the meaning of the suffix.

    The side to fit in memory is the column list of one table, not the dictionary.
    """
    spark = dictionary.sparkSession
    names = spark.createDataFrame(
        [(c, rules.SUFFIX_MEANING.get(rules.suffix(c))) for c in columns], "name string, meaning string"
    )
    entries = dictionary.groupBy(F.col(variable).alias("name")).agg(F.min(text).alias("_text"))
    tail = F.when(F.col("meaning").isNotNull(), F.concat(F.lit(" ("), "meaning", F.lit(")"))).otherwise("")
    return names.join(entries, "name", "left").select(
        F.col("name").alias("column"),
        F.concat("name", F.lit(": "), F.coalesce("_text", "name"), tail).alias("description"),
    )
