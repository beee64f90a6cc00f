"""Writers (S13-S17)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform import rules
from strataform.operators.aggregates import type_aggregate


def write_sorted(df: DataFrame, path: str, key: str = rules.KEY, files: int = 20) -> None:
    """Globally sorted gzip files.

    A second range column splits a key that would otherwise fill one file; Spark
    samples the ranges, so files come out even.
    """
    spread = df.withColumn("_salt", F.xxhash64(*df.columns))
    spread.repartitionByRange(files, key, "_salt").sortWithinPartitions(key).drop("_salt").write.mode(
        "overwrite"
    ).option("compression", "gzip").parquet(path)


def write_type_aggregate(df: DataFrame, path: str, key: str = rules.KEY) -> None:
    """Type-driven aggregate as gzip parquet."""
    type_aggregate(df, key).write.mode("overwrite").option("compression", "gzip").parquet(path)


def write_folds(train: DataFrame, test: DataFrame, path: str, folds: int, fold: str = "fold") -> None:
    """``train{i}``, ``val{i}`` and ``test`` folders.

    One job writes all folders of the folds: each row goes to ``val`` of its own fold and to ``train`` of the
    others, as partitions of one table that are then given their names (a rename on file systems that have one).
    Folders without rows hold no files but the schema. Rows without a fold belong to no folder.
    """
    spark = train.sparkSession
    staged = f"{path}/_folds-{uuid.uuid4().hex}"
    roles = F.array(*[
        F.when(F.col(fold) == i, F.lit(f"val{i}")).otherwise(F.lit(f"train{i}")) for i in range(folds)])
    known = train.where(F.col(fold).isNotNull())
    known.withColumn("_folder", F.explode(roles)).drop(fold).write.partitionBy("_folder").parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"{role}{i}" for i in range(folds) for role in ("train", "val")]:
        made, target = hadoop.Path(f"{staged}/_folder={name}"), hadoop.Path(f"{path}/{name}")
        files.delete(target, True)
        if not files.exists(made):
            spark.createDataFrame([], train.drop(fold).schema).write.parquet(f"{path}/{name}")
        elif not files.rename(made, target):
            raise OSError(f"cannot name {path}/{name}")
    files.delete(hadoop.Path(staged), True)
    test.write.mode("overwrite").parquet(f"{path}/test")


def write_scores(df: DataFrame, path: str, key: str = rules.KEY, score: str = "score") -> None:
    """Key and score as CSV with a header."""
    df.select(key, score).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    report.write.mode("overwrite").option("header", True).csv(path)
