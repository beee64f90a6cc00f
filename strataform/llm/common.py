"""Helpers shared by the operators: scratch tables, row addresses, connected components."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.session import shared_dir

_HELD: dict = {}


def held(name, make):
    """What a Python worker keeps from task to task: one thing at a time, so that the caches of the steps of a job that
    use one worker do not add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def lean(batches):
    """A task's batches. After each, what Arrow's pool keeps of earlier work and nothing uses goes back to the system: a
    worker lives through many steps, and that is several times what whole texts take."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


WORD_SPACE = " \t\n\x0b\x0c\r"  # the bytes that separate words: 0x20 and 0x09-0x0D


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that all executors share."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again; survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_address(table: DataFrame, name: str = "_address") -> DataFrame:
    """A column that tells rows of a stored table apart, repeated rows too."""
    return table.withColumn(
        name, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    )


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, label: str = "links", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``; component: the least node.

    Alternates large and small stars, each round stored in the shared folder. Only minima per
    node are aggregated, so a node with many links needs no more room than any other; the joins
    carry one row per link.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    links = stored(edges.where("a <> b").select(
        F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), label)
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(least(both).select("u", F.least("u", "m").alias("m")), label)
        large = (  # each greater neighbour hangs on the least of the neighbourhood
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        down = large.where("u <> v").distinct()  # u > v in every row
        down = stored(down, label)
        floor = stored(least(down), label)
        small = (
            down.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(floor.select("u", F.col("m").alias("v")))
        )
        now = stored(small.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct(), label)
        for read in (links, low, down, floor):
            discard(read)
        links = now
        mark = links.agg(
            F.count("*").alias("n"), F.countDistinct("v").alias("leaves"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        ).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
