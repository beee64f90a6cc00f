"""A corpus in four stages: toxicity, quality rules, near duplicates, packing.

Each stage takes what the one before kept, whole, and is stored and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.common import scratch_path, stored
from strataform.llm.near import similar
from strataform.llm.packing import pack, token_pieces
from strataform.llm.quality import base_failed, decision, features, fit_quality, text_statistics
from strataform.llm.queries import table, tokenizer
from strataform.llm.toxicity import score_toxicity

#: Near copies: a Jaccard similarity of 4 / 5 or more between the sets of five-word shingles.
NEAR = (4, 5)

ORACLE_SQL = None  # models are fitted in two stages; tests/llm/test_pipeline.py compares with brute force


#: Rows of a batch that tasks send to Python: whole texts are long, and several copies of a batch are in memory at once.
BATCH_ROWS = 2500


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, in a session whose batches have ``BATCH_ROWS`` rows from here on (its other settings stay)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return table(spark, sf_dir, name)


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one, so that no name meets one that an operator makes."""
    others = [F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("_row"))


def given_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows of ``carried(docs)``."""
    return rows.select(*[
        F.col(c) if c in ("doc_id", "text") else F.col(f"_row.c{n}").alias(c) for n, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the letter models do not call toxic."""
    scored = score_toxicity(carried(docs), table_of(spark, sf_dir, "labels"))
    return given_back(scored.where("predicted = 0"), docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and no learned rule rejects."""
    judged = stored(features(text_statistics(carried(docs))), "statistics")  # read twice: to learn, then to judge
    rules = fit_quality(judged.select("doc_id", "stats"), table_of(spark, sf_dir, "labels"))
    kept = judged.where(~base_failed()).where(decision(rules).isNull())
    return given_back(kept, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id, and of rows that repeat it one.

    Rows without doc_id are told apart by their texts; they stay unless a group holds a row with one.
    """
    marked = carried(docs).withColumn("_print", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = marked.select(
        F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "_print").alias("row"), "text")
    groups = similar(rows, "row", "text", 5, *NEAR)
    kept = groups.where("row = component_id").select(
        F.col("row.doc_id").alias("_id"), F.col("row._print").alias("_of")).distinct()
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    left = marked.withColumn("_id", key)
    left = left.join(kept, (left["_id"] == kept["_id"]) & (left["_print"] == kept["_of"]), "left_semi")
    return given_back(left.dropDuplicates(["_id", "_print"]), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its sequence and its place there."""
    pieces = token_pieces(
        docs, "doc_id", "text", tokenizer("word_bpe_49k.json"), end_id=1, most=4096, cached=200_000, block_bytes=2_000_000)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "length", room=4096)


STAGES = [
    ("toxicity", drop_toxic), ("quality_rules", drop_poor), ("simhash_near_dedup", drop_copies),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored in the shared folder."""
    docs = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
