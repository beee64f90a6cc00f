"""Weighted rendezvous hashing of record keys to shards (operator 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.common import stored, with_address


def _score(key: Column, shard: int, weight: float) -> Column:
    """Greater wins. -w / ln(u), with u in (0, 1) from 52 bits of the hash (all exact, none rounds to 1) of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("int")), 12)
    return F.lit(float(weight)) / -F.log((bits.cast("double") + 0.5) / float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """``struct(score, shard)`` of the shard with the greatest score; the lower shard on equal scores.

    A shard's score depends on the key and that shard alone, so one more shard takes rows only
    into itself, and a raised weight only draws rows to its shard. Shards of weight 0 get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("one shard at least needs a positive weight")
    best = F.array_max(F.array(*[
        F.struct(_score(key, n, w).alias("score"), F.lit(-n).alias("low")) for n, w in enumerate(weights) if w > 0
    ]))
    return F.struct(best["score"].alias("score"), (-best["low"]).cast("int").alias("shard"))


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], grown: float | None = None, buckets: int = 4096,
) -> DataFrame:
    """``df`` with ``shard``, ``slot`` and ``grown_shard`` (the shard with one more of weight ``grown``).

    ``slot`` numbers the rows of a shard without gaps from 0. The rows are stored once; each then
    belongs to one of ``buckets`` parts of its shard, by a hash of its place in the stored table,
    and slots are the part's base plus the position in the part. So no shard, and no key however
    often it repeats, meets in one task. The bases are ``buckets`` rows per shard.

    A null key is a key like any other; rows with equal keys share a shard and get a slot each.
    Columns named ``shard``, ``slot`` or ``grown_shard`` are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    of = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    placed = df.select(*kept, of.alias("_of")).withColumn("_best", rendezvous(F.col("_of"), weights))
    more = F.lit(None).cast("int")
    if grown is not None:
        wins = _score(F.col("_of"), len(weights), grown) > F.col("_best.score")
        more = F.when(wins, F.lit(len(weights))).otherwise(F.col("_best.shard")).cast("int")
    rows = with_address(stored(
        placed.select(*kept, F.col("_best.shard").alias("shard"), more.alias("grown_shard")), "shards"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_address.file", "_address.row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("shard").orderBy("_part")
    bases = counts.select(
        "shard", "_part", (F.sum("_n").over(running) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("shard", "_part").orderBy("_address")
    numbered = rows.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(bases, ["shard", "_part"]).select(
        *kept, "shard", (F.col("_base") + F.col("_at")).alias("slot"), "grown_shard")
