"""The registered queries of the numbered operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts),
urls AS (
  SELECT row_number() OVER () AS row_no, page_id, path,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT row_no, rule_host || rule_path AS rule, verdict, row_number() OVER (
    PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (row_no)
"""


@query("op1_url_filter", URL_SQL)
def op1_url_filter(spark, sf_dir):
    from strataform.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    from strataform.llm.common import stored
    from strataform.llm.quality import fit_quality, judge_quality, text_statistics

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    statistics = stored(text_statistics(docs).select("doc_id", "stats"), "statistics")
    rules = fit_quality(statistics, table(spark, sf_dir, "labels"))
    return judge_quality(statistics, rules).select(
        "doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words",
        "base_failed", "kept", "rule")


@query("op3_rendezvous_shards")
def op3_rendezvous_shards(spark, sf_dir):
    from strataform.llm.sharding import assign_shards

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    sharded = assign_shards(docs, "doc_id", [1.0] * 24, grown=1.0)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    from strataform.llm.toxicity import folds, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (folds("doc_id") == 1).alias("held_out"), "score", "predicted")


@query("op5_exact_top_k")
def op5_exact_top_k(spark, sf_dir):
    from strataform.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=5, every=50)


@query("op6_bpe_encode_decode")
def op6_bpe_encode_decode(spark, sf_dir):
    from strataform.llm.bpe import encode_texts

    coded = encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    from strataform.llm.bpe import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op8_genetic_packing")
def op8_genetic_packing(spark, sf_dir):
    from strataform.llm.packing import pack, token_pieces

    pieces = token_pieces(
        table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("word_bpe_49k.json"), end_id=1, most=4096)
    return pack(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "length", room=4096)


@query("op9_simhash_components")
def op9_simhash_components(spark, sf_dir):
    from strataform.llm.simhash import HALVES, fingerprints, near_duplicates

    prints = fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, words=1)
    linked = near_duplicates(prints, "doc_id", words=1, segments=HALVES, most=2)
    return linked.select(
        "doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_token_records")
def op10_token_records(spark, sf_dir):
    from strataform.llm.records import read_records, write_records

    index = write_records(
        table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_records(index).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_jaccard_join")
def op11_jaccard_join(spark, sf_dir):
    from strataform.llm.part_enum import similarity_join

    return similarity_join(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, part=9, whole=10)


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    from strataform.llm.conversations import damaged, repair_conversations

    turns = table(spark, sf_dir, "conversations")
    rows = damaged(turns, "conv_id", "turn", "role", "text")
    done = repair_conversations(rows, turns.select(F.col("conv_id").alias("conv")))
    return done.withColumnRenamed("conv", "conv_id").withColumnRenamed("sha256", "repaired_sha256")


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    from strataform.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", most=8)
