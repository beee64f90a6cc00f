"""The stages of the corpus pipeline and the whole of it, on documents whose columns are named like an operator's own."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from .test_operators import WORDS, classes, library, shingled

COLUMNS = ["doc_id", "text", "passage", "whole", "score", "predicted", "stats", "f_mean_word", "_print", "_id", "_row"]
TYPES = "doc_id long, text string, passage string, whole string, score string, predicted string, stats string, f_mean_word string, _print string, _id string, _row string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic and poor documents, near copies on both sides of 0.8; their rows, and the folder of the tables."""
    rng = random.Random(9)
    parts = ["th", "er", "on", "an", "re", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(2, 3)))
    texts, marks = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randint(60, 120))]
        toxic, poor = int(i % 4 == 0), int(i % 5 == 1)
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = "zogvu" + rng.choice(parts) + rng.choice(parts)
        if poor:
            words = [w + "%%%" for w in words]
        texts.append(" ".join(words))
        marks.append((i, toxic, 1 - poor))
    for i in range(2, 500, 7):
        words = texts[i].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    rows = [(i, t, *[f"{c} of {i}" for c in COLUMNS[2:]]) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, TYPES).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}, folder


def toxic_left(spark, rows, folder):
    """Keys that the operator, given keys and texts alone, does not call toxic."""
    from strataform.llm.toxicity import score_toxicity

    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if not r.predicted}


def poor_left(spark, rows, folder):
    from strataform.llm.quality import fit_quality, judge_quality, text_statistics

    statistics = text_statistics(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).select("doc_id", "stats")
    rules = fit_quality(statistics, spark.read.parquet(f"{folder}/labels.parquet"))
    return {r.doc_id for r in judge_quality(statistics, rules).where("kept").collect()}


def copies_left(rows):
    sets = {r[0]: shingled(r[1]) for r in rows}
    return set(classes(sorted(sets), lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])).values())


def packed_right(got, rows):
    tokenizer = library(WORDS)
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in rows}
    held = collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        held[r.sequence_id].append((r.offset, r.length))
    assert collections.Counter(r.doc_id for r in got) == {k: -(-len(v) // 4096) for k, v in ids.items()}
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(places[-1]) <= 4096


def test_stages_and_run_with_clashing_columns(spark, corpus):
    from corpus_pipeline import drop_copies, drop_poor, drop_toxic, pack_sequences, run

    by, folder = corpus
    every = list(by.values())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = every
    for stage, want in [
        (drop_toxic, lambda rows: toxic_left(spark, rows, folder)), (drop_poor, lambda rows: poor_left(spark, rows, folder)),
        (drop_copies, copies_left),
    ]:
        df = docs.where(F.col("doc_id").isin([r[0] for r in left]))
        got = stage(spark, df, folder)
        assert got.columns == COLUMNS
        kept = want(left)
        assert 0 < len(kept) < len(left)
        assert sorted(map(tuple, got.collect())) == [by[k] for k in sorted(kept)], stage.__name__
        left = [by[k] for k in sorted(kept)]
    df = docs.where(F.col("doc_id").isin([r[0] for r in left]))
    packed_right(pack_sequences(spark, df, folder).collect(), left)
    packed_right(run(spark, folder).collect(), left)
