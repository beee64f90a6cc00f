"""The operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPACE = r"[\x20\x09-\x0D]"
DOCS = "doc_id long, text string, lang string, score string, shard string, key string"


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta's", "12", "é", "中文", "x" * 300, "<|endoftext|>", "don't", "!?", "🙂"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    odd = [None, "", " ", "\n\n", "a  b\t c \n", " lead", "trail ", "a\x1cb \x85c", "\n".join(["same line"] * 4),
           "y " * 6000, "z" * 20_000, "<|endoftext|><|endoftext|> <|startoftext|>"]
    return [*made, *odd, made[0], made[0]]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of all kinds; a repeated row, a null key, and columns named like results."""
    rows = [(i, t, "en", "s", "h", "k") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "no key", None, None, None, None)], DOCS).repartition(3)


def empty(docs):
    return docs.where("false")


# 1 -------------------------------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/fr/", "block"), ("a.com", "/", "allow")]


def judged(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host, = re.match(r"([^/?#]*)", rest).groups()
    path, = re.match(r"([^?#]*)", rest[len(host):]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filter(spark):
    from strataform.llm.url_filter import judge_urls

    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x?y#z", "https://www.example.org/en/12", "x://org",
            "http://notexample.org/es/", "http://b.com/fr/1", "http://a.com/fr/1", "http://q.a.com", "http://a.com?x",
            "a://b://com/fr/", "http://a..com/fr/", "http://" + "a." * 200 + "com/fr/" + "p" * 9000, "http://É.org/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*urls, *urls[4:6]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url), r.url
    assert judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.where("false"), default="block").collect()} == {"block"}


# 2 -------------------------------------------------------------------------------------------


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + n for i, w in enumerate(windows) if often[w] > 1 for n in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_text_statistics(spark):
    from strataform.llm.quality import text_statistics

    rng = random.Random(3)
    made = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate([*texts(), *made, "#* a\x0bb\x0cc\r|<>", "a\n\na\n \na"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    for r in text_statistics(df).collect():
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == counted(r.text), r.text


def test_decision_list_learns_a_threshold(spark):
    from strataform.llm.quality import decision, features, fit_quality, judge_quality, text_statistics

    rng = random.Random(1)
    bad = [" ".join(f"{w}%%%" for w in rng.choices(["one", "two", "three", "four"], k=40)) for _ in range(60)]
    vocabulary = [f"word{i}" for i in range(500)]
    good = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate([*bad, *good])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i >= 60)) for i in range(260)] + [(None, 0), (3, None), (9999, 0)], "doc_id long, quality int")
    stats = text_statistics(docs).select("doc_id", "stats")
    rules = fit_quality(stats, labels)
    assert rules and "%" not in str(rules[0])
    kept = {r.doc_id for r in judge_quality(stats.withColumn("kept", F.lit(1)), rules).where("kept").collect()}
    assert kept == set(range(60, 260))
    assert fit_quality(stats, labels.where("quality = 1")) == []
    assert fit_quality(stats.where("false"), labels) == []
    assert features(stats).select(decision([]).alias("r")).where("r is not null").count() == 0


# 3 -------------------------------------------------------------------------------------------


def hashed(key, shard):
    return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.encode(), 42))


def shard_of(key, n):
    key = "\0null" if key is None else str(key)
    return max(range(n), key=lambda s: (hashed(key, s) >> 11, -s))


def test_rendezvous(spark, docs):
    from strataform.llm.sharding import assign_shards

    got = assign_shards(docs.select("doc_id", "text", "shard"), "doc_id", [1.0] * 24, grown=1.0, buckets=8).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.shard == shard_of(r.doc_id, 24) and r.grown_shard in (r.shard, 24)
        assert r.grown_shard == shard_of(r.doc_id, 25)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert assign_shards(empty(docs), "doc_id", [1.0] * 3).count() == 0


def test_weights_share_the_keys(spark):
    from strataform.llm.sharding import assign_shards

    keys = spark.range(20_000).withColumnRenamed("id", "k")
    share = collections.Counter(r.shard for r in assign_shards(keys, "k", [1.0, 0.0, 3.0]).collect())
    assert share[1] == 0 and abs(share[2] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        assign_shards(keys, "k", [0.0])


# 4 -------------------------------------------------------------------------------------------


def test_toxicity_finds_rare_forms(spark):
    from strataform.llm.toxicity import folds, score_toxicity

    rng = random.Random(7)
    parts = ["th", "er", "on", "an", "re", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    rows, marks = [], {}
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 120))]
        marks[i] = int(i % 4 == 0)
        if marks[i]:
            for _ in range(2):
                words[rng.randrange(len(words))] = "zogvu" + rng.choice(parts) + rng.choice(parts)
        rows.append((i, " ".join(words), 1.0))
    rows += [(10_000, None, 1.0), (10_001, "", 1.0), (10_002, "zogvuxyz", 1.0), (0, rows[0][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(list(marks.items()) + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).withColumn("held", folds("doc_id") == 1).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id in marks]
    right = sum(r.predicted == marks[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[10_000].score == by[10_001].score and by[10_001].predicted == 0 and by[10_002].predicted == 1
    assert len({r.score for r in score_toxicity(docs, labels.where("toxic = 0")).collect()}) == 1
    assert score_toxicity(docs.where("false"), labels).count() == 0


def test_model_matches_its_formula(spark):
    """Ratios of a small model against Kneser-Ney computed plainly."""
    from strataform.llm import toxicity as T

    rng = random.Random(2)
    rows = [(rng.randint(0, 1), " ".join("".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(60))) for _ in range(20)]
    model = T.fit_model(spark.createDataFrame(rows, "toxic int, text string"))
    seen = {(w, b, t) for t, text in rows for b, w in zip([None, *text.split()], text.split())}
    grams = [collections.Counter(), collections.Counter()]
    for w, _, t in seen:
        padded = T.BEGIN * 4 + w + T.END
        grams[t].update(padded[i:i + 5] for i in range(len(padded) - 4))
    levels = [collections.Counter(g[1:] for g in set(grams[0]) | set(grams[1]))]
    for _ in range(3):
        levels.append(collections.Counter(x[1:] for x in levels[-1]))

    def shared(tail):
        level = levels[4 - len(tail)]
        same = {x: n for x, n in level.items() if x[:-1] == tail[:-1]}
        total = sum(same.values())
        if len(tail) == 1:
            return level[tail] / total
        d = T.SHARED_DISCOUNT
        return max(level[tail] - d, 0) / total + d * len(same) / total * shared(tail[1:])

    def chance(t, gram):
        same = {g: n for g, n in grams[t].items() if g[:4] == gram[:4]}
        total = sum(same.values())
        if not total:
            return shared(gram[1:])
        left = sum(min(n, T.DISCOUNT) for n in same.values())
        return max(same.get(gram, 0) - T.DISCOUNT, 0) / total + left / total * shared(gram[1:])

    for w in ("a", "ab", "bbaa", "abab", "b"):
        padded = T.BEGIN * 4 + w + T.END
        known = [padded[i:i + 5] for i in range(len(padded) - 4)]
        want = sum(np.log(chance(1, g) / chance(0, g)) for g in known)
        assert abs(model.ratios([w])[0] - want) < 1e-4, w


# 5 -------------------------------------------------------------------------------------------


def nearest(rows, k, every):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in fine if i is not None and i % every == 0}
    out = set()
    for i, q in asked:
        found = sorted((-int(np.dot(q, v)), (1, 0) if j is None else (0, j)) for j, v in fine if j != i and len(v) == len(q))[:k]
        out |= {(i, n + 1, None if j[0] else j[1], -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_top_k(spark, bins):
    from strataform.llm.topk import top_k

    rng = np.random.default_rng(bins)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(70)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # ties
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 4), (210, [float("inf")] * 4), (None, [0.5] * 4),
             (220, [1.0, 2.0]), (221, [1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    got = [tuple(r) for r in top_k(df, "vec_id", "embedding", k=5, every=10, bins=bins, query_rows=4, block_rows=16).collect()]
    assert len(got) == len(set(got)) and set(got) == nearest(plain, 5, 10)
    assert top_k(df.where("false"), "vec_id", "embedding").count() == 0


def test_top_k_shuffles_large_query_sets(spark, monkeypatch):
    from strataform.llm import topk

    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, "vec_id", "embedding", k=3, every=5, query_rows=4, block_rows=20).collect()}
    assert got == nearest(rows, 3, 5)


# 6, 7 ----------------------------------------------------------------------------------------


def test_encoding_and_counts_match_the_library(spark, docs):
    from strataform.llm.bpe import count_tokens, encode_texts

    tok = library(BYTES)
    coded = encode_texts(docs, "doc_id", "text", BYTES).collect()
    assert len(coded) == docs.count()
    by = {i: t for i, t in enumerate(texts())} | {None: "no key"}
    for r in coded:
        ids = tok.encode(by[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
    for r in count_tokens(docs, "doc_id", "text", BYTES).collect():
        text = by[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids))
    assert encode_texts(empty(docs), "doc_id", "text", BYTES).count() == 0


def test_random_strings():
    from strataform.llm.bpe import _counter, _encoder

    tok, (pairs, encoder), counter = library(BYTES), _encoder(BYTES), _counter(BYTES)
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "a", "b", "The", "'s", "'ll", "9", "!", "é", "中",
                "🙂", "́", "<|endoftext|>", "<|endof", "\0", "​", "Ⅷ", "²", "\r\n", " \n"]
    for _ in range(3000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        ids = tok.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(s), "<u4").tolist() == ids, repr(s)
        assert counter.encode(s) == len(ids) and pairs.decode(ids) == tok.decode(ids, skip_special_tokens=False)


# 8 -------------------------------------------------------------------------------------------


def test_pieces_and_packing(spark, docs):
    from strataform.llm.packing import pack, token_pieces

    tok = library(WORDS)
    by = {i: t for i, t in enumerate(texts())} | {None: "no key"}
    pieces = token_pieces(docs, "doc_id", "text", WORDS, end_id=1, most=64)
    packed = pack(pieces.withColumn("offset", F.lit("mine")), "length", room=64, cell_rows=40).collect()
    assert len(packed) == pieces.count()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tok.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 1]
        want.update((r.doc_id, n, at, tuple(ids[at:at + 64])) for n, at in enumerate(range(0, len(ids), 64)))
    assert want == collections.Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in packed)
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(pieces.where("false"), "length", room=64).count() == 0
    with pytest.raises(ValueError):
        pack(pieces, "length", room=10)


def test_breeding_beats_first_tries():
    from strataform.llm.packing import _pack_in_order, evolve

    rng = random.Random(4)
    sizes = [rng.randint(15, 60) for _ in range(300)]
    order = sorted(range(300), key=lambda i: -sizes[i])
    bins = evolve(sizes, 100, [], people=6, generations=30, seed=1)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(_pack_in_order(order, sizes, 100))
    assert bins == evolve(sizes, 100, [], people=6, generations=30, seed=1)


def test_cells_that_miss_the_bound_are_bred_longer(spark):
    """Triples that fill a sequence each: two generations of four packings ended at 64 sequences, one more."""
    from strataform.llm.packing import pack

    rng, sizes = random.Random(5), []
    for _ in range(60):
        a, b = rng.randint(1100, 1700), rng.randint(1100, 1500)
        sizes += [a, b, 4096 - a - b]
    got = pack(spark.createDataFrame(list(enumerate(sizes)), "n long, length long"), "length", room=4096).collect()
    assert sorted(r.length for r in got) == sorted(sizes)
    assert len({r.sequence_id for r in got}) <= 63


# 9 -------------------------------------------------------------------------------------------


def print_of(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_fingerprints(spark, docs):
    from strataform.llm.simhash import fingerprints

    by = {i: t for i, t in enumerate(texts())} | {None: "no key"}
    for r in fingerprints(docs, "doc_id", "text").collect():
        assert r.w0 & (1 << 64) - 1 == print_of(by[r.doc_id])


@pytest.mark.parametrize("tables", ["WHOLE", "HALVES"])
@pytest.mark.parametrize("chunk", [3, 1024])
def test_components_of_fingerprints(spark, chunk, tables):
    from strataform.llm import simhash
    from strataform.llm.simhash import near_duplicates

    segments = getattr(simhash, tables)

    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(40)] + [0, 0]
    for _ in range(160):
        x = rng.choice(prints)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "doc_id long, w0 long").repartition(3)
    want = classes(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, "doc_id", 1, segments, 2, chunk=chunk).collect()}
    assert got == want
    assert near_duplicates(df.where("false"), "doc_id", 1, segments, 2).count() == 0


def test_wide_fingerprints_lose_no_guaranteed_link(spark):
    """Eight segments: every link of 23 bits or fewer is found, in hot groups too."""
    from strataform.llm.simhash import WIDE, near_duplicates

    rng = random.Random(13)
    prints = [[rng.getrandbits(64) for _ in range(4)] for _ in range(20)]
    for _ in range(150):
        x = list(rng.choice(prints[:6]))
        for _ in range(rng.randint(0, 14)):
            x[rng.randrange(4)] ^= 1 << rng.randrange(64)
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, *map(signed, x)) for i, x in enumerate(prints)], "doc_id long, w0 long, w1 long, w2 long, w3 long")
    distance = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b]))
    want = classes(range(len(prints)), lambda a, b: distance(a, b) <= 23)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, "doc_id", 4, WIDE, 23, chunk=16).collect()}
    assert got == want


def test_components_of_chains(spark):
    from strataform.llm.common import components

    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (101, 103), (7, 7), (50, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 50]} | {i: 100 for i in (100, 101, 102, 103)}


# 10 ------------------------------------------------------------------------------------------


def test_records_round_trip(spark, docs):
    from strataform.llm.records import read_records, read_shuffled, write_records

    tok = library(BYTES)
    by = {i: t for i, t in enumerate(texts())} | {None: "no key"}
    index = write_records(docs, "doc_id", "text", BYTES, end_id=2)
    rows = read_records(index).collect()
    assert collections.Counter(r.key for r in rows) == collections.Counter(r.doc_id for r in docs.collect())
    at, last = 0, -1
    for r in sorted(rows, key=lambda r: r.start):
        ids = [*tok.encode(by[r.key] or "", add_special_tokens=False).ids, 2]
        assert r.start == at and np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        at, now = at + len(ids), -1 if r.key is None else r.key
        assert now >= last
        last = now
    again = read_shuffled(index, seed=3).collect()
    assert collections.Counter((r.key, bytes(r.ids)) for r in again) == collections.Counter((r.key, bytes(r.ids)) for r in rows)
    assert read_records(write_records(empty(docs), "doc_id", "text", BYTES, end_id=2)).count() == 0


def test_blocks_of_texts_through_a_small_cache():
    """Ids are those of single texts, through both generations of a small cache."""
    import pyarrow as pa

    from strataform.llm.packing import _library_encoder

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdé,.\n\u3000", k=rng.randint(0, 4)))
    texts = [None, "", " ", *(" ".join(word() for _ in range(40)) for _ in range(200))]
    small, large = _library_encoder(BYTES, 2, 30), _library_encoder(BYTES, 2, 100_000)
    for begin in range(0, len(texts), 20):
        block = texts[begin:begin + 20] + texts[:5]
        assert list(small.encode_block(pa.array(block, pa.string()), 2)) == [large.encode(t or "") for t in block]


def test_hot_key_spans_files(spark):
    from strataform.llm.records import read_records, write_records

    df = spark.createDataFrame([(5 if i % 3 else i, f"t{i}") for i in range(300)], "doc_id long, text string").repartition(6)
    index = write_records(df, "doc_id", "text", BYTES, end_id=2)
    assert index.where("key = 5").select("file").distinct().count() > 2
    keys = [r.key for r in sorted(read_records(index).collect(), key=lambda r: r.start)]
    assert keys == sorted(keys) and len(keys) == 300


def test_damage_is_found(tmp_path):
    import io

    from strataform.llm.records import frame, payload, unframe

    data = frame(payload(7, b"\1\0\2\0", 2)) + frame(payload(None, b"", 2))
    assert [at for at, _ in unframe(io.BytesIO(data))] == [0, len(frame(payload(7, b"\1\0\2\0", 2)))]
    for n in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[n] ^= 1
        with pytest.raises(ValueError):
            list(unframe(io.BytesIO(bytes(broken))))
    with pytest.raises(ValueError):
        list(unframe(io.BytesIO(data[:-2])))


def test_digest_columns(spark):
    from strataform.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts_ = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = library(BYTES)
    for r in QUERIES["op6_bpe_encode_decode"](spark, sf).collect():
        ids = tok.encode(texts_[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    crcs = {r.doc_id: r.text_crc32 for r in QUERIES["op3_rendezvous_shards"](spark, sf).collect()}
    assert crcs == {i: zlib.crc32(t.encode()) for i, t in texts_.items()}


@pytest.mark.parametrize("path, width", [(BYTES, 2), (WORDS, 4)])
def test_blocks_of_texts_match_the_library(path, width):
    import pyarrow as pa
    from strataform.llm.chunks import TextEncoder
    from strataform.llm.packing import encoded, library_encoder

    plain, known = library(path), library_encoder(path, width)
    small = TextEncoder(known._chunk, b"".join, known._specials, known._special, most=7, encode_many=known._many)
    odd = ["x <|endoftext|> y", "a\n b", "z" * 500 + " y", "　 a\tb İ", "don't 12 3. a<|endoftext|>b c"]
    column = pa.array([None, *texts(), *odd, "", " "]).slice(1)
    want = [
        b"".join(i.to_bytes(width, "little") for i in plain.encode(t or "", add_special_tokens=False).ids)
        for t in column.to_pylist()]
    for encoder in (known, small):
        for block in (1, 60, 1 << 20):
            assert list(encoded(encoder, column, width, block)) == want
    assert list(encoded(known, column.slice(0, 0), width)) == []


# near copies and pipeline ------------------------------------------------------------------------


def shingled(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def copies_and_others(seed=3, line="one line that many of the texts have in common as their head"):
    """Texts with copies changed in so many words that similarities lie on both sides of 0.8, chains too."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    made = []
    for n in range(30):
        text = rng.choices(vocabulary, k=rng.choice([3, 5, 30, 80, 300]))
        for _ in range(6):
            made.append((line + " " if n % 3 else "") + " ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return [*made, None, "", "  \n", made[0].upper(), made[0]]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_similar_texts_match_brute_force(spark, chunk):
    from strataform.llm.near import similar

    made = copies_and_others()
    sets = [shingled(t) for t in made]
    alike = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    pairs = [len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a in range(len(made)) for b in range(a)]
    assert sum(0.8 <= p < 0.9 for p in pairs) > 20 and sum(0.6 < p < 0.8 for p in pairs) > 20
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar(df, "doc_id", "text", chunk=chunk).collect()}
    assert got == classes(range(len(made)), alike)
    assert similar(df.where("false"), "doc_id", "text").count() == 0


def test_pipeline_drops_exact_near_copies(spark):
    """One of each group of near copies stays: the least doc_id, whatever fingerprints say."""
    from corpus_pipeline import drop_copies

    made = copies_and_others(seed=4)
    sets = [shingled(t) for t in made]
    want = classes(range(len(made)), lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    rows = [(i, t, "en") for i, t in enumerate(made)]
    df = spark.createDataFrame([*rows, rows[0], (None, made[0], "en")], "doc_id long, text string, lang string").repartition(3)
    got = drop_copies(spark, df, "").collect()
    assert sorted(map(tuple, got)) == [rows[i] for i in sorted(set(want.values()))]


def test_workers_give_back_what_steps_leave(monkeypatch):
    """Between batches Arrow's unused memory goes back, and the letter strings begin without other steps' caches."""
    from types import SimpleNamespace

    import pyarrow as pa

    from strataform.llm import common
    from strataform.llm.toxicity import _followed

    given = []
    pool = SimpleNamespace(release_unused=lambda: given.append(1))
    monkeypatch.setattr(common, "pa", SimpleNamespace(default_memory_pool=lambda: pool))
    monkeypatch.setattr(common, "_HELD", {("library", "path", 4, 10): "a tokenizer and its pieces"})
    batch = pa.record_batch({"toxic": pa.array([1, 0], pa.int32()), "text": pa.array(["One two, one", None])})
    rows = [r for out in _followed(iter([batch, batch])) for r in out.to_pylist()]
    assert collections.Counter(r["word"] for r in rows) == {"one": 4, "two": 2} and {r["toxic"] for r in rows} == {1}
    assert len(given) == 2 and ("library", "path", 4, 10) not in common._HELD


def test_pieces_do_not_depend_on_blocks(spark, docs):
    from strataform.llm.packing import token_pieces

    whole, small = (
        sorted(map(str, token_pieces(docs, "doc_id", "text", WORDS, end_id=1, most=64, block_bytes=n).collect()))
        for n in (8_000_000, 100))
    assert whole == small
