"""The registered queries of the numbered operators, on whole given tables, against plain Python or their SQL."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    from strataform.llm.queries import QUERIES

    return lambda name: QUERIES[name](spark, SF).collect()


def encoded(texts, name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return {k: tok.encode(t, add_special_tokens=False).ids + end for k, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_gives_the_rows_of_its_sql(run):
    import duckdb

    from strataform.llm.queries import ORACLE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(ORACLE["op1_url_filter"]).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in run("op1_url_filter")]
    assert collections.Counter(got) == collections.Counter(want) and {r[4] for r in got} == {"allow", "block"}


def test_op2_statistics_and_its_own_rules(run, texts):
    rows = run("op2_quality_rules")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = collections.Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert r.kept == (not r.base_failed and r.rule is None)


def test_op4_tells_held_out_toxic_texts(spark):
    """On the largest of the three sets of tables: the smallest has a few toxic texts to learn from, which is too few."""
    from strataform.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    assert sorted(rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    out = [(rows[i].score, int(m)) for i, m in marks.items() if i in rows and rows[i].held_out]
    bad, good = ([s for s, m in out if m == k] for k in (1, 0))
    assert len(bad) > 20 and len(good) > 20
    right = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert right >= 0.9


def test_op7_and_op10_against_the_library(run, texts):
    ids = encoded(texts, "byte_bpe_50k.json", [])
    rows = run("op7_token_counts")
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(
        (k, len(t.encode()), len(ids[k]), len(ids[k]) > 512) for k, t in texts.items())
    start, want = 0, []
    for k in sorted(texts):
        want.append((k, start, len(ids[k]) + 1, crc(ids[k] + [2])))
        start += len(ids[k]) + 1
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run("op10_token_records")) == want


def test_op8_places_every_piece_once(run, texts):
    ids = encoded(texts, "word_bpe_49k.json", [1])
    want = sorted((k, n, b, min(4096, len(x) - b), crc(x[b:b + 4096])) for k, x in ids.items() for n, b in enumerate(range(0, len(x), 4096)))
    rows = run("op8_genetic_packing")
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(w[3] for w in want)
    assert -(-total // 4096) <= len(places) <= -(-total // 4096) * 1.02 + 1


def test_op9_components_of_all_pairs(run, texts):
    prints = {}
    for k, text in texts.items():
        words = WORD.findall(lower(text))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        bits = [2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes) for b in range(64)]
        prints[k] = sum(1 << b for b, on in enumerate(bits) if on)
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    label = {}
    for k in keys:  # ascending, so that a component is found from its least key
        if k in label:
            continue
        label[k], front = k, [k]
        while front:
            near = np.flatnonzero(np.bitwise_count(values ^ np.uint64(prints[front.pop()])) <= 2)
            new = [keys[n] for n in near if keys[n] not in label]
            label.update(dict.fromkeys(new, k))
            front += new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run("op9_simhash_components")}
    assert got == {k: (f"{prints[k]:016x}", label[k]) for k in keys}
