"""The similarity join and the pipeline's near copies against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import classes, copies_and_others, shingled


def changed_texts(seed, sizes, changes, copies=6):
    """Texts with copies changed in a few words each, so that similarities lie on both sides of 0.9; chains too."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    made = []
    for size in sizes:
        text = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            made.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, changes(size))):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[rng.choice(vocabulary)], [], [text[at], rng.choice(vocabulary)]])
    return made


def brute(made, shingle, part, whole):
    sets = [shingled(t, shingle) for t in made]
    alike = lambda a, b: bool(sets[a]) and (
        sets[a] == sets[b] or whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]))
    return sets, classes(range(len(made)), alike)


def test_signatures_meet():
    """Sets that are similar enough share a signature; bands leave no gap."""
    from strataform.llm.part_enum import _band, bands, signatures

    rng = np.random.default_rng(1)
    for part, whole in [(9, 10), (4, 5), (1, 2)]:
        ends = [_band(n, part, whole) for n in range(30)]
        assert ends[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:]))
        for _ in range(300):
            size = int(rng.integers(1, 400))
            one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = len(one) * (whole - part) // whole
            gone = int(rng.integers(0, most + 1))
            other = np.union1d(one[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, most + 1))).astype(np.uint64))
            common = len(np.intersect1d(one, other))
            if whole * common < part * len(np.union1d(one, other)):
                continue
            assert set(bands(len(one), part, whole)) & set(bands(len(other), part, whole))
            met = np.intersect1d(signatures(one, part, whole), signatures(other, part, whole))
            assert len(met) or np.array_equal(one, other)
    assert len(signatures(np.empty(0, np.uint64), 9, 10)) == 0


@pytest.mark.parametrize("part, whole, chunk", [(9, 10, 1024), (9, 10, 2), (4, 5, 1024)])
def test_similarity_join_matches_brute_force(spark, part, whole, chunk):
    from strataform.llm.part_enum import similarity_join

    sizes = [1, 2, 3, 4, 5, 8, 10, 11, 12, 13, 14, 20, 40, 41, 60, 100, 100, 250, 400]
    made = changed_texts(part, sizes, lambda n: max(1, n * (whole - part) // (6 * whole)), copies=8)
    made += [None, "", " \n\t", made[-1].upper(), made[0], "one", "ONE two"]
    sets, want = brute(made, 3, part, whole)
    pairs = [len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a in range(len(made)) for b in range(a)]
    line = part / whole
    assert sum(line <= p < 1 for p in pairs) > 20 and sum(line - 0.1 < p < line for p in pairs) > 15
    rows = [(i, t, "n", "c") for i, t in enumerate(made)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, n_shingles string, component_id string").repartition(3)
    got = similarity_join(df, "doc_id", "text", 3, part, whole, chunk).collect()
    assert len(got) == len(made) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in want}


def test_similarity_join_on_odd_tables(spark):
    from strataform.llm.part_enum import similarity_join

    long = " ".join(f"v{i}" for i in range(9000))
    rows = [(None, "a b c d"), (None, None), (5, "A b c d"), (5, "other words here"), (5, "other words here"), (7, None),
            (8, long), (9, long + " end"), (10, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_join(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, 2, 5), (None, 0, None), (5, 2, 5), (5, 1, 5), (5, 1, 5), (7, 0, 7), (8, 8998, 8), (9, 8999, 8),
                          (10, len(shingled(long[: len(long) // 2], 3)), 10)], key=str)
    assert similarity_join(df.where("false"), "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "x y z"), (None, "X y z")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in similarity_join(nulls, "doc_id", "text").collect()} == {
        (None, 0, None), (None, 1, None)}


def test_a_large_family_of_copies_of_one_original(spark):
    """Copies that are near their original only, and texts that share a part without being similar."""
    from strataform.llm.part_enum import similarity_join

    rng = random.Random(2)
    original = [f"w{i}" for i in range(200)]
    made = [" ".join(original)]
    for _ in range(1500):
        text = list(original)
        text[rng.randrange(200)] = f"x{rng.random()}"
        text[rng.randrange(200)] = f"x{rng.random()}"
        made.append(" ".join(text))
    for n in range(40):
        made.append(" ".join(original[:150] + [f"y{n} {i}" for i in range(25)]))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similarity_join(df, "doc_id", "text", chunk=64).collect()}
    _, want = brute(made[:1] + made[1501:], 3, 9, 10)
    assert all(got[i] == 0 for i in range(1501)) and [got[1500 + i] for i in range(1, 41)] == [
        0 if want[i] == 0 else 1500 + want[i] for i in range(1, 41)]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_near_copies_by_tables(spark, chunk):
    """No wrong link, and nearly all right ones."""
    from strataform.llm.near import similar

    made = copies_and_others()
    sets = [shingled(t) for t in made]
    alike = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = classes(range(len(made)), alike)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar(df, "doc_id", "text", chunk=chunk).collect()}
    links = [(a, b) for a in range(len(made)) for b in range(a) if alike(a, b)]
    assert len(links) > 100
    assert all(want[a] == want[got[a]] for a in got)
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert similar(df.where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("crowd", [100_000, 3, 0])
def test_keys_are_filed_alike_however_groups_are_dealt(spark, crowd):
    """Each text under its segments and all their one-bit neighbours, once; nothing else; equal keys in one task."""
    from strataform.llm.near import _filed

    rng = random.Random(8)
    bits = lambda: rng.getrandbits(64) - (1 << 63)
    same = (bits(), bits())
    rows = [(i, *(same if i < 20 else (bits(), bits()))) for i in range(60)]
    segments = [(0, 0, 12), (0, 32, 12), (1, 40, 14)]
    df = spark.createDataFrame(rows, "id long, w0 long, w1 long").repartition(3)
    filed = _filed(df, segments, 2, len(rows), crowd)
    got = filed.withColumn("task", F.spark_partition_id()).collect()
    want = []
    for i, *words in rows:
        for n, (word, low, size) in enumerate(segments):
            own = (words[word] % (1 << 64) >> low) % (1 << size)
            want += [(n << 40 | k, i, words[(word + 1) % 2]) for k in [own, *[own ^ (1 << b) for b in range(size)]]]
    assert sorted((r.key, r.id, r.check) for r in got) == sorted(want)
    tasks = {}
    for r in got:
        assert tasks.setdefault(r.key, r.task) == r.task


@pytest.mark.parametrize("batch, room", [(10_000, 1 << 16), (100, 1 << 16), (100, 50), (100, 3)])
def test_buckets_of_a_dense_family_are_merged(batch, room):
    """Who meets in a bucket meets in a group; a text of a family passes a few times, not under nearly all of its keys."""
    import numpy as np
    import pyarrow as pa

    from strataform.llm.near import _partners

    rng = np.random.default_rng(4)
    size, lower = 14, 10
    family = rng.random((400, size)) < 0.1
    others = rng.random((400, size)) < 0.5
    own = (np.concatenate([family, others]) << np.arange(size)).sum(axis=1)
    checks = np.r_[rng.choice([0, 1, 6], 400), rng.integers(-1 << 63, 1 << 63, 400)]
    ids = rng.permutation(800) + (5 << 33)
    keys = np.concatenate([own, *[own ^ (1 << b) for b in range(size)]]) | 3 << 40
    rows = sorted(zip(keys.tolist(), np.tile(ids, size + 1).tolist(), np.tile(checks, size + 1).tolist()))
    near, table = set(), {}
    for key, one, check in rows:
        for two, other in table.setdefault(key, []):
            if ((check ^ other) % (1 << 64)).bit_count() <= 20:
                near.add((min(one, two), max(one, two)))
        table[key].append((one, check))
    batches = [pa.record_batch(dict(zip(("key", "id", "check"), map(pa.array, zip(*rows[b:b + batch])))))
               for b in range(0, len(rows), batch)]
    got = [(k, i) for b in _partners(20, lower, room, 1024)(iter(batches)) for k, i in zip(*(c.to_pylist() for c in b.columns))]
    groups = {}
    for key, one in got:
        groups.setdefault(key, set()).add(one)
    meet = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(near) > 10_000 and near <= meet
    if room > 50:
        fitting = {(key, one) for key, bucket in table.items() for one, check in bucket if any(
            two != one and ((check ^ other) % (1 << 64)).bit_count() <= 20 for two, other in bucket)}
        assert 2 * len(got) < len(fitting), (len(got), len(fitting))


def test_long_texts_that_share_one_line_stay_apart(spark):
    from strataform.llm.near import similar

    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    line = " ".join(rng.choices(vocabulary, k=60))
    made = [line + " " + " ".join(rng.choices(vocabulary, k=5000)) for _ in range(60)]
    copies = [t + " one end more" for t in made[:10]]
    df = spark.createDataFrame(list(enumerate(made + copies)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar(df, "doc_id", "text").collect()}
    assert got == {i: i if i < 60 else i - 60 for i in range(70)}


def test_a_family_of_five_thousand(spark):
    """Near copies of one text: each is compared with few others, and the group is whole."""
    from strataform.llm.near import similar

    original = [f"w{i}" for i in range(150)]
    made = []
    for n in range(5000):
        text = list(original)
        text[n % 150] = f"x{n}"
        made.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(8)
    assert {r.component_id for r in similar(df, "doc_id", "text").collect()} == {0}


@pytest.mark.parametrize("size", [1e7, 4e6, 1e5, 3e8])
def test_top_k_of_large_components(spark, size):
    """Scores up to the ends of a long; beyond them they are held there."""
    from strataform.llm.topk import top_k

    rng = np.random.default_rng(8)
    data = [[float(v) for v in row] for row in rng.uniform(-size, size, (120, 8))]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>").repartition(3)
    x = [[int(np.floor(256 * v)) for v in row] for row in data]
    low, high = -(1 << 63), (1 << 63) - 1
    want = set()
    for q in range(0, 120, 50):
        scores = sorted((-min(high, max(low, sum(a * b for a, b in zip(x[q], x[i])))), i) for i in range(120) if i != q)
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])}
    assert set(map(tuple, top_k(df, "vec_id", "embedding").collect())) == want


def test_a_family_of_alike_texts_leaves_no_rows(spark, monkeypatch):
    """Texts that share buckets, but none of which is similar enough to another, end before the links are looked for."""
    from strataform.llm import near

    rng = random.Random(12)
    original = [f"w{i}" for i in range(150)]
    made = []
    for n in range(300):
        text = list(original)
        for at in rng.sample(range(150), 5):  # 23 of 146 shingles change, in others 25 more: similarity under 0.8
            text[at] = f"x{n}.{at}"
        made.append(" ".join(text))
    sets = [shingled(t, 5) for t in made]
    alike = {(a, b) for a in range(300) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    seen, groups = [], near.exact_groups

    def counted(rows, nodes, met, *rest):
        seen.append(met.count())
        return groups(rows, nodes, met, *rest)

    monkeypatch.setattr(near, "exact_groups", counted)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near.similar(df, "doc_id", "text").collect()}
    assert seen[0] <= 100 * len({n for pair in alike for n in pair})
    assert all(got[n] == n for n in range(300) if not any(n in pair for pair in alike))


@pytest.mark.parametrize("room", [1024, 20])
def test_rows_without_a_partner_leave_their_bucket(spark, room):
    """Against brute force; a bucket of more than ``room`` rows stays whole."""
    from strataform.llm.common import stored
    from strataform.llm.verify import Near, partnered, sketch

    rng = np.random.default_rng(7)
    base, sets, prints = rng.integers(0, 1 << 63, 120, np.uint64), [], []
    for n in range(60):
        own = base.copy()
        change = rng.integers(0, 40)
        own[:change] = rng.integers(0, 1 << 63, change, np.uint64)
        sets.append(np.unique(own[: 120 - n % 3]))
        prints.append(rng.integers(0, 4, 5, np.uint64).tobytes())
    nodes = spark.createDataFrame(
        [(n, len(s), bytearray(sketch(s)), bytearray(p)) for n, (s, p) in enumerate(zip(sets, prints))],
        "id long, size long, bits binary, prints binary")
    buckets = {k: sorted(rng.choice(60, int(size), replace=False).tolist()) for k, size in enumerate([2] * 20 + [5] * 20 + [30])}
    met = stored(spark.createDataFrame([(k, i) for k, ids in buckets.items() for i in ids], "key long, id long"), "shared-keys")
    near = Near(4, 5, 96)

    def passes(a, b):
        one, two = (np.frombuffer(sketch(sets[n]), np.uint64) for n in (a, b))
        return near.many(len(sets[a]), one, np.frombuffer(prints[a], np.uint64), np.array([len(sets[b])]), two[None],
                         np.frombuffer(prints[b], np.uint64)[None])[0]

    got = {}
    for r in partnered(met, nodes, near, room).collect():
        got.setdefault(r.key, []).append(r)
    for k, ids in buckets.items():
        want = ids if len(ids) > room else [a for a in ids if any(a != b and passes(a, b) for b in ids)]
        assert sorted(r.id for r in got.get(k, [])) == want
        if want:
            assert {r.head for r in got[k]} <= set(want) and len({r.head for r in got[k]}) == 1
            assert {r.many for r in got[k]} == {len(want) > 2}
    assert len(got) < len(buckets)
