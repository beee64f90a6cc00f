"""Conversation repair against exhaustive search, whitening against dense linear algebra."""

import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest

SPACE = " \t\n\x0b\x0c\r"


def exhaustive(codes):
    """Least (cost, audit) over all ways of editing, by a search over suffixes (letters decide from the front)."""
    from functools import lru_cache

    sys.setrecursionlimit(20_000)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, place, inserts):
        found = []
        if i == len(codes) and place in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            for role in "ua":
                if role in step[place]:
                    cost, rest = best(i, step[place][role], inserts + 1)
                    found.append((cost + 2, "I" + rest))
        if i < len(codes):
            kind, initial = divmod(codes[i], 4)
            cost, rest = best(i + 1, place, 0)
            found.append((cost + 3, "D" + rest))
            if kind in (0, 3):
                for letter, role, price in [("K", "sua?"[initial], 0), ("R", "u", 2), ("R", "a", 2)]:
                    if role in step[place]:
                        cost, rest = best(i + 1, step[place][role], 0)
                        found.append((cost + price + (kind == 3), letter + rest))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def test_cheapest_edits_match_exhaustive_search():
    from strataform.llm.conversations import cheapest_edits

    for n in range(4):
        for codes in itertools.product([0, 1, 2, 3, 4, 13, 14], repeat=n):
            assert cheapest_edits(bytes(codes)) == exhaustive(codes), codes
    rng = random.Random(4)
    for _ in range(400):
        codes = tuple(rng.choice([0, 0, 1, 1, 2, 2, 3, 5, 12, 13, 14]) for _ in range(rng.randint(5, 40)))
        assert cheapest_edits(bytes(codes)) == exhaustive(codes), codes


def test_prefixes_compare_as_strings_also_when_hashes_collide():
    from strataform.llm.conversations import Prefixes

    class Colliding(Prefixes):
        _BASE, _PRIME = 1, 3

    rng = random.Random(1)
    for kind in (Prefixes, Colliding):
        tree, texts = kind(), [""]
        for _ in range(400):
            parent = rng.randrange(max(0, len(texts) - 40), len(texts))
            letter = rng.choice("DIKR")
            tree.add(parent, ord(letter))
            texts.append(texts[parent] + letter)
        assert all(tree.text(n) == t for n, t in enumerate(texts))
        for _ in range(2000):
            a, b = rng.randrange(401), rng.randrange(401)
            x, y = rng.choice(["", *"DIKR"]), rng.choice(["", *"DIKR"])
            if texts[a] != texts[b]:
                assert tree.before(a, ord(x or "\0"), b, ord(y or "\0")) == (texts[a] + x < texts[b] + y)


def plain(rows):
    """The contract, row by row."""
    made = {}
    for conv, turn, role, text in rows:
        held = made.setdefault(conv, [])
        blank = lambda v: " " if v is None else str(v)
        role, text = blank(role), blank(text)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, held in made.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen, count = [], set(), [0] * 5
        for _, role, text in held:
            words = text.strip(SPACE)
            fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            count[fault] += 1
            codes.append(4 * fault + {"s": 0, "u": 1, "a": 2}.get(role[:1], 3))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = exhaustive(tuple(codes)) if held else (0, "")
        lines, left, after = [], iter(held), {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for letter in audit:
            due = after[lines[-1][0][:1] if lines else ""]
            if letter == "I":
                lines.append((due, ""))
                continue
            _, role, text = next(left)
            if letter != "D":
                lines.append((role if letter == "K" else due, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *count[1:4], illegal, cost, audit, digest)
    return out


def conversations():
    rng = random.Random(7)
    words = ["Yes.", "no", "What?", "go on!", "", "  \n", "a.b", "same.", "é!\t", "x " * 4000 + "."]
    rows = []
    for conv in [*range(150), None, -3]:
        turn = rng.randint(-2, 3)
        for n in range(rng.randint(1, 9)):
            role = rng.choice([*["user", "assistant"][n % 2:] * 2, "system", "user", "assistant", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None]) if n else turn, role, rng.choice([*words, None])))
            turn += rng.choice([1, 1, 1, 0, 4])
    rows += [(900, n, ["user", "assistant"][n % 2], f"long {n}.") for n in range(400)]
    rows += [(901, n, "system", f"only {n}.") for n in range(300)]
    return rows + rows[:5]


def test_conversation_repair_matches_the_contract(spark, tmp_path):
    from strataform.llm.queries import QUERIES

    rows = conversations()
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], "conv_id long, turn long, role string, text string, conv string, cost int, audit string")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    run = QUERIES["op12_conversation_repair"]
    got = run(spark, str(tmp_path))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = got.collect()
    want = plain(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r[n] for n in names) == want[r.conv_id], r.conv_id
    df.where("false").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert run(spark, f"{tmp_path}/none").count() == 0


def test_repaired_texts(spark):
    from strataform.llm.conversations import audits, repaired

    df = spark.createDataFrame([(1, 0, "tool", "A."), (1, 1, "user", "B."), (1, 2, "user", "B."), (2, 0, "assistant", "C")],
                               "conv long, turn long, role string, text string")
    got = repaired(df, audits(df)).orderBy("conv", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "A."), (1, 1, "assistant", "B.")]  # "RRD"; the other is deleted
    assert {r.conv: (r.cost, r.audit) for r in audits(df).collect()} == {
        1: exhaustive((3, 1, 9)), 2: exhaustive((14,))}


# 13 --------------------------------------------------------------------------------------------


def test_inertia_and_feast_on_dense_matrices():
    from strataform.llm.whitening import feast, positives

    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 20, 64):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for values in (rng.random(d), np.r_[np.ones(min(d, 3)), np.zeros(d - min(d, 3))], np.full(d, 7.0), 2.0 ** -np.arange(d),
                       1 + 1e-6 * rng.random(d), np.r_[1e9, rng.random(d - 1)]):
            m = (q * values) @ q.T
            m = (m + m.T) / 2
            e = np.sort(np.linalg.eigvalsh(m))[::-1]
            for x in (0.51, (e[0] + e[-1]) / 2 + 1e-9):
                assert positives(m - x * np.eye(d)) == (np.linalg.eigvalsh(m - x * np.eye(d)) > 0).sum()
            got, vectors = feast(m, 8)
            want = e[:8][e[:8] > 1e-12 * e.sum()]
            assert np.allclose(got, want, rtol=1e-9, atol=1e-13 * e.sum())
            assert np.allclose(m @ vectors, vectors * got, atol=1e-11 * e.sum())
            assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-9)
    assert len(feast(np.zeros((3, 3)), 8)[0]) == 0


@pytest.mark.parametrize("rows, d", [(400, 12), (60, 3)])
def test_whitening_matches_dense_algebra(spark, rows, d):
    from strataform.llm.whitening import whiten

    rng = np.random.default_rng(d)
    data = rng.standard_normal((rows, d)) @ rng.standard_normal((d, d))
    made = [(i, [float(v) for v in row], "n", 1) for i, row in enumerate(data)]
    odd = [(None, None, "n", 1), (1, [None] * d, "n", 1), (2, [float("nan")] * d, "n", 1), (3, [float("inf")] + [0.0] * (d - 1), "n", 1),
           (4, [], "n", 1), (5, [1.0] * (d + 1), "n", 1), made[0], (None, made[1][1], "n", 1)]
    df = spark.createDataFrame([*made, *odd], "vec_id long, embedding array<double>, n string, component int").repartition(4)
    got = whiten(df, "vec_id", "embedding").collect()
    use = [made[i][1] for i in range(rows)] + [made[0][1], made[1][1]]
    x = np.floor(np.array(use) * 1024).astype(int) + 100000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    assert len(got) == n * len(e) and {r.n for r in got} == {n}
    w = z @ u / np.sqrt(e)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = [None] * len(e)
    for i in range(2, rows):
        for r in by[i]:
            c = r.component - 1
            sign = np.sign(r.whitened / w[i, c])
            signs[c] = signs[c] or sign
            assert sign == signs[c] and abs(r.whitened * sign - w[i, c]) < 1e-8
            assert r.deviation == deviation[i] and abs(r.explained / (e[c] / np.trace(v)) - 1) < 1e-9
            assert 0 <= r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    from strataform.llm.whitening import whiten

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<double>")
    assert whiten(df, "vec_id", "embedding").count() == 0
    assert whiten(df.where("false"), "vec_id", "embedding").count() == 0
    large = spark.createDataFrame([(i, [1e12 * i, -1e12 * i * i, 3.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whiten(large, "vec_id", "embedding").collect()
    assert got and all(np.isfinite(r.whitened) for r in got)
