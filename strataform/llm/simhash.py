"""SimHash fingerprints and near duplicates by multi-index hashing (operator 9)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import components, stored

#: Bits of a fingerprint that one table is keyed by: (64-bit word, lowest bit, number of bits).
Segment = tuple[int, int, int]
WHOLE: tuple[Segment, ...] = ((0, 0, 64),)
HALVES: tuple[Segment, ...] = ((0, 0, 32), (0, 32, 32))
WIDE: tuple[Segment, ...] = tuple((word, low, 28) for word in range(4) for low in (0, 32))
_SEED = 42


def _mixed(h, n: int):
    """A further 64-bit hash of a hash; ``n`` 0 leaves it as it is."""
    import numpy as np

    if n == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * n & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, words: int) -> list[int]:
    """``words`` unsigned 64-bit words; a bit is set if over half the shingles' hashes have it set."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return [0] * words
    flat = b" ".join(tokens)
    ends, at = [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    last = max(1, len(tokens) - shingle + 1)
    begins = [0, *[e + 1 for e in ends[: last - 1]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(flat[b:e], _SEED) for b, e in zip(begins, ends[-last:])), np.uint64, last)
    out = []
    for n in range(words):
        counts = np.zeros(64, np.int64)
        for at in range(0, last, 1 << 14):
            part = _mixed(hashes[at:at + (1 << 14)], n)
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = 3, words: int = 1) -> DataFrame:
    """``key, w0, w1, ..`` per row of ``df``: 64 fingerprint bits a column, as signed longs.

    Words are what ASCII white space separates, A-Z lower-cased; fewer words than a shingle make
    one shingle; a text without words, or null, has fingerprint 0. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = [f"w{n}" for n in range(words)]

    def run(batches):
        import numpy as np

        for batch in batches:
            prints = np.array(
                [fingerprint(t.as_py(), shingle, words) for t in batch.column("text")], np.uint64).reshape(-1, words)
            signed = np.ascontiguousarray(prints.T).view(np.int64)
            yield pa.record_batch([batch.column("key"), *map(pa.array, signed)], names=["key", *names])

    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("key", key)


def _ball(segment: Segment, table: int) -> str:
    """The keys of a table under which a fingerprint is filed: its segment, and that with any one bit flipped."""
    word, low, bits = segment
    if bits == 64:
        return f"concat(array(w{word}), transform(sequence(0, 63), i -> w{word} ^ shiftleft(1L, i)))"
    part = f"(shiftrightunsigned(w{word}, {low}) & {(1 << bits) - 1}L)"
    near = f"concat(array({part}), transform(sequence(0, {bits - 1}), i -> {part} ^ shiftleft(1L, i)))"
    return f"transform({near}, k -> k | {table << 40}L)"


def _shared_keys(chunk: int):
    """From rows sorted by key: those whose key another row has too, in chunks of ``chunk`` rows."""
    def run(batches):
        import numpy as np

        held_key = held_id = np.empty(0, np.int64)
        done = 0  # rows of the held key that have been passed on

        def flush(keys, ids):
            nonlocal done
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            place = np.arange(len(keys)) - np.repeat(starts, sizes)
            place[: sizes[0]] += done
            many = np.repeat(sizes > 1, sizes)
            many[: sizes[0]] |= done > 0
            done = 0
            return pa.record_batch({
                "key": pa.array(keys[many]), "chunk": pa.array((place[many] // chunk).astype(np.int32)),
                "id": pa.array(ids[many])})

        for batch in batches:
            keys = np.r_[held_key, batch.column("key").to_numpy()]
            ids = np.r_[held_id, batch.column("id").to_numpy()]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys[::-1] != keys[-1], True)) if keys[0] != keys[-1] else len(keys)
            cut = len(keys) - last
            if cut:
                yield flush(keys[:cut], ids[:cut])
            held_key, held_id = keys[cut:], ids[cut:]
            if len(held_key) > 2 * chunk:  # a hot key goes on in whole chunks; one is kept back
                out = (len(held_key) // chunk - 1) * chunk
                before = done
                yield flush(held_key[:out], held_id[:out])
                done, held_key, held_id = before + out, held_key[out:], held_id[out:]
        if len(held_key):
            yield flush(held_key, held_id)

    return run


def _within(most: int):
    """Whether fingerprints have ``most`` differing bits or fewer: one of each pair by two arrays, or one with many."""
    def near(prints, one, other):
        import numpy as np

        return np.bitwise_count(prints[one] ^ prints[other]).sum(axis=-1) <= most

    return near


def _verified(names: Sequence[str], near, sets: str | None = None):
    """From rows sorted by block: links between the rows of a block that ``near(rows, one, other)`` finds.

    ``rows`` are the columns ``names`` as unsigned words, with ``sets`` (a column of packed words) as
    a second part. A block's links are given as stars, one per group of linked rows.
    """
    def stars(ids, prints):
        import numpy as np

        size = len(ids)
        label = np.full(size, -1)
        for begin in range(size):
            if label[begin] >= 0:
                continue
            label[begin], front = begin, [begin]
            while front:
                at = front.pop()
                free = np.flatnonzero(label < 0)
                if not len(free):
                    break
                met = free[near(prints, at, free)]
                label[met] = begin
                front += met.tolist()
        links = []
        for begin in np.unique(label):
            group = ids[label == begin]
            links += [(int(group.min()), int(x)) for x in np.unique(group)[1:]]
        return links

    def run(batches):
        import numpy as np

        held = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(keys, ids, prints, packed=None):
            if sets is not None:
                packed = [np.frombuffer(x, np.uint64) for x in packed]
            rows = lambda b, e: prints[b:e] if sets is None else (prints[b:e], packed[b:e])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(keys)]
            pairs = starts[ends - starts == 2]
            met = near(rows(0, len(ids)), pairs, pairs + 1) & (ids[pairs] != ids[pairs + 1])
            one, two = ids[pairs[met]], ids[pairs[met] + 1]
            out = set(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist()))
            for b, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                out.update(stars(ids[b:e], rows(b, e)))
            a, b = zip(*sorted(out)) if out else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            now = [
                np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "one", "two")], axis=1),
                batch.column("id").to_numpy(),
                np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1),
            ]
            if sets is not None:
                now.append(np.array([*batch.column(sets).to_pylist(), None], object)[:-1])
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            differ = np.flatnonzero((now[0] != now[0][-1]).any(axis=1))
            cut = int(differ[-1]) + 1 if len(differ) else 0
            if cut:
                yield links(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def connected(nodes: DataFrame, groups: DataFrame, names: Sequence[str]) -> DataFrame:
    """``names, component_id`` of ``nodes(id, least, ..)`` by ``groups(node, component)``: the least of each group."""
    least = nodes.join(groups, nodes["id"] == groups["node"], "left").select(
        *names, "least", F.coalesce("component", "id").alias("group"))
    ids = least.groupBy("group").agg(F.min("least").alias("component_id"))
    return stored(least.join(ids, "group").select(*names, "component_id"), "classes")


def near_duplicates(
    prints: DataFrame, key: str, words: int, segments: Sequence[Segment], most: int, chunk: int = 1024,
) -> DataFrame:
    """``prints`` with ``component_id``: the least key reachable over links of ``most`` differing bits or fewer.

    Rows with one fingerprint are one node. Each table is keyed by one segment; a node is filed
    under the ball of radius 1 around its segment, so two nodes whose segments differ in 2 bits or
    fewer meet. By the pigeonhole principle no link is lost if ``most < 3 * len(segments)``; beyond
    that a link is found unless every segment differs in 3 bits or more. Nodes that meet are
    verified on their whole fingerprints, in blocks of two chunks of at most ``chunk`` nodes each,
    however many share a key, and only linked groups are passed on, as stars.

    A null key counts for no ``component_id``; a group of null keys only has null. Rows that repeat
    stay repeated.
    """
    names = [f"w{n}" for n in range(words)]
    prints = stored(prints.select(F.col(key).alias(key), *names), "fingerprints")
    nodes = stored(
        prints.groupBy(*names).agg(F.min(key).alias("least")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    balls = ", ".join(_ball(s, n) for n, s in enumerate(segments))
    filed = nodes.select("id", F.explode(F.expr(f"flatten(array({balls}))")).alias("key"))
    met = stored(
        filed.select("key", "id").repartition("key").sortWithinPartitions("key")
        .mapInArrow(_shared_keys(chunk), "key long, chunk int, id long"), "shared-keys")
    chunks = met.groupBy("key").agg(F.max("chunk").alias("top")).where("top > 0")
    # Chunk c takes part in the blocks (0, c) .. (c, c) .. (c, top): every two chunks of a key meet once.
    blocks = met.join(chunks, "key", "left").select(
        "key", "id", F.explode(F.expr("""transform(sequence(0, coalesce(top, 0)), other ->
            struct(least(chunk, other) AS one, greatest(chunk, other) AS two))""")).alias("block"),
    ).select("key", "block.one", "block.two", "id")
    links = (
        blocks.join(nodes.select("id", *names), "id").repartition("key", "one", "two")
        .sortWithinPartitions("key", "one", "two").select("key", "one", "two", "id", *names)
        .mapInArrow(_verified(names, _within(most)), "a long, b long")
    )
    classes = connected(nodes, components(links), names)
    return prints.join(classes, names).select(key, *names, "component_id")
