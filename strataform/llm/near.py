"""Near duplicates of the pipeline: SimHash tables name the candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import discard, stored
from strataform.llm.simhash import Segment, _mixed, connected, fingerprint
from strataform.llm.verify import Near, described, exact_groups, partnered, set_nodes

#: Ten tables of 25 bits: at a similarity of 0.8 some 15 % of the bits differ, and a segment meets in a quarter of all cases.
TABLES: tuple[Segment, ...] = tuple((word, low, 25) for word in range(5) for low in (0, 32))


def _merged(keys, ids, lower: int, most: int):
    """Rows of buckets (sorted by key) with new keys: buckets of a part that mostly hold the same rows become one.

    Dense families fill many buckets with ever the same texts. Of a part's buckets, the greatest first, each is added
    to the group that holds most of its rows, at least half, if that has ``most`` rows or fewer then; so rows that meet in
    a bucket meet in a group. Groups depend on no ids. A new key is a hash of its rows, so that groups of the same rows
    are one, whatever their part (two texts of one segment meet in 26 buckets).
    """
    import numpy as np

    if not len(keys):
        return keys, ids

    def named(starts, ids):
        own = ids.view(np.uint64)
        return _mixed(np.bitwise_xor.reduceat(_mixed(own, 1), starts), 2) + np.add.reduceat(_mixed(own, 3), starts)

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    part = keys[starts] >> lower
    _, first = np.unique(_mixed(named(starts, ids) ^ part.view(np.uint64), 4), return_index=True)
    order = first[np.lexsort((first, -sizes[first], part[first]))]
    groups, found, now = [], {}, None  # of the part: the groups that each row is in
    for bucket, size, own in zip(starts[order].tolist(), sizes[order].tolist(), part[order].tolist()):
        if own != now:
            found, now = {}, own
        rows = ids[bucket:bucket + size].tolist()
        common = Counter(g for row in rows for g in found.get(row, ()))
        for at, n in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:4]:
            if n == size or 2 * n >= size and len(groups[at]) + size - n <= most:
                break
        else:
            at = len(groups)
            groups.append({})
        group = groups[at]  # a dict keeps the order of its rows
        for row in rows:
            if row not in group:
                group[row] = None
                found.setdefault(row, []).append(at)
    sizes = np.array([len(g) for g in groups])
    ids = np.fromiter(chain.from_iterable(groups), np.int64, sizes.sum())
    starts = sizes.cumsum() - sizes
    names = named(starts, ids)
    _, first = np.unique(names, return_index=True)
    kept = np.zeros(len(starts), bool)
    kept[first] = True
    rows = np.repeat(kept, sizes)
    return np.repeat(names.view(np.int64), sizes)[rows], ids[rows]


def _partners(most: int, lower: int = 0, room: int = 1 << 16, together: int = 1024):
    """From rows ``key, id, check`` sorted by key: those that have another row of their key within ``most`` bits of ``check``.

    Texts that merely fall into one bucket are dropped here, so that what is passed on grows with the links and not with
    the square of the table. Keys that agree but for their ``lower`` bits are one part, and what stays of its buckets is
    merged where it repeats (``_merged``). A part of more than 16 times ``room`` rows is read in pieces of whole keys; one
    of its keys that has more than ``room`` rows passes in pieces, and whole.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        near = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)) <= most

        def met(keys, ids, checks):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            fits = np.zeros(len(keys), bool)
            left = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(starts, sizes))
            small = np.repeat(sizes <= 64, sizes)  # left: rows of the key from this one on
            for step in range(1, min(64, int(sizes.max())) if len(sizes) else 0):
                one = np.flatnonzero(small & (left > step))
                if not len(one):
                    break
                one = one[near(checks[one], checks[one + step])]
                fits[one] = fits[one + step] = True
            for begin, size in zip(starts[sizes > 64], sizes[sizes > 64]):
                own = checks[begin:begin + size]
                ok = fits[begin:begin + size]
                for n in range(64):
                    hit = near(own, own[n])
                    hit[n] = hit.sum() > 1
                    ok |= hit
                alone = np.flatnonzero(~ok)
                if len(alone) > 256:
                    ok[:] = True
                for n in alone[:256]:
                    ok[n] |= near(own, own[n]).sum() > 1
            keys, ids = keys[fits], ids[fits]
            return passed(*_merged(keys, ids, lower, together))

        def passed(keys, ids):
            return pa.record_batch({"key": pa.array(keys), "id": pa.array(ids)})

        held, size, hot = [], 0, None  # batches of the part that is not at its end
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "id", "check")]
            if hot is not None:  # what is left of a key that began to pass in pieces
                end = int(np.searchsorted(now[0], hot, "right"))
                yield passed(now[0][:end], now[1][:end])
                now = [x[end:] for x in now]
                hot = hot if not len(now[0]) else None
            if not len(now[0]):
                continue
            held.append(now)
            size += len(now[0])
            last = int(now[0][-1])
            whole = int(held[0][0][0]) >> lower != last >> lower  # a part has ended
            if not whole and size <= 16 * room:
                continue
            now = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(now[0], last >> lower << lower if whole else last))
            if cut:
                yield met(*[x[:cut] for x in now])
            held, size = [[x[cut:] for x in now]], size - cut
            if not whole and size > room:
                yield passed(*held[0][:2])
                held, size, hot = [], 0, last
        if held:
            yield met(*[np.concatenate(x) for x in zip(*held)])

    return run


def _lower(segments: Sequence[Segment], nodes: int) -> int:
    """Bits of a key that its group does not tell. There are more groups as there are more than some 260,000 texts."""
    return max(0, min(bits for _, _, bits in segments) - max(5, (nodes >> 13).bit_length()))


def _filed(unpacked: DataFrame, segments: Sequence[Segment], words: int, nodes: int, crowd: int) -> DataFrame:
    """``key, id, check``, dealt to tasks by key and sorted by it: each text under its segments and their one-bit neighbours.

    A group is the keys of a table that agree in their upper bits. Only neighbours that fall into another group are sent
    there; those inside its own group a text gets after the shuffle, so that it is sent 6 times a table and not 26
    (``_lower``). A group of more than ``crowd`` texts is dealt key by key instead, all neighbours being sent.
    """
    lower = _lower(segments, nodes)
    filed = []
    for n, (word, low, bits) in enumerate(segments):
        own = f"(shiftrightunsigned(w{word}, {low}) & {(1 << bits) - 1}L | {n << 40}L)"
        check = f"w{(word + 1) % words}"
        filed.append(f"""concat(array(struct({own} AS key, {check} AS check, true AS home)),
            transform(sequence({lower}, {bits - 1}), i -> struct({own} ^ shiftleft(1L, i) AS key, {check} AS check, false AS home)))""")
    around = f"concat(array(key), transform(sequence(0, {lower - 1}), i -> key ^ shiftleft(1L, i)))" if lower else "array(key)"
    entries = unpacked.select("id", F.explode(F.expr(f"flatten(array({', '.join(filed)}))")).alias("entry")).select(
        "id", "entry.*", F.expr(f"shiftright(entry.key, {lower})").alias("part"))
    crowded = stored(
        entries.where("home").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded-groups")
    if not crowded.isEmpty():  # at most 10 * nodes / crowd groups, and never more than there are groups
        met = entries.join(F.broadcast(crowded), "part", "left")
        alone = "n IS NOT NULL AND home"
        entries = met.select(
            "id", "check", F.explode(F.expr(f"CASE WHEN {alone} THEN {around} ELSE array(key) END")).alias("key"),
            F.expr(f"home AND NOT ({alone})").alias("home"), "part", "n",
        ).withColumn("part", F.expr("CASE WHEN n IS NULL THEN part ELSE xxhash64(key) END"))
    # Tasks of about a million rows, whose sort takes some 60 MB; more rows a task only beyond 2e10 entries.
    parts = min(20_000, max(1, nodes * sum(bits + 1 for _, _, bits in segments) // 1_000_000))
    dealt = entries.select("part", "key", "id", "check", "home").repartition(parts, "part")
    return dealt.select(
        F.explode(F.expr(f"CASE WHEN home THEN {around} ELSE array(key) END")).alias("key"), "id", "check",
    ).sortWithinPartitions("key")


def similar(
    df: DataFrame, key: str, text: str, shingle: int = 5, part: int = 4, whole: int = 5,
    segments: Sequence[Segment] = TABLES, words: int = 5, most: int = 96, check: int = 20, chunk: int = 1024,
    crowd: int = 100_000,
) -> DataFrame:
    """``key, component_id`` per row: the least key reachable over links between texts' sets of shingles.

    Texts have fingerprints of ``words`` times 64 bits. Multi-index hashing finds candidates: a table
    for each segment, a text filed under its segment and all one-bit neighbours, so that segments that
    differ in two bits meet. Those that differ in more than ``check`` of 64 other bits from all they meet are dropped at
    once, and so are those that sizes, sketches and whole fingerprints (``most`` bits) tell apart from all they meet.
    Candidates whose whole fingerprints differ in ``most`` bits or fewer are linked if
    the Jaccard similarity of the shingle sets is ``part / whole`` or more, exactly: no wrong link is made; pairs
    whose segments all differ in three bits or more may be missed (the README has the share).

    Equal sets are one node; a text without words has an empty set. ``key`` must tell texts apart and not be null.
    Rows that repeat stay repeated; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def prints(value):
        return b"".join(w.to_bytes(8, "big") for w in fingerprint(value, shingle, words))

    sets = described(rows, shingle, prints=prints)
    nodes = set_nodes(sets)
    word = "conv(hex(substring(prints, {at}, 8)), 16, -10)"  # 64 bits as a signed number
    unpacked = nodes.select("id", *[
        F.expr(word.format(at=8 * n + 1)).cast("long").alias(f"w{n}") for n in range(words)])
    count = nodes.count()
    shared = stored(_filed(unpacked, segments, words, count, crowd).mapInArrow(
        _partners(check, _lower(segments, count)), "key long, id long").distinct(), "shared-keys")
    near = Near(part, whole, most)
    met = partnered(shared, nodes, near)
    groups = exact_groups(rows, nodes, met, shingle, near, chunk)
    classes = connected(nodes, groups, ["d0", "d1"])
    out = sets.select("key", "d0", "d1").join(classes, ["d0", "d1"]).select(F.col("key").alias(key), "component_id")
    for read in (shared, met):
        discard(read)
    return out
