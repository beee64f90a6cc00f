"""Exact links between sets that meet in buckets: pivots first, then what is still apart, by sketches and by the sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import components, discard, held, stored
from strataform.llm.simhash import _SEED

#: Up to this many row marks are broadcast to choose the texts that are read again; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(text: str | None, shingle: int):
    """The sorted, distinct 64-bit hashes of a text's shingles; words as in ``simhash.fingerprint``."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    flat = b" ".join(tokens)
    ends, at = [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    last = max(1, len(tokens) - shingle + 1)
    begins = [0, *[e + 1 for e in ends[: last - 1]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[b:e], _SEED) for b, e in zip(begins, ends[-last:])), np.uint64, last))


def sketch(own) -> bytes:
    """Parities of the elements by some of their bits, two to four bits an element: two sets' sketches differ in no
    more bits than the sets differ in elements, whatever their size."""
    import numpy as np

    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    counts = np.bincount(((own >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(sketches, words: int):
    """Sketches (rows of 64-bit words) of a set as they are at ``words`` words, a power of two."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


class Near:
    """Whether sets may have a similarity of ``part / whole`` or more, by sizes, sketches and, if given, fingerprints of
    which at most ``most`` bits differ. Sizes and sketches never refuse wrongly."""

    def __init__(self, part: int, whole: int, most: int | None = None):
        self.part, self.whole, self.most = part, whole, most

    def many(self, size, bits, prints, sizes, group, group_prints):
        """One set against a group whose sketches have one length."""
        import numpy as np

        part, whole = self.part, self.whole
        words = min(bits.shape[-1], group.shape[-1])
        fits = (whole * np.minimum(size, sizes) >= part * np.maximum(size, sizes))
        differ = np.bitwise_count(folded(bits, words) ^ folded(group, words)).sum(axis=-1, dtype=np.int64)
        fits &= differ * (whole + part) <= (size + sizes) * (whole - part)
        if self.most is not None:
            fits &= np.bitwise_count(prints ^ group_prints).sum(axis=-1, dtype=np.int64) <= self.most
        return fits

    def pairs(self, batch, one: str, other: str):
        """A batch's pairs, ``one`` and ``other`` being the columns' prefixes."""
        import numpy as np

        part, whole = self.part, self.whole
        sizes = [batch.column(f"{n}_size").to_numpy() for n in (one, other)]
        fits = whole * np.minimum(*sizes) >= part * np.maximum(*sizes)
        if self.most is not None:
            a, b = (np.frombuffer(b"".join(batch.column(f"{n}_prints").to_pylist()), np.uint64).reshape(
                batch.num_rows, -1) for n in (one, other))
            fits &= np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= self.most
        a, b = batch.column(f"{one}_bits"), batch.column(f"{other}_bits")
        for n in np.flatnonzero(fits):
            x, y = (np.frombuffer(c[n].as_buffer(), np.uint64) for c in (a, b))
            words = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64))
            fits[n] = differ * (whole + part) <= int(sizes[0][n] + sizes[1][n]) * (whole - part)
        return fits


def partnered(met: DataFrame, nodes: DataFrame, near: Near, room: int = 1024) -> DataFrame:
    """Of buckets ``key, id`` (stored, no row twice) the rows that ``near`` lets pass with another of their bucket, with the
    bucket's pivot: ``key, id, head, many`` as of ``headed``, stored.

    No link is lost, as pairs that ``near`` refuses are none. Families whose members are alike but not similar enough fill
    buckets with each other; they end here, where they are compared a bucket at a time, and no later step carries them.
    A pivot is the row whose fingerprint is the closest to those of the bucket (of 64 of them, if there are more). A bucket
    of more than ``room`` rows passes in pieces, and whole.
    """
    def run(batches):
        import numpy as np

        def pivot(ids, prints):
            score = np.zeros(len(ids), np.int64)
            for n in range(min(64, len(ids))):
                differ = np.bitwise_count(prints ^ prints[n]).sum(axis=-1, dtype=np.int64)
                score += np.maximum(0, 64 * prints.shape[1] - 2 * differ)  # 0: no more alike than others
            return int(np.lexsort((ids, -score))[0])

        def kept(ids, sizes, bits, prints):
            """The rows with a partner, and the pivot's place."""
            lengths = np.array([len(b) for b in bits])
            kinds = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
            kinds = [(k, np.stack([bits[n] for n in k]), prints[k], sizes[k]) for k in kinds]

            def partners(q):
                fits = np.zeros(len(ids), bool)
                for kind, group, group_prints, group_sizes in kinds:
                    fits[kind] = near.many(sizes[q], bits[q], prints[q], group_sizes, group, group_prints)
                fits[q] = False
                return fits

            head = pivot(ids, prints) if len(ids) > 2 else 0
            ok = partners(head)
            ok[head] = ok.any()
            for q in range(len(ids)):
                if not ok[q] and q != head:
                    now = partners(q)
                    ok |= now
                    ok[q] = now.any()
            if not ok[head] and ok.any():
                rest = np.flatnonzero(ok)
                head = int(rest[pivot(ids[rest], prints[rest])])
            return ok, head

        def passed(key, ids, head, many):
            return [np.full(len(ids), x) if n != 1 else x for n, x in enumerate((key, ids, head, many))]

        def bucket(keys, ids, sizes, bits, prints):
            if len(ids) > room:
                return passed(keys[0], ids, ids[pivot(ids, prints)], True)
            ok, head = kept(ids, sizes, [np.frombuffer(b, np.uint64) for b in bits], prints)
            return passed(keys[0], ids[ok], ids[head], bool(ok.sum() > 2))

        def batch_of(parts):
            return pa.record_batch(dict(zip(("key", "id", "head", "many"), map(pa.array, map(np.concatenate, zip(*parts))))))

        def columns(batch):
            prints = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            return [*(batch.column(c).to_numpy() for c in ("key", "id", "size")),
                    np.array(batch.column("bits").to_pylist(), object), prints]

        rest, hot, head = None, None, 0  # rows of the last key so far; a key that passes in pieces, and its pivot
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch) if rest is None else [np.concatenate(x) for x in zip(rest, columns(batch))]
            rest = None
            if hot is not None:
                end = int(np.searchsorted(now[0], hot, "right"))
                if end:
                    yield batch_of([passed(hot, now[1][:end], head, True)])
                now = [x[end:] for x in now]
                if not len(now[0]):
                    continue
                hot = None
            starts = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
            parts = [bucket(*[x[b:e] for x in now]) for b, e in zip(starts[:-1], starts[1:])]
            rest = [x[starts[-1]:] for x in now]
            if len(rest[0]) > room:
                hot, head = rest[0][0], rest[1][pivot(rest[1], rest[4])]
                parts.append(passed(hot, rest[1], head, True))
                rest = None
            if parts:
                yield batch_of(parts)
        if rest is not None:
            yield batch_of([bucket(*rest)])

    own = met.groupBy("id").agg(F.collect_list("key").alias("keys"))  # as many keys as a text is filed under, at most
    rows = own.join(nodes.select("id", "size", "bits", "prints"), "id").select(
        F.explode("keys").alias("key"), "id", "size", "bits", "prints")
    return stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(
        run, "key long, id long, head long, many boolean"), "met")


def headed(met: DataFrame) -> DataFrame:
    """Buckets ``key, id`` with each row's pivot: ``key, id, head, many``, stored; ``many``: the bucket has more than two rows.

    A pivot is the member that meets others most often: of copies of one original, that is the original. It is found by
    a maximum that combines on the map side.
    """
    often = met.groupBy("id").agg(F.count("*").alias("n"))
    ranked = met.join(often, "id").select("key", "id", F.struct("n", (-F.col("id")).alias("id")).alias("rank"))
    heads = ranked.groupBy("key").agg(F.max("rank").alias("head"), (F.count("*") > 2).alias("many"))
    return stored(
        ranked.join(heads, "key").select("key", "id", (-F.col("head.id")).alias("head"), "many"), "headed")


def _pivots(met: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each bucket's pivot with its members, once each and stored; ``many``: of a bucket of more than two."""
    pairs = met.where("head <> id").groupBy(F.col("head").alias("a"), F.col("id").alias("b"))
    return stored(pairs.agg(F.max("many").alias("many")), "pivots")


def _links(one, two):
    """Pairs of two lists of arrays, the lesser first."""
    import numpy as np

    one, two = np.concatenate(one), np.concatenate(two)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], schema=_PAIR)


def _filtered(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """The pairs that sizes, sketches and fingerprints let pass."""
    side = lambda n: nodes.select(
        F.col("id").alias(n), F.col("size").alias(f"{n}_size"), F.col("bits").alias(f"{n}_bits"), F.col("prints").alias(f"{n}_prints"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], schema=_PAIR).filter(pa.array(near.pairs(batch, "a", "b")))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _checked(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, part: int, whole: int, room: int = 256) -> DataFrame:
    """The pairs ``a, b`` whose sets have the similarity, exactly; ``pairs`` is a stored table.

    Each pair's ``b`` is compared with ``a`` where at most some ``room`` partners of ``a`` meet, so that a set is
    sent once for each pair it is ``b`` of, and once for ``room`` pairs it is ``a`` of.
    """
    spark = rows.sparkSession
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / room).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    wanted = dealt.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("id")).unionByName(
        dealt.select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("id")).distinct())
    wanted = stored(wanted.join(nodes.select("id", "least"), "id"), "wanted")
    marks = wanted.select(F.xxhash64("least").alias("_mark")).distinct()
    texts = rows.withColumn("_mark", F.xxhash64("key"))
    if marks.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(marks), "_mark", "left_semi")

    def read(batches):
        schema = pa.schema([("a", pa.int64()), ("salt", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("hashes", pa.binary())])
        text = made = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part_ = batch.slice(begin, 256)
                sets = []
                for now in part_.column("text").to_pylist():
                    if made is None or now != text:
                        text, made = now, shingle_set(now, shingle).tobytes()
                    sets.append(made)
                yield pa.RecordBatch.from_arrays(
                    [part_.column(c) for c in ("a", "salt", "side", "id")] + [pa.array(sets, pa.binary())], schema=schema)

    def compare(batches):
        import numpy as np

        group = own = None
        for batch in batches:
            keys = zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist())
            links = []
            hashes = batch.column("hashes")
            for n, (key, side, member) in enumerate(zip(keys, batch.column("side").to_pylist(), batch.column("id").to_pylist())):
                now = np.frombuffer(hashes[n].as_buffer(), np.uint64)
                if side == 0:
                    group, own = key, now.copy()
                    continue
                if key != group:
                    raise ValueError(f"no set of pivot {key}")
                common = 0
                if len(own) and len(now):
                    at = np.searchsorted(own, now)
                    common = int((own[np.minimum(at, len(own) - 1)] == now).sum())
                if common * (whole + part) >= part * (len(own) + len(now)):
                    links.append((key[0], member))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)

    fetched = texts.select("key", "text").join(wanted, texts["key"] == wanted["least"]).select("a", "salt", "side", "id", "text")
    sets = fetched.mapInArrow(read, "a long, salt long, side int, id long, hashes binary")
    links = sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(compare, "a long, b long")
    links = stored(links, "links")
    discard(wanted)
    return links


def _apart(
    met: DataFrame, pivots: DataFrame, nodes: DataFrame, groups: DataFrame, near: Near, chunk: int, few: bool,
) -> DataFrame:
    """Pairs of a bucket whose members are in different groups (``node, component``) and that ``near`` lets pass.

    Buckets of two members, of one group, or equal to another bucket, have nothing to add. A bucket is of one group if all
    members are in its pivot's, so that only pairs of ``pivots`` are looked up, and rows of buckets only where one of those
    is still apart. In the others the members outside the greatest group are compared with all members of other groups, in
    blocks of ``chunk`` and ``chunk``: copies grow with what is apart, not with the bucket. With ``few``, a block gives no
    more pairs than would join its groups.
    """
    side = lambda n: groups.select(F.col("node").alias(n), F.col("component").alias(f"{n}_group"))
    split = pivots.where("many").join(side("a"), "a", "left").join(side("b"), "b", "left").where(
        "coalesce(a_group, a) <> coalesce(b_group, b)").select(F.col("a").alias("head"), F.col("b").alias("id"))
    left = met.join(split, ["head", "id"]).where("many").select("key").distinct()
    open_ = stored(met.join(left, "key", "left_semi").join(groups, met["id"] == groups["node"], "left").select(
        "key", "id", F.coalesce("component", "id").alias("label")), "open-buckets")
    sizes = open_.groupBy("key", "label").agg(
        F.count("*").alias("own"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    top = sizes.groupBy("key").agg(
        F.sum("own").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("own", "label")).alias("top"),
    ).groupBy("n", "x", "y").agg(F.min(F.struct("key", "top")).alias("one")).select(
        F.col("one.key").alias("key"), F.col("one.top.label").alias("great"),
        F.ceil((F.col("n") - F.col("one.top.own")) / chunk).alias("asks"), F.ceil(F.col("n") / chunk).alias("parts"))
    rows = open_.join(top, "key").select(
        "key", "id", "label", "great", "asks", "parts", F.xxhash64("id").alias("h"))
    asked = rows.select(
        "key", "id", "label", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"),
        F.pmod("h", "parts").alias("part"))
    asking = rows.where("label <> great").select(
        "key", "id", "label", F.lit(1).alias("side"), F.pmod("h", "asks").alias("ask"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    block = ["key", "ask", "part"]

    def run(batches):
        import numpy as np

        def pairs(rows):
            side = np.array([r["side"] for r in rows])
            ids, labels, sizes = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label", "size"))
            bits = [np.frombuffer(r["bits"], np.uint64) for r in rows]
            prints = np.frombuffer(b"".join(r["prints"] for r in rows), np.uint64).reshape(len(rows), -1)
            targets, lengths = np.flatnonzero(side == 0), np.array([len(b) for b in bits])
            kinds = [targets[lengths[targets] == n] for n in np.unique(lengths[targets])]
            kinds = [(k, np.stack([bits[n] for n in k])) for k in kinds]
            joined = dict(zip(labels.tolist(), labels.tolist()))  # of each label, another of its group, or itself

            def root(label):
                while joined[label] != label:
                    joined[label] = label = joined[joined[label]]
                return label

            one, two, held = [], [], 0
            for q in np.flatnonzero(side == 1):
                for kind, group in kinds:
                    fits = near.many(sizes[q], bits[q], prints[q], sizes[kind], group, prints[kind]) & (labels[kind] != labels[q])
                    found = kind[fits]
                    if few:
                        found = found[np.unique(labels[found], return_index=True)[1]]
                        use = []
                        for n in found:
                            x, y = root(int(labels[q])), root(int(labels[n]))
                            if x != y:
                                joined[x] = y
                                use.append(n)
                        found = np.array(use, np.int64)
                    one.append(np.full(len(found), ids[q]))
                    two.append(ids[found])
                    held += len(found)
                if held > 1 << 16:
                    yield _links(one, two)
                    one, two, held = [], [], 0
            if held:
                yield _links(one, two)

        rows_, name = [], None
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                for row in batch.slice(begin, 1024).to_pylist():
                    now = tuple(row[c] for c in block)
                    if now != name and rows_:
                        yield from pairs(rows_)
                        rows_ = []
                    name = now
                    rows_.append(row)
        if rows_:
            yield from pairs(rows_)

    blocks = asked.unionByName(asking).join(nodes.select("id", "size", "bits", "prints"), "id")
    return blocks.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "a long, b long").distinct()


def exact_groups(
    rows: DataFrame, nodes: DataFrame, met: DataFrame, shingle: int, near: Near, chunk: int = 1024,
) -> DataFrame:
    """Components ``node, component`` over all pairs that share a bucket and whose sets are similar.

    ``rows``: ``key, text``, a key telling texts apart; ``nodes``: stored ``id, least`` (a key of a text with this
    set), ``size, bits, prints``; ``met``: stored ``key, id``, no row twice, with ``head, many`` as ``headed`` makes them,
    which is done here if they are missing. No pair is lost:

    1. each bucket's members are compared with its pivot; components of what is similar;
    2. of one bucket's groups that are still apart, those pairs that may be similar and would join them all; components anew;
    3. all other pairs of one bucket that are still apart and may be similar.

    Each step looks only at what the steps before left apart, whatever the size of the groups. Every link is decided by the
    shingle sets themselves, made again from the texts of those rows.
    """
    part, whole = near.part, near.whole
    own = met if "head" in met.columns else headed(met)
    pivots = _pivots(own)
    seen = stored(_filtered(pivots.select("a", "b"), nodes, near), "pairs")
    links = _checked(rows, nodes, seen, shingle, part, whole)
    groups = components(links, "joined")
    for few in (True, False):
        order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = stored(_apart(own, pivots, nodes, groups, near, chunk, few).join(order(seen), ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            seen = seen.unionByName(rest)
            more = _checked(rows, nodes, rest, shingle, part, whole)
            if not more.isEmpty():
                links = links.unionByName(more)
                groups = components(links, "joined")
    for read in (pivots, *([own] if own is not met else [])):
        discard(read)
    return groups


def described(rows: DataFrame, shingle: int, prints=None, signatures=None) -> DataFrame:
    """``key, id, d0, d1, size, bits, prints, signatures`` of each row's shingle set, stored.

    ``d0, d1``: 128 bits of the set; ``prints`` and ``signatures`` are made by the given functions of
    the text and of the set. Texts are read one at a time.
    """
    kind = rows.schema["key"].dataType.simpleString()
    names = ["d0", "d1", "size", "bits", "prints", "signatures"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        import numpy as np
        import xxhash

        held("sets", dict)  # lets go of what other steps kept in this worker
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                made = []
                for text in part.column("text").to_pylist():
                    own = shingle_set(text, shingle)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    made.append((
                        int(digest[0]), int(digest[1]), len(own), sketch(own), prints(text) if prints else b"",
                        signatures(own).view(np.int64) if signatures else []))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *[pa.array(c, t) for c, t in zip(zip(*made), types)]], names=["key", *names])

    made = rows.mapInArrow(
        run, f"key {kind}, d0 long, d1 long, size long, bits binary, prints binary, signatures array<long>")
    return stored(made.withColumn("id", F.monotonically_increasing_id()), "sets")


def set_nodes(sets: DataFrame) -> DataFrame:
    """``id, least, d0, d1, size, bits, prints`` of each different set of ``described``: one row's id, and the least key."""
    return stored(sets.groupBy("d0", "d1").agg(
        F.min("id").alias("id"), F.min("key").alias("least"), *[F.first(n).alias(n) for n in ("size", "bits", "prints")]), "nodes")
