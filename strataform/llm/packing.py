"""Packing of token sequences by a grouping genetic algorithm on islands (operator 8)."""

from __future__ import annotations

import bisect
import random
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.chunks import TextEncoder, batched
from strataform.llm.common import held, lean, stored


def library_encoder(path: str, width: int = 4, cached: int = 500_000) -> TextEncoder:
    """The tokenizer of a file, piece by piece; ids as little-endian integers of ``width`` bytes. One per worker, with
    two generations of ``cached`` pieces."""
    return held(("library", path, width, cached), lambda: _library_encoder(path, width, cached))


def _library_encoder(path: str, width: int, cached: int) -> TextEncoder:
    import os

    import numpy as np
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kind = f"<u{width}"

    def ids(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()

    vocabulary = tokenizer.get_vocab()
    closed = any(token.endswith("</w>") for token in vocabulary)
    spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space in byte-level form
    spaced[[i for token, i in vocabulary.items() if token[0] == "\u0120" and not closed]] = True

    # Words whose ends do not show in the ids are parted by a sign that is one token and that none of them holds.
    parting = [t for t in "^`~{}\\_@=+[]" + string.digits + string.punctuation if f"{t}</w>" in vocabulary and len(ids(t)) == width]

    def many(words: list[str]) -> list[bytes]:
        """Ids of words that begin with their only space, by one call."""
        joined = "".join(words)
        if closed:
            between = next((t for t in parting if t not in joined), None)
            if between is not None:
                found = tokenizer.encode_batch_fast([f" {between}".join(["", *words])], add_special_tokens=False)[0]
                coded = np.array(found.ids, kind)
                marks = np.flatnonzero(coded == np.frombuffer(ids(between), kind)[0])
                if len(marks) == len(words):  # one before each word
                    coded, ends = coded.tobytes(), [*(marks[1:] * width).tolist(), len(coded) * width]
                    return [coded[b + width:e] for b, e in zip((marks * width).tolist(), ends)]
        else:  # the first token of each word shows
            found = tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0]
            coded = np.array(found.ids, kind)
            begins = np.flatnonzero(spaced[coded])
        if closed or len(begins) != len(words):
            found = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            coded = np.array(found.ids, kind)
            begins = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words)))
        coded, begins = coded.tobytes(), [*(begins * width).tolist(), len(coded) * width]
        return [coded[b:e] for b, e in zip(begins, begins[1:])]

    specials = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return TextEncoder(ids, b"".join, specials, ids, most=cached, encode_many=many)


def encoded(encoder: TextEncoder, texts: pa.Array, width: int = 4, block_bytes: int = 8_000_000) -> Iterator[bytes]:
    """The ids of each text, taken in blocks of about ``block_bytes``."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (sizes.cumsum() - sizes) // block_bytes  # of each text, by the bytes before it
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield from encoder.encode_block(texts.slice(begin, end - begin), width)


def token_pieces(
    df: DataFrame, key: str, text: str, path: str, end_id: int, most: int, cached: int = 500_000,
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """``key, piece, start, length, ids`` of each row's ids and ``end_id``, cut after every ``most`` ids.

    ``ids``: little-endian unsigned 32-bit. A null text is an empty one: its one piece is the end id.
    ``cached`` bounds what a worker keeps, and ``block_bytes`` the texts that are split at a time; they change time, never a result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        encoder, end, step = library_encoder(path, cached=cached), end_id.to_bytes(4, "little"), 4 * most

        def cut(batch):
            for value, ids in zip(batch.column("key"), encoded(encoder, batch.column("text"), 4, block_bytes)):
                ids, own = ids + end, value.as_py()
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    yield own, piece, at // 4, len(part) // 4, part

        for batch in lean(batches):
            yield from batched(cut(batch), pa.schema([
                batch.schema.field("key"), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
                pa.field("length", pa.int64()), pa.field("ids", pa.binary()),
            ]))

    return rows.mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


class _Bins:
    """Bins under construction; best fit finds the fullest bin with room."""

    def __init__(self, sizes: list[int], room: int):
        self.sizes, self.room = sizes, room
        self.bins: list[list[int]] = []
        self.free: list[tuple[int, int]] = []  # (room left, bin), ascending

    def put_bin(self, items: list[int]) -> None:
        left = self.room - sum(self.sizes[i] for i in items)
        bisect.insort(self.free, (left, len(self.bins)))
        self.bins.append(items)

    def best_fit(self, item: int) -> None:
        need = self.sizes[item]
        at = bisect.bisect_left(self.free, (need, -1))
        if at == len(self.free):
            self.put_bin([item])
            return
        left, bin_ = self.free.pop(at)
        self.bins[bin_].append(item)
        bisect.insort(self.free, (left - need, bin_))


def _fitness(bins: list[list[int]], sizes: list[int], room: int) -> tuple[int, float]:
    """Fewer bins first, then bins of unequal fill: full ones leave useful room elsewhere."""
    return -len(bins), sum((sum(sizes[i] for i in b) / room) ** 2 for b in bins)


def _pack_in_order(order: list[int], sizes: list[int], room: int) -> list[list[int]]:
    packed = _Bins(sizes, room)
    for item in order:
        packed.best_fit(item)
    return packed.bins


def _cross(one, other, sizes, room, rng) -> list[list[int]]:
    """Whole well-filled bins of ``other`` go into ``one``; bins that share a document with them
    dissolve, and what they held besides is placed by best fit, longest first."""
    fills = sorted(((sum(sizes[i] for i in b), n) for n, b in enumerate(other)), reverse=True)
    most = max(1, len(fills) // 2)
    injected = [other[n] for _, n in fills[: rng.randint(max(1, most // 2), most)]]
    taken = {i for b in injected for i in b}
    child, homeless = _Bins(sizes, room), []
    for b in injected:
        child.put_bin(list(b))
    for b in one:
        if taken.isdisjoint(b):
            child.put_bin(list(b))
        else:
            homeless += [i for i in b if i not in taken]
    for item in sorted(homeless, key=lambda i: (-sizes[i], i)):
        child.best_fit(item)
    return child.bins


def _mutate(bins, sizes, room, rng) -> list[list[int]]:
    """The emptiest bins and a few others dissolve; their documents are placed by best fit."""
    fills = sorted((sum(sizes[i] for i in b), n) for n, b in enumerate(bins))
    gone = {n for _, n in fills[:2]} | {rng.randrange(len(bins)) for _ in range(max(2, len(bins) // 50))}
    child = _Bins(sizes, room)
    for n, b in enumerate(bins):
        if n not in gone:
            child.put_bin(list(b))
    for item in sorted((i for n in gone for i in bins[n]), key=lambda i: (-sizes[i], i)):
        child.best_fit(item)
    return child.bins


def evolve(
    sizes: list[int], room: int, population: list[list[list[int]]], people: int, generations: int, seed: int,
) -> list[list[int]]:
    """The best packing of one island after some generations; starts from ``population`` and fills it up.

    Ends early at the fewest bins that the total allows.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // room)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    population = list(population) or [_pack_in_order(order, sizes, room)]
    best = max(population, key=lambda b: _fitness(b, sizes, room))
    if len(best) <= bound:
        return best
    while len(population) < people:
        mixed = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.25))
        population.append(_pack_in_order(mixed, sizes, room))
    ranked = sorted(((_fitness(b, sizes, room), n, b) for n, b in enumerate(population)), reverse=True)
    made = len(ranked)
    for _ in range(generations):
        if -ranked[0][0][0] <= bound:
            break
        one, other = ranked[0][2], ranked[rng.randrange(1, len(ranked))][2] if len(ranked) > 1 else ranked[0][2]
        for child in (_cross(one, other, sizes, room, rng), _mutate(_cross(other, one, sizes, room, rng), sizes, room, rng)):
            ranked.append((_fitness(child, sizes, room), made, child))
            made += 1
        ranked = sorted(ranked, reverse=True)[:people]  # the elite stays
    return ranked[0][2]


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for number, items in enumerate(bins):
        for i in items:
            out[i] = number
    return out


def _groups(labels) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(labels) + 1)]
    for i, b in enumerate(labels):
        bins[b].append(i)
    return [b for b in bins if b]


def pack(
    pieces: DataFrame, length: str, room: int, cell_rows: int = 4096, islands: int = 2, people: int = 6,
    generations: int = 30, epochs: int = 2,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every row in a sequence of at most ``room``.

    Rows are dealt by a hash into cells of about ``cell_rows``, whatever the size of the input.
    Each cell is bred on ``islands`` islands (one row each); after each epoch an island gets the
    elite of its neighbour. The best island of a cell wins. A cell whose first packing, best fit from
    the longest down, has the fewest bins that its total allows is not bred. Places follow each other without gaps.

    Lengths are 1 to ``room``, others raise; null counts as wrong. Equal rows are packed one by
    one. Columns named ``sequence_id`` or ``offset`` are replaced. An empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    items = stored(pieces.select(*kept, F.monotonically_increasing_id().alias("_item")), "pieces")
    total = items.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col(length).between(1, room), F.lit(False))).alias("fits"),
    ).first()
    if total["n"] != total["fits"]:
        raise ValueError(f"{total['n'] - total['fits']} rows are longer than {room}, or empty")
    cells = max(1, -(-total["n"] // cell_rows))
    state = stored(
        items.select(
            F.pmod(F.xxhash64("_item"), F.lit(cells)).alias("cell"), F.col(length).cast("long").alias("size"), "_item")
        .groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("size", "_item"))).alias("held"))
        .select("cell", F.col("held.size").alias("sizes"), F.col("held._item").alias("items")), "cells")

    bred = state.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes").withColumn(
        "elite", F.array().cast("array<array<int>>"))
    for epoch in range(epochs):
        def run(frames, epoch=epoch):
            for frame in frames:
                best = []
                for cell, island, sizes, elite in zip(frame["cell"], frame["island"], frame["sizes"], frame["elite"]):
                    sizes = [int(x) for x in sizes]
                    begun = [_groups([int(b) for b in labels]) for labels in elite]
                    bins = evolve(
                        sizes, room, begun, people, generations, (int(cell) * 64 + int(island)) * 64 + epoch)
                    best.append(_labels(bins, len(sizes)))
                yield frame[["cell", "island"]].assign(best=best)

        grown = stored(
            bred.repartition("cell", "island").mapInPandas(run, "cell long, island int, best array<int>"), "islands")
        if epoch + 1 < epochs:
            guests = grown.select("cell", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("guest"))
            bred = (
                grown.join(guests, ["cell", "island"]).join(state.select("cell", "sizes"), "cell")
                .select("cell", "island", "sizes", F.array("best", "guest").alias("elite"))
            )
    winner = grown.groupBy("cell").agg(F.min_by("best", F.struct(F.array_max("best"), "island")).alias("best"))

    def place(frames):
        import numpy as np

        for frame in frames:
            for cell, sizes, own, best in zip(frame["cell"], frame["sizes"], frame["items"], frame["best"]):
                sizes, best = np.asarray(sizes, np.int64), np.asarray(best, np.int64)
                order = np.argsort(best, kind="stable")
                ends = np.cumsum(sizes[order])
                begins = ends - sizes[order]
                first = np.r_[True, best[order][1:] != best[order][:-1]]
                base = begins[first][np.cumsum(first) - 1]
                yield type(frame)({
                    "_item": np.asarray(own, np.int64)[order], "sequence_id": (int(cell) << 24) + best[order],
                    "offset": begins - base,
                })

    placed = state.join(winner, "cell").mapInPandas(place, "_item long, sequence_id long, offset long")
    return items.join(placed, "_item").select(*kept, "sequence_id", "offset")
