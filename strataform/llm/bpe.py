"""Byte-pair encoding by a priority queue over a linked list of symbols (operators 6 and 7)."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.chunks import SPACES, TextEncoder, batched

#: What counts as one word for the byte-level tokenizers.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
).findall
_PLACE = 40  # bits of a queue entry that hold the place; the rank stands above


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + n) for n, b in enumerate(others)}


class BytePairs:
    """Vocabulary and merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.byte_ids = [vocabulary[letters[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = []  # by rank: left, right, merged
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocabulary[left], vocabulary[right]
            self.ranks[a, b] = rank
            self.made.append((a, b, vocabulary[left + right]))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {letter: b for b, letter in letters.items()}
        self.strings: dict[int, bytes] = {
            i: bytes(back[x] for x in token) for token, i in vocabulary.items() if token not in self.specials}
        self.strings |= {i: token.encode() for token, i in self.specials.items()}

    def merge(self, word: bytes, symbols_only: bool = False):
        """Ids of a word; with ``symbols_only`` their number: the symbols less the merges."""
        symbols = [self.byte_ids[b] for b in word]
        size = len(symbols)
        if size < 2:
            return size if symbols_only else symbols
        ranks, made, mask = self.ranks, self.made, (1 << _PLACE) - 1
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = []
        for place in range(size - 1):
            rank = ranks.get((symbols[place], symbols[place + 1]))
            if rank is not None:
                queue.append(rank << _PLACE | place)
        heapq.heapify(queue)
        merges = 0
        while queue:
            entry = heapq.heappop(queue)
            place, (left, right, merged) = entry & mask, made[entry >> _PLACE]
            other = after[place]
            if symbols[place] != left or other >= size or symbols[other] != right:
                continue  # stale: a neighbour has been merged since
            symbols[place], symbols[other] = merged, -1
            merges += 1
            following, previous = after[other], before[place]
            after[place] = following
            if following < size:
                before[following] = place
                rank = ranks.get((merged, symbols[following]))
                if rank is not None:
                    heapq.heappush(queue, rank << _PLACE | place)
            if previous >= 0:
                rank = ranks.get((symbols[previous], merged))
                if rank is not None:
                    heapq.heappush(queue, rank << _PLACE | previous)
        return size - merges if symbols_only else [s for s in symbols if s >= 0]

    def decode(self, ids) -> str:
        """Vocabulary strings put together; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _WordCache(dict):
    def __init__(self, encode, most: int = 400_000):
        super().__init__()
        self._encode, self._most = encode, most

    def __missing__(self, word: str):
        value = self._encode(word.encode())
        if len(self) >= self._most:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[BytePairs, TextEncoder]:
    """One per worker and file: the caches serve all tasks of the worker."""
    pairs = BytePairs(path)
    words = _WordCache(lambda w: b"".join(i.to_bytes(4, "little") for i in pairs.merge(w)))
    return pairs, TextEncoder(
        lambda chunk: b"".join(map(words.__getitem__, WORDS(chunk))), b"".join,
        tuple(pairs.specials), lambda s: pairs.specials[s].to_bytes(4, "little"),
    )


@lru_cache(maxsize=2)
def _counter(path: str) -> TextEncoder:
    pairs = BytePairs(path)
    words = _WordCache(lambda w: pairs.merge(w, symbols_only=True))
    return TextEncoder(
        lambda chunk: sum(map(words.__getitem__, WORDS(chunk))), sum, tuple(pairs.specials), lambda s: 1,
        most=500_000,
    )


def encode_texts(df: DataFrame, key: str, text: str, path: str, decode: bool = True) -> DataFrame:
    """``key, ids binary`` (little-endian unsigned 32-bit) and, if asked, ``decoded`` per row of ``df``.

    A null text is an empty one: no ids, decoded empty. Strings of special tokens inside a text
    become their ids. Rows that repeat stay repeated; only the two named columns are read, so
    other columns cannot clash.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, ids binary" + ", decoded string" * decode

    def run(batches):
        import numpy as np

        pairs, encoder = _encoder(path)

        def coded(batch):
            for value, content in zip(batch.column("key"), batch.column("text")):
                ids = encoder.encode(content.as_py() or "")
                yield (value.as_py(), ids, pairs.decode(np.frombuffer(ids, "<u4").tolist())) if decode else (
                    value.as_py(), ids)

        for batch in batches:
            fields = [batch.schema.field("key"), pa.field("ids", pa.binary())]
            yield from batched(coded(batch), pa.schema(fields + [pa.field("decoded", pa.string())] * decode))

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key, n_bytes, n_tokens`` per row of ``df``: initial symbols less merges, no ids made.

    A null text is an empty one (0 and 0). Special strings inside a text count one each.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            yield pa.record_batch({
                "key": batch.column("key"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array([counter.encode(t) for t in texts], pa.int64()),
            })

    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
