"""Encoding of texts piece by piece, with a bounded cache of pieces.

No token of the tokenizers used here holds a space after another character, so a text may be
encoded from one "white space and what follows it" to the next, and the results joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: The code points that Unicode counts as white space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall


class PieceCache(dict):
    """Piece to its encoded form, filled on demand, in two generations of ``most`` entries.

    What is dropped is computed again: the bound changes time, never a result. A piece after
    which a text may not be cut (empty, or ending in white space) has None.
    """

    def __init__(self, encode: Callable[[str], object], lead: str, most: int):
        super().__init__()
        self._encode, self._lead, self._most, self._older = encode, lead, most, {}

    def __missing__(self, piece: str):
        value = self._older.get(piece)
        if value is None and piece and not piece[-1].isspace():
            value = self._encode(self._lead + piece)
        self._keep({piece: value})
        return value

    def _keep(self, new: dict) -> None:
        if len(self) >= self._most:  # what was not asked for since the last turn goes
            self._older = dict(self)
            self.clear()
        self.update(new if max(map(len, new), default=0) <= 128 else {p: v for p, v in new.items() if len(p) <= 128})

    def values(self, pieces: list[str], encode_many: Callable[[list[str]], Iterable], at_once: int = 10_000) -> list:
        """The values of different pieces; what is new is encoded by few calls."""
        found = list(map(self.get, pieces))
        new = [n for n, value in enumerate(found) if value is None]
        if self._older:
            again = {}
            for n, value in zip(new, map(self._older.get, [pieces[n] for n in new])):
                if value is not None:
                    found[n] = again[pieces[n]] = value
            self._keep(again)
            new = [n for n in new if found[n] is None]
        new = [n for n in new if pieces[n] and not pieces[n][-1].isspace()]
        for at in range(0, len(new), at_once):
            some = new[at:at + at_once]
            words = [pieces[n] for n in some]
            learnt = dict(zip(words, encode_many([self._lead + w for w in words])))
            self._keep(learnt)
            for n, value in zip(some, learnt.values()):
                found[n] = value
        return found


class TextEncoder:
    """Texts to values that ``join`` puts together (bytes of ids, or numbers of tokens)."""

    def __init__(
        self, encode_chunk: Callable[[str], object], join: Callable[[Iterable], object],
        specials: tuple[str, ...] = (), encode_special: Callable[[str], object] | None = None, most: int = 300_000,
        encode_many: Callable[[list[str]], Iterable] | None = None,
    ):
        self._chunk, self._join = encode_chunk, join
        self._first = PieceCache(encode_chunk, "", 50_000)
        self._rest = PieceCache(encode_chunk, " ", most)
        self._specials, self._special, self._many = specials, encode_special, encode_many
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")").split

    def encode_block(self, texts: pa.Array, width: int) -> Iterator[bytes]:
        """The ids (of ``width`` bytes) of each text, null as empty; each different piece is looked up once."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for s in self._specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(special), "", texts), " ")
        coded = split.flatten().dictionary_encode()
        pieces, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        values = self._rest.values(pieces, self._many)
        sizes = np.array([len(v) // width if v is not None else 0 for v in values], np.int64)
        open_end = np.array([v is None for v in values], bool)  # a text may not be cut behind such a piece
        data = np.frombuffer(b"".join(v for v in values if v is not None), f"<u{width}")
        lengths = sizes[at]
        ends = np.r_[0, lengths.cumsum()]
        small = np.int32 if max(ends[-1], len(data)) < 1 << 31 else np.int64
        place = np.repeat(((sizes.cumsum() - sizes)[at] - ends[:-1]).astype(small), lengths)
        place += np.arange(len(place), dtype=small)
        ids = data[place].tobytes()
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        low, high = bounds[:-1], bounds[1:]
        seen = np.r_[0, open_end[at].cumsum()]
        slow = (seen[high] > seen[low]).tolist()  # special ones too: their one piece is empty
        begin, end = ends[low + 1] * width, ends[high] * width
        for n, (first, b, e) in enumerate(zip(at[low].tolist(), begin.tolist(), end.tolist())):
            yield self.encode(texts[n].as_py()) if slow[n] else self._first[pieces[first]] + ids[b:e]

    def encode(self, text: str):
        if self._specials and any(s in text for s in self._specials):
            parts = self._cut(text)  # ordinary text and special strings in turn
            return self._join(
                self._special(p) if n % 2 else self._plain(p) for n, p in enumerate(parts) if p)
        return self._plain(text)

    def _plain(self, text: str):
        first, *rest = text.split(" ")
        try:
            return self._join([self._first[first], *map(self._rest.__getitem__, rest)])
        except TypeError:  # a None: spaces in a row, or at an end
            return self._join(map(self._chunk, _CHUNKS(text)))


def batched(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20, most_rows: int = 10_000):
    """Rows as record batches of bounded size; binary and text values count."""
    columns: list[list] = [[] for _ in schema]
    size = 0
    for row in rows:
        for column, value in zip(columns, row):
            column.append(value)
            if isinstance(value, (bytes, str)):
                size += len(value)
        if size >= most_bytes or len(columns[0]) >= most_rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            columns, size = [[] for _ in schema], 0
    if columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
