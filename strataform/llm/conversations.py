"""Repair of conversations by cheapest edits (operator 12)."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import WORD_SPACE, stored

# A row's code: 4 * kind + the initial of its role.
_INITIALS = {"s": 0, "u": 1, "a": 2}
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)

# Places in the sequence of kept roles: nothing yet, after the system row, after a user, after an assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # where an inserted or renamed row leads
_KEEPS = ({0: _SYSTEM, 1: _USER}, {1: _USER}, {2: _ASSISTANT}, {1: _USER})
_DEAREST = 5  # what it costs at most to go on from any place as if from any other


class Prefixes:
    """Edit prefixes as linked nodes: each knows its letter, its parent, its 2**j-th ancestors and a rolling hash.

    Prefixes that go on in two ways share all their nodes. Two prefixes are compared by the first letter after
    their longest common prefix, found by descending through ancestors of one depth with unequal hashes.
    """

    _BASE, _PRIME = 1_000_003, (1 << 61) - 1

    def __init__(self):
        self.letters, self.depths, self.hashes = array("b", [0]), array("i", [0]), array("q", [0])
        self.ups = [array("i", [0])]

    def add(self, parent: int, letter: int) -> int:
        node = len(self.letters)
        depth = self.depths[parent] + 1
        self.letters.append(letter)
        self.depths.append(depth)
        self.hashes.append((self.hashes[parent] * self._BASE + letter) % self._PRIME)
        if depth >> len(self.ups):
            self.ups.append(array("i", bytes(4 * node)))
        at = parent
        for up in self.ups:
            up.append(at)
            at = up[at]
        return node

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor at a depth."""
        steps, j = self.depths[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.ups[j][node]
            steps >>= 1
            j += 1
        return node

    def equal(self, one: int, other: int) -> bool:
        """Whether two prefixes of one length are the same: unequal hashes say no, equal ones are verified by letters."""
        if self.hashes[one] != self.hashes[other]:
            return False
        up, letters = self.ups[0], self.letters
        while one != other:
            if letters[one] != letters[other]:
                return False
            one, other = up[one], up[other]
        return True

    def before(self, one: int, first: int, other: int, second: int) -> bool:
        """Whether prefix ``one`` with letter ``first`` is ASCII-less than ``other`` with ``second`` (0: no letter)."""
        if one == other:
            return first < second
        depth = min(self.depths[one], self.depths[other])
        a, b = self.lifted(one, depth), self.lifted(other, depth)
        if self.equal(a, b):  # one is the beginning of the other
            x = self.letters[self.lifted(one, depth + 1)] if self.depths[one] > depth else first
            y = self.letters[self.lifted(other, depth + 1)] if self.depths[other] > depth else second
            longer = self.depths[other] + (second > 0) > self.depths[one] + (first > 0)
            return x < y or (x == y and longer)
        for up in reversed(self.ups):
            if not self.equal(up[a], up[b]):
                a, b = up[a], up[b]
        return self.letters[a] < self.letters[b]

    def text(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.letters[node])
            node = self.ups[0][node]
        return out[::-1].decode()


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and ASCII-least audit (initials of Delete, Insert, Keep, Rerole) that turn rows into ``(s?(ua)+)?``.

    Dynamic programming over rows and places: the best prefix of each place is a node of ``Prefixes``. Prefixes that
    reach one place with one cost are never each other's beginning (inserts cost), so the lesser one stays so
    whatever follows. Places that cost over 5 more than the cheapest are never on the best way and are dropped.
    """
    tree = Prefixes()
    delete, insert, keep, rerole = b"DIKR"

    def offer(held, place, cost, parent, letter):
        old = held.get(place)
        if old is None or cost < old[0] or (cost == old[0] and tree.before(parent, letter, old[1], old[2])):
            held[place] = (cost, parent, letter)

    def settled(held):
        low = min(cost for cost, _, _ in held.values())
        heads = {p: (c, tree.add(n, letter) if letter else n) for p, (c, n, letter) in held.items() if c <= low + _DEAREST}
        for _ in range(2):  # at most two inserts in a row lead anywhere new
            for place, (cost, node) in list(heads.items()):
                if cost + 2 > low + _DEAREST:
                    continue
                target = _NEXT[place]
                old = heads.get(target)
                if old is None or cost + 2 < old[0] or (cost + 2 == old[0] and tree.before(node, insert, old[1], 0)):
                    heads[target] = (cost + 2, tree.add(node, insert))
        return heads

    heads = settled({_START: (0, 0, 0)})
    for code in codes:
        kind, initial = divmod(code, 4)
        held: dict = {}
        for place, (cost, node) in heads.items():
            offer(held, place, cost + 3, node, delete)
            if kind in (BLANK, DUPLICATE):
                continue
            more = cost + (kind == TRUNCATED)
            if initial in _KEEPS[place]:
                offer(held, _KEEPS[place][initial], more, node, keep)
            offer(held, _NEXT[place], more + 2, node, rerole)
        heads = settled(held)
    ends = [heads[p] for p in (_START, _ASSISTANT) if p in heads]
    best = ends[0]
    for cost, node in ends[1:]:
        if cost < best[0] or (cost == best[0] and tree.before(node, 0, best[1], 0)):
            best = (cost, node)
    return best[0], tree.text(best[1])


@lru_cache(maxsize=1 << 16)
def _short_edits(codes: bytes) -> tuple[int, str]:
    return cheapest_edits(codes)


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text`` with planted faults, chosen by crc32(``conv:turn``) mod 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    marked = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
        fault.alias("fault")).where("fault <> 0")
    return marked.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _streamed(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *order)


_ORDER = ("turn", "role", "text")  # ascending, nulls first


def _rows(batches, names):
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows(conv, turn, role, text)``: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows come in the order of turns, nulls first; rows of one turn by role, then text. Whether role and text were
    seen at an earlier turn is an aggregate that combines on the map side, so no task holds a conversation's texts; a
    task then streams its conversations in order and holds one byte a row, and the nodes of the edits (some
    logarithm of the rows each) of one conversation.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    marked = rows.withColumn("mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    firsts = marked.groupBy(F.col("conv").alias("_conv"), F.col("mark").alias("_mark")).agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = marked.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")), "left").select(
        "conv", "turn", "role", "text", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("later"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([*[(n, pa.int64()) for n in names], ("audit", pa.string())])

    def run(batches):
        out, now, codes, turns, count, last = [], None, bytearray(), None, None, None

        def done():
            cost, audit = (_short_edits if len(codes) <= 40 else cheapest_edits)(bytes(codes))
            gaps = min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1) if turns[2] else 0
            out.append((now[0], gaps, *count, cost, audit))

        def flush(type_):
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], type_), *[pa.array(c, f.type) for c, f in zip(columns[1:], schema)]],
                schema=schema.insert(0, pa.field("conv", type_)))

        def batches_of_rows():
            nonlocal now, codes, turns, count, last
            type_ = pa.int64()
            for batch in batches:
                type_ = batch.schema.field("conv").type
                for conv, turn, role, text, later in _rows([batch], ["conv", "turn", "role", "text", "later"]):
                    if now is None or now[0] != conv:
                        if now is not None:
                            done()
                        now, codes, turns, count, last = (conv,), bytearray(), [0, 0, 0], [0, 0, 0, 0], None
                    words = text.strip(WORD_SPACE)
                    fault = CLEAN
                    if not words:
                        fault = BLANK
                    elif later or last == (turn, role, text):
                        fault = DUPLICATE
                    elif words[-1] not in ".!?":
                        fault = TRUNCATED
                    if fault:
                        count[fault - 1] += 1
                    if last is not None and (last[1][:1], role[:1]) not in (("s", "u"), ("u", "a"), ("a", "u")):
                        count[3] += 1
                    if turn is not None and (last is None or last[0] != turn):
                        turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                    codes.append(4 * fault + _INITIALS.get(role[:1], 3))
                    last = (turn, role, text)
                if len(out) >= 1000:
                    yield flush(type_)
            if now is not None:
                done()
            if out:
                yield flush(type_)

        yield from batches_of_rows()

    return _streamed(seen, *_ORDER).mapInArrow(
        run, f"conv {kind}, {', '.join(n + ' long' for n in names)}, audit string")


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``conv, place, role, text``: the rows of each conversation after the edits of ``audits``; ``place`` counts from 0.

    A conversation's audit comes first in its task, then its rows in the order in which they were audited; texts
    pass through.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    both = rows.select("conv", F.lit(1).alias("side"), "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        audited.select("conv", F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                       F.lit("").alias("text"), "audit"))

    def run(batches):
        audit, at, place, expect = "", 0, 0, "user"

        for batch in batches:
            out = []

            def put(conv, role, text):
                nonlocal place, expect
                out.append((conv, place, role, text))
                place, expect = place + 1, "assistant" if role[:1] == "u" else "user"

            def inserts(conv):
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put(conv, expect, "")
                    at += 1

            for conv, side, role, text, edits in _rows([batch], ["conv", "side", "role", "text", "audit"]):
                if side == 0:
                    audit, at, place, expect = edits, 0, 0, "user"
                    inserts(conv)
                    continue
                letter, at = audit[at], at + 1
                if letter == "K":
                    put(conv, role, text)
                elif letter == "R":
                    put(conv, expect, text)
                inserts(conv)
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("conv").type), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["conv", "place", "role", "text"])

    return _streamed(both, "side", *_ORDER).mapInArrow(run, f"conv {kind}, place long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """``conv, sha256`` of each conversation's ``role:text`` in the order of ``place``, joined by newlines.

    A digest is a matter of order: one task passes a conversation's texts through, and holds one of them.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        now = state = None
        for batch in batches:
            out = []
            for conv, role, text in _rows([batch], ["conv", "role", "text"]):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append((now[0], state.hexdigest()))
                    now, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            type_ = batch.schema.field("conv").type
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in out], type_), pa.array([s for _, s in out], pa.string())], names=["conv", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]], type_), pa.array([state.hexdigest()], pa.string())], names=["conv", "sha256"])

    return rows.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, f"conv {kind}, sha256 string")


def repair_conversations(rows: DataFrame, all_convs: DataFrame | None = None) -> DataFrame:
    """``audits`` with ``sha256`` of each repaired conversation, for all of ``all_convs(conv)`` if given.

    ``rows``: ``conv, turn, role, text``, none null but conv and turn; other columns are not read. A conversation without
    rows has zeros, an empty audit and the digest of nothing. A null conversation is one like any other. Repeated rows
    are duplicates; an empty table gives no rows.
    """
    rows = rows.select("conv", "turn", "role", "text")
    audited = stored(audits(rows), "audits")
    hashes = digests(repaired(rows, audited)).withColumnRenamed("conv", "_conv")
    out = audited
    if all_convs is not None:
        out = all_convs.select(F.col("conv").alias("_all")).distinct().join(
            audited, F.col("_all").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("_all", "conv")
    out = out.join(hashes, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in zeros], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("sha256"))
