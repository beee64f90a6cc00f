"""Token ids as length-delimited binary records with an offset index (operator 10).

A record: length of the payload (unsigned 64-bit), masked checksum of those 8 bytes (32-bit), the
payload, masked checksum of the payload; all little-endian. The payload: 1 byte (bit 0: a key
follows), the key (signed 64-bit, 0 if null), 1 byte (bytes per id, 2 or 4), the ids. The checksum is
CRC-32, masked by rotating it right by 15 bits and adding a constant, so that a checksum of
checksums is safe. No CRC-32C is at hand that is fast enough here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.chunks import batched
from strataform.llm.common import scratch_path, stored
from strataform.llm.packing import encoded, library_encoder

#: Fixed value: what masking adds.
MASK = 0xA282EAD8
_HEAD, _KEY = struct.Struct("<QI"), struct.Struct("<BqB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload(key: int | None, ids: bytes, width: int) -> bytes:
    return _KEY.pack(key is not None, key or 0, width) + ids


def unframe(file, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """``(offset, payload)`` of each record from a file's present place ``at`` on; damage raises."""
    while head := file.read(_HEAD.size):
        if len(head) < _HEAD.size or masked(head[:8]) != (told := _HEAD.unpack(head))[1]:
            raise ValueError(f"damaged record length at byte {at}")
        body, tail = file.read(told[0]), file.read(4)
        if len(body) < told[0] or len(tail) < 4 or masked(body) != struct.unpack("<I", tail)[0]:
            raise ValueError(f"damaged record at byte {at}")
        yield at, body
        at += _HEAD.size + len(body) + 4


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(
    df: DataFrame, key: str, text: str, path: str, end_id: int, folder: str | None = None, width: int = 2,
) -> DataFrame:
    """Writes the ids of every row's text and ``end_id`` to record files, ascending by ``key`` (a long).

    Returns the stored index ``part, file, key, offset, at, n_tokens``: ``at`` counts the ids before
    the record in its file, ``offset`` its bytes. Files follow each other by ``part``.

    Quantiles of the key, taken from its column alone, cut the rows into as many parts as the
    input has partitions. A key that repeats over several quantiles is dealt over all parts that
    it spans, so a hot key meets in no single file. Ids travel compressed. A task that runs again
    writes files of new names; the index names those that count. Null keys come first, null texts
    are empty. ``folder`` (default: a fresh one in the shared folder) may be any location that
    Arrow's file systems open.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    cuts = rows.agg(F.percentile_approx(
        "key", F.array(*[F.lit(n / parts) for n in range(1, parts)]), F.lit(10_000))).first()[0] if parts > 1 else []
    cuts = sorted(c for c in cuts or [])
    folder = folder or scratch_path(spark, "records")
    system, inside = _opened(folder)
    system.create_dir(inside, recursive=True)

    def coded(batches):
        import bisect

        import zstandard

        encoder, end, turn = library_encoder(path, width), end_id.to_bytes(width, "little"), 0
        shrink = zstandard.ZstdCompressor(level=1).compress

        def one(batch):
            nonlocal turn
            for value, ids in zip(batch.column("key").to_pylist(), encoded(encoder, batch.column("text"), width)):
                low, high = (0, 0) if value is None else (bisect.bisect_left(cuts, value), bisect.bisect_right(cuts, value))
                part, turn = low + turn % (high - low + 1), turn + 1
                yield part, value, shrink(ids + end)

        for batch in batches:
            yield from batched(one(batch), pa.schema([("part", pa.int32()), ("key", pa.int64()), ("ids", pa.binary())]))

    index_schema = pa.schema([
        ("part", pa.int32()), ("file", pa.string()), ("key", pa.int64()), ("offset", pa.int64()), ("at", pa.int64()),
        ("n_tokens", pa.int64())])

    def written(batches):
        import uuid

        import zstandard

        restore = zstandard.ZstdDecompressor().decompress
        system, inside = _opened(folder)
        file, now, offset, at, name = None, None, 0, 0, ""

        def lines():
            nonlocal file, now, offset, at, name
            for batch in batches:
                for part, value, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "ids"))):
                    if part != now:
                        if file is not None:
                            file.close()
                        now, offset, at, name = part, 0, 0, f"part-{part:06d}-{uuid.uuid4().hex}.rec"
                        file = system.open_output_stream(f"{inside}/{name}")
                    ids = restore(ids)
                    record = frame(payload(value, ids, width))
                    file.write(record)
                    yield part, name, value, offset, at, len(ids) // width
                    offset, at = offset + len(record), at + len(ids) // width
            if file is not None:
                file.close()

        yield from batched(lines(), index_schema)

    dealt = rows.mapInArrow(coded, "part int, key long, ids binary")
    index = dealt.repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("key")).mapInArrow(
        written, "part int, file string, key long, offset long, at long, n_tokens long")
    return stored(index.withColumn("folder", F.lit(folder)), "record-index")


def _ids(body: bytes) -> tuple[int | None, bytes]:
    import numpy as np

    has, key, width = _KEY.unpack_from(body)
    return (key if has else None), np.frombuffer(body, f"<u{width}", offset=_KEY.size).astype("<u4").tobytes()


def read_records(index: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids`` of all records, from the files that ``index`` names.

    ``start`` counts the ids of all records before it; ``ids``: little-endian unsigned 32-bit. Every
    checksum is verified. One task reads one file; a running sum over files (one row each) gives the
    files' bases.
    """
    files = index.groupBy("folder", "part", "file").agg(F.sum("n_tokens").alias("n"))
    files = stored(files.withColumn(
        "base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("folder", "file", "base"), "record-files")

    def run(batches):
        def lines():
            for batch in batches:
                for folder, name, base in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "base"))):
                    system, inside = _opened(folder)
                    with system.open_input_stream(f"{inside}/{name}", buffer_size=1 << 20) as file:
                        for _, body in unframe(file):
                            key, ids = _ids(body)
                            yield key, base, len(ids) // 4, ids
                            base += len(ids) // 4

        yield from batched(lines(), pa.schema([
            ("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    count = max(1, files.count())
    return files.repartition(count, "file").mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def read_shuffled(index: DataFrame, seed: int) -> DataFrame:
    """``turn, key, ids`` of all records, fetched one by one through the index in a random order.

    ``turn`` is a hash of seed and place: sorting by it is the order of reading.
    """
    wanted = index.withColumn("turn", F.xxhash64(F.lit(seed), "file", "offset"))

    def run(batches):
        def lines():
            for batch in batches:
                for folder, name, offset, turn in zip(
                        *(batch.column(c).to_pylist() for c in ("folder", "file", "offset", "turn"))):
                    system, inside = _opened(folder)
                    with system.open_input_file(f"{inside}/{name}") as file:
                        file.seek(offset)
                        key, ids = _ids(next(unframe(file, offset))[1])
                        yield turn, key, ids

        yield from batched(lines(), pa.schema([("turn", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())]))

    return wanted.repartition("turn").sortWithinPartitions("turn").select(
        "folder", "file", "offset", "turn").mapInArrow(run, "turn long, key long, ids binary")
