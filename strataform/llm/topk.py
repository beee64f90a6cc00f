"""Exact top-k search by distributed histogram selection (operator 5)."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.common import stored

#: Up to this many bytes of query blocks are broadcast; more are shuffled.
BROADCAST_BYTES = 32 << 20


def quantised(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``id, x array<double>``: floor(scale * component). Rows whose vector is null, or holds a null or
    a value that is not finite, are left out."""
    exact = F.transform(vector, lambda v: v.cast("double"))
    fine = F.col(vector).isNotNull() & ~F.exists(
        exact, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return df.where(F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(exact, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows as blocks ``block, n, dims, bound, ids, data``; each is packed where its rows are, without a shuffle.

    Vectors of different length are in different blocks, so that scores exist between equal lengths only.
    """
    def run(batches):
        import numpy as np

        def packed(ids, vectors, dims):
            data = np.asarray(vectors, np.float64).reshape(len(vectors), dims)
            # a null id sorts behind all others
            own = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
            order = np.argsort(own, kind="stable")
            data = data[order]
            bound = float(np.abs(data).sum(axis=1).max()) if dims else 0.0
            bound = max(bound, float(np.abs(data).max()) if dims else 0.0)
            return uuid.uuid4().hex, len(ids), dims, bound, own[order].tobytes(), data.tobytes()

        schema = pa.schema([("block", pa.string()), ("n", pa.int64()), ("dims", pa.int32()), ("bound", pa.float64()),
                            ("ids", pa.binary()), ("data", pa.binary())])
        open_: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for own, vector in zip(batch.column("id").to_pylist(), batch.column("x")):
                dims = len(vector.values)
                ids, vectors = open_.setdefault(dims, ([], []))
                ids.append(own)
                vectors.append(vector.values.to_numpy(zero_copy_only=False))
                if len(ids) == most:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, packed(ids, vectors, dims)))], schema)
                    del open_[dims]
        for dims, (ids, vectors) in open_.items():
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, packed(ids, vectors, dims)))], schema)

    return rows.mapInArrow(run, "block string, n long, dims int, bound double, ids binary, data binary")


def _scores(queries, candidates, dims: int):
    """Integer inner products of two float matrices. Doubles are exact below 2**53; beyond, Python's
    integers are used, and scores that leave the range of a long are set to its ends."""
    import numpy as np

    if dims == 0:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(candidates).sum(axis=1).max())
    if most < 2.0 ** 53:
        return (queries @ candidates.T).astype(np.int64)
    ints = [[[int(v) for v in row] for row in m] for m in (queries, candidates)]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(high, max(low, sum(a * b for a, b in zip(q, c)))) for c in ints[1]] for q in ints[0]], np.int64)


def _pairs(batches):
    """Scores of every query block with every candidate block of a stream: ``query block, its ids, own, ids, scores``."""
    import numpy as np

    for batch in batches:
        for row in range(batch.num_rows):
            get = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
            dims = get["dims"]
            queries = np.frombuffer(get["q_data"]).reshape(get["q_n"], dims)
            candidates = np.frombuffer(get["data"]).reshape(get["n"], dims)
            q_ids, ids = np.frombuffer(get["q_ids"], np.int64), np.frombuffer(get["ids"], np.int64)
            scores = _scores(queries, candidates, dims)
            yield get, q_ids, ids, scores, q_ids[:, None] != ids[None, :]


def top_k(
    df: DataFrame, key: str, vector: str, k: int = 5, every: int = 50, scale: int = 256, bins: int = 256,
    query_rows: int = 512, block_rows: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` greatest scores, ties to the smaller id.

    Queries: rows whose key is divisible by ``every``; candidates: all rows with another key and as
    many components. Score: inner product of ``floor(scale * component)``.

    1. Rows become blocks; every query block meets every candidate block (a stated query set in
       blocks). Query blocks are broadcast while their bytes are below a checked bound; beyond it only
       their names are, and both sides are shuffled by query block, where AQE splits what is large.
    2. Histogram rounds: each task counts its scores by query and bin of the query's present range;
       counts are summed over tasks; the bin that holds the k-th greatest score becomes the next
       range. A range of integers ends after ``log_bins(range)`` rounds, at one value: the k-th score.
    3. One filter: scores above it are kept (fewer than ``k``), and of those equal to it the ``k``
       smallest ids of each task. One ordering over what is left gives ranks.

    Ties therefore cost no more than ``k`` rows per query and task. Repeated rows are candidates one
    by one; a query that repeats with one and the same vector answers once; two different vectors
    under one key answer as one query each. Null keys ask nothing and lose every tie.
    """
    rows = quantised(df, key, vector, scale)
    asked = stored(rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "x"]), "asked")
    many = asked.count()
    queries = asked.repartition(max(1, -(-many // query_rows)), F.xxhash64("id", "x"))
    queries = stored(_blocks(queries, query_rows).select(
        F.col("block").alias("q_block"), F.col("n").alias("q_n"), "dims", F.col("bound").alias("q_bound"),
        F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "query-blocks")
    blocks = stored(_blocks(rows, block_rows), "blocks")
    of_candidates = blocks.groupBy("dims").agg(F.max("bound").alias("bound"))
    known = {r["dims"]: r["bound"] for r in of_candidates.collect()}  # one row per vector length
    names = queries.agg(
        F.sum(F.octet_length("q_data") + F.octet_length("q_ids")).alias("bytes"), F.max("q_bound").alias("bound")).first()
    small = (names["bytes"] or 0) <= BROADCAST_BYTES

    # |score| <= (sum of a query's components) * (greatest candidate component) <= product of the bounds
    top = int(min(2.0 ** 63 - 1, (names["bound"] or 0.0) * max(known.values(), default=0.0))) + 1
    top = min(top, (1 << 63) - 1)

    def met(ranges: DataFrame | None) -> DataFrame:
        asks = queries if ranges is None else queries.join(ranges, "q_block")
        if small:
            return blocks.join(F.broadcast(asks), "dims")
        names = F.broadcast(queries.select("q_block", "dims"))  # some 40 bytes for each query_rows queries
        return blocks.join(names, "dims").join(asks.drop("dims"), "q_block")

    schema = "q_block string, place int, bin int, n long"
    ranges = None
    low, high = -top, top + 1
    rounds = 0
    span = high - low
    while span > 1:
        span = -(-span // bins)
        rounds += 1

    for turn in range(rounds):
        def histogram(batches, first=turn == 0):
            import numpy as np

            sums: dict[str, np.ndarray] = {}
            for get, q_ids, _, scores, other in _pairs(batches):
                n = len(q_ids)
                begin = np.full(n, low, object) if first else np.array(get["low"], object)
                width = np.full(n, -(-(high - low) // bins), object) if first else np.array(get["width"], object)
                begin, width = begin.astype(np.int64)[:, None], np.maximum(width.astype(np.int64), 1)[:, None]
                above = scores.view(np.uint64) - begin.view(np.uint64)  # right for scores from begin on, however far
                step = above // width.astype(np.uint64)
                inside = other & (scores >= begin) & (step < bins)
                if not first:  # not what stands above the range: it has been counted off
                    inside &= above < np.array(get["span"], np.uint64)[:, None]
                flat = (np.arange(n)[:, None] * bins + np.where(inside, step, 0).astype(np.int64))[inside]
                got = np.bincount(flat, minlength=n * bins).reshape(n, bins)
                old = sums.get(get["q_block"])
                sums[get["q_block"]] = got if old is None else old + got
            for block, got in sums.items():
                place, bin_ = np.nonzero(got)
                yield pa.record_batch({
                    "q_block": pa.array([block] * len(place), pa.string()), "place": pa.array(place.astype(np.int32)),
                    "bin": pa.array(bin_.astype(np.int32)), "n": pa.array(got[place, bin_])})

        counted = met(ranges).mapInArrow(histogram, schema).groupBy("q_block", "place", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("q_block", "place").orderBy(F.desc("bin")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        found = counted.withColumn("to_here", F.sum("n").over(above))
        if ranges is None:
            before = queries.select("q_block", F.posexplode(F.sequence(F.lit(1), F.col("q_n").cast("int"))).alias(
                "place", "_")).select("q_block", "place", F.lit(low).cast("long").alias("low"),
                                     F.lit(-(-(high - low) // bins)).cast("long").alias("width"), F.lit(k).cast("long").alias("want"))
        else:
            before = ranges.select("q_block", F.posexplode(F.arrays_zip("low", "width", "want")).alias("place", "r")).select(
                "q_block", "place", "r.low", "r.width", "r.want")
        chosen = (
            before.join(found, ["q_block", "place"], "left").groupBy("q_block", "place", "low", "width", "want").agg(
                F.max(F.when(F.col("to_here") >= F.col("want"), F.struct("bin", "to_here", "n"))).alias("hit"))
        )
        # fewer than k candidates in all: everything from the least score on is wanted
        narrowed = chosen.select(
            "q_block", "place",
            F.when(F.col("hit").isNull(), F.col("low")).otherwise(
                F.col("low") + F.col("hit.bin").cast("decimal(20,0)") * F.col("width")).cast("long").alias("low"),
            F.greatest(F.lit(1), F.ceil(F.col("width") / bins)).cast("long").alias("width"), F.col("width").alias("span"),
            F.when(F.col("hit").isNull(), F.col("want")).otherwise(
                F.col("want") - (F.col("hit.to_here") - F.col("hit.n"))).alias("want"),
        )
        ranges = stored(narrowed.groupBy("q_block").agg(
            F.sort_array(F.collect_list(F.struct("place", "low", "width", "span", "want"))).alias("r")).select(
            "q_block", *[F.col(f"r.{c}").alias(c) for c in ("low", "width", "span", "want")]), "ranges")

    def kept(batches):
        import numpy as np

        best: dict[tuple[str, int], list] = {}
        for get, q_ids, ids, scores, other in _pairs(batches):
            least = np.array(get["low"], np.int64)[:, None]
            place, at = np.nonzero(other & (scores >= least))
            tied = scores[place, at] == least[place, 0]
            first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.empty(0, bool)
            starts = np.flatnonzero(first)
            run = np.cumsum(tied)
            base = np.repeat(run[starts] - tied[starts], np.diff(np.r_[starts, len(place)])) if len(place) else run
            use = ~tied | (run - base <= k)  # ids ascend in a block: the first k ties are the smallest
            for p, a in zip(place[use].tolist(), at[use].tolist()):
                best.setdefault((get["q_block"], p), [int(q_ids[p])]).append((-int(scores[p, a]), int(ids[a])))
                held = best[get["q_block"], p]
                if len(held) > 8 * k:
                    best[get["q_block"], p] = [held[0], *sorted(held[1:])[:k]]
        rows = [(b, p, held[0], i, -s) for (b, p), held in best.items() for s, i in sorted(held[1:])[:k]]
        b, p, q, i, s = zip(*rows) if rows else ((),) * 5
        yield pa.record_batch({
            "q_block": pa.array(b, pa.string()), "place": pa.array(p, pa.int32()), "query_id": pa.array(q, pa.int64()),
            "vec_id": pa.array([None if x == (1 << 63) - 1 else x for x in i], pa.int64()), "score": pa.array(s, pa.int64())})

    left = met(ranges).mapInArrow(kept, "q_block string, place int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
