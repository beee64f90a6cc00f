"""Whitening of embeddings by the principal components that FEAST contour integration finds (operator 13)."""

from __future__ import annotations

import decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import stored

SCALE, SHIFT = 1024, 100_000
_LARGEST = 2.0 ** 52  # scaled entries below it are whole numbers that doubles and longs hold alike


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, x array<long>``: floor(1024 * entry) + 100000, of vectors without null, non-finite or too large entries."""
    exact = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.size(vector).__gt__(0) & ~F.exists(
        exact, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= F.lit(_LARGEST / SCALE)))
    return df.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(key).alias("key"), F.transform(exact, lambda v: (F.floor(v * SCALE) + SHIFT).cast("long")).alias("x"))


def positives(matrix) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the inertia of its block LDL' with Bunch-Parlett pivots."""
    import numpy as np

    a = matrix.copy()
    count = 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), n)
        if diagonal[p] == 0 and off[r, s] == 0:
            break
        if diagonal[p] >= 0.6404 * off[r, s]:  # (1 + sqrt(17)) / 8
            rest = np.delete(np.arange(n), p)
            count += a[p, p] > 0
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:
            rest = np.delete(np.arange(n), [r, s])
            block, columns = a[np.ix_([r, s], [r, s])], a[np.ix_(rest, [r, s])]
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            count += 1 if determinant < 0 else 2 * (block[0, 0] + block[1, 1] > 0)
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return int(count)


def feast(matrix, most: int, nodes: int = 12, rounds: int = 40):
    """The ``most`` greatest eigenvalues (falling) and unit eigenvectors of a symmetric matrix without negative ones.

    Inertia counts bisect for the interval that holds them and end it in the middle of the gap below. The spectral projector
    onto the interval is a Gauss-Legendre quadrature of complex shifted solves along a half circle; Rayleigh-Ritz on the
    projected basis gives the pairs, again until residuals are at rounding level and as many values lie in the
    interval as the inertia says. Where equal values cross the border, the interval takes them all and the first ones stay.
    Eigenvalues below 1e-12 of the trace count as zero and have no component.
    """
    import numpy as np

    d = len(matrix)
    scale = float(np.trace(matrix))
    if not scale > 0:
        return np.empty(0), np.empty((d, 0))
    a = matrix / scale  # eigenvalues add up to 1
    above = lambda x: positives(a - x * np.eye(d))
    floor, top = 1e-12, 1.0 + 1e-6
    wanted = min(most, d, above(floor))
    low, high = floor, top  # at least `wanted` above low, fewer above high
    for _ in range(200):
        middle = (low * high) ** 0.5 if high > 4 * low else (low + high) / 2
        if above(middle) >= wanted:
            low = middle
        else:
            high = middle
        if high - low <= 1e-14 * high:
            break
    inside = above(low)
    begin, end = 0.0, low  # the gap below: nothing between end and the greatest value that is outside
    if inside < d:
        for _ in range(40):
            middle = (begin + end) / 2
            if above(middle) > inside:
                begin = middle
            else:
                end = middle
        border = (end + low) / 2 if end > 0 else low / 2
    else:
        border = low / 2
    inside = above(border)
    centre, radius = (border + top) / 2, (top - border) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angles = -np.pi / 2 * (points - 1)
    size = min(d, 2 * inside + 8)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((d, size)))[0]
    for turn in range(rounds):
        projected = np.zeros_like(basis)
        for angle, weight in zip(angles, weights):
            z = centre + radius * np.exp(1j * angle)
            projected += weight / 2 * (radius * np.exp(1j * angle) * np.linalg.solve(z * np.eye(d) - a, basis.astype(complex))).real
        q, sizes, _ = np.linalg.svd(projected, full_matrices=False)
        q = q[:, sizes > 1e-14 * sizes[0]]
        values, turned = np.linalg.eigh(q.T @ a @ q)
        vectors = q @ turned
        held = values > border
        wrong = np.linalg.norm(a @ vectors[:, held] - vectors[:, held] * values[held], axis=0)
        if held.sum() == inside and wrong.max(initial=0.0) <= 4e-15:
            break
        if turn % 8 == 7 and size < d:  # too many values close to the border: a wider basis
            size = min(d, 2 * size)
            more = np.random.default_rng(turn).standard_normal((d, size - vectors.shape[1]))
            vectors = np.concatenate([vectors, more], axis=1)
        basis = np.linalg.qr(vectors)[0]
    else:
        if held.sum() != inside or wrong.max(initial=0.0) > 1e-10:
            raise RuntimeError(f"{int(held.sum())} of {inside} components found")
    order = np.argsort(-values[held], kind="stable")[:wanted]
    values, vectors = values[held][order], vectors[:, held][:, order]
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


def _matrix(batch):
    import numpy as np

    return batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def _summed(partial, width: int):
    """The sums of rows ``i, v array<double>`` by ``i``, each added up by one task, as a matrix on the driver."""
    import numpy as np

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v")):
                v = v.values.to_numpy()
                sums[i] = sums[i] + v if i in sums else v.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], names=["i", "v"])

    out = np.zeros((width, width))
    for row in partial.repartition("i").mapInArrow(run, "i int, v array<double>").collect():  # width rows
        out[row["i"]] = row["v"]
    return out


def _products(rows: DataFrame, column: str, centred):
    """Rows ``i, v``: each task's sum of outer products of ``centred(matrix)``, one row of it a row."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = centred(batch)
                total = z.T @ z + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return rows.select(column).mapInArrow(run, "i int, v array<double>")


def whiten(df: DataFrame, key: str, vector: str, most: int = 8) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that are null or empty, hold a null or non-finite entry, or one of 2**42 or more, take no part, nor do those of
    other than the most frequent length (ties: the greater). Entries become whole numbers; counts, sums and deviations are
    exact (a deviation beyond a long is null). Passes over the stored rows give the sums, the covariance (entries centred before
    they are multiplied, one partial matrix a task) and the whitened columns. What reaches the driver has the size
    of the covariance, the square of the vectors' length, whatever the rows; ``feast`` finds the components there.

    Components whose eigenvalue is below 1e-12 of the trace have no rows: none, if all vectors are equal. Rows that repeat and null
    keys stay; an empty table gives no rows; other columns are not read.
    """
    import numpy as np

    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    empty = spark.createDataFrame(
        [], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = stored(whole_vectors(df, key, vector), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return empty
    d, n = lengths["d"], lengths["n"]
    rows = rows.where(F.size("x") == d)

    def added(batches):
        sums = np.zeros(d, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            small = int(np.abs(x).max()) * len(x) < 1 << 62
            sums = sums + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([decimal.Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], names=["i", "s"])

    totals = rows.select("x").mapInArrow(added, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(d, object)
    for row in totals:  # one a dimension
        sums[row["i"]] = int(row["s"])
    near = np.array([int(s) // n for s in sums], np.int64)  # whole part of the mean, then the rest: both subtract exactly
    rest = np.array([(int(s) % n) / n for s in sums])

    def centred(batch):
        return (_matrix(batch) - near).astype(np.float64) - rest

    covariance = _summed(_products(rows, "x", centred), d) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = feast(covariance, most)
    if not len(values):
        return empty
    projection = vectors / np.sqrt(values)

    def projected(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            exact = max(int(x.max()), -int(x.min())) * n + max(map(abs, sums))
            if exact * exact * d < 1 << 63:
                deviation = ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [int(s) for s in ((x.astype(object) * n - sums) ** 2).sum(axis=1)]
                deviation = [s if s < 1 << 63 else None for s in deviation]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(deviation, pa.int64()),
                 pa.array((centred(batch) @ projection).tolist(), pa.list_(pa.float64()))], names=["key", "deviation", "w"])

    done = stored(rows.mapInArrow(projected, f"key {kind}, deviation long, w array<double>"), "whitened")
    k = len(values)
    means = np.array(done.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first())

    def off(batch):
        return batch.column("w").flatten().to_numpy().reshape(batch.num_rows, k) - means

    error = float(np.abs(_summed(_products(done, "w", off), k) / n - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    spread = done.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return spread.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
