"""Whitening of vectors by their leading principal components.

Sums and the centred covariance are taken by Spark, one partial state a partition, added in rounds of ``FAN``
states, so the driver sees a few matrices of the vectors' dimension however many rows there are. The driver
reduces that matrix to tridiagonal form by Householder reflections, finds the leading eigenvalues by bisection over Sturm
counts, and their vectors by inverse iteration, made orthogonal again within clusters of eigenvalues.
Every row is then projected on the shared components.

Entries become whole numbers, so sums, centred entries and deviations are exact at any size.
"""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, query, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN = 64                # partial states added by one task
RANK = 1e-10            # components below this share of the largest eigenvalue are rounding
OUT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix; reflector k acts on rows k + 1 and on."""
    a, reflectors = np.array(matrix, dtype=np.float64), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        v[0] += math.copysign(length, v[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            rest = a[k + 1:, k + 1:]
            p = 2 * rest @ v
            w = p - (p @ v) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = -math.copysign(length, a[k + 1, k])
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each x: negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off ** 2, initial=0.0)))
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = d - x - e * e / np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def largest_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling; each interval is halved until doubles end."""
    n = len(diagonal)
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    high += np.abs(high) * 1e-15 + 1e-300
    rank = n - 1 - np.arange(k)             # so many lie below the wanted one
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        above = below(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves (T - shift) x = b by elimination with row exchanges."""
    n = len(diagonal)
    a, b, c, swapped, factor = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, [False] * n, [0.0] * n
    for i in range(n - 1):
        e = float(off[i])
        if abs(a[i]) < abs(e):
            swapped[i] = True
            factor[i] = a[i] / e
            a[i], b[i], c[i], a[i + 1], b[i + 1] = e, a[i + 1], b[i + 1], b[i] - factor[i] * a[i + 1], -factor[i] * b[i + 1]
        else:
            a[i] = a[i] if abs(a[i]) > least else least
            factor[i] = e / a[i]
            a[i + 1] -= factor[i] * b[i]
    a[-1] = a[-1] if abs(a[-1]) > least else least

    def solve(rhs):
        y = rhs.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            y[i] = (y[i] - (b[i] * y[i + 1] if i + 1 < n else 0) - (c[i] * y[i + 2] if i + 2 < n else 0)) / a[i]
        return np.array(y)

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors, one column for each of the falling ``values``."""
    n, draw = len(diagonal), np.random.default_rng(13)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    least, gap = np.finfo(float).eps * norm, 1e-3 * norm
    out, first, shift = np.zeros((n, len(values))), 0, math.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > gap:
            first = k                       # a new cluster
        shift = min(value, shift - 4 * least) if k > first else value
        solve, x = _solver(diagonal, off, shift, least), draw.normal(size=n)
        for _ in range(rounds):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                x = x / np.linalg.norm(x)
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, the k largest, falling."""
    diagonal, off, reflectors = tridiagonal(matrix)
    values = largest_values(diagonal, off, min(k, len(diagonal)))
    vectors = vectors_of(diagonal, off, values)
    for place, v in reversed(list(enumerate(reflectors))):
        vectors[place + 1:] -= 2 * np.outer(v, v @ vectors[place + 1:])
    return values, vectors / np.linalg.norm(vectors, axis=0)


def tree_sum(states: DataFrame, fan: int = FAN) -> np.ndarray | None:
    """Sum of the arrays in ``state``, all of one length; None without rows."""
    kind = dict(states.dtypes)["state"]

    def add(batches):
        total = None
        for batch in batches:
            for row in batch["state"]:
                values = row.values.to_numpy(zero_copy_only=False)
                total = values.copy() if total is None else total + values
        if total is not None:
            yield pa.record_batch({"state": pa.array([total], batch_type)})

    batch_type = pa.list_(pa.int64() if "bigint" in kind else pa.float64())
    left = materialise(states)
    while (rows := left.count()) > fan:
        left = materialise(left.repartition(-(-rows // fan)).mapInArrow(add, f"state {kind}"))
    found = [np.array(r["state"]) for r in left.collect()]
    return np.sum(found, axis=0) if found else None


def _matrix(column, dims: int) -> np.ndarray:
    """The rows as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _states(rows: DataFrame, state, kind: str) -> DataFrame:
    """One row a partition: the sum of ``state(batch)``."""
    type_ = pa.list_(pa.int64() if kind == "bigint" else pa.float64())

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                values = state(batch)
                total = values if total is None else total + values
        if total is not None:
            yield pa.record_batch({"state": pa.array([total], type_)})

    return rows.mapInArrow(run, f"state array<{kind}>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Null vectors and those with null or non-finite entries are dropped. A vector shorter than the longest lacks
    entries, which count as null. Repeated rows and null vec_ids are rows like others. Components whose
    eigenvalue is rounding (constant or dependent dimensions, a single vector) are left out, so there can be fewer
    than ``components``, or no rows at all, as for an empty table. An entry whose ``SCALE``-fold fits no long is an
    error. ``deviation`` is a decimal, as it outgrows a long at about 10^9 rows.
    """
    spark = vectors.sparkSession
    x = F.col(column)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("v")).where(
        x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    dims, low, high = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not dims:
        return spark.createDataFrame([], OUT)
    if max(abs(low), abs(high)) * SCALE >= 2.0 ** 62:
        raise ValueError("an entry is too large for a long")
    rows = rows.where(F.size("v") == dims)

    def sums(batch):                        # two halves of each number, so that no sum overflows
        m = _matrix(batch["v"], dims)
        return np.concatenate([[len(m)], (m >> 32).sum(0), (m & 0xFFFFFFFF).sum(0)])

    total = tree_sum(_states(rows, sums, "bigint")).tolist()
    n = total[0]
    S = [(a << 32) + b for a, b in zip(total[1:dims + 1], total[dims + 1:])]
    widest = n * int(SCALE * (float(high) - float(low)) + 2)          # no |n * x - S| is larger
    small = n * (int(SCALE * max(abs(low), abs(high))) + SHIFT + 1) < 2 ** 62
    plain = small and dims * widest ** 2 < 2 ** 62

    def centred(column):
        """n * x - S, exact, and x - S / n."""
        m = _matrix(column, dims)
        y = n * m - np.array(S, dtype=np.int64) if small else n * m.astype(object) - np.array(S, dtype=object)
        return y, y.astype(np.float64) / n

    def products(batch):
        y = centred(batch["v"])[1]
        return (y.T @ y).ravel()

    covariance = tree_sum(_states(rows, products, "double")).reshape(dims, dims) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading(covariance, components)
    rank = int((values > RANK * values[0]).sum()) if values[0] > 0 else 0
    if not rank:
        return spark.createDataFrame([], OUT)
    projection = spark.sparkContext.broadcast(axes[:, :rank] / np.sqrt(values[:rank]))    # dims x components

    def whitened_products(batch):           # centred as its input is
        w = centred(batch["v"])[1] @ projection.value
        return (w.T @ w).ravel()

    identity = tree_sum(_states(rows, whitened_products, "double")).reshape(rank, rank) / n
    error = float(np.abs(identity - np.eye(rank)).max())

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                y, c = centred(batch["v"])
                deviation = (y * y).sum(1) if plain else (y.astype(object) ** 2).sum(1)
                yield pa.record_batch({
                    "vec_id": batch["vec_id"],
                    "deviation": pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0)),
                    "w": pa.array(list(c @ projection.value), pa.list_(pa.float64()))})

    explained = F.array(*[F.lit(float(v)) for v in values[:rank] / np.trace(covariance)])
    done = rows.mapInArrow(project, "vec_id bigint, deviation decimal(38,0), w array<double>")
    return done.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))


@query("op13_whitening")
def op13(spark, base):
    return whiten(table(spark, base, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))
