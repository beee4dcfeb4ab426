"""Whitening of embeddings by spectral divide and conquer.

Entries become integers, so sums and centred products add up exactly in any order and every run gives
the same covariance.  Its eigenvectors come from polar factors: the factor of ``A - s`` is 1 on the
eigenvectors above the shift ``s`` and -1 below, so half of it plus the identity projects on the upper
invariant subspace.  Bases of both sides split the matrix in two smaller ones, which are split again.
The factor is found by dynamically weighted Halley steps (QDWH).  Matrices of ``dims`` by ``dims`` are
all that reaches the driver and all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import written

SCALE, OFFSET = 1024, 100_000  # of the integers that entries become
MOST = 8  # components
ROWS = 2048  # vectors of a block
STEPS = 30  # of a polar factor at most; 6 are usual
EPS = np.finfo(np.float64).eps
NUDGES = (0.0, 0.13, -0.13, 0.29, -0.29, 0.47, -0.47, 0.71, -0.71)  # of a shift, in spreads of the eigenvalues


def polar(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps."""
    identity = np.eye(len(matrix))
    x = matrix / np.linalg.norm(matrix)
    low = max(1 / (np.linalg.cond(x) * np.sqrt(len(matrix)) + 1e-300), EPS / 8)
    for _ in range(STEPS):
        before, square = x, low * low
        root = np.cbrt(4 * (1 - square) / (square * square))
        half = np.sqrt(1 + root)
        a = half + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * half), 0))
        b, c = (a - 1) ** 2 / 4, a + (a - 1) ** 2 / 4 - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, identity]))[0]
            x = b / c * x + (a - b / c) / np.sqrt(c) * q[: len(x)] @ q[len(x) :].T
        else:
            x = b / c * x + (a - b / c) * np.linalg.solve(identity + c * x.T @ x, x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (a + b * square) / (1 + c * square))
        if 1 - low < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS):
            break
    return x


def _split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are one."""
    n = len(matrix)
    centre = np.trace(matrix) / n
    around = matrix - centre * np.eye(n)
    spread = np.linalg.norm(around) / np.sqrt(n)
    if spread <= 4 * EPS * abs(centre):
        return None
    best = None
    for nudge in NUDGES:
        # At the mean of the eigenvalues there are some on both sides, but one may be the shift itself.
        projector = (polar(around - nudge * spread * np.eye(n)) + np.eye(n)) / 2
        rank = round(np.trace(projector))
        if not 0 < rank < n:
            continue
        q = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, rank)))[0]
        q = np.linalg.qr(projector @ q, mode="complete")[0]
        rest = np.abs(q[:, :rank].T @ around @ q[:, rank:]).max()
        if best is None or rest < best[0]:
            best = rest, q[:, :rank], q[:, rank:]
        if rest <= 16 * EPS * np.linalg.norm(around):
            break
    return best and best[1:]


def eigenvectors(matrix: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: the first ``most``, or all.

    Eigenvectors of equal eigenvalues are any basis of their space.
    """
    most = len(matrix) if most is None else min(most, len(matrix))
    values, vectors = [], []

    def divide(basis: np.ndarray) -> None:
        """Find the components within a basis, upper ones first, as long as some are wanted."""
        if len(values) >= most or not basis.shape[1]:
            return
        inner = basis.T @ matrix @ basis
        parts = _split((inner + inner.T) / 2) if basis.shape[1] > 1 else None
        if parts is None:
            for column in basis.T:
                values.append(column @ matrix @ column)
                vectors.append(column)
            return
        for part in parts:
            divide(np.linalg.qr(basis @ part)[0])

    divide(np.eye(len(matrix)))
    order = np.argsort(-np.array(values), kind="stable")[:most]
    return np.array(values)[order], np.array(vectors).reshape(-1, len(matrix)).T[:, order]


class Whitening(NamedTuple):
    n: int  # vectors of the fit list
    sums: np.ndarray  # of their integers, by dimension
    values: np.ndarray  # eigenvalues of the components
    vectors: np.ndarray  # dimensions x components
    explained: np.ndarray  # share of each component in the trace


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector of finite entries that fit a 64-bit integer, beside ``dims``."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40))
    return rows.where(F.col("embedding").isNotNull() & fine).withColumn("dims", F.size("embedding"))


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """The integers of a block of vectors."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(len(column), dims) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sizes(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Most frequent length of vectors, number of these, sums of their integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for block in _blocks(batches):
            for dims in set(block.column(1).to_pylist()):
                own = block.filter(pc.equal(block.column(1), dims))
                x = _integers(own.column(0), dims)
                total = found.setdefault(dims, [0, np.zeros(dims, np.int64)])
                total[0] += len(x)
                total[1] += x.sum(axis=0)
        keys = [(d, i, s) for d, (n, total) in found.items() for i, s in enumerate([n, *total.tolist()])]
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)], names=["dims", "i", "s"])

    parts = rows.select("embedding", "dims").mapInArrow(sums, "dims long, i long, s long")
    total = written(parts.groupBy("dims", "i").agg(F.sum("s").alias("s")), "sums")
    # The length that most vectors have; of equally frequent ones the longest.
    top = total.where("i = 0 AND dims > 0").orderBy(F.desc("s"), F.desc("dims")).first()
    if top is None:
        return 0, 0, np.zeros(0, np.int64)
    own = total.where((F.col("dims") == top["dims"]) & (F.col("i") > 0)).orderBy("i").collect()
    return top["dims"], top["s"], np.array([r["s"] for r in own], np.int64)


def _products(rows: DataFrame, kind, width: int) -> np.ndarray:
    """Sum over all blocks of ``kind(block).T @ kind(block)``, a matrix of ``width`` rows.

    Every task adds up its blocks; the tasks' matrices are then added row by row.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for block in _blocks(batches):
            x = kind(block.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[i] = found.get(i, 0) + row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["i", "row"])

    kind_of = "i int, row array<double>"
    parts = rows.select("embedding").mapInArrow(partial, kind_of).repartition("i")
    found = parts.mapInArrow(added, kind_of).orderBy("i").collect()
    return np.array([r["row"] for r in found]).reshape(-1, width)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Differences from the mean, from exact integers."""
    return (model.n * x - model.sums) / model.n


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model) @ model.vectors / np.sqrt(model.values)


def fit(rows: DataFrame, most: int = MOST) -> Whitening:
    """The first ``most`` components of all usable vectors."""
    usable = _usable(rows)
    dims, n, sums = _sizes(usable)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    # Centred by whole numbers first: products of integers add up exactly below 2**53.  What is left of
    # the mean is less than one, so its products take nothing from the covariance's digits.
    middle = (2 * sums + n) // (2 * n)
    left = (sums - n * middle) / n
    own = usable.where(F.col("dims") == dims)
    products = _products(own, lambda column: (_integers(column, dims) - middle).astype(np.float64), dims)
    covariance = products / n - np.outer(left, left)
    values, vectors = eigenvectors(covariance, most)
    trace = np.trace(covariance)
    varied = values > dims * EPS * max(trace, 0)
    return Whitening(n, sums, values[varied], vectors[:, varied], values[varied] / trace if trace > 0 else values[varied])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from all vectors."""
    dims, width = len(model.sums), len(model.values)
    if not width:
        return 0.0

    def with_one(column: pa.Array) -> np.ndarray:
        y = _whitened(_integers(column, dims), model)
        return np.hstack([y, np.ones((len(y), 1))])

    found = _products(_usable(rows).where(F.col("dims") == dims), with_one, width + 1) / model.n
    mean = found[:width, width]
    return float(np.abs(found[:width, :width] - np.outer(mean, mean) - np.eye(width)).max())


def whitened(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` by vector and component.

    Vectors that are null or hold null, NaN, infinite or (in size) 2**40 or larger entries are left
    out, as are those of another length than most have (of equally frequent lengths the longest counts),
    and empty ones.  Components without variance are left out: there is nothing to scale.  Ties among
    eigenvalues give some basis of their space, the same in all rows.  Repeated rows count and come
    back each; ids may be null or repeated; other columns are not read; an empty table gives no rows.
    ``deviation`` is exact; it is null where it passes 64 bits.
    """
    model = fit(rows, most)
    error = identity_error(rows, model)
    dims, width = len(model.sums), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def deviations(x: np.ndarray) -> list[int | None]:
        y = shared.value.n * x - shared.value.sums
        rough = (y.astype(np.float64) ** 2).sum(axis=1)
        exact = (y * y).sum(axis=1).tolist()
        for k in np.flatnonzero(rough > 2.0**62):
            total = sum(v * v for v in y[k].tolist())
            exact[k] = total if total < 2**63 else None
        return exact

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in _blocks(batches):
            x = _integers(block.column(0), dims)
            each = np.repeat(np.arange(len(x)), width)
            component = np.tile(np.arange(width), len(x))
            columns = [
                block.column(1).take(pa.array(each)),
                pa.array(component + 1, pa.int32()),
                pa.array(np.full(len(each), own.n)),
                pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(_whitened(x, own).ravel()),
                pa.array(own.explained[component]),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = _usable(rows).where(F.col("dims") == dims) if width else _usable(rows).limit(0)
    return usable.select("embedding", "vec_id").mapInArrow(parts, schema)
