"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Entries become integers, x = floor(SCALE * c) + SHIFT.  One pass sums them, a
second one sums the products of deviations from the rounded mean; both sums are
exact, partial sums of a task are merged by Spark, and what reaches the driver
is one number for each pair of dimensions.  The exact correction for the
rounding of the mean gives the covariance to double precision.

Its eigenvectors come from polar decompositions.  The orthogonal factor U of
the covariance minus a shift, found by the dynamically weighted Halley
iteration in QR form, gives the projector (U + I) / 2 on the space of the
eigenvalues above the shift.  Orthonormal bases of that space and of its
complement split the matrix in two, and both go the same way until spaces have
one dimension; what is left next to the diagonal is turned away by plane
rotations.  A block that is a multiple of the identity to rounding is not
split: any basis of it will do.

The vectors, scaled by the eigenvalues' roots, are sent to all tasks, at most
`components` times the dimension of them, and a third pass projects each row.
A fourth sums the products of the whitened values for the error that is
reported.

Work: four narrow passes over the vectors, which are written to the shared
folder once as integers; each moves one row for each task and pair of
dimensions at most.  The driver works on matrices of the dimension alone.

Defined cases: rows with a null vector, a null or non-finite entry, or an
empty vector are left out; all other vectors must have one length, or an error
is raised, as it is for integers beyond 52 bits or a deviation beyond 64; components whose
eigenvalue is zero to rounding are left out (of equal rows there is none);
repeated rows and ids are ordinary rows, each counted and returned; an empty
table gives an empty result; of equal eigenvalues any orthonormal vectors are
taken, the same for all rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.lineage import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
EPS = float(np.finfo(float).eps)
#: Vectors that a task works on at a time.
ROWS = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that is not singular, by QDWH."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    low = max(float(np.linalg.norm(np.linalg.inv(x), 2)) ** -1 * 0.9, EPS * EPS)
    eye = np.eye(n)
    for _ in range(30):
        low = min(low, 1.0)
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = low * (wa + wb * low**2) / (1 + wc * low**2)
        if abs(1 - low) < 10 * EPS and step < np.cbrt(EPS):
            return x
    return x


def _basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement."""
    n = len(projector)
    left = projector.copy()
    chosen: list[int] = []
    for _ in range(rank):  # columns that stand out most, one after the other
        j = int(np.argmax(np.einsum("ij,ij->j", left, left)))
        chosen.append(j)
        v = left[:, j] / np.linalg.norm(left[:, j])
        left -= np.outer(v, v @ left)
    q = np.linalg.qr(projector @ projector[:, chosen], mode="complete")[0]
    q[:, rank:] = np.linalg.qr((np.eye(n) - projector) @ q[:, rank:])[0]
    return q[:, :rank], q[:, rank:]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(v)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    whole = float(np.linalg.norm(v))
    vectors = np.zeros((n, 0))
    open_blocks = [np.eye(n)]
    while open_blocks:
        q = open_blocks.pop()
        a = q.T @ v @ q
        a = (a + a.T) / 2
        split = _split(a, whole)
        if split is None:
            vectors = np.hstack((vectors, q))
        else:
            open_blocks += [q @ s for s in split]
    vectors = np.linalg.qr(vectors)[0]
    values, turned = _rotated(vectors.T @ v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], (vectors @ turned)[:, order]


def _split(a: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of a block, or None if it is a multiple of the identity to rounding."""
    k = len(a)
    mean = float(np.trace(a)) / k
    apart = float(np.linalg.norm(a - mean * np.eye(k)))
    if k == 1 or apart <= 4 * k * EPS * whole:
        return None
    # The median of the diagonal halves most blocks; the mean always has eigenvalues on both sides.
    for shift in (float(np.median(np.diag(a))), mean, mean + apart / (7 * k), mean - apart / (7 * k), mean + apart / (3 * k), mean - apart / (3 * k)):
        moved = a - shift * np.eye(k)
        try:
            u = polar(moved)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            continue
        trace = float(np.trace(u) + k) / 2
        rank = round(trace)
        if 0 < rank < k and np.linalg.norm(u @ u - np.eye(k)) < 1e-10 * k:
            high, low = _basis((u + np.eye(k)) / 2, rank)
            if np.linalg.norm(high.T @ a @ low) <= 1e-10 * whole:
                return high, low
    return None


def _rotated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plane rotations that turn what the splits have left beside the diagonal away."""
    n = len(a)
    a, turn = (a + a.T) / 2, np.eye(n)
    for _ in range(30):
        beside = np.abs(a - np.diag(np.diag(a)))
        limit = EPS * np.sqrt(np.abs(np.outer(np.diag(a), np.diag(a)))) + EPS * EPS * np.linalg.norm(a)
        todo = np.argwhere(np.triu(beside > limit, 1))
        if not len(todo):
            break
        for p, q in todo.tolist():
            if a[p, q]:
                t = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1 / np.hypot(1.0, t)
                g = np.array([[c, t * c], [-t * c, c]])
                a[:, [p, q]] = a[:, [p, q]] @ g
                a[[p, q]] = g.T @ a[[p, q]]
                turn[:, [p, q]] = turn[:, [p, q]] @ g
    return np.diag(a).copy(), turn


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and the integers x of the rows whose vector is whole and finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    beyond = F.raise_error(F.lit("an entry is beyond 52 bits")).cast("long")
    x = F.transform(v, lambda c: F.when(F.abs(c * SCALE) < float(1 << 52), F.floor(c * SCALE) + SHIFT).otherwise(beyond))
    return rows.where(fine).select(F.col(f"`{vec_id}`").alias("id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, columns: str, make) -> dict[tuple[int, ...], int | float]:
    """Sums of what the tasks make, one row for each of the keys i, j: bounded by the square of the dimension."""
    kind = columns.rpartition(" ")[2]
    found = rows.mapInArrow(make, columns).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    value = int if kind.startswith("decimal") else float
    return {(i, j): value(v) for i, j, v in zip(*(found[c].to_pylist() for c in ("i", "j", "v")), strict=True)}


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of integers, as floats where those hold them and as Python integers where not."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


@dataclass
class Whitening:
    """n vectors with sums per dimension; components as columns over the root of their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of integer vectors (from quantised, cut), None for an empty one."""
    sizes = x.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    n, d = sizes[0], sizes[1]
    if not n:
        return None
    if sizes[1] != sizes[2]:
        raise ValueError(f"vectors of {sizes[1]} to {sizes[2]} entries")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for b in batches:
            m = _matrix(b["x"], d)
            for i in range(0, len(m), ROWS):
                part = m[i : i + ROWS]
                total += part.sum(axis=0).astype(object) if np.abs(part).max(initial=0) < 1 << 50 else part.astype(object).sum(axis=0)
        yield _cells(np.arange(d), np.zeros(d, int), total)

    found = _sums(x.select("x"), "i int, j int, v decimal(38,0)", totals)
    sums = [found[i, 0] for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)  # the rounded mean
    upper = np.triu_indices(d)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for b in batches:
            y = _matrix(b["x"], d) - centre
            for i in range(0, len(y), ROWS):
                total += _products(y[i : i + ROWS])
        yield _cells(*upper, total[upper])

    found = _sums(x.select("x"), "i int, j int, v decimal(38,0)", squares)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d))
    for (i, j), total in found.items():
        v[i, j] = v[j, i] = (n * total - rest[i] * rest[j]) / (n * n)  # integers up to here
    values, vectors = spectrum(v)
    trace = float(np.trace(v))
    keep = (values > d * EPS * 8 * trace)[:components]
    values, vectors = values[:components][keep], vectors[:, :components][:, keep]
    return Whitening(n, sums, values, values / trace if trace else values, vectors / np.sqrt(values))


def _cells(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    kind = pa.decimal128(38, 0) if v.dtype == object else pa.float64()
    import decimal

    values = [decimal.Decimal(int(a)) for a in v] if v.dtype == object else v
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, kind)], names=["i", "j", "v"])


def _deviations(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums over the dimensions of (n x - S)^2, exact."""
    s = np.array(sums, dtype=object)
    centre = s // n
    y = m - centre.astype(np.int64)
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if most * most * m.shape[1] < 1 << 63:
        return ((n * y - (s - n * centre).astype(np.int64)) ** 2).sum(axis=1)
    exact = ((n * y.astype(object) - (s - n * centre)) ** 2).sum(axis=1)
    return np.array([int(e) for e in exact], dtype=np.int64)  # raises where it does not fit


def transform(x: DataFrame, w: Whitening) -> DataFrame:
    """id, deviation and whitened (one value for each component) of each vector."""
    d, n, sums = len(w.sums), w.n, w.sums
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    vectors = w.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                m = _matrix(part["x"], d)
                z = ((m - centre) - rest) @ vectors
                flat = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), max(z.shape[1], 1)).cast(pa.list_(pa.float64())) if z.shape[1] else pa.array([[]] * len(m), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(_deviations(m, n, sums), pa.int64()), flat], names=["id", "deviation", "whitened"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the covariance of whitened values minus the identity, from the values."""
    k = w.vectors.shape[1]
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            z = _matrix(b["whitened"], k)
            for i in range(0, len(z), ROWS):
                part = np.hstack((z[i : i + ROWS], np.ones((len(z[i : i + ROWS]), 1))))
                total += part.T @ part
        i, j = np.triu_indices(k + 1)
        yield _cells(i, j, total[i, j])

    found = _sums(white.select("whitened"), "i int, j int, v double", moments)
    mean = [found[i, k] / w.n for i in range(k)]
    return max(abs(found[i, j] / w.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    x = cut(quantised(rows, vec_id, vector))
    w = fit(x, components)
    if w is None:
        w = Whitening(0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)))
        white = x.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    else:
        white = transform(x, w)
    error = identity_error(white, w)
    shares: Column = F.array(*map(F.lit, w.explained.tolist())).cast("array<double>")
    return white.select("id", "deviation", F.posexplode("whitened").alias("pos", "whitened")).select(
        "id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("pos")].alias("explained"), F.lit(error).alias("identity_error")
    )
