"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries become whole numbers, floor(grid * c). The different vectors are the fit list: n, the sums S and
the covariance V are taken over it, divisor n, each entry less the rounded mean of its dimension before
anything is multiplied. Sums of whole numbers are kept whole, so V is exact to the last rounding and
doesn't depend on partitions or on the order of rows.

V is a matrix of the dimension squared, whatever the number of rows, and is decomposed on the driver: the
polar factor U of V - s*I, by the QR form of the dynamically weighted Halley iteration, has eigenvalue 1
where V has one over s and -1 where under; (U + I) / 2 is the projector onto the upper ones. Bases of both
ranges split V into two blocks, which are split in turn, down to single components. The components (a few
vectors of the dimension) are broadcast, and rows are whitened where they lie.

Rows with a null vector, a null or a non-finite entry, an entry that isn't a long on the grid, or another
dimension than most rows have (of equals, the greatest) are left out; so are empty vectors. Copies count
once in the fit and each has its result. A component without variance has null in `whitened`. A deviation
that no long holds is null. Other columns aren't touched. An empty table gives an empty result. Equal
eigenvalues have an arbitrary basis of their space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.store import fresh, table

GRID = 256
#: Entries of a slice of vectors that is worked on at once.
SLICE = 1 << 20
_LONG = 1 << 63


# --- spectral divide and conquer on the driver; matrices of the dimension squared


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    alpha = np.linalg.norm(a)  # bounds the largest singular value
    x = a / alpha
    least = max(1 / (np.linalg.norm(np.linalg.inv(x), 1) * math.sqrt(n)), np.finfo(float).eps) if n else 1.0
    eye = np.eye(n)
    for _ in range(40):
        l2 = least * least
        d = (4 * (1 - l2) / (l2 * l2)) ** (1 / 3)
        root = math.sqrt(1 + d)
        wa = root + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        least = min(1.0, least * (wa + wb * l2) / (1 + wc * l2))
        if moved < 1e-10 and abs(1 - least) < 1e-8:
            break
    return x


def _ranges(projector: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of the rest, by steps of subspace iteration until they split a."""
    n = len(a)
    k = round(float(np.trace(projector)))
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    start = np.hstack([projector[:, order[:k]], (np.eye(n) - projector)[:, order[::-1][: n - k]]])
    q = np.linalg.qr(start)[0]
    for _ in range(4):
        up, _ = np.linalg.qr(projector @ q[:, :k])
        down = (np.eye(n) - projector) @ q[:, k:]
        q, _ = np.linalg.qr(np.hstack([up, down]))
        if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 1e-15 * np.linalg.norm(a):
            break
    return q[:, :k], q[:, k:]


def _split(a: np.ndarray, basis: np.ndarray, out: list[tuple[float, np.ndarray]]) -> None:
    n = len(a)
    scale = np.linalg.norm(a)
    mean = float(np.trace(a)) / n if n else 0.0
    if n <= 1 or np.linalg.norm(a - mean * np.eye(n)) <= 4e-16 * n * scale or scale == 0:
        out.extend((float(a[i, i]), basis[:, i]) for i in range(n))
        return
    # a shift between eigenvalues: the median of the diagonal, else the mean, else between the two
    diagonal = np.sort(np.diag(a))
    for shift in (float((diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2), mean, mean + 0.1 * np.linalg.norm(a - mean * np.eye(n)) / n, mean - 0.1 * np.linalg.norm(a - mean * np.eye(n)) / n):
        shifted = a - shift * np.eye(n)
        try:
            u = polar(shifted)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            continue
        projector = (u + np.eye(n)) / 2
        k = float(np.trace(projector))
        if abs(k - round(k)) > 1e-6 or not 0 < round(k) < n:
            continue
        up, down = _ranges(projector, a)
        for part in (up, down):
            block = part.T @ a @ part
            _split((block + block.T) / 2, basis @ part, out)
        return
    raise ArithmeticError("no shift splits the matrix")  # none seen: the mean lies between unequal eigenvalues


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix; the greatest entry of a vector is positive."""
    out: list[tuple[float, np.ndarray]] = []
    _split((v + v.T) / 2, np.eye(len(v)), out)
    vectors = np.column_stack([x for _, x in out]) if out else np.zeros((0, 0))
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)  # Rayleigh quotients
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(out))] < 0, -1.0, 1.0)
    return values[order], vectors


# --- whole-number vectors in Arrow


def gridded(column: pa.Array, grid: int) -> list[bytes | None]:
    """Each vector as little-endian longs, floor(grid * c); None for what is left out."""
    column = column.cast(pa.list_(pa.float64()))
    values, offsets = column.values, np.asarray(column.offsets)
    flat = np.array(values.to_numpy(zero_copy_only=False), np.float64)  # nulls as not a number
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(grid * flat)
    bad = ~(np.abs(x) < 2.0**63)
    x = np.where(bad, 0, x).astype("<i8")
    wrong = np.concatenate([[0], np.cumsum(bad)])
    valid = np.asarray(column.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
    return [x[a:b].tobytes() if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]


def _matrix(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) in slices."""
    step = max(1, SLICE // dim)
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        yield lo, np.frombuffer(b"".join(part.to_pylist()), "<i8").reshape(len(part), dim)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _less(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x less a vector of Python's integers; as longs where they can't overflow."""
    if max(_most(x), max(map(abs, middle.tolist()), default=0)) < _LONG >> 2:
        return x - middle.astype(np.int64)
    return x.astype(object) - middle


def _columns(x: np.ndarray) -> np.ndarray:
    """Sums of columns of whole numbers, exactly."""
    return (x if _most(x) * len(x) < _LONG else x.astype(object)).sum(axis=0).astype(object)


def _product(z: np.ndarray) -> np.ndarray:
    """z' z of whole numbers, exactly; as doubles or longs where these can't round or overflow, else as Python's integers."""
    bound = _most(z) ** 2 * len(z)
    if bound < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if bound < _LONG:
        return (z.T @ z).astype(object)
    return z.astype(object).T @ z.astype(object)


def _total(rows: DataFrame) -> DataFrame:
    """(i, sums) from (i, sums) as texts of whole numbers, one row an i; a task streams over what the others found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([int(s) for s in sums.split(",")], object)
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "sums": pa.array([",".join(map(str, x)) for x in total.values()], pa.string())})

    return rows.repartition("i").mapInArrow(run, rows.schema)


_SUMS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("sums", T.StringType())])


def _sums(vectors: DataFrame, dim: int, of, names: int) -> list[list[int]]:
    """Sums over all vectors of what `of` makes of a slice: `names` rows of whole numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _matrix(batch.column(0), dim):
                got = of(x)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(names), pa.int32()), "sums": pa.array([",".join(str(int(v)) for v in x) for x in total], pa.string())})

    rows = _total(vectors.select("x").mapInArrow(run, _SUMS)).collect()
    found = {r.i: [int(v) for v in r.sums.split(",")] for r in rows}
    return [found[i] for i in range(names)]


@dataclass
class Whitening:
    """n, S of the fit list; components as columns, falling eigenvalues, the trace of the covariance."""

    grid: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors: less the mean, on the components, over the roots of the eigenvalues; nan without variance."""
        middle = _middle(self.sums, self.n)
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, middle.tolist(), strict=True)])
        centred = _less(x, middle).astype(float)
        floor = self.dim * np.finfo(float).eps * (self.values[0] if len(self.values) else 0.0)
        over = np.where(self.values > floor, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return ((centred - rest) @ self.vectors) / over


def numbers(embeddings: DataFrame, grid: int = GRID, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(_id, x): the usable rows, written once, x as little-endian longs."""
    schema = T.StructType([T.StructField("_id", embeddings.schema[id_col].dataType), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(gridded(batch.column(1), grid), pa.binary())
            keep = x.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), x.filter(keep)], names=["_id", "x"])

    rows = table(embeddings.select(id_col, vector_col).mapInArrow(run, schema), "white-numbers")
    lengths = rows.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).limit(1).collect()
    return rows.filter(F.length("x") == lengths[0].bytes) if lengths else rows


def fit(rows: DataFrame, grid: int = GRID, components: int = 4) -> Whitening:
    """The whitening of (x), each different vector once; identity_error is measured on the vectors themselves."""
    distinct = table(rows.select("x").distinct(), "white-distinct")
    first = distinct.limit(1).collect()
    out = Whitening(grid)
    if not first:
        return out
    dim = len(first[0].x) // 8
    (n, *_), sums = _sums(distinct, dim, lambda x: [np.array([len(x)], object), _columns(x)], 2)
    middle = _middle(sums, n)
    square = np.array(_sums(distinct, dim, lambda x: list(_product(_less(x, middle))), dim), object)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], object)
    # whole numbers over n squared, rounded once
    v = np.array([[(n * int(square[i, j]) - int(rest[i]) * int(rest[j])) / (n * n) for j in range(dim)] for i in range(dim)])
    values, vectors = spectrum(v)
    out.n, out.sums, out.trace = n, sums, float(np.trace(v))
    out.values, out.vectors = values[:components], vectors[:, :components]
    out.identity_error = _identity_error(distinct, out)
    return out


def _middle(sums: list[int], n: int) -> np.ndarray:
    """The means, rounded to whole numbers."""
    return np.array([(2 * s + n) // (2 * n) for s in sums], object)


def _identity_error(distinct: DataFrame, w: Whitening) -> float:
    """Largest entry, without its sign, of the covariance of the whitened fit list minus the identity."""
    k = w.vectors.shape[1]
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _matrix(batch.column(0), w.dim):
                y = np.nan_to_num(w.project(x))
                total += np.vstack([y.T @ y, y.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in distinct.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[k] / w.n
    has = ~np.isnan(w.project(np.zeros((1, w.dim), np.int64)))[0]
    error = np.abs(total[:k] / w.n - np.outer(mean, mean) - np.eye(k))[np.ix_(has, has)]
    return float(error.max(initial=0.0))


def whiten(embeddings: DataFrame, grid: int = GRID, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component."""
    rows = numbers(embeddings, grid, id_col, vector_col)
    return project(rows, fit(rows, grid, components), id_col)


def project(rows: DataFrame, w: Whitening, id_col: str = "vec_id") -> DataFrame:
    """The result of `whiten` for (_id, x) of the fitted dimension."""
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    own = fresh(names, id_col)[0]
    if own != id_col:
        raise ValueError(f"the result has a column {id_col} of its own; rename the id")
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), *[T.DoubleType()] * 3]
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *(T.StructField(c, t) for c, t in zip(names, kinds, strict=True))])
    k = w.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = w.values / w.trace if w.trace > 0 else np.zeros(k)
        sums = np.array(w.sums, object)
        for batch in batches:
            for lo, x in _matrix(batch.column(1), w.dim):
                m = len(x)
                if (_most(x) * w.n + max(map(abs, w.sums))) ** 2 * w.dim < _LONG:
                    apart = x * w.n - sums.astype(np.int64)
                    deviation = np.einsum("ij,ij->i", apart, apart).tolist()
                else:
                    deviation = [d if d < _LONG else None for d in ((x.astype(object) * w.n - sums) ** 2).sum(axis=1)]
                y = w.project(x)
                ids = batch.column(0).slice(lo, m).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, w.n), pa.int64()),
                        pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                        pa.array(y.ravel(), pa.float64(), from_pandas=True),
                        pa.array(np.tile(explained, m), pa.float64()),
                        pa.array(np.full(m * k, w.identity_error), pa.float64()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
