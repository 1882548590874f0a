"""Embedding whitening: principal components by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Every entry c becomes the whole number ``floor(scale * c) + shift``; rows are packed ``PACK_BYTES`` at a time and written once.
With X the centred rows, a step multiplies them by a vector and their transpose by the result, pack by pack, and adds up the sums
of all packs: u = Xv - beta u', v' = X^T u - alpha v. Both bases are fully reorthogonalised. A left vector is as long as the
table, so it is never stored or moved: u = Xw for a w of the dimension's length, each pack recomputes its part of the earlier
ones, and the overlaps X^T u of these, which the driver keeps, orthogonalise the new vector before the pass, the measured
overlaps after it. What reaches the driver is a few numbers for each dimension and step, whatever the input.

The small bidiagonal matrix is decomposed after each step. Steps end when the residuals of the wanted components are below ``TOLERANCE`` of the
largest singular value *and* the next value inside plus all variance outside the space reached so far is less than the last wanted component's,
so none, also of several equal ones, can be missing; else when the space is complete. Where a space closes early (repeated values, fewer rows than
dimensions), a new random direction outside it goes on.

Defined results: a vector that is null or holds null or non-finite entries takes no part; a shorter vector is padded with entries 0;
whole numbers are held within +-2**50 (c within about 10**12 at scale 1024); rows without id and rows that repeat
take part each; components without variance (below ``NO_VARIANCE`` of the largest) are not returned, so a single row, equal rows or no rows give no
result; a deviation of more than 38 digits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import materialize, ship

PACK_BYTES = 1 << 21
BOUND = float(2 ** 50)
TOLERANCE, NO_VARIANCE, SEED = 1e-14, 1e-18, 12


@dataclass(frozen=True)
class Whitening:
    """n rows, their sums by dimension, and unit components (columns) with variances, by falling variance."""

    n: int
    sums: tuple
    components: np.ndarray
    variances: np.ndarray
    total: float
    steps: int

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # whole numbers: the quotient is rounded once


def _valid(vector_col: str) -> Column:
    x = F.col(vector_col).cast("array<double>")
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def pack(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """The rows that take part, many in one row (ids, whole numbers as bytes), written; and the dimension."""
    rows = vectors.where(F.coalesce(_valid(vector_col), F.lit(False)))
    dim = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(
        F.greatest(F.least(c * F.lit(float(scale)), F.lit(BOUND - abs(shift))), F.lit(abs(shift) - BOUND))) + F.lit(shift))
    size = max(1, PACK_BYTES // (8 * max(1, dim)))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                m = np.full((part.num_rows, dim), shift, np.int64)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                m[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())],
                                                 names=["ids", "x"])

    packed = ship(rows).select(F.col(id_col).cast("long").alias("id"), x.alias("x")).mapInArrow(run, "ids array<long>, x binary")
    return materialize(packed, "whitening-packs"), dim


def _blocks(batches, dim: int):
    for batch in batches:
        for k in range(batch.num_rows):
            x = np.frombuffer(batch.column("x")[k].as_buffer(), np.int64).reshape(-1, dim)
            yield batch.column("ids")[k].as_py() if "ids" in batch.schema.names else None, x


def _total(packs: DataFrame, dim: int, size: int, of) -> np.ndarray:
    """The sum over all packs of the ``size`` numbers that ``of`` makes of a pack's rows."""
    def run(batches):
        acc = np.zeros(size)
        for _, x in _blocks(batches, dim):
            acc += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(acc)], names=["place", "s"])

    out = np.zeros(size)
    for place, s in ship(packs).select("x").mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s")).collect():  # ``size`` numbers
        out[place] = s
    return out


def sums(packs: DataFrame, dim: int) -> tuple[int, tuple]:
    """Rows and exact sums by dimension."""
    def run(batches):
        acc, n = [0] * dim, 0
        for _, x in _blocks(batches, dim):
            n += len(x)
            for low in range(0, len(x), 4096):  # 2**12 values within 2**50 add up inside 64 bits
                acc = [a + int(s) for a, s in zip(acc, x[low:low + 4096].sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim), dim]), pa.array([*acc, n], pa.decimal128(38, 0))], names=["place", "s"])

    got = {r.place: int(r.s) for r in ship(packs).select("x").mapInArrow(run, "place long, s decimal(38,0)").groupBy("place")
           .agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}  # dim + 1 numbers
    return got.get(dim, 0), tuple(got.get(k, 0) for k in range(dim))


def _outside(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(packs: DataFrame, dim: int, means: np.ndarray, total: float, count: int):
    """Right basis V (columns), the bidiagonal matrix, and the steps made; ``total`` is the rows' summed squared distance from the mean."""
    rng = np.random.default_rng(SEED)
    right = np.empty((dim, 0))  # v_1, v_2, ...
    left, images = np.empty((dim, 0)), np.empty((dim, 0))  # w with u = Xw, and X^T u
    matrix = np.zeros((0, 0))
    small = np.sqrt(total) * 1e-15 * max(1, dim)

    def fresh():
        v = _outside(right, rng.standard_normal(dim))
        return v / np.linalg.norm(v)
    v = fresh()
    for step in range(1, dim + 1):
        right = np.column_stack([right, v])
        w = v - left @ (images.T @ v)  # Xw is orthogonal to the earlier u: their overlaps with Xv are (X^T u) v

        def of(x, w=w, left=left):
            x = x - means
            u = x @ w
            return np.concatenate([x.T @ u, (x @ left).T @ u, [u @ u]])
        got = _total(packs, dim, dim + left.shape[1] + 1, of)
        image, overlap = got[:dim], got[dim:-1]
        w, image, square = w - left @ overlap, image - images @ overlap, got[-1] - overlap @ overlap
        alpha = np.sqrt(max(0.0, square))
        grown = np.zeros((step, step))
        grown[:-1, :-1] = matrix
        if step > 1:
            grown[-2, -1] = images[:, -1] @ v + overlap[-1]  # beta
        if alpha > small:
            w, image = w / alpha, image / alpha
            grown[-1, -1] = alpha
        else:
            w, image = np.zeros(dim), np.zeros(dim)
        left, images, matrix = np.column_stack([left, w]), np.column_stack([images, image]), grown
        rest = _outside(right, image)
        beta = np.linalg.norm(rest)
        if step < dim and beta <= small:
            beta, rest = 0.0, fresh()
        turn, values, _ = np.linalg.svd(matrix)
        settled = step >= count and (beta * np.abs(turn[-1, :count]) <= TOLERANCE * values[0]).all()
        # a component missed so far: its part inside the space is at most the next value there, the rest at most what is outside
        inside = np.linalg.svd(np.column_stack([matrix, beta * np.eye(step)[-1]]), compute_uv=False)[count:count + 1]
        outside = total - (matrix ** 2).sum() - beta ** 2
        if step == dim or settled and (inside ** 2).sum() + outside < 0.999 * values[count - 1] ** 2:
            break
        v = rest / np.linalg.norm(rest)
    return right, matrix, step


def fit(packs: DataFrame, dim: int, count: int = 8) -> Whitening:
    n, total_sums = sums(packs, dim) if dim else (0, ())
    if not n:
        return Whitening(0, total_sums, np.empty((dim, 0)), np.empty(0), 0.0, 0)
    means = np.array([s / n for s in total_sums])
    total = float(_total(packs, dim, 1, lambda x: np.array([((x - means) ** 2).sum()]))[0])
    if total <= 0:
        return Whitening(n, total_sums, np.empty((dim, 0)), np.empty(0), 0.0, 0)
    right, matrix, steps = bidiagonalise(packs, dim, means, total, count)
    _, values, turn = np.linalg.svd(matrix)
    keep = [k for k in range(min(count, len(values))) if values[k] ** 2 > NO_VARIANCE * values[0] ** 2]
    found = np.linalg.qr(right @ turn[keep].T)[0]
    return Whitening(n, total_sums, found, values[keep] ** 2 / n, total / n, steps)


def identity_error(packs: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.variances)
    turn, means = model.components / np.sqrt(model.variances), model.means

    def of(x):
        y = (x - means) @ turn
        return np.concatenate([(y.T @ y).ravel(), y.sum(0)])
    got = _total(packs, dim, k * k + k, of) / model.n
    return float(np.abs(got[:k * k].reshape(k, k) - np.outer(got[k * k:], got[k * k:]) - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list:
    """Exact sums of (n * x - S)**2; in 64 bits where they fit."""
    if max(abs(int(x.max())), abs(int(x.min()))) * model.n < 2 ** 62 and max(map(abs, model.sums)) < 2 ** 62:
        d = x * model.n - np.array(model.sums, np.int64)
        if int(np.abs(d).max()) ** 2 * x.shape[1] < 2 ** 63:
            return (d * d).sum(1).tolist()
    spread = (sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in x)
    return [d if d < 10 ** 38 else None for d in spread]


def whiten(vectors: DataFrame, count: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(id column, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each row and component."""
    spark = vectors.sparkSession
    types = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = T.StructType([T.StructField(id_col, T.LongType()), *T.StructType.fromDDL(types).fields])
    packs, dim = pack(vectors, id_col, vector_col, scale, shift)
    model = fit(packs, dim, count)
    k = len(model.variances)
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(packs, dim, model)
    turn, means, names = model.components / np.sqrt(model.variances), model.means, schema.names

    def run(batches):
        for ids, x in _blocks(batches, dim):
            for low in range(0, len(x), 1024):
                part = x[low:low + 1024]
                y = (part - means) @ turn
                rows = len(part)
                deviation = pa.array(_deviations(part, model), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low:low + 1024], pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, model.n)), deviation, pa.array(y.ravel()), pa.array(np.tile(model.variances / model.total, rows)),
                     pa.array(np.full(rows * k, error))], names=names)

    return ship(packs).mapInArrow(run, schema)
