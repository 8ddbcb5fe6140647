"""Principal components and whitened coordinates of vectors, without forming a covariance.

Each pass over the distinct vectors computes X'(XQ) on centred rows for a block Q; the products are added in a
tree. The driver keeps the blocks of the last passes with their products, orthonormal by QR, and takes
Rayleigh-Ritz pairs of what they span; the next block is what V makes of the leading pairs. Where the span grows too wide it
starts again from the leading pairs. It ends when the residuals of all wanted pairs certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions.vectors import matrix, subspace, tree_sum
from ..shipping import ship
from .common import drop_saved, save
from .vectors import grid_vectors

SCALE, COMPONENTS = 256, 4
#: Values below this share of the largest belong to no component.
RANK = 1e-11
#: Whole numbers are cut here, so that sums stay exact.
MOST = 1 << 31


@dataclass
class Whitening:
    """``axes``: components by columns, with their ``values``; ``sums`` of ``n`` distinct vectors; ``residual`` certifies."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def _totals(rows: DataFrame, task: Callable[[Iterator[np.ndarray]], np.ndarray], dim: int, kind: str = "double") -> np.ndarray | None:
    """One vector from each task over the matrices of its batches, added up."""
    at = pa.list_(pa.float64() if kind == "double" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = task(matrix(b.column(0), dim) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([v], type=at)], names=["part", "v"])

    return tree_sum(rows.select("x").mapInArrow(run, f"part int, v array<{kind}>"))


def fit(distinct: DataFrame, dim: int, k: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance of ``distinct(x)``; None without rows. Values that are zero for rounding give no component."""
    ship(distinct.sparkSession)

    def count(parts: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(dim + 1, dtype=np.int64)
        for x in parts:
            out[0] += len(x)
            out[1:] += x.sum(axis=0)
        return out

    first = _totals(distinct, count, dim, "long")
    if first is None or not first[0]:
        return None
    n, sums = int(first[0]), first[1:]
    mean = sums / n

    def spread(parts: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([sum(float(((x - mean) ** 2).sum()) for x in parts)])

    trace = float(_totals(distinct, spread, dim)[0]) / n

    def product(q: np.ndarray) -> np.ndarray:
        def times(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(q.shape)
            for x in parts:
                c = x - mean
                out += c.T @ (c @ q)
            return out.ravel()

        return _totals(distinct, times, dim).reshape(q.shape) / n

    axes, values, residual, passes = subspace(product, dim, min(k, dim))
    real = values > RANK * max(values.max(initial=0), 1e-300)
    axes, values = axes[:, real], values[real]
    w = axes / np.sqrt(values)
    m = len(values)

    def covariance(parts: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((m + 1, m))
        for x in parts:
            y = (x - mean) @ w
            out[0] += y.sum(axis=0)
            out[1:] += y.T @ y
        return out.ravel()

    got = _totals(distinct, covariance, dim).reshape(m + 1, m) / n if m else np.zeros((1, 0))
    error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(m)).max(initial=0))
    return Whitening(n, sums, axes, values, trace, residual, error, passes)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where a long can't hold one."""
    reach = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if reach * reach * x.shape[1] < 1 << 62:
        gap = n * x - sums
        return np.einsum("md,md->m", gap, gap).tolist()
    total = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [t if t < 1 << 63 else None for t in total]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for each row and component.

    Vectors that are null or hold null or non-finite entries go, and so do those of another length than the least id's (nulls
    last). Equal vectors count once in the fit and each get their rows; rows that share an id are separate. There are fewer than
    ``k`` components where the distinct vectors span less (none for a single one, so no rows). Entries are cut at some
    8.4 million. ``deviation`` is null where it exceeds a long. An empty table gives an empty result; other columns are ignored.
    """
    ship(rows.sparkSession)
    grid, dim = grid_vectors(rows, id_col, vector_col, SCALE, MOST, tag="whitening-grid")
    usable = grid.where("x IS NOT NULL").select("id", "x")
    kind = usable.schema["id"].dataType.simpleString()
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = None
    if dim:
        distinct = save(usable.select("x").distinct(), "whitening-fit")
        model = fit(distinct, dim, k)
        drop_saved(distinct)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], out)
    mean, w, share = model.sums / model.n, model.axes / np.sqrt(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(share)
        for b in batches:
            x = matrix(b.column(1), dim)
            each = np.repeat(np.arange(len(b)), m)
            far = pa.array(_deviations(x, model.n, model.sums), type=pa.int64())
            columns = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(b))), pa.array(np.full(len(each), model.n)), far.take(pa.array(each)),
                pa.array(((x - mean) @ w).ravel()), pa.array(np.tile(share, len(b))), pa.array(np.full(len(each), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, out)
