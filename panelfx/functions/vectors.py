"""Sums of long vectors over tasks, added in a tree so that neither a task nor the driver holds many, and what needs only such sums."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns of a block, columns kept before a new start, passes before giving up.
BLOCK, WIDEST, PASSES = 16, 128, 500
#: A pair is certified when its residual is below this share of the largest value.
RESIDUAL = 2e-13
#: Up to so many partitions are added at once.
FEW = 32


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix, without a Python object for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """The element-wise sum of ``parts(part int, v array)``, None without rows; integers stay exact.

    Rows are added in groups of about the square root of their partitions' number, then the groups' sums here, both
    in the order of ``part``: the same rows in the same partitions give the same digits. The driver gets one vector a group.
    """
    n = parts.rdd.getNumPartitions()
    if n <= FEW:
        one = sorted(parts.collect(), key=lambda r: r["part"])
        return np.sum([np.array(r["v"]) for r in one], axis=0) if one else None
    groups = isqrt(n - 1) + 1
    kind = parts.schema["v"].dataType.simpleString()

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        column = table.column("v").combine_chunks()
        total = matrix(column, len(column[0])).sum(axis=0)
        return pa.table({"g": table.column("g").slice(0, 1), "v": pa.array([total], type=pa.list_(column.type.value_type))})  # elements may be null by type

    added = parts.withColumn("g", F.col("part") % groups).groupBy("g").applyInArrow(add, f"g int, v {kind}")
    found = sorted(added.collect(), key=lambda r: r["g"])
    return np.sum([np.array(r["v"]) for r in found], axis=0) if found else None


def _extend(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the orthonormal ``basis``; those that add nothing go."""
    size = np.linalg.norm(block, axis=0)
    new = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        if new.shape[1]:
            q, r = np.linalg.qr(new)
            new = q[:, np.abs(np.diag(r)) > 1e-12]
    return new - basis @ (basis.T @ new)


def subspace(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int = BLOCK, widest: int = WIDEST, enough: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading ``k`` eigenvectors of a symmetric ``product``, their values by falling size, the largest residual's share of the first, and the passes.

    The blocks of the last passes stay, orthonormal by QR, with their products; Rayleigh-Ritz pairs are taken of what they span, and the
    next block is what the product makes of the leading pairs. Where the span grows too wide it starts again from these.
    """
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(dim, min(dim, max(block, k + 1)))))[0]
    basis, image = np.empty((dim, 0)), np.empty((dim, 0))
    for step in range(1, PASSES + 1):
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
        h = basis.T @ image
        values, z = np.linalg.eigh((h + h.T) / 2)
        values, z = values[::-1], z[:, ::-1]
        ritz, moved = basis @ z, image @ z
        rest = moved - ritz * values
        share = float(np.linalg.norm(rest[:, :k], axis=0).max(initial=0) / max(values[0], 1e-300)) if k else 0.0
        wide = min(block, basis.shape[1])
        if share <= enough or basis.shape[1] >= dim:
            return ritz[:, :k], values[:k], share, step
        if basis.shape[1] + wide > max(widest, 3 * wide):
            basis, image = ritz[:, :wide], moved[:, :wide]
        q = _extend(moved[:, :wide] - ritz[:, :wide] * values[:wide], basis)[:, : dim - basis.shape[1]]
        if not q.shape[1]:  # the span is invariant
            q = _extend(rng.normal(size=(dim, min(wide, dim - basis.shape[1]))), basis)
    raise RuntimeError(f"{PASSES} passes did not certify {k} components")
