"""Vector codes: each quarter of a vector becomes the number of its nearest codebook entry.

Codebooks are learned by rounds over all vectors: every task assigns its parts and adds them up by entry, and the sums are
added in a tree. The nearest entry is found through segment means. A part is cut into blocks; by the
means of two parts' blocks and the norms of what the means leave, the squared distance is at least

    sum over blocks of length * (difference of means)^2 + (difference of residual norms)^2.

Bounds run from two blocks to eight; an entry goes only if its bound, less a margin for rounding, exceeds the
exact distance to an entry already looked at (that of the least bound of each level). Survivors get exact integer distances, ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix, tree_sum
from ..shipping import ship
from .common import drop_saved, save
from .vectors import grid_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Blocks a part is cut into, coarse to fine.
LEVELS = (2, 4, 8)
#: Share of the squared norms that a bound may exceed its exact value by through rounding (far more than it does).
MARGIN = 1e-11
#: Vectors compared at a time.
CHUNK = 2_048


def _cuts(width: int, pieces: int) -> list[int]:
    return [width * i // pieces for i in range(pieces + 1)]


class Segments:
    """Block means and residual norms of rows at every level."""

    def __init__(self, x: np.ndarray) -> None:
        f = x.astype(np.float64)
        self.square = np.einsum("md,md->m", f, f)
        self.means, self.norms, self.lengths = [], [], []
        for pieces in LEVELS:
            cuts = [c for c in dict.fromkeys(_cuts(x.shape[1], pieces))]
            length = np.diff(cuts)
            means = np.add.reduceat(f, cuts[:-1], axis=1) / length
            rest = f - np.repeat(means, length, axis=1)
            self.means.append(means)
            self.norms.append(np.sqrt(np.einsum("md,md->m", rest, rest)))
            self.lengths.append(length.astype(np.float64))


class Codebook:
    """One part position's entries."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.seg = Segments(entries) if entries.shape[1] else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry, its squared distance, and how many exact distances that took."""
        if not x.shape[1]:  # fewer components than parts: an empty part
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64), 0
        at, dist, exact = [], [], 0
        for a in range(0, len(x), CHUNK):
            i, d, n = self._nearest(x[a : a + CHUNK])
            at.append(i)
            dist.append(d)
            exact += n
        return np.concatenate(at) if at else np.empty(0, dtype=np.int64), np.concatenate(dist) if dist else np.empty(0, dtype=np.int64), exact

    def _distance(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x[row] - self.entries[entry]
        return np.einsum("md,md->m", gap, gap)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        own, ref = Segments(x), self.seg
        slack = MARGIN * (own.square + ref.square.max(initial=0))
        bound = (own.norms[0][:, None] - ref.norms[0]) ** 2
        for b, length in enumerate(own.lengths[0]):
            bound += length * (own.means[0][:, b, None] - ref.means[0][:, b]) ** 2
        # the entry of the least coarse bound is looked at first, and limits the others
        seed = bound.argmin(axis=1)
        limit = self._distance(x, np.arange(len(x)), seed) + slack
        row, entry = np.nonzero(bound <= limit[:, None])
        exact = len(x)
        for level in range(1, len(LEVELS)):
            gap = own.means[level][row] - ref.means[level][entry]
            fine = (gap * gap) @ own.lengths[level] + (own.norms[level][row] - ref.norms[level][entry]) ** 2
            # so is the entry of the least bound at this level
            starts = _starts(row)
            seed = _first(fine, starts, entry, len(self.entries))[1]
            limit = np.minimum(limit, self._distance(x, np.arange(len(x)), seed) + slack)
            exact += len(x)
            kept = fine <= limit[row]
            row, entry = row[kept], entry[kept]
        least, at = _first(self._distance(x, row, entry), _starts(row), entry, len(self.entries))
        return at, least, exact + len(row)


def _starts(row: np.ndarray) -> np.ndarray:
    """Where each row's entries begin; every row has kept its nearest one at least."""
    return np.flatnonzero(np.diff(row, prepend=-1))


def _first(value: np.ndarray, starts: np.ndarray, entry: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each run, and the lowest entry that has it."""
    least = np.minimum.reduceat(value, starts)
    tied = np.where(value == np.repeat(least, np.diff(np.append(starts, len(value)))), entry, none)
    return least, np.minimum.reduceat(tied, starts)


def _parts(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    cuts = _cuts(dim, PARTS)
    for b in batches:
        x = matrix(b.column(column), dim)
        yield b, [x[:, lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]


def train(grid: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks after ``rounds`` over all of ``grid(id, x)``, one array of entries by components a part."""
    order = [F.col("id").isNull(), "id", "x"]
    first = grid.orderBy(*order).limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), dim)
    cuts = _cuts(dim, PARTS)
    books = [start[:, lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
    k = len(first)
    for _ in range(rounds):
        held = list(books)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = [Codebook(e) for e in held]  # noqa: B023
            total, seen = [np.zeros_like(e) for e in held], np.zeros((PARTS, k), dtype=np.int64)  # noqa: B023
            for _, parts in _parts(batches, "x", dim):
                for p, x in enumerate(parts):
                    at, _, _ = book[p].nearest(x)
                    np.add.at(total[p], at, x)
                    seen[p] += np.bincount(at, minlength=k)
            flat = np.concatenate([seen.ravel(), *(t.ravel() for t in total)])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([flat], type=pa.list_(pa.int64()))], names=["part", "v"])

        flat = tree_sum(grid.select("x").mapInArrow(add, "part int, v array<long>"))
        seen, rest = flat[: PARTS * k].reshape(PARTS, k), flat[PARTS * k :]
        nxt, at = [], 0
        for p, e in enumerate(held):
            total = rest[at : at + e.size].reshape(e.shape)
            at += e.size
            used = seen[p][:, None] > 0
            nxt.append(np.where(used, total // np.maximum(seen[p], 1)[:, None], e))
        books = nxt
    return books


def encode(grid: DataFrame, books: list[np.ndarray], dim: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *extra, code, error)`` for rows of ``grid(id, x, *extra)`` that have an ``x``."""
    ship(grid.sparkSession)
    names = ["id", *extra]
    types = ", ".join(f"`{n}` {grid.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = [Codebook(e) for e in books]
        for b, parts in _parts(batches, "x", dim):
            found = [book[p].nearest(x) for p, x in enumerate(parts)]
            code = np.zeros(len(b), dtype=np.int64)
            for at, _, _ in found:
                code = code * 256 + at
            error = np.sum([d for _, d, _ in found], axis=0, dtype=np.int64)
            text = pa.array([f"{c:0{2 * PARTS}x}" for c in code.tolist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), text, pa.array(error)], names=[*names, "code", "error"])

    return grid.select("x", *names).mapInArrow(run, f"{types}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(int(c)) for e in books for c in e.ravel()).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` for every row whose vector is there and finite.

    ``label_error`` adds up the errors of rows with an equal label (nulls together; without ``label_col``, of all
    rows); it is null where that exceeds a long. A codebook has at most as many entries as there are rows.
    The dimension is that of the least id's vector (nulls last); vectors of another length stay, with null code and error.
    Components are cut where squared distances would no longer fit 62 bits (beyond some 260 million at 64 dimensions). Rows that share an id
    are separate vectors, ordered by their vector; other columns are ignored. An empty table gives an empty result.
    """
    ship(rows.sparkSession)
    label = F.lit(0) if label_col is None else F.col(label_col)
    most = (1 << 30) // (isqrt(1 << 16) + 1)  # of a part of up to 65,536 components
    grid, dim = grid_vectors(rows, id_col, vector_col, SCALE, most, {"label": label}, "codes-grid")
    usable = grid.where("x IS NOT NULL")
    books = train(usable, dim) if dim is not None else []
    done = encode(usable, books, dim or 0, ("label",))
    other = grid.where("x IS NULL").select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = save(done.unionByName(other), "codes")
    # one row a label, written: the planner sees its size
    by_label = save(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    drop_saved(grid)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
