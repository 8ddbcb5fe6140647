"""The joint fit over a panel of any number of units: blocks of whole units in Spark, only sums over them anywhere else.

The longer side of the panel is cut into blocks, each a row with its outcomes, weights and covariates as arrays. A pass of
``operators.factored`` is one job over the blocks, whose sums are added in a tree (a panel of one block is solved within its task); the certificate of the low-rank part is block subspace
iteration on the weighted residual. What is carried between passes, and what the driver holds, has the shorter side's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.threads import one_thread
from ..functions.vectors import FEW, subspace, tree_sum
from ..shipping import ship
from ..spec import LARGE_PENALTY, InvalidPanel, effective_penalty
from . import factored
from .weights import joint_time, joint_unit

#: Cells of a block at most (unless a single line has more), directions sought at a time, and how far they are certified.
BLOCK_CELLS, DIRECTIONS, DIRECTION_ERROR = 1 << 19, 8, 1e-9


@dataclass
class JointFit:
    """``alpha(u, alpha)``, ``beta(t, beta)``, ``low(u, t, low)`` and ``tau(u, t, tau)`` of treated cells are plans over the blocks, which ``release`` frees."""

    mu: float
    alpha: DataFrame
    beta: DataFrame
    low: DataFrame
    tau: DataFrame
    gamma: list[float]
    objective: float
    iters: int
    converged: int
    rank: int
    dual: float
    blocks: DataFrame

    def release(self) -> None:
        self.blocks.unpersist()


def weighted_cells(cells: DataFrame, lam_time: float, lam_unit: float) -> DataFrame:
    """``(u, t, y, d, w[, x])`` with the joint method's weights, 0 where a cell isn't fitted."""
    time, unit = joint_time(cells, lam_time), joint_unit(cells, lam_unit).select("j", "delta_unit")
    a = cells.join(time, F.col("t") == F.col("s")).join(unit, F.col("u") == F.col("j"))
    w = F.when((F.col("d") == 0) & F.col("y").isNotNull(), F.col("delta_time") * F.col("delta_unit")).otherwise(0.0)
    return a.select("u", "t", "y", "d", w.alias("w"), *(["x"] if "x" in cells.columns else []))


def unit_blocks(weighted: DataFrame, n_short: int, n_covariates: int, line: str = "u", across: str = "t") -> DataFrame:
    """``(block, lines, y, w, d, x)``: lines along the long side by block, arrays short x lines as bytes. A block has whole lines."""
    per = max(1, BLOCK_CELLS // max(1, n_short))
    p = n_covariates

    def pack(table: pa.Table) -> pa.Table:
        lines, at = np.unique(table.column(line).to_numpy(), return_inverse=True)
        s = table.column(across).to_numpy()
        shape = (n_short, len(lines))
        y, w, d, x = np.full(shape, np.nan), np.zeros(shape), np.zeros(shape, dtype=np.int8), np.zeros((*shape, p))
        y[s, at] = table.column("y").to_numpy(zero_copy_only=False)
        w[s, at] = table.column("w").to_numpy(zero_copy_only=False)
        d[s, at] = table.column("d").to_numpy(zero_copy_only=False)
        if p:
            x[s, at] = np.nan_to_num(np.array(table.column("x").to_pylist(), dtype=float))
        row = {"block": table.column("block").slice(0, 1), "lines": pa.array([lines], type=pa.list_(pa.int32()))}
        return pa.table(row | {k: pa.array([v.tobytes()], type=pa.binary()) for k, v in (("y", y), ("w", w), ("d", d), ("x", x))})

    dealt = weighted.withColumn("block", F.floor(F.col(line) / per).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, lines array<int>, y binary, w binary, d binary, x binary")


def _unpack(batches: Iterator[pa.RecordBatch], n_short: int, p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(len(b)):
            lines = np.array(b.column("lines")[k].as_py())
            shape = (n_short, len(lines))
            get = lambda c, kind, s: np.frombuffer(b.column(c)[k].as_py(), dtype=kind).reshape(s)  # noqa: B023, E731
            yield lines, get("y", np.float64, shape), get("w", np.float64, shape), get("d", np.int8, shape), get("x", np.float64, (*shape, p))


class Spread:
    """A panel in blocks, for ``factored.solve``: every sweep is a job over the blocks."""

    def __init__(self, blocks: DataFrame, n_short: int, n_long: int, n_covariates: int) -> None:
        self.blocks, self.n_periods, self.n_units, self.n_covariates = blocks, n_short, n_long, n_covariates

    def _added(self, of) -> np.ndarray:
        n, p = self.n_periods, self.n_covariates

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, y, w, _, x in _unpack(batches, n, p):
                v = of(np.where(w > 0, y, 0.0), w, x)
                total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([total], type=pa.list_(pa.float64()))], names=["part", "v"])

        return tree_sum(self.blocks.mapInArrow(run, "part int, v array<double>"))

    def sweep(self, state: factored.State, lam: float) -> np.ndarray:
        return self._added(lambda y, w, x: factored.sums(state, y, w, x, lam))

    def leading(self, state: factored.State, lam: float) -> tuple[np.ndarray, np.ndarray]:
        """Leading left singular vectors and values of the weighted residual."""

        def product(q: np.ndarray) -> np.ndarray:
            def of(y: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
                m = w * factored.units_given(state, y, w, x, lam)[1]
                return (m @ (m.T @ q)).ravel()

            return self._added(of).reshape(q.shape)

        n = self.n_periods
        u, s, _, _ = subspace(product, n, min(DIRECTIONS, n), block=min(n, 2 * DIRECTIONS), enough=DIRECTION_ERROR)
        return u, np.sqrt(np.maximum(s, 0))


def _in_one_task(blocks: DataFrame, n_short: int, p: int, lam: float, tol: float, maxiter: int) -> factored.Solved:
    """The same passes over a panel of a single block, all within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for _, y, w, _, x in _unpack(batches, n_short, p):
            got = factored.solve(factored.Panel(np.where(w > 0, y, 0.0), w, x), lam, tol, maxiter)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (got.objective, got.passes, got.converged, got.dual)] + [pa.array([got.state.flat()], type=pa.list_(pa.float64()))], names=["objective", "passes", "converged", "dual", "state"])

    r = blocks.mapInArrow(run, "objective double, passes long, converged boolean, dual double, state array<double>").first()
    rank = (len(r["state"]) - p) // n_short - 1
    like = factored.State(np.zeros(n_short), np.zeros((n_short, rank)), np.zeros(p))
    return factored.Solved(like.like(np.array(r["state"])), r["objective"], r["passes"], r["converged"], r["dual"])


def fit(cells: DataFrame, lam_time: float, lam_unit: float, lam_norm: float, tol: float = 1e-6, maxiter: int = 500) -> JointFit:
    """Intercept, unit and period effects, covariates' coefficients and low-rank part of the joint method at a penalty above 0.

    The same optimum as ``kernels.fit_joint`` finds for a dense panel. Lines without weight have effect 0 before the
    intercept is taken out. The design must have simultaneous adoption (``validate.simultaneous``).
    """
    spark = cells.sparkSession
    ship(spark)
    lam = effective_penalty(lam_norm)
    if lam <= 0:
        raise InvalidPanel("the joint method is not identified at norm penalty 0")
    size = cells.agg(F.max("u").alias("u"), F.max("t").alias("t"), *([F.max(F.size("x")).alias("p")] if "x" in cells.columns else [])).first()
    n, t, p = size["u"] + 1, size["t"] + 1, size["p"] if "x" in cells.columns else 0
    line, across, n_long, n_short = ("u", "t", n, t) if n >= t else ("t", "u", t, n)
    count = -(-n_long // max(1, BLOCK_CELLS // n_short))
    blocks = unit_blocks(weighted_cells(cells, lam_time, lam_unit), n_short, p, line, across)
    blocks = (blocks.coalesce(count) if count < FEW else blocks).persist()
    problem = Spread(blocks, n_short, n_long, p)
    weight = problem._added(lambda y, w, x: np.array([w.sum()]))
    if weight is None or weight[0] < 1e-10:
        blocks.unpersist()
        raise InvalidPanel("no control cell has weight")
    goal = np.inf if lam >= LARGE_PENALTY else lam
    got = _in_one_task(blocks, n_short, p, goal, tol, maxiter) if count == 1 else factored.solve(problem, goal, tol, maxiter)
    state, ridge = got.state, 0.0 if lam >= LARGE_PENALTY else lam

    def per_line(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, y, w, _, x in _unpack(b, n_short, p):
            theta, _ = factored.units_given(state, np.where(w > 0, y, 0.0), w, x, ridge)
            yield pa.RecordBatch.from_arrays([pa.array(lines, type=pa.int32()), pa.array(theta[:, 0])], names=["at", "effect"])

    def per_cell(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, y, w, d, x in _unpack(b, n_short, p):
            theta, _ = factored.units_given(state, np.where(w > 0, y, 0.0), w, x, ridge)
            low = state.a @ theta[:, 1:].T
            tau = y - theta[:, 0] - state.beta[:, None] - low - x @ state.gamma
            short, long_ = np.indices(y.shape)
            flat = [pa.array(lines[long_.ravel()], type=pa.int32()), pa.array(short.ravel(), type=pa.int32()), pa.array(low.ravel()), pa.array(tau.ravel(), mask=~(np.isfinite(tau) & (d == 1)).ravel())]
            yield pa.RecordBatch.from_arrays(flat, names=[line, across, "low", "tau"])

    along = blocks.mapInArrow(per_line, "at int, effect double")
    zero = along.where("at = 0").first()["effect"]
    along = along.withColumn("effect", F.col("effect") - zero)
    other = spark.createDataFrame([(i, float(b - state.beta[0])) for i, b in enumerate(state.beta)], "at int, effect double")
    unit, time = (along, other) if line == "u" else (other, along)
    every = blocks.mapInArrow(per_cell, f"{line} int, {across} int, low double, tau double")
    return JointFit(
        float(zero + state.beta[0]), unit.select(F.col("at").alias("u"), F.col("effect").alias("alpha")), time.select(F.col("at").alias("t"), F.col("effect").alias("beta")),
        every.select("u", "t", "low"), every.where("tau IS NOT NULL").select("u", "t", "tau"), [float(g) for g in state.gamma],
        got.objective, got.passes, int(got.converged), state.a.shape[1], got.dual, blocks,
    )
