"""Dense fits in numpy for the cases without a closed form, and the tasks that distribute them.

A panel is small (one broadcast per executor); the work is the list of fits. Tasks are rows of a
DataFrame, dealt at random over partitions so that costly penalties don't meet in one, and run under
``mapInPandas``. A failed fit is a row with a null effect and converged -1, never an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.threads import one_thread
from ..functions.vectors import tree_sum
from ..shipping import ship
from ..spec import LARGE_PENALTY, InvalidPanel, effective_penalty
from . import factored

#: A panel that is broadcast has at most this many cells.
MOST_CELLS = 4_000_000


def shrink(m: np.ndarray, lam: float) -> np.ndarray:
    """Singular values less ``lam``, at least 0; the zero matrix for input that isn't finite."""
    if lam <= 0:
        return m
    if not np.isfinite(m).all() or lam >= np.linalg.norm(m):
        return np.zeros_like(m)
    try:
        u, s = factored.spectrum(m, lam)
    except np.linalg.LinAlgError:
        return np.zeros_like(m)
    keep = s - lam > 1e-10
    return (u[:, keep] * (1 - lam / s[keep])) @ (u[:, keep].T @ m)


def fit_cell(y: np.ndarray, w: np.ndarray, lam: float, x: np.ndarray | None = None, tol: float = 1e-6, maxiter: int = 500) -> dict:
    """Weighted two-way effects and a low-rank part on periods x units; ``w`` is 0 where a cell isn't used.

    From a cold start: in factors at interior penalties; at 0 and infinity unit means, period means and covariates alternate.
    """
    ok = (w > 0) & np.isfinite(y)
    w, y0 = np.where(ok, w, 0.0), np.where(ok, y, 0.0)
    t, n = y.shape
    if 0 < lam < LARGE_PENALTY:
        panel = factored.Panel(y0, w, None if x is None else np.nan_to_num(x))
        got = factored.solve(panel, lam, tol, maxiter)
        alpha, low = panel.parts(got.state, lam)
        return {"alpha": alpha, "beta": got.state.beta, "low": low, "gamma": got.state.gamma, "iters": got.passes, "converged": int(got.converged)}
    alpha, beta, low = np.zeros(n), np.zeros(t), np.zeros((t, n))
    gamma = np.zeros(0 if x is None else x.shape[2])
    xs = None if x is None else np.nan_to_num(x)
    col, row = w.sum(axis=0), w.sum(axis=1)
    converged = it = 0
    for it in range(1, maxiter + 1):
        old = alpha, beta, low, gamma
        xg = 0.0 if xs is None else xs @ gamma
        alpha = np.where(col > 0, (w * (y0 - beta[:, None] - low - xg)).sum(axis=0) / np.where(col > 0, col, 1), 0.0)
        beta = np.where(row > 0, (w * (y0 - alpha - low - xg)).sum(axis=1) / np.where(row > 0, row, 1), 0.0)
        rest = y0 - alpha - beta[:, None]
        if xs is not None:
            a = np.einsum("tnp,tn,tnq->pq", xs, w, xs)
            gamma = np.linalg.lstsq(a, np.einsum("tnp,tn->p", xs, w * (rest - low)), rcond=1e-10)[0]
            xg = xs @ gamma
        low = np.where(ok, rest - xg, low) if lam == 0 else np.zeros((t, n))
        moved = max((np.abs(a - b).max(initial=0) for a, b in zip((alpha, beta, low, gamma), old, strict=True)), default=0)
        if not np.isfinite(moved):
            raise FloatingPointError("fit diverged")
        if moved < tol:
            converged = 1
            break
    return {"alpha": alpha, "beta": beta, "low": low, "gamma": gamma, "iters": it, "converged": converged}


@dataclass
class Effects:
    """Weighted unit and period effects and covariates of a panel without a low-rank part; ``inverse`` is that of the normal equations."""

    w: np.ndarray
    x: np.ndarray
    inverse: np.ndarray
    eigen: np.ndarray

    @classmethod
    def of(cls, w: np.ndarray, x: np.ndarray) -> Effects:
        (t, n), p = w.shape, x.shape[2]
        m = np.zeros((n + t + p, n + t + p))
        m[:n, :n], m[n : n + t, n : n + t] = np.diag(w.sum(axis=0)), np.diag(w.sum(axis=1))
        m[n : n + t, :n], m[:n, n : n + t] = w, w.T
        if p:
            m[:n, n + t :], m[n : n + t, n + t :] = np.einsum("tn,tnp->np", w, x), np.einsum("tn,tnp->tp", w, x)
            m[n + t :, : n + t] = m[: n + t, n + t :].T
            m[n + t :, n + t :] = np.einsum("tnp,tn,tnq->pq", x, w, x)
        scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
        eigen, v = np.linalg.eigh(m / np.outer(scale, scale))
        real = eigen > 1e-11 * eigen[-1]
        v = v[:, real] / scale[:, None]
        return cls(w, x, (v / eigen[real]) @ v.T, eigen[real])

    def solve(self, goal: np.ndarray) -> np.ndarray:
        rest = self.w * goal
        return self.inverse @ np.concatenate((rest.sum(axis=0), rest.sum(axis=1), np.einsum("tn,tnp->p", rest, self.x)))

    def fitted(self, b: np.ndarray) -> np.ndarray:
        t, n = self.w.shape
        return b[:n] + b[n : n + t, None] + self.x @ b[n + t :]

    def towards(self, u: int, t: int) -> np.ndarray:
        """The inverse times the design row of a cell."""
        n = self.w.shape[1]
        return self.inverse[:, u] + self.inverse[:, n + t] + self.inverse[:, n + self.w.shape[0] :] @ self.x[t, u]


def fit_joint(y: np.ndarray, d: np.ndarray, delta: np.ndarray, lam: float, x: np.ndarray | None = None, tol: float = 1e-6, maxiter: int = 500, condition: bool = True) -> dict:
    """One weighted fit of intercept, unit and period effects, covariates and a low-rank part; the effect is the mean residual of treated cells."""
    t, n = y.shape
    ok = (delta > 0) & np.isfinite(y) & (d == 0)
    w = np.where(ok, delta, 0.0)
    if w.sum() < 1e-10:
        raise InvalidPanel("no control cell has weight")
    xs = np.zeros((t, n, 0)) if x is None else np.nan_to_num(x)
    flat = np.where(ok, y, 0.0)
    inner = 0 < lam < LARGE_PENALTY
    effects = Effects.of(w, xs) if condition or not inner else None
    low, converged, it = np.zeros((t, n)), 1, 1
    if inner:
        panel = factored.Panel(flat, w, xs)
        got = factored.solve(panel, lam, tol, maxiter)
        alpha, low = panel.parts(got.state, lam)
        b, converged, it = np.concatenate((alpha, got.state.beta, got.state.gamma)), int(got.converged), got.passes
    else:
        b = effects.solve(flat)
    fitted = b[:n] + b[n : n + t, None] + xs @ b[n + t :]
    if lam == 0:  # takes up all that is left of the fitted cells, and nothing elsewhere
        low = np.where(ok, flat - fitted, 0.0)
    fitted = fitted + low
    tau = np.where((d == 1) & np.isfinite(y), y - fitted, np.nan)
    return {
        "mu": b[0] + b[n], "alpha": b[:n] - b[0], "beta": b[n : n + t] - b[n], "gamma": b[n + t :], "low": low, "tau": tau, "fitted": fitted,
        "att": float(np.nanmean(tau)) if np.isfinite(tau).any() else np.nan, "iters": it, "converged": converged, "condition": None if effects is None else float(np.sqrt(effects.eigen[-1] / effects.eigen[0])),
    }


def fits_densely(cells: DataFrame) -> bool:
    """Whether the panel has no more cells than dense fits take."""
    size = cells.agg(F.max("u"), F.max("t")).first()
    return size[0] is None or (size[0] + 1) * (size[1] + 1) <= MOST_CELLS


def dense(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Outcome, treatment (NaN where absent) and covariates of a checked number of cells, periods x units."""
    size = cells.agg(F.max("u"), F.max("t"), F.count("*")).first()
    n, t = (size[0] if size[0] is not None else -1) + 1, (size[1] if size[1] is not None else -1) + 1
    if n * t > MOST_CELLS:
        raise InvalidPanel(f"{n} x {t} cells are too many for dense fits; use the closed forms")
    cols = ["u", "t", "y", "d"] + (["x"] if "x" in cells.columns else [])
    rows = cells.select(*cols).toPandas()
    y, d = np.full((t, n), np.nan), np.full((t, n), np.nan)
    y[rows.t, rows.u], d[rows.t, rows.u] = rows.y.astype(float), rows.d
    if "x" not in cols or not len(rows):
        return y, d, None
    p = len(rows.x.iloc[0])
    x = np.full((t, n, p), np.nan)
    x[rows.t, rows.u] = np.array([[np.nan if v is None else v for v in r] for r in rows.x], dtype=float)
    return y, d, x


def cell_weights(y: np.ndarray, d: np.ndarray, u: int, t: int, lam_time: float, lam_unit: float) -> np.ndarray:
    """theta x omega for target (u, t) on valid control cells, the target itself left out."""
    v = (d == 0) & np.isfinite(y)
    theta = np.exp(-lam_time * np.abs(np.arange(len(y)) - t))
    omega = np.ones(y.shape[1])
    if lam_unit > 0:
        both = v & v[:, [u]]
        both[t] = False
        n = both.sum(axis=0)
        sq = np.where(both, (np.nan_to_num(y) - np.nan_to_num(y[:, [u]])) ** 2, 0.0).sum(axis=0)
        omega = np.where(n > 0, np.exp(-lam_unit * np.sqrt(sq / np.maximum(n, 1))), 0.0)
        omega[u] = 1.0
    w = np.where(v, np.outer(theta, omega), 0.0)
    w[t, u] = 0.0
    return w


def share(cells: DataFrame) -> Broadcast:
    """The dense panel for all tasks. Whoever asks for it destroys it when its last result is there."""
    return cells.sparkSession.sparkContext.broadcast(dense(cells))


def cell_fits(cells: DataFrame, tasks: DataFrame, with_parameters: bool = False, tol: float = 1e-6, maxiter: int = 500, panel: Broadcast | None = None) -> DataFrame:
    """Two-step fits for ``tasks(task_id, u, t, lam_time, lam_unit, lam_norm)``.

    Returns ``(task_id, u, t, tau, iters, converged)``, with_parameters also alpha, beta and low (flat,
    period by period) and gamma.
    """
    spark = cells.sparkSession
    ship(spark)
    panel = panel or share(cells)
    extra = ", alpha array<double>, beta array<double>, low array<double>, gamma array<double>" if with_parameters else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        y, d, x = panel.value
        for f in frames:
            out = []
            for r in f.itertuples():
                row = {"task_id": r.task_id, "u": r.u, "t": r.t, "tau": None, "iters": 0, "converged": -1, "alpha": None, "beta": None, "low": None, "gamma": None}
                try:
                    w = cell_weights(y, d, r.u, r.t, r.lam_time, r.lam_unit)
                    if not w.any() or not np.isfinite(y[r.t, r.u]):
                        raise InvalidPanel("nothing to fit")
                    fit = fit_cell(y, w, effective_penalty(r.lam_norm), x, tol, maxiter)
                    effect = y[r.t, r.u] - fit["alpha"][r.u] - fit["beta"][r.t] - fit["low"][r.t, r.u]
                    if x is not None:
                        effect -= np.nan_to_num(x[r.t, r.u]) @ fit["gamma"]
                    row |= {"tau": float(effect), "iters": fit["iters"], "converged": fit["converged"], "alpha": fit["alpha"], "beta": fit["beta"], "low": fit["low"].ravel(), "gamma": fit["gamma"]}
                except (ArithmeticError, np.linalg.LinAlgError, InvalidPanel):
                    pass
                out.append(row)
            got = pd.DataFrame(out, columns=list(row) if out else None)
            yield got if with_parameters else got[["task_id", "u", "t", "tau", "iters", "converged"]]

    parts = spark.sparkContext.defaultParallelism * 4
    dealt = tasks.repartition(parts, F.xxhash64("task_id"))
    return dealt.mapInPandas(run, f"task_id long, u int, t int, tau double, iters int, converged int{extra}")


def averages(fits: DataFrame, n_units: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Means over the fits that succeeded: ``(u, alpha)``, ``(t, beta)``, ``(u, t, low)``.

    Each task adds its fits' vectors to one; the tasks' vectors are added in a tree.
    """
    spark = fits.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in zip(*(b.column(k) for k in range(3)), strict=True):
                v = np.concatenate([[1.0], *(c.values.to_numpy() for c in row)])
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([total], type=pa.list_(pa.float64()))], names=["part", "v"])

    total = tree_sum(fits.where("converged >= 0").select("alpha", "beta", "low").mapInArrow(add, "part int, v array<double>"))
    n = n_units if total is not None else 0
    t = 0 if total is None else (len(total) - 1 - n) // (n + 1)
    mean = np.zeros(0) if total is None else total[1:] / total[0]
    frame = lambda cols, kinds: spark.createDataFrame(pd.DataFrame(cols), kinds)
    alpha = frame({"u": np.arange(n, dtype=np.int32), "alpha": mean[:n]}, "u int, alpha double")
    beta = frame({"t": np.arange(t, dtype=np.int32), "beta": mean[n : n + t]}, "t int, beta double")
    ts, us = np.indices((t, n)).reshape(2, -1).astype(np.int32)
    return alpha, beta, frame({"u": us, "t": ts, "low": mean[n + t :]}, "u int, t int, low double")


def tasks_for(targets: DataFrame, grid: DataFrame) -> DataFrame:
    """Every target cell under every row of ``grid(g_id, lam_time, lam_unit, lam_norm)``."""
    t = targets.select("u", "t").crossJoin(F.broadcast(grid))
    return t.withColumn("task_id", F.monotonically_increasing_id())


#: Control cells fall into so many buckets by hash, so that a search may look at some of them first.
BUCKETS = 64


def controls(cells: DataFrame, buckets: tuple[int, int] | None = None) -> DataFrame:
    """``(u, t)`` of the cells that are left out in turn, or of those in buckets from the first number up to the second."""
    c = cells.where("d = 0 AND y IS NOT NULL").select("u", "t")
    at: Column = F.pmod(F.xxhash64("u", "t"), F.lit(BUCKETS))
    return c if buckets is None else c.where((at >= buckets[0]) & (at < buckets[1]))


def _first_failed() -> Column:
    """The first period and unit whose fit failed, as a struct; null if none did."""
    return F.min(F.when(F.col("tau").isNull(), F.struct("t", "u"))).alias("first_failed")


def cv_lowrank(cells: DataFrame, grid: DataFrame, tol: float = 1e-6, maxiter: int = 500, panel: Broadcast | None = None, buckets: tuple[int, int] | None = None) -> DataFrame:
    """Leave-one-out scores of interior penalties: ``(g_id, lam_time, lam_unit, lam_norm, q, n_valid, n_attempted, first_failed)``."""
    control = controls(cells, buckets)
    keyed = control.select("u", "t").crossJoin(F.broadcast(grid))
    keyed = keyed.withColumn("task_id", F.xxhash64("u", "t", "g_id"))
    fits = cell_fits(cells, keyed, tol=tol, maxiter=maxiter, panel=panel).select("task_id", "tau")
    return keyed.join(fits, "task_id").groupBy("g_id", "lam_time", "lam_unit", "lam_norm").agg(F.sum(F.col("tau") ** 2).alias("q"), F.count("tau").alias("n_valid"), F.count("*").alias("n_attempted"), _first_failed())


def joint_weights(y: np.ndarray, d: np.ndarray, lam_time: float, lam_unit: float) -> np.ndarray:
    """The joint estimator's weights for a design with simultaneous adoption."""
    t, n = y.shape
    ever = np.nanmax(d, axis=0) == 1
    if np.isnan(d[:, ever]).any():
        from ..spec import MissingTreatmentCell

        raise MissingTreatmentCell("a treated unit lacks cells")
    post = int((d[:, ever].max(axis=1) == 1).sum())
    time = np.exp(-lam_time * np.abs(np.arange(t) - (t - post / 2)))
    pre = slice(0, t - post)
    path = np.nanmean(y[pre][:, ever], axis=1)
    rmse = np.sqrt(np.nanmean((y[pre] - path[:, None]) ** 2, axis=0))
    unit = np.where(np.isnan(rmse), 0.0, np.exp(-lam_unit * np.nan_to_num(rmse)))
    return np.outer(time, unit) * (np.nan_to_num(1 - d))


class HeldOut:
    """Leave-one-out residuals of the joint fit for one combination of penalties.

    The normal equations are inverted once, and a cell is taken out by a rank-one change. Where its
    weighted residuals then have a spectral norm of at most half the penalty, the low-rank part is zero and the residual is e / (1 - h). Else the panel
    without the cell is fitted from where the whole panel's fit ended, until it is certified itself.
    """

    def __init__(self, y: np.ndarray, d: np.ndarray, x: np.ndarray | None, lam_time: float, lam_unit: float, lam: float, tol: float, maxiter: int) -> None:
        ok = np.isfinite(y) & (d == 0)
        self.w = np.where(ok, joint_weights(y, d, lam_time, lam_unit), 0.0)
        self.y, self.lam, self.tol, self.maxiter = np.where(ok, y, 0.0), lam, tol, maxiter
        self.x = np.zeros((*y.shape, 0)) if x is None else np.nan_to_num(x)
        self.effects = Effects.of(self.w, self.x)
        self.rest = self.y - self.effects.fitted(self.effects.solve(self.y))
        self.whole: factored.State | None = None
        self.fits = 0

    def residual(self, u: int, t: int) -> float | None:
        w, lam = self.w, self.lam
        if w.sum() - w[t, u] < 1e-10:
            return None
        q = self.effects.towards(u, t)
        moved = self.effects.fitted(q)
        left = 1 - w[t, u] * moved[t, u]
        plain = self.rest[t, u] / left if left > 1e-10 else None
        if lam == 0 or lam >= LARGE_PENALTY:
            return plain
        without = w.copy()
        without[t, u] = 0.0
        if plain is not None:
            rest = without * (self.rest + w[t, u] * plain * moved)
            if np.linalg.norm(rest) <= lam / 2 or np.linalg.norm(rest, 2) <= lam / 2:
                return float(plain)
        if self.whole is None:
            self.whole = factored.solve(factored.Panel(self.y, w, self.x), lam, self.tol, self.maxiter).state
        self.fits += 1
        panel = factored.Panel(self.y, without, self.x)
        got = factored.solve(panel, lam, self.tol, self.maxiter, self.whole)
        alpha, low = panel.parts(got.state, lam)
        return float(self.y[t, u] - alpha[u] - got.state.beta[t] - low[t, u] - self.x[t, u] @ got.state.gamma)


def cv_joint(cells: DataFrame, grid: DataFrame, tol: float = 1e-6, maxiter: int = 500, panel: Broadcast | None = None, buckets: tuple[int, int] | None = None) -> DataFrame:
    """Joint leave-one-out scores: each control cell in turn has weight 0 and the panel is fitted anew; columns as ``cv_lowrank``."""
    spark = cells.sparkSession
    ship(spark)
    panel = panel or share(cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        y, d, x = panel.value
        held: HeldOut | None = None
        key = None
        for f in frames:
            out = []
            for r in f.itertuples():
                tau = None
                try:
                    if key != r.g_id:  # rows are sorted by combination
                        key, held = r.g_id, None
                        held = HeldOut(y, d, x, r.lam_time, r.lam_unit, effective_penalty(r.lam_norm), tol, maxiter)
                    tau = held.residual(r.u, r.t) if held is not None else None
                except (ArithmeticError, np.linalg.LinAlgError, InvalidPanel):
                    pass
                out.append((r.g_id, r.lam_time, r.lam_unit, r.lam_norm, r.u, r.t, tau))
            yield pd.DataFrame(out, columns=["g_id", "lam_time", "lam_unit", "lam_norm", "u", "t", "tau"])

    keyed = controls(cells, buckets).crossJoin(F.broadcast(grid))
    dealt = keyed.repartition(spark.sparkContext.defaultParallelism * 4, F.xxhash64("u", "t", "g_id")).sortWithinPartitions("g_id")
    fits = dealt.mapInPandas(run, "g_id int, lam_time double, lam_unit double, lam_norm double, u int, t int, tau double")
    return fits.groupBy("g_id", "lam_time", "lam_unit", "lam_norm").agg(F.sum(F.col("tau") ** 2).alias("q"), F.count("tau").alias("n_valid"), F.count("*").alias("n_attempted"), _first_failed())


def joint_fit(cells: DataFrame, lam_time: float, lam_unit: float, lam_norm: float, tol: float = 1e-6, maxiter: int = 500) -> dict:
    """The joint fit of a dense panel held here, whose size is checked; ``operators.joint`` fits any."""
    y, d, x = dense(cells)
    return fit_joint(y, d, joint_weights(y, d, lam_time, lam_unit), effective_penalty(lam_norm), x, tol, maxiter)
