"""Two-step fits over the cells that matter to a target, for panels that no task can hold whole.

A target's weights fall with distance in time and between units, so most cells of a long and wide panel weigh next to
nothing. Units are kept as one row each (their control cells in order of periods); a target meets those whose weight may
matter, each cut to its periods that do, and is fitted in one task over these units and periods alone.

What is left out is bounded: the fit, carried on to the other cells, exceeds the least objective of the whole panel by at most
their weight times the greatest square that their residuals can have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.threads import one_thread
from ..shipping import ship
from ..spec import InvalidPanel, effective_penalty
from . import kernels
from .distance import distances_without

#: Units whose greatest weight is under this share of that of all other units are left out, and cells whose period weighs under this share of the nearest
#: one of their unit's and of the target's unit's control periods.
DROP_BELOW = 1e-6


def series(cells: DataFrame) -> DataFrame:
    """``(j, path)``: each unit's control cells ``(s, y)``, with covariates ``(s, y, x)``, by period."""
    held = [F.col("t").alias("s"), "y", *(["x"] if "x" in cells.columns else [])]
    return cells.where("d = 0 AND y IS NOT NULL AND NOT isnan(y)").groupBy(F.col("u").alias("j")).agg(F.sort_array(F.collect_list(F.struct(*held))).alias("path"))


def partners(cells: DataFrame, targets: DataFrame, lam_unit: float) -> DataFrame:
    """``(u, t, j, omega)``: the units that a target meets, itself among them, and their weights (1 each without a unit penalty)."""
    own = targets.select("u", "t", F.col("u").alias("j"), F.lit(1.0).alias("omega"))
    if lam_unit == 0:  # all units weigh alike: every target really needs all of them
        others = targets.select("u", "t").crossJoin(cells.select(F.col("u").alias("j")).distinct()).select("*", F.lit(1.0).alias("omega"))
    else:
        others = distances_without(cells, targets).where("dist IS NOT NULL").select("u", "t", "j", F.exp(-lam_unit * F.col("dist")).alias("omega"))
    return own.unionByName(others.where("u <> j"))


def _weight(lam_time: float, s: Column) -> Column:
    return F.exp(-lam_time * F.abs(s - F.col("t"))) * F.col("omega")


def support(cells: DataFrame, targets: DataFrame, lam_time: float, lam_unit: float, drop_below: float = DROP_BELOW) -> DataFrame:
    """``(u, t, j, omega, path, mass, lesser)``: a target's units with those of their control cells that matter.

    ``mass`` is what all its cells weigh, left out or not; ``lesser`` is what the own unit's do or what all others' do, if that is less.

    Units are cut by what they weigh, the own unit staying always, and periods by what they weigh against the nearest of the unit's and the nearest of the target's unit's: a cut of cells by
    their product would leave units of little weight a few cells, from which their effects can't be told. The target's own cell is never among them.
    """
    met = partners(cells, targets, lam_unit).join(series(cells), "j")
    path = F.filter("path", lambda c: (F.col("j") != F.col("u")) | (c["s"] != F.col("t")))
    met = met.where("omega > 0").select("u", "t", "j", "omega", path.alias("path")).where(F.size("path") > 0)
    weights = F.transform("path", lambda c: _weight(lam_time, c["s"]))
    other = lambda c: F.when(F.col("j") != F.col("u"), F.col(c))
    sized = met.select("u", "t", "j", F.array_max(weights).alias("best"), F.aggregate(weights, F.lit(0.0), lambda a, b: a + b).alias("mass"))
    most = sized.groupBy("u", "t").agg(
        F.max(other("best")).alias("top"), F.max(F.when(F.col("j") == F.col("u"), F.col("best"))).alias("nearest"), F.sum("mass").alias("mass"), F.least(F.sum(F.when(F.col("j") == F.col("u"), F.col("mass"))), F.sum(other("mass"))).alias("lesser"),
    )
    x = met.withColumn("best", F.array_max(weights)).join(most, ["u", "t"]).where((F.col("j") == F.col("u")) | (F.col("best") >= drop_below * F.col("top")))
    kept = F.filter("path", lambda c: F.exp(-lam_time * F.abs(c["s"] - F.col("t"))) >= drop_below * F.least(F.col("best") / F.col("omega"), F.col("nearest")))
    return x.select("u", "t", "j", "omega", kept.alias("path"), "mass", "lesser")


def sizes(found: DataFrame, lam_time: float) -> DataFrame:
    """``(u, t, n_cells, kept, left_out)``: how many of a target's cells matter, what they weigh, and what the others do."""
    weights = F.transform("path", lambda c: _weight(lam_time, c["s"]))
    own = found.select("u", "t", F.size("path").alias("n"), F.aggregate(weights, F.lit(0.0), lambda a, b: a + b).alias("w"), "mass")
    return own.groupBy("u", "t").agg(F.sum("n").alias("n_cells"), F.sum("w").alias("kept"), F.greatest(F.max("mass") - F.sum("w"), F.lit(0.0)).alias("left_out"))


def fits(cells: DataFrame, targets: DataFrame, lam: tuple[float, float, float], tol: float = 1e-6, maxiter: int = 500, drop_below: float = DROP_BELOW) -> DataFrame:
    """``(u, t, tau, iters, converged, n_cells, left_out, excess)`` for every target ``(u, t)`` with an outcome.

    ``left_out``: what was left out weighs so much of the lesser of two, the own unit's cells and all others'; ``excess``: at most so much of the fit's objective lies above the whole panel's
    least one (null with covariates, whose values have no known range). A target without cells, or whose fit fails, has a null effect and converged -1.
    Targets whose units and periods make up more than ``kernels.MOST_CELLS`` are refused before any is gathered.
    """
    spark = cells.sparkSession
    ship(spark)
    lam_time, lam_unit, lam_norm = lam
    found = support(cells, targets, lam_time, lam_unit, drop_below)
    at = lambda k: F.col("path")[k]["s"]
    ends = found.groupBy("u", "t").agg(F.count("*").alias("units"), F.min(at(0)).alias("first"), F.max(F.element_at("path", -1)["s"]).alias("last"))
    large = ends.agg(F.max((F.col("units") + 1) * (F.greatest("last", "t") - F.least("first", "t") + 1))).first()[0]
    if large and large > kernels.MOST_CELLS:
        raise InvalidPanel(f"a target's units and periods that matter make up {large} cells, too many for one task")
    low, high = cells.where("d = 0 AND y IS NOT NULL AND NOT isnan(y)").agg(F.min("y"), F.max("y")).first()
    own = cells.select("u", "t", F.col("y").alias("y0"), *([F.col("x").alias("x0")] if "x" in cells.columns else []))
    wanted = targets.select("u", "t").join(own, ["u", "t"])
    penalty = effective_penalty(lam_norm)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        one_thread()
        u, t = (int(k.as_py()) for k in key)
        row = {"u": u, "t": t, "tau": None, "iters": 0, "converged": -1, "n_cells": 0, "left_out": None, "excess": None}
        try:
            row |= _fit_one(u, t, table, lam_time, penalty, tol, maxiter, low, high)
        except (ArithmeticError, np.linalg.LinAlgError, InvalidPanel):
            pass
        return pa.Table.from_pylist([row], schema=RESULT)

    got = found.join(wanted, ["u", "t"]).groupBy("u", "t").applyInArrow(fit, "u int, t int, tau double, iters int, converged int, n_cells long, left_out double, excess double")
    back = wanted.select("u", "t").join(got, ["u", "t"], "left")
    return back.fillna({"iters": 0, "converged": -1, "n_cells": 0})


RESULT = pa.schema([("u", pa.int32()), ("t", pa.int32()), ("tau", pa.float64()), ("iters", pa.int32()), ("converged", pa.int32()), ("n_cells", pa.int64()), ("left_out", pa.float64()), ("excess", pa.float64())])


def _fit_one(u: int, t: int, table: pa.Table, lam_time: float, penalty: float, tol: float, maxiter: int, low: float, high: float) -> dict:
    y0 = table["y0"][0].as_py()
    if y0 is None or not np.isfinite(y0):
        raise InvalidPanel("no outcome")
    path = table["path"].combine_chunks()
    flat = path.flatten()
    s, value = flat.field("s").to_numpy(), flat.field("y").to_numpy()
    js, omega = table["j"].to_numpy(), table["omega"].to_numpy()
    unit_of = np.repeat(np.arange(len(js)), np.diff(path.offsets.to_numpy()))
    units, periods = np.unique(np.append(js, u)), np.unique(np.append(s, t))
    col, row = np.searchsorted(units, js)[unit_of], np.searchsorted(periods, s)
    y, w = np.zeros((len(periods), len(units))), np.zeros((len(periods), len(units)))
    y[row, col], w[row, col] = value, np.exp(-lam_time * np.abs(s - t)) * omega[unit_of]
    own = np.searchsorted(periods, t), np.searchsorted(units, u)
    x = None
    if "x0" in table.column_names:
        given = np.array([[np.nan if v is None else v for v in r] for r in flat.field("x").to_pylist()], dtype=float)
        x = np.zeros((*y.shape, given.shape[1]))
        x[row, col] = np.nan_to_num(given)
        x[own] = np.nan_to_num(np.array([np.nan if v is None else v for v in table["x0"][0].as_py()], dtype=float))
    got = kernels.fit_cell(y, w, penalty, x, tol, maxiter)
    alpha, beta, part = got["alpha"], got["beta"], got["low"]
    effect = y0 - alpha[own[1]] - beta[own[0]] - part[own] - (0.0 if x is None else x[own] @ got["gamma"])
    mass = table["mass"][0].as_py()
    missed = max(mass - float(w.sum()), 0.0)
    excess = None
    if x is None:
        # cells left out: within these units and periods, of other periods, of other units
        middle, mean = (low + high) / 2, beta.mean()
        away = max(np.abs(alpha + beta[:, None] + part - middle).max(), np.abs(alpha + mean - middle).max(), np.abs(beta - mean).max())
        strength = np.linalg.svd(part, compute_uv=False).sum() if 0 < penalty < kernels.LARGE_PENALTY else 0.0
        objective = float((w * (y - alpha - beta[:, None] - part) ** 2).sum() + (penalty * strength if strength else 0.0))
        over = missed * ((high - low) / 2 + away) ** 2
        excess = float(over / (objective + over)) if over > 0 else 0.0
    return {"tau": float(effect), "iters": got["iters"], "converged": got["converged"], "n_cells": len(s), "left_out": missed / table["lesser"][0].as_py() if missed else 0.0, "excess": excess}
