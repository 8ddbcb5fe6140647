"""Unit and time weights of the two-step and the joint estimator, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running
from .distance import distances_without
from .index import treated_cells, units


def theta(targets: DataFrame, cells: DataFrame, lam: float) -> DataFrame:
    """``(t, s, theta)``: exp(-lam |t - s|) for each target period and every period."""
    periods = cells.select(F.col("t").alias("s")).distinct()
    return targets.select("t").distinct().crossJoin(periods).withColumn("theta", F.exp(-lam * F.abs(F.col("t") - F.col("s"))))


def omega(targets: DataFrame, cells: DataFrame, lam: float) -> DataFrame:
    """``(u, t, j, omega)``: exp(-lam dist without t); the unit itself 1; no shared period 0; all 1 for lam 0."""
    everyone = cells.select(F.col("u").alias("j")).distinct()
    grid = targets.select("u", "t").crossJoin(everyone)
    if lam == 0:
        return grid.withColumn("omega", F.lit(1.0))
    d = distances_without(cells, targets)
    joined = grid.join(d, ["u", "t", "j"], "left")
    w = F.when(F.col("u") == F.col("j"), 1.0).when(F.col("dist").isNull(), 0.0).otherwise(F.exp(-lam * F.col("dist")))
    return joined.select("u", "t", "j", w.alias("omega"))


def weight_matrix(targets: DataFrame, cells: DataFrame, lam_time: float, lam_unit: float, drop_below: float = 0.0) -> DataFrame:
    """``(u, t, j, s, w)`` = theta x omega; with ``drop_below``, cells under that share of the target's largest are left out."""
    w = omega(targets, cells, lam_unit).join(theta(targets, cells, lam_time), "t").withColumn("w", F.col("theta") * F.col("omega"))
    if drop_below:
        top = F.max("w").over(Window.partitionBy("u", "t"))
        w = w.withColumn("top", top).where(F.col("w") >= drop_below * F.col("top"))
    return w.select("u", "t", "j", "s", "w")


def shape(cells: DataFrame) -> DataFrame:
    """One row: n_t and t_post of a design with simultaneous adoption."""
    return cells.agg(F.countDistinct("t").alias("n_t"), F.min(F.when(F.col("d") == 1, F.col("t"))).alias("t1")).select("n_t", (F.col("n_t") - F.col("t1")).alias("t_post"))


def joint_time(cells: DataFrame, lam: float) -> DataFrame:
    """``(s, delta_time)``: distance from the centre T - T_post / 2."""
    periods = cells.select(F.col("t").alias("s")).distinct().crossJoin(F.broadcast(shape(cells)))
    return periods.select("s", F.exp(-lam * F.abs(F.col("s") - (F.col("n_t") - F.col("t_post") / 2))).alias("delta_time"))


def joint_unit(cells: DataFrame, lam: float) -> DataFrame:
    """``(j, rmse, delta_unit)``: against the mean path of ever-treated units before adoption."""
    pre = cells.where("y IS NOT NULL").crossJoin(F.broadcast(shape(cells))).where("t < n_t - t_post")
    path = pre.join(units(cells).where("treated").select("u"), "u").groupBy("t").agg(F.avg("y").alias("m"))
    rmse = pre.join(path, "t").groupBy("u").agg(F.sqrt(F.avg((F.col("y") - F.col("m")) ** 2)).alias("rmse"))
    everyone = cells.select("u").distinct().crossJoin(F.broadcast(shape(cells)))
    joined = everyone.join(rmse, "u", "left")
    w = F.when(F.col("n_t") == F.col("t_post"), 1.0).when(F.col("rmse").isNull(), 0.0).otherwise(F.exp(-lam * F.col("rmse")))
    return joined.select(F.col("u").alias("j"), "rmse", w.alias("delta_unit"))


def joint_delta(cells: DataFrame, lam_time: float, lam_unit: float) -> DataFrame:
    """``(u, t, delta)``: product of both, zero on treated cells."""
    a = cells.join(joint_time(cells, lam_time), F.col("t") == F.col("s")).join(joint_unit(cells, lam_unit), F.col("u") == F.col("j"))
    return a.select("u", "t", (F.col("delta_time") * F.col("delta_unit") * (1 - F.col("d"))).alias("delta"))


def first_target(cells: DataFrame) -> DataFrame:
    """The treated cell that comes first by period, then unit."""
    return treated_cells(cells).orderBy("t", "u").limit(1)


def stats(weights: DataFrame, key: str, value: str) -> DataFrame:
    """Count, extremes and where they are (the first of ties), mean, sd, percentiles, entropy, effective size, concentration."""
    w = weights.select(F.col(key).alias("k"), F.col(value).alias("w"))
    first = lambda order: F.struct(order, F.col("k"))
    a = w.agg(
        F.count("w").alias("n"), F.min("w").alias("min"), F.max("w").alias("max"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"),
        F.min(first(F.col("w")))["k"].alias("argmin"), F.min(first(-F.col("w")))["k"].alias("argmax"), F.sum("w").alias("total"),
        *[F.percentile("w", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)],
    )
    p = w.crossJoin(F.broadcast(a.select("total", "n"))).withColumn("p", F.try_divide("w", "total"))
    # equal weights are one value of the order; how many of them it takes to reach a half is arithmetic
    same = p.groupBy("p", "n").agg(F.count("w").alias("k")).where("p IS NOT NULL").withColumn("mass", F.col("p") * F.col("k"))
    order = running(same, "p", {"mass_above": (F.sum, "mass", True), "k_above": (F.sum, "k", True)})
    short = 0.5 - 1e-12 - (F.col("mass_above") - F.col("mass"))
    need = F.col("k_above") - F.col("k") + F.greatest(F.lit(1), F.ceil(F.try_divide(short, F.col("p"))))
    reached = order.agg(F.try_divide(F.min(F.when(F.col("mass_above") >= 0.5 - 1e-12, need)), F.max("n")).alias("concentration"))
    b = p.agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"), F.try_divide(F.lit(1.0), F.sum(F.col("p") ** 2)).alias("ess")).crossJoin(reached)
    return a.drop("total").crossJoin(b)

