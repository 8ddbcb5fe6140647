"""Estimator corners with closed forms, as plain expressions.

``twostep_zero``: penalty 0, any design: unit means over control cells by time weights, then period means
of what is left by unit weights. ``twostep_inf`` and ``joint_inf``: infinite penalty, simultaneous
adoption, complete panel: weighted difference in differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import treated_cells, units, valid
from .weights import joint_time, joint_unit, omega, shape, theta


def unit_sums(cells: DataFrame, targets: DataFrame, lam_time: float) -> DataFrame:
    """``(t, j, sw, swy)``: time-weighted sums of each unit's valid cells, for each target period."""
    c = valid(cells).select(F.col("u").alias("j"), F.col("t").alias("s"), "y")
    w = theta(targets, cells, lam_time)
    return c.join(w, "s").groupBy("t", "j").agg(F.sum("theta").alias("sw"), F.sum(F.col("theta") * F.col("y")).alias("swy"))


def twostep_zero(cells: DataFrame, targets: DataFrame, lam_time: float, lam_unit: float) -> DataFrame:
    """``(u, t, y, alpha, beta, tau)`` for each target cell; a control cell is left out of its own fit.

    A unit or period without weight has alpha or beta 0.
    """
    sums = unit_sums(cells, targets, lam_time)
    t0 = targets.select("u", "t", "y")
    c = valid(cells)
    own = t0.join(sums.withColumnRenamed("j", "u"), ["u", "t"], "left").join(c.select("u", "t", F.lit(1).alias("in_fit")), ["u", "t"], "left")
    held = F.coalesce("in_fit", F.lit(0))
    sw, swy = F.coalesce("sw", F.lit(0.0)) - held, F.coalesce("swy", F.lit(0.0)) - held * F.col("y")
    own = own.select("u", "t", "y", F.when(sw > 1e-12, swy / sw).otherwise(0.0).alias("alpha"))
    left = c.select(F.col("u").alias("j"), "t", F.col("y").alias("y_j")).join(sums, ["t", "j"]).select("j", "t", (F.col("y_j") - F.col("swy") / F.col("sw")).alias("r"))
    if lam_unit == 0:  # all others count alike: a period's sums less the unit's own
        per = left.groupBy("t").agg(F.count("*").cast("double").alias("n"), F.sum("r").alias("sr"))
        mine = t0.select("u", "t").join(per, "t").join(left.withColumnRenamed("j", "u"), ["u", "t"], "left")
        beta = mine.select("u", "t", (F.col("n") - F.col("r").isNotNull().cast("int")).alias("sw"), (F.col("sr") - F.coalesce("r", F.lit(0.0))).alias("swr"))
    else:
        w = omega(targets, cells, lam_unit).where("u <> j")
        beta = w.join(left, ["j", "t"]).groupBy("u", "t").agg(F.sum("omega").alias("sw"), F.sum(F.col("omega") * F.col("r")).alias("swr"))
    out = own.join(beta, ["u", "t"], "left").withColumn("beta", F.when(F.col("sw") > 0, F.col("swr") / F.col("sw")).otherwise(0.0))
    return out.select("u", "t", "y", "alpha", "beta", (F.col("y") - F.col("alpha") - F.col("beta")).alias("tau"))


def att(tau: DataFrame) -> DataFrame:
    """Mean effect over target cells and their number."""
    return tau.agg(F.avg("tau").alias("att"), F.count("tau").alias("n_cells"))


def weighted_att(tau: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean effect by unit weights ``(u, w)``; weights that aren't positive and finite are left out."""
    w = tau.join(weights, "u").where("w > 0 AND w < double('infinity')")
    return w.agg(F.try_divide(F.sum(F.col("w") * F.col("tau")), F.sum("w")).alias("att"), F.sum("w").alias("sum_w"))


def joint_inf(cells: DataFrame, lam_time: float, lam_unit: float) -> DataFrame:
    """The joint effect without a low-rank part: one row ``(lam_time, lam_unit, att)``."""
    g = cells.sparkSession.createDataFrame([(float(lam_time), float(lam_unit))], "lam_time double, lam_unit double")
    return joint_inf_grid(cells, g)


def joint_inf_grid(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """``(lam_time, lam_unit, att)`` for every row of ``grid(lam_time, lam_unit)``, in one plan."""
    one = shape(cells)
    rmse = joint_unit(cells, 0.0).select(F.col("j").alias("u"), "rmse")
    per = cells.join(units(cells).select("u", "treated"), "u").join(rmse, "u").crossJoin(F.broadcast(one))
    rows = per.crossJoin(F.broadcast(grid))
    dt = F.exp(-F.col("lam_time") * F.abs(F.col("t") - (F.col("n_t") - F.col("t_post") / 2)))
    du = F.when(F.col("rmse").isNull(), 0.0).otherwise(F.exp(-F.col("lam_unit") * F.col("rmse")))
    pre = F.col("t") < F.col("n_t") - F.col("t_post")
    rows = rows.select("lam_time", "lam_unit", "treated", pre.alias("pre"), dt.alias("dt"), du.alias("du"), "y")
    n = lambda c, v: F.sum(F.when(c, v))
    y, dt_, du_, tr, pr = F.col("y"), F.col("dt"), F.col("du"), F.col("treated"), F.col("pre")
    # controls after adoption are weighted by unit within each period, and periods alike: sums over a complete block
    a = rows.groupBy("lam_time", "lam_unit").agg(
        F.avg(F.when(tr & ~pr, y)).alias("t_post"),
        F.try_divide(n(tr & pr, dt_ * y), n(tr & pr, dt_)).alias("t_pre"),
        F.try_divide(n(~tr & ~pr, du_ * y), n(~tr & ~pr, du_)).alias("c_post"),
        F.try_divide(n(~tr & pr, dt_ * du_ * y), n(~tr & pr, dt_ * du_)).alias("c_pre"),
    )
    return a.select("lam_time", "lam_unit", (F.col("t_post") - F.col("t_pre") - F.col("c_post") + F.col("c_pre")).alias("att"))


def joint_inf_tau(cells: DataFrame, lam_time: float, lam_unit: float) -> DataFrame:
    """``(u, t, y, tau)``: each treated cell's own residual of the joint fit without a low-rank part.

    A cell's outcome, less its unit's time-weighted mean before adoption, less what the controls' weighted
    mean of the period exceeds their weighted mean before adoption by. The mean of tau is the joint effect.
    """
    one = F.broadcast(shape(cells))
    time, unit = joint_time(cells, lam_time), joint_unit(cells, lam_unit).select(F.col("j").alias("u"), "delta_unit")
    per = cells.join(units(cells).select("u", "treated"), "u").join(unit, "u").join(time, F.col("t") == F.col("s")).crossJoin(one)
    per = per.withColumn("pre", F.col("t") < F.col("n_t") - F.col("t_post"))
    own = per.where("treated AND pre").groupBy("u").agg(F.try_divide(F.sum(F.col("delta_time") * F.col("y")), F.sum("delta_time")).alias("own_pre"))
    w = F.col("delta_time") * F.col("delta_unit")
    before = per.where("NOT treated AND pre").agg(F.try_divide(F.sum(w * F.col("y")), F.sum(w)).alias("c_pre"))
    now = per.where("NOT treated AND NOT pre").groupBy("t").agg(F.try_divide(F.sum(F.col("delta_unit") * F.col("y")), F.sum("delta_unit")).alias("c_now"))
    t = treated_cells(cells).select("u", "t", "y").join(own, "u").join(now, "t").crossJoin(F.broadcast(before))
    return t.select("u", "t", "y", (F.col("y") - F.col("own_pre") - F.col("c_now") + F.col("c_pre")).alias("tau"))


def did(cells: DataFrame) -> DataFrame:
    """Difference in differences of a block design and its four means."""
    per = cells.join(units(cells).select("u", "treated"), "u").crossJoin(F.broadcast(shape(cells)))
    post = F.col("t") >= F.col("n_t") - F.col("t_post")
    m = lambda a, b: F.avg(F.when(a & b, F.col("y")))
    tr = F.col("treated")
    a = per.agg(m(tr, post).alias("treated_post"), m(tr, ~post).alias("treated_pre"), m(~tr, post).alias("control_post"), m(~tr, ~post).alias("control_pre"))
    return a.withColumn("did", F.col("treated_post") - F.col("treated_pre") - F.col("control_post") + F.col("control_pre"))


def twostep_inf(cells: DataFrame, lam_time: float, lam_unit: float) -> DataFrame:
    """``(u, t, y, tau)`` per treated cell: each with its own time and unit weights."""
    targets = treated_cells(cells).select("u", "t", "y")
    pre = cells.crossJoin(F.broadcast(shape(cells))).where("t < n_t - t_post").select(F.col("u").alias("j"), F.col("t").alias("s"), F.col("y").alias("y_s"))
    w = theta(targets, cells, lam_time)
    before = pre.join(w, "s").groupBy("t", "j").agg(F.try_divide(F.sum(F.col("theta") * F.col("y_s")), F.sum("theta")).alias("m"))
    own = targets.join(before.withColumnRenamed("j", "u"), ["u", "t"]).select("u", "t", "y", F.col("m").alias("own_pre"))
    never = units(cells).where("NOT treated").select(F.col("u").alias("j"))
    now = cells.select(F.col("u").alias("j"), "t", F.col("y").alias("y_now"))
    controls = omega(targets, cells, lam_unit).join(never, "j").join(now, ["j", "t"]).join(before, ["j", "t"])
    gain = controls.groupBy("u", "t").agg(F.try_divide(F.sum(F.col("omega") * (F.col("y_now") - F.col("m"))), F.sum("omega")).alias("gain"))
    return own.join(gain, ["u", "t"]).select("u", "t", "y", (F.col("y") - F.col("own_pre") - F.col("gain")).alias("tau"))

