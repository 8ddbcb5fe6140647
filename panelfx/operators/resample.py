"""Bootstraps as joins: draws are counts of how often a unit (or sampling unit) is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SurveyDesign
from .index import treated_cells, units, valid
from .native import unit_sums

#: Fixed values of the portable generator: modulus and the multipliers of its three rounds.
MODULUS, ROUNDS = 2147483647, (48271, 69621, 16807)


def draw(b: Column, k: Column, seed: int, group: Column | None = None) -> Column:
    """A pseudo-random whole number from replicate and slot in 64-bit integer arithmetic, alike on every engine and partitioning.

    ``group`` is a number drawn for the slot's group, which sets the slots of groups of any size apart.
    """
    x = F.pmod(b.cast("long") * 7919 + k.cast("long") * 104729 + F.lit(seed * 613 + 1) + (0 if group is None else group), F.lit(MODULUS))
    for c in ROUNDS:
        x = F.pmod(F.pmod(x * x, F.lit(MODULUS)) + x * c + c, F.lit(MODULUS))
    return x


def replicates(cells: DataFrame, n: int) -> DataFrame:
    return cells.sparkSession.range(n).select(F.col("id").cast("int").alias("b"))


def unit_draws(cells: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """``(b, k, u)``: never-treated units for the first slots, ever-treated for the rest, each with replacement."""
    u = units(cells).withColumn("i", F.row_number().over(Window.partitionBy("treated").orderBy("u")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("treated")))
    n0 = u.agg(F.count(F.when(~F.col("treated"), 1)).alias("n0"))
    slots = u.crossJoin(F.broadcast(n0)).select("treated", "n", (F.col("i") + F.when(F.col("treated"), F.col("n0")).otherwise(0)).alias("k"))
    drawn = replicates(cells, n_boot).crossJoin(slots).withColumn("i", (draw(F.col("b"), F.col("k"), seed) % F.col("n")).cast("int"))
    return drawn.join(u.select("treated", "i", "u"), ["treated", "i"]).select("b", "k", "u")


def boot_zero(cells: DataFrame, lam_time: float, draws: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(b, att)`` of the two-step estimator at unit and norm penalty 0, by multiplicities.

    A unit's own mean doesn't depend on who else is drawn, so a replicate only re-weights the period
    means: nothing is fitted again. Replicates without a treated cell are left out.
    """
    m = draws.groupBy("b", "u").agg(F.count("*").alias("m"))
    targets = treated_cells(cells)
    sums = unit_sums(cells, targets, lam_time)
    sums = sums.withColumnRenamed("j", "u")
    own = targets.select("u", "t", "y").join(sums, ["u", "t"], "left").select("u", "t", "y", F.coalesce(F.try_divide("swy", "sw"), F.lit(0.0)).alias("alpha"))
    left = valid(cells).select("u", "t", "y").join(sums, ["u", "t"]).select("u", "t", (F.col("y") - F.col("swy") / F.col("sw")).alias("r"))
    beta = m.join(left, "u").groupBy("b", "t").agg((F.sum(F.col("m") * F.col("r")) / F.sum("m")).alias("beta"))
    tau = m.join(own, "u").join(beta, ["b", "t"], "left").withColumn("tau", F.col("y") - F.col("alpha") - F.coalesce("beta", F.lit(0.0)))
    if weights is None:
        return tau.groupBy("b").agg((F.sum(F.col("m") * F.col("tau")) / F.sum("m")).alias("att"))
    w = tau.join(weights.select("u", "w"), "u").where("w > 0")
    return w.groupBy("b").agg((F.sum(F.col("m") * F.col("w") * F.col("tau")) / F.sum(F.col("m") * F.col("w"))).alias("att"))


def variance(boot: DataFrame, ddof: int = 1) -> DataFrame:
    """``(n, variance, se)`` of finite replicates; fewer than two give 0."""
    v = boot.where("att IS NOT NULL AND NOT isnan(att)")
    var = F.var_samp("att") if ddof else F.var_pop("att")
    a = v.agg(F.count("*").alias("n"), F.coalesce(var, F.lit(0.0)).alias("variance"))
    return a.withColumn("variance", F.when(F.col("n") < 2, 0.0).otherwise(F.col("variance"))).withColumn("se", F.sqrt("variance"))


def percentile_interval(boot: DataFrame, level: float = 95.0) -> DataFrame:
    """Linear interpolation at (n - 1) p on both ends."""
    a = (1 - level / 100) / 2
    return boot.agg(F.percentile("att", F.lit(a)).alias("low"), F.percentile("att", F.lit(1 - a)).alias("high"))


def strata(design: DataFrame) -> DataFrame:
    """``(stratum, n, fpc, f, m)``: sampling units, declared total, sampled share, and the draws a replicate makes."""
    s = design.groupBy("stratum").agg(F.countDistinct("psu").alias("n"), F.max("fpc").alias("fpc"))
    f = F.col("n") / F.col("fpc")
    m = F.when(F.col("fpc").isNull(), F.col("n") - 1).otherwise(F.greatest(F.lit(1), F.round((1 - f) * (F.col("n") - 1)).cast("int")))
    return s.select("stratum", "n", "fpc", f.alias("f"), m.cast("int").alias("m"))


def rao_wu(design: DataFrame, n_boot: int, seed: int = 42, options: SurveyDesign | None = None) -> DataFrame:
    """``(b, u, w)``: rescaled weights w n/m r, with r the draws of the unit's sampling unit in its stratum.

    A stratum that is a census keeps its weights. One with a single sampling unit keeps them too
    (skip), is moved about the stratum mean by a random sign (centered), or is an error (fail).
    """
    lonely = (options or SurveyDesign("stratum", "psu")).lonely
    s = strata(design)
    if lonely == "fail" and s.where("n = 1").limit(1).count():
        from ..spec import InvalidPanel

        raise InvalidPanel("a stratum has one sampling unit")
    psu = design.select("stratum", "psu").distinct()
    psu = psu.withColumn("i", F.row_number().over(Window.partitionBy("stratum").orderBy("psu")) - 1)
    order = s.withColumn("h", F.row_number().over(Window.orderBy("stratum")) - 1)  # one row a stratum
    order = order.withColumn("h", draw(F.col("h"), F.lit(0), seed + 1))
    open_ = order.where("n > 1 AND coalesce(f, 0) < 1")
    slots = open_.select("stratum", "h", "n", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    b = replicates(design, n_boot)
    drawn = b.crossJoin(slots).withColumn("i", (draw(F.col("b"), F.col("k"), seed, F.col("h")) % F.col("n")).cast("int"))
    r = drawn.groupBy("b", "stratum", "i").agg(F.count("*").alias("r")).join(psu, ["stratum", "i"]).select("b", "stratum", "psu", "r")
    rows = b.crossJoin(design.join(order, "stratum").select("u", "stratum", "psu", "w", "n", "m", "h", order.f))
    rows = rows.join(r, ["b", "stratum", "psu"], "left")
    held = (F.col("n") == 1) | (F.coalesce("f", F.lit(0.0)) >= 1)
    base = F.col("w")
    if lonely == "centered":
        mean = design.groupBy("stratum", "psu").agg(F.sum("w").alias("t")).agg(F.avg("t").alias("mean_psu"))
        rows = rows.crossJoin(F.broadcast(mean))
        sign = F.when(draw(F.col("b"), F.lit(0), seed + 2, F.col("h")) % 2 == 0, 1.0).otherwise(-1.0)
        base = F.when(F.col("n") == 1, F.greatest(F.lit(0.0), F.col("w") + sign * (F.col("w") - F.col("mean_psu")))).otherwise(base)
    w = F.when(held, base).otherwise(F.col("w") * F.col("n") / F.col("m") * F.coalesce("r", F.lit(0)))
    return rows.select("b", "u", w.alias("w"))


def rao_wu_att(tau: DataFrame, weights: DataFrame) -> DataFrame:
    """``(b, att)``: effects fitted once, averaged by each replicate's weights."""
    j = weights.where("w > 0").join(tau.select("u", "tau"), "u")
    return j.groupBy("b").agg((F.sum(F.col("w") * F.col("tau")) / F.sum("w")).alias("att"))


def kish(weights: DataFrame) -> DataFrame:
    """Design effect of unequal positive weights."""
    w = weights.where("w > 0")
    return w.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.count("*") * F.sum(F.col("w") ** 2) / F.sum("w") ** 2).alias("deff"))


def high_fpc(design: DataFrame, share: float = 0.5) -> DataFrame:
    """Strata sampled beyond ``share``, and the largest share."""
    return strata(design).agg(F.count(F.when(F.col("f") > share, 1)).alias("n_high"), F.max("f").alias("max_f"))
