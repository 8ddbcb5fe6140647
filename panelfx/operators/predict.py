"""Predictions as joins of the cells with the tables of a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import InvalidSpec

TYPES = ("y0", "xb", "counterfactual", "y1", "te", "att", "residuals", "fitted", "alpha", "beta", "mu")


def predictions(cells: DataFrame, alpha: DataFrame, beta: DataFrame, tau: DataFrame, low: DataFrame | None = None, mu: float | None = None, att: float | None = None, gamma: list[float] | None = None) -> DataFrame:
    """All predictions of every cell, from ``alpha(u, alpha)``, ``beta(t, beta)``, ``tau(u, t, tau)``, ``low(u, t, low)``.

    Without ``mu`` (two-step) a treated cell's counterfactual is its outcome less its effect, or the sum
    of the parts where the effect is missing. With ``mu`` (joint) it is the sum everywhere. ``gamma`` are the
    coefficients of the cells' covariates.
    """
    d = cells.join(alpha, "u", "left").join(beta, "t", "left").join(tau.select("u", "t", "tau"), ["u", "t"], "left")
    parts = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("beta", F.lit(0.0)) + F.lit(mu or 0.0)
    if low is not None:
        d = d.join(low, ["u", "t"], "left")
        parts = parts + F.coalesce("low", F.lit(0.0))
    if gamma and "x" in d.columns:
        for k, g in enumerate(gamma):
            parts = parts + F.coalesce(F.get("x", F.lit(k)), F.lit(0.0)) * g
    joint = mu is not None
    y0 = parts if joint else F.when((F.col("d") == 1) & F.col("tau").isNotNull() & F.col("y").isNotNull(), F.col("y") - F.col("tau")).otherwise(parts)
    effect = F.lit(att).cast("double") if joint else F.coalesce(F.col("tau"), F.lit(att).cast("double"))
    d = d.withColumn("y0", y0).withColumn("te", F.when(F.col("d") == 1, effect)).withColumn("mu", F.lit(mu).cast("double"))
    d = d.withColumn("y1", F.col("y0") + F.coalesce("te", F.lit(att).cast("double")))
    d = d.withColumn("fitted", F.col("y0") + F.when(F.col("d") == 1, F.coalesce("te", F.lit(0.0))).otherwise(0.0))
    return d.withColumn("residuals", F.col("y") - F.col("fitted")).select("u", "t", "y", "d", "alpha", "beta", "mu", "y0", "y1", "te", "fitted", "residuals")


def predict(all_: DataFrame, kind: str = "y0") -> DataFrame:
    """One prediction by name; synonyms as in TYPES."""
    if kind not in TYPES:
        raise InvalidSpec(f"no prediction {kind}")
    name = {"xb": "y0", "counterfactual": "y0", "att": "te"}.get(kind, kind)
    return all_.select("u", "t", F.col(name).alias(kind))


def zero_parameters(cells: DataFrame, lam_time: float) -> tuple[DataFrame, DataFrame]:
    """Averages over the two-step fits at unit and norm penalty 0: ``(u, alpha)`` and ``(t, beta)``."""
    from .index import treated_cells, valid
    from .native import unit_sums

    targets = treated_cells(cells)
    n = targets.groupBy("t").agg(F.count("*").alias("n_fits")).withColumnRenamed("t", "fit_t")
    sums = unit_sums(cells, targets, lam_time).join(n, F.col("t") == F.col("fit_t"))
    mean = lambda c: F.sum(c * F.col("n_fits")) / F.sum("n_fits")
    alpha = sums.groupBy(F.col("j").alias("u")).agg(mean(F.try_divide("swy", "sw")).alias("alpha"))
    left = valid(cells).select(F.col("u").alias("_u"), F.col("t").alias("s"), "y").join(sums, F.col("_u") == F.col("j"))
    per = left.groupBy("fit_t", "n_fits", "s").agg(F.avg(F.col("y") - F.try_divide("swy", "sw")).alias("b"))
    beta = per.groupBy(F.col("s").alias("t")).agg(mean(F.col("b")).alias("beta"))
    return alpha, beta


def signature(cells: DataFrame) -> tuple:
    """Number of cells and an order-free checksum of their units, periods, outcomes and treatments: equal for the same panel however it is partitioned."""
    r = cells.agg(F.count("*").alias("n"), F.sum(F.xxhash64("unit", "time", "y", "d").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
