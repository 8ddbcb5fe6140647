"""Validation and structure of a panel. Each function is one aggregate plan over the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running
from ..spec import PanelSpec
from .distance import pair_stats
from .index import finite, units

ERROR_SHARE, WARN_SHARE = 0.30, 0.10


def duplicates(df: DataFrame, unit: str = "unit", time: str = "time") -> DataFrame:
    """Unit-period pairs that occur more than once."""
    return df.groupBy(unit, time).agg(F.count("*").alias("n")).where("n > 1")


def time_gaps(cells: DataFrame) -> DataFrame:
    """Per unit: cells, steps of more than one period, and whether periods rise strictly."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("u").orderBy("t"))
    return cells.withColumn("step", step).groupBy("u").agg(F.count("*").alias("n_cells"), F.count(F.when(F.col("step") > 1, 1)).alias("n_gaps"), F.coalesce(F.min("step") > 0, F.lit(True)).alias("rising"))


def dims(cells: DataFrame) -> DataFrame:
    """N, T, observed cells, missing share and its tier."""
    d = cells.agg(F.countDistinct("u").alias("n_units"), F.countDistinct("t").alias("n_periods"), F.count(F.when(F.col("y").isNotNull() & F.col("d").isNotNull(), 1)).alias("n_obs"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    miss = 1 - F.try_divide(F.col("n_obs"), F.col("n_units") * F.col("n_periods"))
    d = d.withColumn("miss", miss)
    return d.withColumn("tier", tier(F.col("miss"))).withColumn("balanced", F.col("miss") < 1e-10)


def tier(miss: Column) -> Column:
    return F.when(miss > ERROR_SHARE, "error").when(miss > WARN_SHARE, "warn").when(miss >= 1e-10, "note").otherwise("balanced")


def empty_lines(cells: DataFrame) -> DataFrame:
    """Units and periods without any outcome."""
    by = lambda k: cells.groupBy(F.col(k).alias("idx")).agg(F.count("y").alias("n")).where("n = 0").select(F.lit(k).alias("axis"), "idx")
    return by("u").unionByName(by("t"))


def treatment_values(cells: DataFrame) -> DataFrame:
    """Whether the treatment takes exactly the values 0 and 1."""
    return cells.agg(F.count(F.when(F.col("d") == 0, 1)).alias("n0"), F.count(F.when(F.col("d") == 1, 1)).alias("n1"), F.count(F.when(~F.col("d").isin(0, 1), 1)).alias("n_other")).withColumn("binary", (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n_other") == 0))


def switches(cells: DataFrame) -> DataFrame:
    """Per unit: ever treated, first treated period, changes of treatment, changes back."""
    before = F.lag("d").over(Window.partitionBy("u").orderBy("t"))
    return (
        cells.withColumn("b", before)
        .groupBy("u")
        .agg(
            F.max("d").alias("ever"),
            F.min(F.when(F.col("d") == 1, F.col("t"))).alias("first_t"),
            F.coalesce(F.sum((F.col("d") != F.col("b")).cast("int")), F.lit(0)).alias("n_switch"),
            F.coalesce(F.sum(((F.col("d") == 0) & (F.col("b") == 1)).cast("int")), F.lit(0)).alias("n_back"),
        )
    )


def pattern(cells: DataFrame) -> DataFrame:
    """The design's name, cohorts, treated periods, periods before and after adoption, absorbing."""
    s = switches(cells).agg(F.max("n_switch").alias("max_switch"), F.countDistinct("first_t").alias("n_cohorts"), F.sum("ever").alias("n_treated_units"), F.min("first_t").alias("t1"), (F.max("n_back") == 0).alias("absorbing"))
    p = cells.groupBy("t").agg(F.max("d").alias("any_d")).crossJoin(s.select("t1")).agg(F.count(F.when(F.col("t") < F.col("t1"), 1)).alias("n_pre"), F.sum("any_d").alias("n_post"))
    name = F.when(F.col("max_switch") >= 2, "switching_treatment").when(F.col("n_cohorts") > 1, "staggered_adoption").when(F.col("n_treated_units") > 1, "multiple_treated_simultaneous").otherwise("single_treated_unit")
    return s.crossJoin(p).select(name.alias("pattern"), "n_cohorts", "n_treated_units", "n_pre", "n_post", "absorbing")


def cohorts(cells: DataFrame) -> DataFrame:
    """Units and treated cells by first treated period."""
    return units(cells).where("treated").groupBy("first_t").agg(F.count("*").alias("n_units"), F.sum("n_d").alias("n_cells"))


def simultaneous(cells: DataFrame) -> DataFrame:
    """Whether all treated units start at once and stay treated, with all their cells present; and T_post."""
    span = cells.agg(F.countDistinct("t").alias("n_t"))
    per = cells.groupBy("u").agg(F.min(F.when(F.col("d") == 1, F.col("t"))).alias("t1"), F.sum("d").alias("n_d"), F.count("*").alias("n")).where("n_d > 0").crossJoin(span)
    a = per.agg(F.min("t1").alias("t1"), F.max("t1").alias("t1_max"), F.min("n_d").alias("lo"), F.max("n_d").alias("hi"), F.min("n").alias("n"), F.max("n_t").alias("n_t"))
    ok = (F.col("t1") == F.col("t1_max")) & (F.col("lo") == F.col("hi")) & (F.col("hi") == F.col("n_t") - F.col("t1")) & (F.col("n") == F.col("n_t"))
    return a.select(ok.alias("simultaneous"), "t1", (F.col("n_t") - F.col("t1")).alias("t_post"))


def quartile(y: DataFrame, p: float, name: str) -> DataFrame:
    """One row: the order statistic of ``y(y)`` at n*p, or the mean of it and the next where n*p is a whole number.

    Distinct values are counted and ranked by slices of their order.
    """
    held = running(y.groupBy("y").agg(F.count("*").alias("k")), "y", {"last": (F.sum, "k", False)})
    held = held.withColumn("first", F.col("last") - F.col("k") + 1).crossJoin(F.broadcast(y.agg(F.count("*").alias("n"))))
    rank, whole = F.ceil(F.col("n") * p), F.col("n") * p == F.floor(F.col("n") * p)
    at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("y")))
    got = held.agg(at(F.greatest(rank, F.lit(1))).alias("a"), at(rank + 1).alias("b"), F.max(whole).alias("whole"))
    return got.select(F.when(F.col("whole") & F.col("b").isNotNull(), (F.col("a") + F.col("b")) / 2).otherwise(F.col("a")).alias(name))


def outliers(cells: DataFrame, k: float = 10.0) -> DataFrame:
    """Tukey fences by quartiles that average two order statistics where n*p is a whole number."""
    y = cells.where("y IS NOT NULL").select("y")
    q = quartile(y, 0.25, "q1").crossJoin(quartile(y, 0.75, "q3"))
    q = q.select("q1", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))
    return y.crossJoin(F.broadcast(q)).groupBy("q1", "q3", "low", "high").agg(F.count(F.when((F.col("y") < F.col("low")) | (F.col("y") > F.col("high")), 1)).alias("n_outliers"))


def raw_problems(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row of counts before any cast: treatments that are neither 0 nor 1, and rows with a covariate that is null or not finite."""
    d = F.col(spec.treatment).cast("double")
    missing = F.lit(False)
    for c in spec.covariates:
        missing = missing | finite(F.col(c)).isNull()
    return df.dropna(subset=[spec.unit, spec.time, spec.treatment]).agg(F.count(F.when(~d.isin(0.0, 1.0) | F.isnan(d), 1)).alias("n_not_binary"), F.count(F.when(missing, 1)).alias("n_no_covariate"))


def balance(cells: DataFrame, column: str = "x") -> DataFrame:
    """Standardised difference of a covariate between ever-treated and other units before the first treatment."""
    first = cells.agg(F.min(F.when(F.col("d") == 1, F.col("t"))).alias("t1"))
    pre = cells.join(units(cells).select("u", "treated"), "u").crossJoin(F.broadcast(first)).where("t < t1")
    x = F.col(column)
    one, zero = F.when(F.col("treated"), x), F.when(~F.col("treated"), x)
    a = pre.agg(F.avg(one).alias("mean_treated"), F.avg(zero).alias("mean_control"), F.stddev_samp(one).alias("s1"), F.stddev_samp(zero).alias("s0"))
    pooled = F.sqrt((F.col("s1") ** 2 + F.col("s0") ** 2) / 2)
    a = a.withColumn("std_diff", F.when(pooled >= 1e-10, (F.col("mean_treated") - F.col("mean_control")) / pooled))
    size = F.abs("std_diff")
    return a.select("mean_treated", "mean_control", "std_diff", F.when(size < 0.1, "negligible").when(size < 0.25, "small").when(size < 0.5, "moderate").otherwise("large").alias("band"))


def feasibility(cells: DataFrame) -> DataFrame:
    """The conditions that an estimate needs, each as a number."""
    per = cells.groupBy("u").agg(F.max("d").alias("ever"), F.count(F.when((F.col("d") == 0) & F.col("y").isNotNull(), 1)).alias("n_control"), F.min(F.when(F.col("d") == 1, F.col("t"))).alias("first_t"), F.min("t").alias("t0"))
    pre = F.min(F.when(F.col("ever") == 1, F.col("first_t") - F.col("t0")))
    a = per.agg(F.sum("ever").alias("n_treated"), F.sum(1 - F.col("ever")).alias("n_never"), F.sum("n_control").alias("n_control_cells"), pre.alias("min_pre"), F.min(F.when(F.col("ever") == 1, F.col("n_control"))).alias("min_own_control"))
    v = cells.agg(F.var_samp("y").alias("var_y"))
    ok = (F.col("var_y") > 0) & (F.col("n_treated") >= 1) & (F.col("n_never") >= 2) & (F.col("n_control_cells") >= 1) & (F.col("min_pre") >= 2) & (F.col("min_own_control") >= 1)
    return a.crossJoin(v).withColumn("feasible", F.coalesce(ok, F.lit(False)))


def min_valid_pairs(cells: DataFrame) -> DataFrame:
    """Least over treated units of the most control periods shared with another unit."""
    best = pair_stats(cells).groupBy(F.col("i").alias("u")).agg(F.max("n").alias("n"))
    return units(cells).where("treated").join(best, "u", "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("min_valid_pairs"))


def weight_check(cells: DataFrame, weight: str = "w") -> DataFrame:
    """Weights are finite, positive and the same in all cells of a unit."""
    w = F.col(weight)
    per = cells.groupBy("u").agg(F.min(w).alias("lo"), F.max(w).alias("hi"), F.count(w).alias("n"), F.count("*").alias("m"))
    bad = (F.col("n") < F.col("m")) | ~(F.col("lo") > 0) | F.isnan("hi") | ((F.col("hi") - F.col("lo")) / (F.abs("hi") + 1) > 1e-12)
    return per.agg(F.count("*").alias("n_units"), F.count(F.when(bad, 1)).alias("n_bad"))


def design_check(design: DataFrame, nest: bool = False) -> DataFrame:
    """Per stratum: sampling units, declared total, whether that suffices, and codes shared with other strata."""
    d = design.select("stratum", "psu", "fpc").distinct()
    shared = d.groupBy("psu").agg(F.countDistinct("stratum").alias("k"))
    own = d.join(shared, "psu").groupBy("stratum").agg(F.countDistinct("psu").alias("n_psu"), F.max("fpc").alias("fpc"), F.countDistinct("fpc").alias("n_fpc"), F.count(F.when(F.col("k") > 1, 1)).alias("n_shared"))
    ok = (F.col("fpc").isNull() | ((F.col("fpc") >= F.col("n_psu")) & (F.col("n_fpc") == 1))) & (F.lit(nest) | (F.col("n_shared") == 0))
    return own.select("stratum", "n_psu", "fpc", "n_shared", ok.alias("ok"))


def report(cells: DataFrame) -> DataFrame:
    """All checks as rows ``(check, ok, value)``."""
    d, v, f, m = dims(cells), treatment_values(cells), feasibility(cells), min_valid_pairs(cells)
    row = lambda df, name, ok, value: df.select(F.lit(name).alias("check"), ok.alias("ok"), value.cast("double").alias("value"))
    return (
        row(d, "missing_share", F.col("miss") <= ERROR_SHARE, F.col("miss"))
        .unionByName(row(d, "periods", F.col("n_periods") >= 2, F.col("n_periods")))
        .unionByName(row(d, "units", F.col("n_units") >= 3, F.col("n_units")))
        .unionByName(row(v, "binary_treatment", F.col("binary"), F.col("n1")))
        .unionByName(row(f, "feasible", F.col("feasible"), F.col("n_control_cells")))
        .unionByName(row(m, "shared_periods", F.col("min_valid_pairs") >= 2, F.col("min_valid_pairs")))
        .unionByName(row(empty_lines(cells).agg(F.count("*").alias("n")), "no_empty_lines", F.col("n") == 0, F.col("n")))
        .unionByName(row(duplicates(cells, "u", "t").agg(F.count("*").alias("n")), "unique_cells", F.col("n") == 0, F.col("n")))
    )
