"""Registered queries of the panel engine. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.stored import fixed
from .oracle import ORACLE_SQL
from .operators import cv, diagnose, distance, joint, kernels, native, predict, resample, sparse, validate, weights
from .operators.index import index_cells, treated_cells
from .sources import panels
from .spec import FitOptions, PanelSpec, SurveyDesign

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

LAM_TIME, LAM_UNIT, N_BOOT = 0.1, 0.05, 200


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places (and no negative zero), whole numbers to longs."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def panel(spark: SparkSession, sf_dir: str, rule: str = "block", period: str = "quarter") -> DataFrame:
    """Nations by period, indexed and treated by a rule; the tables behind them are read once, however often a query reads its cells."""
    cells = index_cells(fixed(panels.nation_periods(spark, sf_dir, period)), PanelSpec(treatment="none"))
    return fixed(panels.treat(cells, rule))


def survey(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """The design by unit number."""
    key = cells.select("unit", "u").distinct()
    return panels.nation_design(spark, sf_dir).join(key, "unit").select("u", "stratum", "psu", "w", "fpc")


def with_covariate(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    return cells.join(panels.nation_covariate(spark, sf_dir), ["unit", "time"], "left")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders to an average effect: index, treat, weight, fit every treated cell, average."""
    return tidy(native.att(zero_tau(panel(spark, sf_dir))))


def zero_tau(cells: DataFrame, lam_unit: float = 0.0) -> DataFrame:
    return native.twostep_zero(cells, treated_cells(cells).select("u", "t", "y"), LAM_TIME, lam_unit)


def _boot(cells: DataFrame) -> DataFrame:
    return resample.boot_zero(cells, LAM_TIME, resample.unit_draws(cells, N_BOOT))


def _grid(spark: SparkSession) -> DataFrame:
    return cv.grid_frame(spark, [0, 0.1, 0.5], [0, 0.05])


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str, rule: str | None = "block", period: str = "quarter") -> Callable:
    """Register a function of (spark, sf_dir, cells) whose result is tidied."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir, panel(spark, sf_dir, rule, period) if rule else None))
        return f

    return put


QUERIES["flagship_att"] = flagship


def simple(name: str, f: Callable[[DataFrame], DataFrame], rule: str = "block", period: str = "quarter") -> None:
    query(name, rule, period)(lambda spark, sf_dir, cells: f(cells))


# structure
simple("panel_index", lambda c: c.select("u", "t", "y", "d"))
simple("panel_dims", validate.dims)
simple("panel_dims_month", validate.dims, period="month")
simple("duplicates", lambda c: validate.duplicates(c.select(F.col("u") % 5, "t").toDF("unit", "time")))
simple("time_gaps", validate.time_gaps, period="month")
simple("empty_lines", lambda c: validate.empty_lines(c.withColumn("y", F.expr("CASE WHEN u <> 3 AND t <> 4 THEN y END"))))
simple("treatment_values", validate.treatment_values)
simple("switch_count", validate.switches, "switching")
simple("pattern_block", validate.pattern)
simple("pattern_staggered", validate.pattern, "staggered")
simple("pattern_switching", validate.pattern, "switching")
simple("cohorts", validate.cohorts, "staggered")
simple("simultaneous", validate.simultaneous)
simple("outliers", validate.outliers)
query("balance")(lambda s, d, c: validate.balance(with_covariate(s, d, c)))
simple("feasibility", validate.feasibility)
simple("min_valid_pairs", validate.min_valid_pairs)
query("weight_check")(lambda s, d, c: validate.weight_check(c.join(survey(s, d, c).select("u", "w"), "u")))
query("design_check")(lambda s, d, c: validate.design_check(survey(s, d, c)))
simple("report", validate.report)
simple("summary_stats", diagnose.summarize)
query("priority_dims", None)(lambda s, d, c: validate.dims(panels.treat(index_cells(panels.priority_periods(s, d), PanelSpec(treatment="none")), "block")))
query("events_dims", None)(lambda s, d, c: validate.dims(panels.treat(index_cells(panels.user_days(s, d), PanelSpec(treatment="none")), "block")))

# distances and weights
simple("unit_distance", distance.distances, "staggered")
simple("unit_distance_without", lambda c: distance.distances_without(c, c.where("d = 0 AND u < 3 AND t < 4")), "staggered")
simple("distance_summary", distance.distance_summary)
simple("twostep_theta", lambda c: weights.theta(treated_cells(c), c, LAM_TIME))
simple("twostep_omega", lambda c: weights.omega(treated_cells(c), c, LAM_UNIT), "staggered")
simple("weight_matrix", lambda c: weights.weight_matrix(weights.first_target(c), c, LAM_TIME, LAM_UNIT))
simple("sparse_support", lambda c: sparse.sizes(sparse.support(c, treated_cells(c).select("u", "t"), 1.0, LAM_UNIT), 1.0))
simple("weight_matrix_sparse", lambda c: weights.weight_matrix(weights.first_target(c), c, 1.0, LAM_UNIT, drop_below=1e-6))
simple("first_target", lambda c: weights.first_target(c).select("u", "t", "y"))
simple("joint_delta_time", lambda c: weights.joint_time(c, LAM_TIME))
simple("joint_delta_unit", lambda c: weights.joint_unit(c, LAM_UNIT))
simple("joint_delta", lambda c: weights.joint_delta(c, LAM_TIME, LAM_UNIT))
simple("weight_stats", lambda c: weights.stats(weights.joint_unit(c, LAM_UNIT), "j", "delta_unit"))

# estimators
simple("did_block", native.did)
simple("joint_inf", lambda c: native.joint_inf(c, LAM_TIME, LAM_UNIT))
query("joint_inf_grid")(lambda s, d, c: native.joint_inf_grid(c, _grid(s).select("lam_time", "lam_unit")))
simple("joint_tau", lambda c: native.joint_inf_tau(c, LAM_TIME, LAM_UNIT))
query("joint_weighted_att")(lambda s, d, c: native.weighted_att(native.joint_inf_tau(c, LAM_TIME, LAM_UNIT), survey(s, d, c).select("u", "w")))
query("joint_rao_wu_att")(lambda s, d, c: resample.rao_wu_att(native.joint_inf_tau(c, LAM_TIME, LAM_UNIT), resample.rao_wu(survey(s, d, c), N_BOOT)))
simple("twostep_inf", lambda c: native.twostep_inf(c, LAM_TIME, LAM_UNIT))
simple("twostep_zero", lambda c: zero_tau(c, LAM_UNIT))
simple("twostep_zero_staggered", zero_tau, "staggered")
simple("twostep_zero_switching", lambda c: native.att(zero_tau(c, LAM_UNIT)), "switching")
query("weighted_att")(lambda s, d, c: native.weighted_att(zero_tau(c), survey(s, d, c).select("u", "w")))

# search
query("cv_zero_grid")(lambda s, d, c: cv.scores_zero(c, _grid(s)))
query("cv_select")(lambda s, d, c: cv.best_row(cv.scores_zero(c, _grid(s))))
query("cv_summary")(lambda s, d, c: cv.summary(cv.scores_zero(c, _grid(s))))
query("cv_sensitivity")(lambda s, d, c: cv.sensitivity(cv.scores_zero(c, _grid(s))))
query("cv_joint_grid")(lambda s, d, c: cv.scores_joint(c, _grid(s)))
query("cv_joint_select")(lambda s, d, c: cv.best_row(cv.scores_joint(c, _grid(s))))
query("cv_top")(lambda s, d, c: cv.top(cv.scores_zero(c, _grid(s)), 3))



def _planned(spark: SparkSession, cells: DataFrame, preset: str) -> DataFrame:
    """A preset grid, and how many fits each of its rows asks of the panel."""
    return cv.grid_frame(spark, *cv.GRIDS[preset]).crossJoin(F.broadcast(kernels.controls(cells).agg(F.count("*").alias("n_fits"))))


query("grid_default")(lambda s, d, c: _planned(s, c, "default"))
query("grid_fine")(lambda s, d, c: _planned(s, c, "fine"))

# resampling
simple("boot_draws", lambda c: resample.unit_draws(c, N_BOOT))
simple("boot_zero_att", _boot)
simple("boot_variance", lambda c: resample.variance(_boot(c)))
simple("boot_variance_population", lambda c: resample.variance(_boot(c), ddof=0))
simple("boot_flags", lambda c: diagnose.moment_flags(diagnose.moments(_boot(c)), 0.5, 5.0))
simple("boot_percentile_ci", lambda c: resample.percentile_interval(_boot(c)))
simple("boot_moments", lambda c: diagnose.moments(_boot(c)))
query("boot_weighted_att")(lambda s, d, c: resample.boot_zero(c, LAM_TIME, resample.unit_draws(c, N_BOOT), survey(s, d, c).select("u", "w")))
query("design_strata")(lambda s, d, c: resample.strata(survey(s, d, c)))
query("rao_wu_weights")(lambda s, d, c: resample.rao_wu(survey(s, d, c), N_BOOT))
query("rao_wu_att")(lambda s, d, c: resample.rao_wu_att(zero_tau(c), resample.rao_wu(survey(s, d, c), N_BOOT)))
query("rao_wu_centered")(lambda s, d, c: resample.rao_wu(survey(s, d, c).where("stratum > 0 OR psu = 0"), N_BOOT, options=SurveyDesign("stratum", "psu", lonely="centered")))
query("kish_deff")(lambda s, d, c: resample.kish(survey(s, d, c)))
query("high_fpc")(lambda s, d, c: resample.high_fpc(survey(s, d, c).withColumn("fpc", F.col("stratum") * 2.0 + 6)))


# prediction and diagnostics
def _predicted(c: DataFrame) -> DataFrame:
    alpha, beta = predict.zero_parameters(c, LAM_TIME)
    return predict.predictions(c, alpha, beta, zero_tau(c))


simple("predict_all", _predicted)
simple("predict_y0", lambda c: predict.predict(_predicted(c), "y0"))
simple("predict_te", lambda c: predict.predict(_predicted(c), "te"))
simple("fit_alpha", lambda c: predict.zero_parameters(c, LAM_TIME)[0])
simple("fit_beta", lambda c: predict.zero_parameters(c, LAM_TIME)[1])
simple("es_horizon", lambda c: diagnose.event_study(c, zero_tau(c)), "staggered")
simple("es_window", lambda c: diagnose.event_study(c, zero_tau(c), 90.0, 0, 5), "staggered")
simple("es_placebo", lambda c: diagnose.placebo(c, *predict.zero_parameters(c, LAM_TIME)))
simple("pretrend_wald", lambda c: diagnose.pretrend(diagnose.placebo(c, *predict.zero_parameters(c, LAM_TIME))))


def _tests(c: DataFrame) -> DataFrame:
    es = diagnose.event_study(c, zero_tau(c)).where("n >= 2")
    return diagnose.multiple(diagnose.z_tests(es.select("h", "att", "se"), "att", "se"), ["h"])


simple("mht", _tests, "staggered")
simple("mht_cells", lambda c: diagnose.multiple(diagnose.cell_tests(zero_tau(c), 5.0), ["u", "t"]).drop("y"))


def _joint_predicted(c: DataFrame) -> DataFrame:
    """Counterfactuals of treated cells by the joint fit at infinite norm: the outcome less the cell's own effect."""
    return native.joint_inf_tau(c, LAM_TIME, LAM_UNIT).select("u", "t", (F.col("y") - F.col("tau")).alias("y0"), F.col("tau").alias("te"))


simple("predict_joint", _joint_predicted)


# fits without a closed form: rows only
@query("twostep_lowrank")
def _twostep_lowrank(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    grid = spark.createDataFrame([(0, LAM_TIME, LAM_UNIT, 10.0)], "g_id int, lam_time double, lam_unit double, lam_norm double")
    tasks = treated_cells(cells).select("u", "t").crossJoin(grid).withColumn("task_id", F.xxhash64("u", "t"))
    return kernels.cell_fits(cells, tasks).select("u", "t", "tau", "iters", "converged")


simple("twostep_sparse", lambda c: sparse.fits(c, treated_cells(c), (1.0, LAM_UNIT, 1.0)))


def _whole(cells: DataFrame) -> bool:
    """The joint method needs every treated cell."""
    return cells.agg((F.count("*") == F.countDistinct("u") * F.countDistinct("t")).alias("whole")).first()["whole"]


@query("joint_lowrank")
def _joint_lowrank(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    if not _whole(cells):
        return spark.createDataFrame([], "att double, mu double, iters int, converged int")
    fit = joint.fit(cells, LAM_TIME, LAM_UNIT, 10.0)
    return native.att(fit.tau).select("att", F.lit(fit.mu).alias("mu"), F.lit(fit.iters).alias("iters"), F.lit(fit.converged).alias("converged"))


@query("joint_lowrank_tau")
def _joint_lowrank_tau(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    return joint.fit(cells, LAM_TIME, LAM_UNIT, 10.0).tau if _whole(cells) else spark.createDataFrame([], "u int, t int, tau double")


#: The grid of interior penalties that a search runs over in full.
INTERIOR = ([0.0, 1.0], [0.0, 1.0], [0.1, 1.0])


@query("cv_joint_interior")
def _cv_joint_interior(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    if not _whole(cells):
        return spark.createDataFrame([], "g_id int, lam_time double, lam_unit double, lam_norm double, q double, n_valid long, n_attempted long")
    return kernels.cv_joint(cells, cv.grid_frame(spark, *INTERIOR)).drop("first_failed")


@query("joint_rao_wu_interior")
def _joint_rao_wu_interior(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """The best of the interior grid by the joint score, its effects, and their average under rescaled weights."""
    from .plans.strategy import search

    if not _whole(cells):
        return spark.createDataFrame([], "b int, att double")
    best, _ = search(cells, FitOptions(method="joint", prune=True), INTERIOR, True)
    tau = joint.fit(cells, best["lam_time"], best["lam_unit"], best["lam_norm"]).tau
    return resample.rao_wu_att(tau, resample.rao_wu(survey(spark, sf_dir, cells), N_BOOT))


@query("triple_bias")
def _triple_bias(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    if not _whole(cells):
        return spark.createDataFrame([], "rank int, unit double, time double, rest double, product double")
    return diagnose.triple(cells, joint.fit(cells, LAM_TIME, LAM_UNIT, 10.0).low, LAM_TIME, LAM_UNIT)


@query("cv_lowrank")
def _cv_lowrank(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    grid = spark.createDataFrame([(0, 0.1, 0.0, 10.0), (1, 0.1, 0.0, 1e10)], "g_id int, lam_time double, lam_unit double, lam_norm double")
    return kernels.cv_lowrank(cells, grid).drop("first_failed")


@query("unconverged", rule="staggered")
def _unconverged(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    tasks = treated_cells(cells).select("u", "t").withColumn("task_id", F.xxhash64("u", "t")).withColumn("lam_time", F.lit(0.1)).withColumn("lam_unit", F.lit(0.0)).withColumn("lam_norm", F.lit(1.0))
    return diagnose.unconverged(kernels.cell_fits(cells, tasks, maxiter=3))


@query("factors")
def _factors(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    grid = spark.createDataFrame([(0, LAM_TIME, LAM_UNIT, 10.0)], "g_id int, lam_time double, lam_unit double, lam_norm double")
    tasks = treated_cells(cells).select("u", "t").crossJoin(grid).withColumn("task_id", F.xxhash64("u", "t"))
    size = cells.agg(F.max("u")).first()
    n = size[0] + 1 if size[0] is not None else 1
    got = diagnose.factors_of(kernels.averages(kernels.cell_fits(cells, tasks, with_parameters=True), n)[2])  # the average over all fits
    return spark.createDataFrame([(got["frobenius"], got["nuclear"], got["effective_rank"], got["max_abs"])], "frobenius double, nuclear double, effective_rank double, max_abs double")


@query("boot_joint")
def _boot_joint(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    from .plans.strategy import boot_refit

    if not _whole(cells):
        return spark.createDataFrame([], "b int, att double")
    return boot_refit(cells, FitOptions(method="joint"), (LAM_TIME, LAM_UNIT, 1e10)).where("att IS NOT NULL")
