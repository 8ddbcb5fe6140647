"""Chooses between closed forms and dense kernels, and runs a whole estimation."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cv, diagnose, distance, infer, joint, kernels, native, predict, resample, sparse, validate
from ..operators import weights as native_weights
from ..operators.index import index_cells, treated_cells, units
from ..spec import LARGE_PENALTY, FitOptions, InvalidPanel, InvalidSpec, NoControlCell, NoTreatedCell, PanelSpec, PanelWarning, SearchFailed, SurveyDesign, effective_penalty, search_mode


def choose_path(method: str, lam_norm: float, simultaneous: bool, complete: bool, covariates: bool = False) -> str:
    """``zero``, ``inf`` or ``kernel``: the closed form that is exact here, or else dense fits."""
    if covariates:
        return "kernel"
    if method == "twostep" and lam_norm == 0:
        return "zero"
    if effective_penalty(lam_norm) >= LARGE_PENALTY and simultaneous and complete:
        return "inf"
    return "kernel"


@dataclass
class Parameters:
    """The parts of a fit: averages over the cells' fits for twostep, one fit's for joint (which has ``mu``, else None).

    ``cells`` has a row for each treated cell's fit: tau, iters, converged (1, 0 at the limit, -1 failed).
    """

    alpha: DataFrame
    beta: DataFrame
    low: DataFrame
    gamma: list[float]
    mu: float | None
    cells: DataFrame
    condition: float | None = None


@dataclass
class Fit:
    """An estimate, its inference, and the tables behind it. ``failures`` counts treated cells and replicates without a result."""

    options: FitOptions
    cells: DataFrame
    path: str
    lambdas: tuple[float, float, float]
    att: float
    tau: DataFrame
    inference: dict
    boot: DataFrame | None = None
    scores: list[dict] = field(default_factory=list)
    weights: DataFrame | None = None
    design: DataFrame | None = None
    survey: SurveyDesign | None = None
    failures: dict = field(default_factory=dict)
    signature: tuple = ()

    def check(self) -> None:
        """The panel must still be the one that was fitted, cell by cell."""
        if self.signature and predict.signature(self.cells) != self.signature:
            raise InvalidPanel("the panel has changed since it was fitted")

    def bootstrap(self, n: int = 1000, seed: int | None = None) -> Fit:
        """The same fit with a new bootstrap; penalties, weights and survey design stay."""
        options = replace(self.options, n_boot=n, seed=self.options.seed if seed is None else seed)
        boot, se, interval, failed = resampled(self.cells, options, self.lambdas, self.path, self.tau, self.weights, self.design, self.survey)
        if self.boot is not None:
            self.boot.unpersist()
        n1 = units(self.cells).where("treated").count()
        return replace(self, options=options, boot=boot, inference=infer.intervals(self.att, se, n1, options.level, options.ci, interval), failures=self.failures | {"replicates": failed})

    def release(self) -> None:
        """Free what the fit keeps in the executors' storage; it works on from its sources."""
        distance.drop_pairs(self.cells)
        for held in (self.tau, self.boot, self.cells):
            if held is not None:
                held.unpersist()

    def parameters(self) -> Parameters:
        """Unit and period effects, low-rank part and covariate coefficients: the joint method's from its fit over blocks, two-step ones in closed form where all units weigh alike, else by the kernel."""
        spark, lam = self.cells.sparkSession, self.lambdas
        if self.options.method == "joint" and effective_penalty(lam[2]) > 0:
            got = joint.fit(self.cells, *lam, self.options.tol, self.options.maxiter)
            cells = got.tau.select("u", "t", "tau", F.lit(got.iters).alias("iters"), F.lit(got.converged).alias("converged"))
            return Parameters(got.alpha, got.beta, got.low, got.gamma, got.mu, cells)
        if self.options.method == "joint":
            got = kernels.joint_fit(self.cells, *lam, self.options.tol, self.options.maxiter)
            table = lambda v, k, name: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"{k} int, {name} double")
            t, u = np.indices(got["low"].shape).reshape(2, -1).astype(np.int32)
            low = spark.createDataFrame(pd.DataFrame({"u": u, "t": t, "low": got["low"].ravel()}), "u int, t int, low double")
            cells = self.tau.select("u", "t", "tau", F.lit(got["iters"]).alias("iters"), F.lit(got["converged"]).alias("converged"))
            return Parameters(table(got["alpha"], "u", "alpha"), table(got["beta"], "t", "beta"), low, [float(g) for g in got["gamma"]], float(got["mu"]), cells, got["condition"])
        if self.path == "zero" and lam[1] == 0:
            alpha, beta = predict.zero_parameters(self.cells, lam[0])
            cells = self.tau.select("u", "t", "tau", F.lit(1).alias("iters"), F.lit(1).alias("converged"))
            return Parameters(alpha, beta, zero_low(self.cells, lam[0]), [], None, cells)
        grid = spark.createDataFrame([(0, *map(float, lam))], "g_id int, lam_time double, lam_unit double, lam_norm double")
        fits = kernels.cell_fits(self.cells, kernels.tasks_for(treated_cells(self.cells), grid), True, self.options.tol, self.options.maxiter).persist()
        n = self.cells.agg(F.max("u")).first()[0] + 1
        alpha, beta, low = (f.persist() for f in kernels.averages(fits, n))
        gamma = fits.where("converged >= 0").select(F.posexplode("gamma").alias("k", "g")).groupBy("k").agg(F.avg("g").alias("g")).orderBy("k").collect()
        for f in (alpha, beta, low):
            f.count()
        cells = fits.select("u", "t", "tau", "iters", "converged").persist()
        cells.count()
        fits.unpersist()
        return Parameters(alpha, beta, low, [r["g"] for r in gamma], None, cells)

    def predictions(self) -> DataFrame:
        """Every prediction of every cell (see ``operators.predict``); with covariates, their share is in the counterfactual."""
        self.check()
        p = self.parameters()
        return predict.predictions(self.cells, p.alpha, p.beta, self.tau, p.low, p.mu, self.att, p.gamma)

    def predict(self, kind: str = "y0") -> DataFrame:
        return predict.predict(self.predictions(), kind)

    def diagnose(self, verb: str, **options) -> DataFrame | dict:
        """By name: summarize, vce, eventstudy, placebo, pretrend, bootstrap, factors, triplerob, unconverged, loocv, sensitivity, mht, weights, distance, table."""
        self.check()
        if verb == "summarize":
            return diagnose.summarize(self.cells)
        if verb == "eventstudy":
            return diagnose.event_study(self.cells, self.tau, **options)
        if verb in ("placebo", "pretrend"):
            p = self.parameters()
            mu = p.mu or 0.0
            gaps = diagnose.placebo(self.cells, p.alpha.withColumn("alpha", F.col("alpha") + mu), p.beta, low=p.low, gamma=p.gamma, **options)
            if verb == "placebo":
                return gaps
            wald = diagnose.pretrend(gaps).first()
            return self.cells.sparkSession.createDataFrame([(wald["wald"], wald["df"], diagnose.pretrend_p(wald["wald"], wald["df"]))], "wald double, df long, p double")
        if verb == "bootstrap":
            return diagnose.moments(self.boot)
        if verb == "vce":
            return resample.variance(self.boot, self.options.ddof)
        if verb == "factors":
            return diagnose.factors_of(self.parameters().low)
        if verb == "triplerob":
            return diagnose.triple(self.cells, self.parameters().low, *self.lambdas[:2], **options)
        if verb == "table":
            return diagnose.table([{"name": options.pop("name", self.options.method), **self.inference}], **options)
        if verb == "unconverged":
            return diagnose.unconverged(self.parameters().cells)
        if verb == "loocv":
            return loocv(self.lambdas, self.scores)
        if verb == "sensitivity":
            rows = [(g, r["lam_time"], r["lam_unit"], r["lam_norm"], r["q"]) for g, r in enumerate(self.scores) if math.isfinite(r["q"])]
            return cv.sensitivity(self.cells.sparkSession.createDataFrame(rows, "g_id int, lam_time double, lam_unit double, lam_norm double, q double"))
        if verb == "mht":
            return diagnose.multiple(diagnose.cell_tests(self.tau, self.inference["se"]), ["u", "t"])
        if verb == "weights":
            return native_weights.joint_unit(self.cells, self.lambdas[1]) if self.options.method == "joint" else native_weights.theta(treated_cells(self.cells), self.cells, self.lambdas[0])
        if verb == "distance":
            return distance.distance_summary(self.cells, self.lambdas[1])
        raise InvalidSpec(f"no diagnosis {verb}")


def loocv(lambdas: tuple[float, float, float], scores: list[dict]) -> dict:
    """What a search found: its seeds (best on each axis with the others at their ends) and its end, valid and failed fits, and how stable the end is."""
    finite = [r for r in scores if math.isfinite(r["q"])]
    key = ("lam_time", "lam_unit", "lam_norm")
    seeds = {
        "lam_time": [r for r in finite if r["lam_unit"] == 0 and math.isinf(r["lam_norm"])],
        "lam_norm": [r for r in finite if r["lam_time"] == r["lam_unit"] == 0],
        "lam_unit": [r for r in finite if r["lam_time"] == 0 and math.isinf(r["lam_norm"])],
    }
    stage1 = {k: min(v, key=lambda r: r["q"])[k] if v else None for k, v in seeds.items()}
    ok, n = (sum(r.get(k, 0) for r in scores) for k in ("n_valid", "n_attempted"))
    grids = tuple(sorted({r[k] for r in scores}) for k in key)
    out = {"lambdas": lambdas, "stage1": stage1, "n_scores": len(scores), "n_given_up": sum("at_least" in r for r in scores), "n_failed": sum(math.isinf(r["q"]) and "at_least" not in r for r in scores)}
    out |= {"q_min": min((r["q"] for r in finite), default=None), "q_max": max((r["q"] for r in finite), default=None), "valid_share": ok / n if n else None}
    out |= {"first_failed": min((r["first_failed"] for r in scores if r.get("first_failed")), default=None)}
    return out | (cv.stability(dict(zip(key, lambdas, strict=True)), grids) if scores else {})


def zero_low(cells: DataFrame, lam_time: float) -> DataFrame:
    """``(u, t, low)``: at norm penalty 0 the low-rank part is what a fit's effects leave of the control cells; averages over all fits."""
    alpha, beta = predict.zero_parameters(cells, lam_time)
    rest = cells.join(alpha, "u", "left").join(beta, "t", "left")
    return rest.select("u", "t", F.when((F.col("d") == 0) & F.col("y").isNotNull(), F.col("y") - F.col("alpha") - F.col("beta")).otherwise(0.0).alias("low"))


def estimate(df: DataFrame, spec: PanelSpec | None = None, options: FitOptions | None = None, grid: str | tuple = "default", survey: SurveyDesign | None = None) -> Fit:
    """Validate, choose penalties (given ones, or by leave-one-out search), estimate and bootstrap.

    Every failed check of ``validate.report`` is an error, and so are treatments other than 0 and 1 and covariates that are
    missing. A weight in the spec weights effects, not fits. With a survey design the bootstrap rescales weights
    (1 each where the spec names none) and fits nothing again.
    """
    spec, options = spec or PanelSpec(), options or FitOptions()
    spec.check(df.schema)
    raw = validate.raw_problems(df, spec).first()
    if raw["n_not_binary"]:
        raise InvalidPanel(f"{raw['n_not_binary']} rows have a treatment other than 0 and 1")
    if raw["n_no_covariate"]:
        raise InvalidPanel(f"{raw['n_no_covariate']} rows lack a covariate")
    cells = distance.keep_pairs(index_cells(df, spec).persist())
    if not cells.where("d = 1 AND y IS NOT NULL").limit(1).count():
        raise NoTreatedCell("no treated cell")
    if not cells.where("d = 0 AND y IS NOT NULL").limit(1).count():
        raise NoControlCell("no control cell")
    failed = [r["check"] for r in validate.report(cells).collect() if not r["ok"]]
    if failed:
        raise InvalidPanel(", ".join(sorted(failed)))
    sim = bool(validate.simultaneous(cells).first()["simultaneous"])
    complete = bool(validate.dims(cells).first()["balanced"])
    if options.method == "joint" and not sim:
        raise InvalidPanel("the joint method needs simultaneous, absorbing adoption")
    scores: list[dict] = []
    if options.lambdas is None:
        best, scores = search(cells, options, grid, sim and complete)
        lam = (best["lam_time"], best["lam_unit"], best["lam_norm"])
    else:
        lam = options.lambdas
    path = choose_path(options.method, lam[2], sim, complete, bool(spec.covariates))
    tau, att = effects(cells, options, lam, path)
    lost = treated_cells(cells).count() - tau.where("tau IS NOT NULL").count()
    weights = design = None
    if spec.weight:
        if validate.weight_check(cells).first()["n_bad"]:
            raise InvalidPanel("weights must be positive and constant within a unit")
        weights = cells.groupBy("u").agg(F.max("w").alias("w"))
        att = native.weighted_att(tau, weights).first()["att"]
    if survey:
        design = survey_table(df, cells, spec, survey, weights)
        if validate.design_check(design, nest=True).where("NOT ok").limit(1).count():
            raise InvalidPanel("a stratum has fewer units in its population than in the sample, or several populations")
    boot, se, interval, missed = resampled(cells, options, lam, path, tau, weights, design, survey)
    n1 = units(cells).where("treated").count()
    return Fit(options, cells, path, lam, att, tau, infer.intervals(att, se, n1, options.level, options.ci, interval), boot, scores, weights, design, survey, {"cells": lost, "replicates": missed}, predict.signature(cells))


def survey_table(df: DataFrame, cells: DataFrame, spec: PanelSpec, survey: SurveyDesign, weights: DataFrame | None) -> DataFrame:
    """``(u, stratum, psu, w, fpc)``; strata and sampling units must be constant within a unit."""
    fpc = F.col(survey.fpc).cast("double") if survey.fpc else F.lit(None).cast("double")
    psu = F.struct(survey.stratum, survey.psu) if survey.nest else F.col(survey.psu)
    own = df.select(F.col(spec.unit).alias("unit"), F.col(survey.stratum).alias("stratum"), psu.alias("psu"), fpc.alias("fpc")).distinct()
    own = cells.select("unit", "u").distinct().join(own, "unit").select("u", "stratum", "psu", "fpc")
    if own.groupBy("u").count().where("count > 1").limit(1).count():
        raise InvalidPanel("a unit has several strata, sampling units or populations")
    if not survey.nest and own.select("stratum", "psu").distinct().groupBy("psu").count().where("count > 1").limit(1).count():
        raise InvalidPanel("a sampling unit is in several strata; nest them if their codes repeat")
    w = weights if weights is not None else cells.select("u").distinct().withColumn("w", F.lit(1.0))
    return own.join(w, "u").select("u", "stratum", "psu", "w", "fpc")


def resampled(cells, options, lam, path, tau, weights=None, design=None, survey=None) -> tuple[DataFrame | None, float | None, tuple[float, float] | None, int]:
    """Replicates, their standard error and percentile interval, and how many have no effect."""
    if not options.n_boot:
        return None, None, None, 0
    if design is not None:
        boot = resample.rao_wu_att(tau, resample.rao_wu(design, options.n_boot, options.seed, survey))
    elif path == "zero" and lam[1] == 0:
        boot = resample.boot_zero(cells, lam[0], resample.unit_draws(cells, options.n_boot, options.seed), weights)
    else:
        boot = boot_refit(cells, options, lam, weights)
    boot = boot.where("att IS NOT NULL AND NOT isnan(att)").persist()
    got = resample.variance(boot, options.ddof).first()
    if options.n_boot - got["n"] > cv.WARN_SHARE * options.n_boot:
        warnings.warn(f"{options.n_boot - got['n']} of {options.n_boot} replicates have no effect", PanelWarning, stacklevel=3)
    r = resample.percentile_interval(boot, options.level).first()
    return boot, got["se"], (r["low"], r["high"]) if r["low"] is not None else None, options.n_boot - got["n"]


def effects(cells: DataFrame, options: FitOptions, lam: tuple[float, float, float], path: str) -> tuple[DataFrame, float]:
    targets = treated_cells(cells)
    spark = cells.sparkSession
    if path == "zero":
        tau = native.twostep_zero(cells, targets.select("u", "t", "y"), lam[0], lam[1])
    elif path == "inf" and options.method == "twostep":
        tau = native.twostep_inf(cells, lam[0], lam[1])
    elif options.method == "twostep" and not kernels.fits_densely(cells):
        tau = sparse.fits(cells, targets, lam, options.tol, options.maxiter)
    elif options.method == "twostep":
        grid = spark.createDataFrame([(0, *map(float, lam))], "g_id int, lam_time double, lam_unit double, lam_norm double")
        tau = kernels.cell_fits(cells, kernels.tasks_for(targets, grid), tol=options.tol, maxiter=options.maxiter)
    elif path == "inf":
        tau = native.joint_inf_tau(cells, lam[0], lam[1])
    elif effective_penalty(lam[2]) > 0:
        fit = joint.fit(cells, *lam, options.tol, options.maxiter)
        tau = fit.tau.persist()
        att = native.att(tau).first()["att"]
        fit.release()
        return tau, att
    else:
        fit = kernels.joint_fit(cells, *lam, options.tol, options.maxiter)
        rows = [(int(u), int(t), float(v)) for (t, u), v in _finite(fit["tau"])]
        return spark.createDataFrame(rows, "u int, t int, tau double"), fit["att"]
    tau = tau.persist()
    return tau, native.att(tau).first()["att"]


def _finite(m):
    return [(tuple(i), m[tuple(i)]) for i in np.argwhere(np.isfinite(m))]


class Tried:
    """How many held-out fits a search tried for each combination, how many failed, and the first that did."""

    def __init__(self) -> None:
        self.rows: dict[tuple, list] = {}

    def add(self, row: tuple, r) -> tuple[float | None, int, int]:
        held = self.rows.setdefault(row, [0, 0, None])
        held[0] += r["n_valid"]
        held[1] += r["n_attempted"]
        held[2] = min((tuple(f) for f in (held[2], r["first_failed"]) if f is not None), default=None)
        return r["q"], r["n_valid"], r["n_attempted"]

    def of(self, score: dict) -> dict:
        held = self.rows.get((score["lam_time"], score["lam_unit"], score["lam_norm"]))
        return {} if held is None else {"n_valid": held[0], "n_attempted": held[1], "first_failed": held[2]}

    def judge(self) -> None:
        """Give up where more than ABORT_SHARE of all fits failed, warn beyond WARN_SHARE."""
        ok, n = (sum(r[k] for r in self.rows.values()) for k in (0, 1))
        share = 1 - ok / n if n else 0.0
        first = min((r[2] for r in self.rows.values() if r[2] is not None), default=None)
        if share > cv.ABORT_SHARE:
            raise SearchFailed(f"{share:.0%} of the held-out fits failed, the first at period and unit {first}")
        if share > cv.WARN_SHARE:
            warnings.warn(f"{share:.1%} of the held-out fits failed, the first at period and unit {first}", PanelWarning, stacklevel=3)


def search(cells: DataFrame, options: FitOptions, grid: str | tuple, block: bool = False) -> tuple[dict, list[dict]]:
    """Search by the method's own leave-one-out score; every combination that was asked for is returned.

    With pruning (``options.prune``) a combination is given up once its sum over some cells exceeds the best: it has an infinite score then and
    the sum as ``at_least``. The winner is the same. ``block``: the panel is complete with simultaneous adoption, so the joint scores at infinite norm have a closed form.
    """
    preset = grid if isinstance(grid, tuple) else cv.GRIDS[cv.ALIASES.get(grid, grid)]
    spark, by_joint = cells.sparkSession, options.method == "joint"
    closed = "x" not in cells.columns
    plain = (lambda n: block and closed and effective_penalty(n) >= LARGE_PENALTY) if by_joint else (lambda n: closed and n == 0)
    cycling = search_mode(options) == "cycling"
    prune = cycling if options.prune is None else options.prune
    fitted = kernels.cv_joint if by_joint else kernels.cv_lowrank
    panel, tried = None, Tried()

    def score(rows: list[tuple], bound: float) -> list[tuple[float, float | None]]:
        nonlocal panel
        make = lambda ids: spark.createDataFrame([(g, *map(float, rows[g])) for g in ids], "g_id int, lam_time double, lam_unit double, lam_norm double")
        easy = [g for g, r in enumerate(rows) if plain(r[2])]
        rest = [g for g, r in enumerate(rows) if not plain(r[2])]
        exact: dict[int, float] = {}
        below: dict[int, float] = {}
        if easy:
            found = (cv.scores_joint if by_joint else cv.scores_zero)(cells, make(easy).select("g_id", "lam_time", "lam_unit")).collect()
            exact |= {r["g_id"]: r["q"] if r["n_valid"] == r["n_attempted"] and r["q"] is not None else math.inf for r in found}
        if rest:
            panel = panel or kernels.share(cells)
            wave = lambda ids, lo, hi: {r["g_id"]: tried.add(rows[r["g_id"]], r) for r in fitted(cells, make(ids), options.tol, options.maxiter, panel, (lo, hi)).collect()}
            if prune:
                some, below, _ = cv.bounded(rest, wave, min([bound, *exact.values()]))
            else:
                some = {g: q if ok == n and q is not None else math.inf for g, (q, ok, n) in wave(rest, 0, kernels.BUCKETS).items()}
            exact |= some
        return [(exact.get(g, math.inf), below.get(g)) for g in range(len(rows))]

    try:
        best, scores = (cv.cycle if cycling else cv.exhaust)(score, preset, bounding=True)
        tried.judge()
        return best, [r | tried.of(r) for r in scores]
    except SearchFailed:
        tried.judge()
        raise
    finally:
        if panel is not None:
            panel.destroy()


def environment() -> dict:
    """Versions that a fit depends on."""
    import sys

    import pyarrow as pa
    import pyspark

    return {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "numpy": np.__version__, "pandas": pd.__version__, "pyarrow": pa.__version__}


def expected_seconds(n_units: int, n_periods: int, n_fits: int, iterations: int = 30, operations: float = 5e7) -> float | None:
    """A rough run time on one core for panels of 50,000 cells and more (None below): singular value decompositions prevail."""
    if n_units * n_periods < 50_000:
        return None
    return n_fits * iterations * n_units * n_periods * min(n_units, n_periods) / operations


def boot_refit(cells: DataFrame, options: FitOptions, lam: tuple[float, float, float], weights: DataFrame | None = None) -> DataFrame:
    """``(b, att)``: each replicate's panel is gathered from the broadcast one and fitted anew, penalties held."""
    from ..functions.threads import one_thread
    from ..shipping import ship

    spark = cells.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(kernels.dense(cells))
    draws = resample.unit_draws(cells, options.n_boot, options.seed)
    lists = draws.groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "u"))), lambda s: s["u"]).alias("us"))
    method, tol, maxiter = options.method, options.tol, options.maxiter
    by_unit = None if weights is None else {r["u"]: r["w"] for r in weights.collect()}  # no more than the panel's units

    def run(frames):
        one_thread()
        y0, d0, x0 = shared.value
        for f in frames:
            out = []
            for b, us in zip(f.b, f.us, strict=True):
                us = np.asarray(us)
                y, d, x = y0[:, us], d0[:, us], None if x0 is None else x0[:, us]
                att = None
                try:
                    if method == "joint":
                        fit = kernels.fit_joint(y, d, kernels.joint_weights(y, d, lam[0], lam[1]), effective_penalty(lam[2]), x, tol, maxiter, condition=False)
                        att = fit["att"]
                        if by_unit:
                            cell = np.argwhere(np.isfinite(fit["tau"]))
                            att = float(np.average(fit["tau"][cell[:, 0], cell[:, 1]], weights=[by_unit[us[u]] for u in cell[:, 1]])) if len(cell) else None
                    else:
                        taus, ws = [], []
                        for t, u in np.argwhere((d == 1) & np.isfinite(y)):
                            w = kernels.cell_weights(y, d, u, t, lam[0], lam[1])
                            fit = kernels.fit_cell(y, w, effective_penalty(lam[2]), x, tol, maxiter)
                            effect = y[t, u] - fit["alpha"][u] - fit["beta"][t] - fit["low"][t, u]
                            taus.append(effect - (0 if x is None else np.nan_to_num(x[t, u]) @ fit["gamma"]))
                            ws.append(by_unit[us[u]] if by_unit else 1.0)
                        att = float(np.average(taus, weights=ws)) if taus else None
                except (ArithmeticError, np.linalg.LinAlgError, InvalidPanel):
                    att = None
                out.append((b, att))
            yield pd.DataFrame(out, columns=["b", "att"])

    parts = min(options.n_boot, spark.sparkContext.defaultParallelism * 4)
    return lists.repartition(parts, F.xxhash64("b")).mapInPandas(run, "b int, att double")
