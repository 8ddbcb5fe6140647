"""Kernels against closed forms and brute force, properties, edges and a simulated recovery."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.functions import dist
from panelfx.operators import cv, diagnose, distance, infer, kernels, native, predict, resample, validate
from panelfx.operators.index import index_cells, treated_cells
from panelfx.plans.strategy import choose_path, environment, estimate, expected_seconds, search
from panelfx.spec import FitOptions, InvalidPanel, InvalidSpec, NoTreatedCell, PanelSpec, SurveyDesign, effective_penalty


def frame(spark, y, d):
    t, n = y.shape
    rows = [(int(i), int(s), None if y[s, i] is None or np.isnan(y[s, i]) else float(y[s, i]), int(d[s, i])) for s in range(t) for i in range(n)]
    return spark.createDataFrame(rows, "unit int, time int, y double, d int")


def block(n=8, t=10, treated=2, start=7, seed=0, effect=0.0):
    r = np.random.default_rng(seed)
    y = r.normal(size=n) + np.cumsum(r.normal(size=t))[:, None] * 0.3 + r.normal(size=(t, n)) * 0.3
    d = np.zeros((t, n), dtype=int)
    d[start:, :treated] = 1
    return y + effect * d, d


@pytest.fixture(scope="module")
def small(spark):
    y, d = block()
    return y, d, index_cells(frame(spark, y, d)).cache()


def test_distances(small):
    y, d, cells = small
    for r in distance.distances(cells).collect():
        both = (d[:, r["i"]] == 0) & (d[:, r["j"]] == 0)
        want = 0.0 if r["i"] == r["j"] else math.sqrt(np.mean((y[both, r["i"]] - y[both, r["j"]]) ** 2))
        assert r["dist"] == pytest.approx(want, abs=1e-12) and r["n"] == both.sum()


def test_no_shared_period(spark):
    y, d = block(4, 4)
    y[:2, 0] = np.nan
    y[2:, 1] = np.nan
    got = {(r["i"], r["j"]): r for r in distance.distances(index_cells(frame(spark, y, d * 0))).collect()}
    assert got[0, 1]["dist"] is None and got[0, 1]["n"] == 0
    assert got[0, 0]["dist"] == 0.0


@pytest.mark.parametrize("lams", [(0.0, 0.0), (0.1, 0.0), (0.2, 0.7)])
def test_closed_forms_agree_with_kernels(small, lams):
    y, d, cells = small
    targets = treated_cells(cells).select("u", "t", "y")
    zero = {(r["u"], r["t"]): r["tau"] for r in native.twostep_zero(cells, targets, *lams).collect()}
    inf = {(r["u"], r["t"]): r["tau"] for r in native.twostep_inf(cells, *lams).collect()}
    for (u, t), tau in zero.items():
        w = kernels.cell_weights(y, d, u, t, *lams)
        a = kernels.fit_cell(y, w, 0.0)
        assert y[t, u] - a["alpha"][u] - a["beta"][t] - a["low"][t, u] == pytest.approx(tau, abs=1e-9)
        b = kernels.fit_cell(y, w, math.inf, tol=1e-13, maxiter=20_000)
        assert y[t, u] - b["alpha"][u] - b["beta"][t] == pytest.approx(inf[u, t], abs=1e-7)
    joint = kernels.joint_fit(cells, *lams, math.inf)
    assert native.joint_inf(cells, *lams).first()["att"] == pytest.approx(joint["att"], abs=1e-9)
    if lams == (0.0, 0.0):
        assert native.did(cells).first()["did"] == pytest.approx(joint["att"], abs=1e-9)


def test_search_score_is_brute_force(spark, small):
    y, d, cells = small
    grid = cv.grid_frame(spark, [0.0, 0.3], [0.0, 0.5])
    got = {(r["lam_time"], r["lam_unit"]): r["q"] for r in cv.scores_zero(cells, grid).collect()}
    for lt, lu in got:
        q = 0.0
        for t, u in np.argwhere(d == 0):
            f = kernels.fit_cell(y, kernels.cell_weights(y, d, u, t, lt, lu), 0.0)
            q += (y[t, u] - f["alpha"][u] - f["beta"][t]) ** 2
        assert got[lt, lu] == pytest.approx(q, rel=1e-9)


def test_tie_break():
    rows = [{"g_id": 0, "lam_time": 1.0, "lam_unit": 0.0, "lam_norm": 1.0, "q": 2.0}, {"g_id": 1, "lam_time": 0.5, "lam_unit": 0.0, "lam_norm": 1.0, "q": 2.0 + 1e-12}, {"g_id": 2, "lam_time": 9.0, "lam_unit": 0.0, "lam_norm": 5.0, "q": 2.0}, {"g_id": 3, "lam_time": 0.0, "lam_unit": 0.0, "lam_norm": 0.0, "q": math.nan}]
    assert cv.select(rows)["g_id"] == 2
    assert cv.select(rows[:2])["g_id"] == 1
    best, seen = cv.cycle(lambda rs: [(a - 1) ** 2 + (b - 2) ** 2 + (0 if c == 1 else 1) for a, b, c in rs], ([0, 1], [0, 2], [0, 1, math.inf]))
    assert (best["lam_time"], best["lam_unit"], best["lam_norm"]) == (1, 2, 1) and len(seen) <= 12


def test_shrink_properties():
    r = np.random.default_rng(0)
    for _ in range(20):
        m = r.normal(size=(r.integers(1, 9), r.integers(1, 9)))
        s = np.linalg.svd(m, compute_uv=False)
        out = kernels.shrink(m, 0.4)
        assert np.linalg.svd(out, compute_uv=False)[: len(s)] == pytest.approx(np.maximum(s - 0.4, 0), abs=1e-9)
        assert (kernels.shrink(m, np.linalg.norm(m)) == 0).all() and (kernels.shrink(m, 0) == m).all()
    assert (kernels.shrink(np.array([[np.nan, 1.0]]), 1.0) == 0).all()


def test_larger_penalty_smaller_low_rank():
    y, d = block(seed=3)
    w = (d == 0).astype(float)
    norms = [np.linalg.norm(kernels.fit_cell(y, w, lam)["low"], "nuc") for lam in (0.5, 1.0, 2.0, 4.0, math.inf)]
    assert all(a >= b - 1e-6 for a, b in zip(norms, norms[1:], strict=False)) and norms[-1] == 0


def test_recovery_with_factors(spark):
    r = np.random.default_rng(42)
    y, d = block(20, 16, 4, 12, 1, effect=0.5)
    y = y + r.normal(size=(16, 2)) @ r.normal(size=(2, 20)) * 0.5
    fit = estimate(frame(spark, y, d), options=FitOptions(lambdas=(0.0, 0.0, 1.0), n_boot=20))
    assert fit.path == "kernel" and abs(fit.att - 0.5) < 0.5
    assert fit.inference["se"] > 0 and fit.inference["low"] < fit.att < fit.inference["high"]


def test_covariates_are_recovered(spark):
    r = np.random.default_rng(4)
    y, d = block(12, 12, 2, 9, 2)
    x = r.normal(size=y.shape)
    y = y + 2.0 * x
    rows = [(int(i), int(s), float(y[s, i]), int(d[s, i]), float(x[s, i])) for s in range(12) for i in range(12)]
    df = spark.createDataFrame(rows, "unit int, time int, y double, d int, x1 double")
    cells = index_cells(df, PanelSpec(covariates=("x1",)))
    joint = kernels.joint_fit(cells, 0, 0, math.inf)
    assert joint["gamma"][0] == pytest.approx(2.0, abs=0.1)
    twice = kernels.fit_joint(y, d, (d == 0) * 1.0, 1e10, np.stack([x, x], axis=2))
    assert twice["att"] == pytest.approx(joint["att"], abs=1e-6)


def test_partitions_do_not_matter(small):
    _, _, cells = small
    targets = treated_cells(cells).select("u", "t", "y")
    one = sorted(map(tuple, native.twostep_zero(cells.coalesce(1), targets, 0.1, 0.2).collect()))
    many = sorted(map(tuple, native.twostep_zero(cells.repartition(8), targets, 0.1, 0.2).collect()))
    assert np.allclose(np.array(one), np.array(many), atol=1e-12)


def test_bootstrap_by_multiplicities(small):
    y, d, cells = small
    draws = resample.unit_draws(cells, 12).cache()
    got = {r["b"]: r["att"] for r in resample.boot_zero(cells, 0.1, draws).collect()}
    for b in (0, 5, 11):
        us = [r["u"] for r in sorted(draws.where(f"b = {b}").collect(), key=lambda r: r["k"])]
        yb, db = y[:, us], d[:, us]
        taus = []
        for t, u in np.argwhere(db == 1):
            f = kernels.fit_cell(yb, kernels.cell_weights(yb, db, u, t, 0.1, 0.0), 0.0)
            taus.append(yb[t, u] - f["alpha"][u] - f["beta"][t])
        assert got[b] == pytest.approx(np.mean(taus), abs=1e-9)


def test_survey_edges(spark):
    design = spark.createDataFrame([(0, 0, 0, 1.0, 2.0), (1, 0, 1, 2.0, 2.0), (2, 1, 2, 3.0, 9.0), (3, 2, 3, 1.0, 8.0), (4, 2, 4, 1.0, 8.0)], "u int, stratum long, psu long, w double, fpc double")
    kept = {r["u"]: r["w"] for r in resample.rao_wu(design, 3).where("b = 1").collect()}
    assert (kept[0], kept[1], kept[2]) == (1.0, 2.0, 3.0)  # a census and a single unit keep their weights
    assert kept[3] + kept[4] == pytest.approx(2.0)
    with pytest.raises(InvalidPanel):
        resample.rao_wu(design, 3, options=SurveyDesign("stratum", "psu", lonely="fail"))
    bad = spark.createDataFrame([(0, 0, 7, 1.0, 1.0), (1, 0, 8, 1.0, 1.0), (2, 1, 7, 1.0, 5.0)], "u int, stratum long, psu long, w double, fpc double")
    ok = {r["stratum"]: r["ok"] for r in validate.design_check(bad).collect()}
    assert ok == {0: False, 1: False} and validate.design_check(bad, nest=True).where("ok").count() == 1


def test_distributions():
    assert dist.t_quantile(0.975, 7) == pytest.approx(2.364624251592784)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.beta_i(2, 3, 0.4) == pytest.approx(0.5248)
    assert dist.t_cdf(-2.0, 5) == pytest.approx(0.050969739414929105)


def test_normal_column(spark):
    z = [-9.0, -3.0, -1.0, 0.0, 0.3, 2.99, 3.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(dist.normal_cdf_column(F.col("z"))).collect()]
    assert got == pytest.approx([dist.normal_cdf(x) for x in z], rel=1e-7, abs=1e-15)


def test_intervals():
    a = infer.intervals(1.0, 0.5, 8)
    assert a["ci_method"] == "percentile->t" and a["high"] == pytest.approx(1 + 0.5 * dist.t_quantile(0.975, 7))
    assert infer.intervals(1.0, 0.0, 8)["p"] is None
    assert infer.intervals(1.0, 0.5, 1)["t_high"] == pytest.approx(1 + 0.5 * 1.959963984540054)
    assert infer.intervals(1.0, 0.5, 8, percentile=(0.1, 2.0))["low"] == 0.1


def test_guards(spark):
    y, d = block()
    with pytest.raises(NoTreatedCell):
        estimate(frame(spark, y, d * 0), options=FitOptions(lambdas=(0, 0, 0), n_boot=0))
    with pytest.raises(InvalidPanel):
        estimate(frame(spark, y * 0, d), options=FitOptions(lambdas=(0, 0, 0), n_boot=0))
    for bad in ({"n_boot": 1}, {"tol": 0}, {"lambdas": (-1, 0, 0)}, {"lambdas": (math.inf, 0, 0)}, {"method": "x"}):
        with pytest.raises(InvalidSpec):
            FitOptions(**bad)
    with pytest.raises(InvalidSpec):
        PanelSpec(outcome="z").check(frame(spark, y, d).schema)
    assert effective_penalty(math.inf) == 1e10
    assert choose_path("twostep", 0, False, False) == "zero" and choose_path("joint", math.inf, True, True) == "inf" and choose_path("joint", 1.0, True, True) == "kernel"


def test_odd_cells(spark):
    rows = [(0, 0, float("nan"), 0), (0, 1, float("inf"), 0), (0, 2, 1.0, None), (None, 1, 1.0, 0), (1, 0, 2.0, 0), (1, 1, None, 0)]
    cells = index_cells(spark.createDataFrame(rows, "unit int, time int, y double, d int")).collect()
    assert len(cells) == 4 and sum(c["y"] is not None for c in cells) == 1
    none = index_cells(spark.createDataFrame([], "unit int, time int, y double, d int"))
    assert none.count() == 0 and validate.dims(none).first()["n_obs"] == 0


def test_failed_fit_is_a_row(spark):
    y, d = block(4, 5, 1, 3)
    y[:, 1:] = np.nan
    y[:3, 0] = np.nan
    cells = index_cells(frame(spark, y, d))
    tasks = treated_cells(cells).select("u", "t", F.lit(0.0).alias("lam_time"), F.lit(0.0).alias("lam_unit"), F.lit(1.0).alias("lam_norm"), F.col("t").cast("long").alias("task_id"))
    got = kernels.cell_fits(cells, tasks).collect()
    assert len(got) == 2 and all(r["tau"] is None and r["converged"] == -1 for r in got)


def test_factor_diagnostics():
    r = np.random.default_rng(0)
    low = np.outer(r.normal(size=6), r.normal(size=5))
    f = diagnose.factors(low)
    assert f["effective_rank"] == pytest.approx(1, abs=1e-9) and f["share"][0] == pytest.approx(1)
    assert diagnose.factors(np.zeros((3, 3)))["effective_rank"] == 0
    b = diagnose.triple_bias(low, [(0, 0, np.eye(5)[0], np.eye(6)[0])])
    assert b["rank"] in (1, 2) and b["unit"] == pytest.approx(0, abs=1e-9) and b["product"] == pytest.approx(0, abs=1e-9)


def test_predict_and_tables(small):
    _, _, cells = small
    alpha, beta = predict.zero_parameters(cells, 0.1)
    tau = native.twostep_zero(cells, treated_cells(cells).select("u", "t", "y"), 0.1, 0.0)
    out = predict.predictions(cells, alpha, beta, tau)
    assert out.where("d = 1 AND abs(residuals) > 1e-9").count() == 0
    assert predict.predict(out, "counterfactual").count() == cells.count()
    with pytest.raises(InvalidSpec):
        predict.predict(out, "nothing")
    joint = kernels.joint_fit(cells, 0, 0, math.inf)
    a = cells.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(joint["alpha"])], "u int, alpha double")
    b = cells.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(joint["beta"])], "t int, beta double")
    p = predict.predictions(cells, a, b, tau, mu=float(joint["mu"]), att=joint["att"])
    assert p.where("d = 1").agg(F.avg("residuals")).first()[0] == pytest.approx(0, abs=1e-9)
    row = {"name": "a", "att": 1.0, "se": 0.1, "low": 0.8, "high": 1.2, "p": 0.001}
    for fmt in ("markdown", "latex", "csv", "display"):
        assert "1.0000***" in diagnose.table([row], fmt)


def test_weights_design_and_new_bootstrap(spark):
    y, d = block(20, 12, 4, 9, 5, effect=1.0)
    rows = [(int(i), int(s), float(y[s, i]), int(d[s, i]), 1.0 + i % 3, int(i) // 5, int(i), 20.0) for s in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "unit int, time int, y double, d int, w double, stratum int, psu int, fpc double")
    spec = PanelSpec(weight="w")
    fit = estimate(df, spec, FitOptions(lambdas=(0.1, 0.0, 0.0), n_boot=30))
    tau = {(r["u"], r["t"]): r["tau"] for r in fit.tau.collect()}
    assert fit.att == pytest.approx(np.average(list(tau.values()), weights=[1.0 + u % 3 for u, _ in tau]))
    designed = estimate(df, spec, FitOptions(lambdas=(0.1, 0.0, 0.0), n_boot=30), survey=SurveyDesign("stratum", "psu", "fpc"))
    assert designed.att == pytest.approx(fit.att) and designed.inference["se"] > 0
    again = designed.bootstrap(40, seed=1)
    assert again.att == fit.att and again.boot.count() <= 40 and again.inference["se"] != designed.inference["se"]
    refit = estimate(df, spec, FitOptions(method="joint", lambdas=(0.0, 0.0, math.inf), n_boot=10))
    assert refit.path == "inf" and refit.inference["se"] > 0
    with pytest.raises(InvalidPanel):
        estimate(df.withColumn("w", F.when(F.col("time") == 0, 5.0).otherwise(F.col("w"))), spec, FitOptions(lambdas=(0.1, 0.0, 0.0), n_boot=0))


def test_average_parameters(small):
    y, d, cells = small
    t = treated_cells(cells)
    tasks = t.select("u", "t", F.lit(0.1).alias("lam_time"), F.lit(0.0).alias("lam_unit"), F.lit(1.0).alias("lam_norm"), (F.col("t") * 100 + F.col("u")).cast("long").alias("task_id"))
    fits = kernels.cell_fits(cells, tasks, with_parameters=True, maxiter=50).cache()
    alpha, beta, low = kernels.averages(fits, y.shape[1])
    rows = fits.collect()
    got = {r["u"]: r["alpha"] for r in alpha.collect()}
    assert got[3] == pytest.approx(np.mean([r["alpha"][3] for r in rows]))
    assert {(r["u"], r["t"]): r["low"] for r in low.collect()}[2, 4] == pytest.approx(np.mean([r["low"][4 * y.shape[1] + 2] for r in rows]))
    assert beta.count() == y.shape[0]


def test_joint_effects_by_cell(small, spark):
    """At infinite norm the API gives each cell its own effect, as the kernel does, and weights them."""
    y, d, cells = small
    for lams in ((0.0, 0.0), (0.2, 0.7)):
        want = kernels.joint_fit(cells, *lams, math.inf)["tau"]
        for r in native.joint_inf_tau(cells, *lams).collect():
            assert r["tau"] == pytest.approx(want[r["t"], r["u"]], abs=1e-9)
    rows = [(int(i), int(s), float(y[s, i]), int(d[s, i]), 1.0 + 4 * (i == 0), int(i) // 4, int(i), 20.0) for s in range(y.shape[0]) for i in range(y.shape[1])]
    df = spark.createDataFrame(rows, "unit int, time int, y double, d int, w double, stratum int, psu int, fpc double")
    fit = estimate(df, PanelSpec(weight="w"), FitOptions(method="joint", lambdas=(0.2, 0.7, math.inf), n_boot=20), survey=SurveyDesign("stratum", "psu", "fpc"))
    w = np.where(np.arange(y.shape[1]) == 0, 5.0, 1.0)
    ok = np.isfinite(want)
    assert fit.path == "inf" and fit.att == pytest.approx((want * w)[ok].sum() / np.broadcast_to(w, want.shape)[ok].sum())
    assert fit.inference["se"] > 0 and fit.boot.select("att").distinct().count() > 1


@pytest.mark.parametrize("lams", [(0.0, 0.0), (0.3, 0.5)])
def test_joint_search_score_is_brute_force(spark, small, lams):
    y, d, cells = small
    grid = spark.createDataFrame([(0, *lams)], "g_id int, lam_time double, lam_unit double")
    got = cv.scores_joint(cells, grid).first()
    q = 0.0
    for t, u in np.argwhere(d == 0):
        delta = kernels.joint_weights(y, d, *lams)
        delta[t, u] = 0.0
        q += (y[t, u] - kernels.fit_joint(y, d, delta, 1e10)["fitted"][t, u]) ** 2
    assert got["q"] == pytest.approx(q, rel=1e-8) and got["n_valid"] == got["n_attempted"] == (d == 0).sum()
    full = grid.selectExpr("g_id", "lam_time", "lam_unit", "1e10 AS lam_norm")
    assert kernels.cv_joint(cells, full).first()["q"] == pytest.approx(q, rel=1e-8)


def test_joint_search_uses_the_joint_score(spark, small):
    _, _, cells = small
    grids = ([0.0, 0.5], [0.0, 0.4], [1.0, math.inf])
    best, scores = search(cells, FitOptions(method="joint", maxiter=60), grids, True)
    assert len(scores) == 8 and best["q"] == min(r["q"] for r in scores)
    by = {(r["lam_time"], r["lam_unit"], r["lam_norm"]): r["q"] for r in scores}
    some = spark.createDataFrame([(0, 0.5, 0.4, 1.0), (1, 0.0, 0.4, 1e10)], "g_id int, lam_time double, lam_unit double, lam_norm double")
    got = {r["g_id"]: r["q"] for r in kernels.cv_joint(cells, some, maxiter=60).collect()}
    assert by[0.5, 0.4, 1.0] == pytest.approx(got[0]) and by[0.0, 0.4, math.inf] == pytest.approx(got[1])
    cycled, seen = search(cells, FitOptions(cv="cycling", maxiter=40), ([0.0, 0.5], [0.0], [0.0, math.inf]), True)
    assert math.isfinite(cycled["q"]) and len(seen) <= 4
    assert cv.stability(best, grids)["combinations"] == 8


def test_panels_are_refused(spark):
    y, d = block()
    df = frame(spark, y, d)
    for bad in (df.withColumn("d", F.col("d") * 0.9), df.withColumn("d", F.col("d") * 2), df.withColumn("d", F.when(F.col("d") == 1, 1.9).otherwise(0.0))):
        with pytest.raises(InvalidPanel):
            estimate(bad, options=FitOptions(lambdas=(0, 0, 0), n_boot=0))
    x = df.withColumn("x", F.when(F.col("unit") > 0, F.rand(1)))
    with pytest.raises(InvalidPanel):
        estimate(x, PanelSpec(covariates=("x",)), FitOptions(lambdas=(0, 0, math.inf), n_boot=0))
    y[:, 5] = np.nan
    with pytest.raises(InvalidPanel):
        estimate(frame(spark, y, d), options=FitOptions(lambdas=(0, 0, 0), n_boot=0))


@pytest.mark.parametrize("method", ["twostep", "joint"])
def test_fit_predicts_and_diagnoses(spark, method):
    y, d = block(10, 12, 3, 8, 6, effect=1.0)
    fit = estimate(frame(spark, y, d), options=FitOptions(method=method, lambdas=(0.1, 0.1, 2.0), n_boot=6, maxiter=80))
    assert fit.path == "kernel" and fit.failures == {"cells": 0, "replicates": 0}
    p = fit.parameters()
    assert p.alpha.count() == 10 and p.beta.count() == 12 and p.low.count() == 120
    rows = {(r["u"], r["t"]): r for r in fit.predictions().collect()}
    tau = {(r["u"], r["t"]): r["tau"] for r in fit.tau.collect()}
    for (u, t), v in tau.items():
        assert rows[u, t]["y0"] == pytest.approx(y[t, u] - v, abs=1e-3)
    assert fit.predict("te").where("te IS NOT NULL").count() == 12
    for verb in ("summarize", "eventstudy", "placebo", "pretrend", "bootstrap", "unconverged", "mht", "weights", "distance"):
        fit.diagnose(verb).collect()
    assert fit.diagnose("factors")["nuclear"] >= 0 and fit.diagnose("loocv")["n_scores"] == 0
    with pytest.raises(InvalidSpec):
        fit.diagnose("nothing")


def test_draws_of_large_strata_differ(spark):
    """Slots beyond 1009 of one stratum aren't the first of the next, and draws are spread evenly."""
    design = spark.range(3000).selectExpr("int(id) AS u", "id div 1500 AS stratum", "id AS psu", "1.0D AS w", "CAST(NULL AS DOUBLE) AS fpc")
    got = [r["w"] for r in resample.rao_wu(design, 1).orderBy("u").collect()]
    assert got[1009 - 1500 :] != got[: 1500 - 1009] and sum(got[:1500]) == pytest.approx(1500)
    cells = spark.range(40).selectExpr("int(id % 20) AS u", "int(id div 20) AS t", "1.0D AS y", "0 AS d")
    n = {r["u"]: r["n"] for r in resample.unit_draws(cells, 500).groupBy("u").agg(F.count("*").alias("n")).collect()}
    assert sum((v - 500) ** 2 / 500 for v in n.values()) < 45  # chi-square, 19 degrees of freedom


def test_distance_keeps_small_terms(spark):
    """One huge period must not swallow the others when it is left out."""
    y = np.array([[1e9, -1e9, 0.0], [1.0, 1.001, 5.0], [2.0, 2.002, 1.0], [3.0, 3.0, 0.0]])
    cells = index_cells(frame(spark, y, np.zeros((4, 3), dtype=int)))
    got = {r["j"]: r["dist"] for r in distance.distances_without(cells, cells.where("u = 0 AND t = 0")).collect()}
    assert got[1] == pytest.approx(math.sqrt((0.001**2 + 0.002**2) / 3), rel=1e-6)


def test_quartiles_of_ties(spark):
    for values in ([1.0], [1.0, 2.0], [1, 2, 3, 4], [5.0] * 40, [1, 1, 2, 2, 2, 9, 9, 10], list(range(101))):
        y = spark.createDataFrame([(float(v),) for v in values], "y double")
        v, n = sorted(values), len(values)
        for p in (0.25, 0.75):
            want = (v[int(n * p) - 1] + v[int(n * p)]) / 2 if n * p == int(n * p) else v[math.ceil(n * p) - 1]
            assert validate.quartile(y, p, "q").first()["q"] == want


def test_shapiro_wilk_and_helpers():
    r = np.random.default_rng(0)
    assert diagnose.shapiro_wilk(r.normal(size=200))[1] > 0.01 and diagnose.shapiro_wilk(r.exponential(size=200))[1] < 1e-6
    assert diagnose.shapiro_wilk([1.0] * 20) is None
    p = [diagnose.shapiro_wilk(r.normal(size=50))[1] for _ in range(400)]
    assert 0.01 < np.mean(np.array(p) < 0.05) < 0.1
    assert environment()["pyspark"] and expected_seconds(10, 10, 5) is None and expected_seconds(1000, 100, 10) > 0
