"""The joint fit over blocks, leave-one-out scores at interior norms, bounded searches and tiles, against dense fits and brute force."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelfx.functions import ordered, threads
from panelfx.functions.vectors import subspace, tree_sum
from panelfx.operators import cv, diagnose, distance, factored, joint, kernels, native, predict, validate, weights
from panelfx.operators.index import index_cells
from panelfx.plans.strategy import Tried, estimate, search
from panelfx.spec import FitOptions, InvalidPanel, PanelSpec, PanelWarning, SearchFailed
from test_estimators import block, frame


def factor_panel(n=14, t=12, treated=3, start=9, seed=3):
    r = np.random.default_rng(seed)
    y, d = block(n, t, treated, start, seed, effect=0.5)
    return y + r.normal(size=(t, 2)) @ r.normal(size=(2, n)) * 0.7, d


@pytest.mark.parametrize("lam", [0.05, 0.5, 3.0, math.inf])
def test_factors_reach_the_optimum(lam):
    """Against a plain proximal gradient with effects projected out, and by the conditions for an optimum."""
    y, d = factor_panel()
    w = kernels.joint_weights(y, d, 0.1, 0.2)
    panel = factored.Panel(y, w)
    got = factored.solve(panel, lam, 1e-9, 20_000)
    alpha, low = panel.parts(got.state, 0.0 if math.isinf(lam) else lam)
    rest = w * (y - alpha - got.state.beta[:, None] - low)
    assert got.converged and np.abs(rest.sum(axis=0)).max() < 1e-6 and np.abs(rest.sum(axis=1)).max() < 1e-6
    if math.isinf(lam):
        assert got.state.a.shape[1] == 0
        return
    # no direction is steeper than the penalty, and L is a fixed point of its proximal step
    assert np.linalg.norm(rest, 2) <= lam / 2 * (1 + 1e-4)
    step = kernels.shrink(low + rest / w.max(), lam / (2 * w.max()))
    assert np.abs(step - low).max() < 1e-5
    warm = factored.solve(panel, lam, 1e-9, 20_000, got.state)
    assert warm.passes <= 5 and warm.objective == pytest.approx(got.objective, rel=1e-9)


@pytest.mark.parametrize(("lam", "shape"), [(0.5, (14, 12)), (0.5, (9, 16)), (1e10, (14, 12)), (50.0, (14, 12))])
def test_blocks_equal_the_dense_fit(spark, monkeypatch, lam, shape):
    n, t = shape
    y, d = factor_panel(n, t, 3, t - 3)
    y[1, n - 1] = np.nan
    monkeypatch.setattr(joint, "BLOCK_CELLS", 40)  # many blocks
    cells = index_cells(frame(spark, y, d))
    got = joint.fit(cells, 0.1, 0.2, lam, tol=1e-9, maxiter=5000)
    want = kernels.fit_joint(y, d, kernels.joint_weights(y, d, 0.1, 0.2), lam, tol=1e-9, maxiter=5000)
    assert got.mu == pytest.approx(want["mu"], abs=1e-6) and got.converged == 1 and got.rank <= min(n, t)
    assert {r["u"]: r["alpha"] for r in got.alpha.collect()} == pytest.approx(dict(enumerate(want["alpha"])), abs=1e-6)
    assert {r["t"]: r["beta"] for r in got.beta.collect()} == pytest.approx(dict(enumerate(want["beta"])), abs=1e-6)
    assert {(r["u"], r["t"]): r["low"] for r in got.low.collect()} == pytest.approx({(u, s): want["low"][s, u] for s in range(t) for u in range(n)}, abs=1e-5)
    tau = {(r["u"], r["t"]): r["tau"] for r in got.tau.collect()}
    assert tau == pytest.approx({(u, s): want["tau"][s, u] for s, u in np.argwhere(d == 1)}, abs=1e-5)
    got.release()


def test_blocks_with_covariates_and_guards(spark):
    y, d = factor_panel(12, 12)
    r = np.random.default_rng(0)
    x = r.normal(size=y.shape)
    y = y + 2 * x
    rows = [(int(i), int(s), float(y[s, i]), int(d[s, i]), float(x[s, i])) for s in range(12) for i in range(12)]
    df = spark.createDataFrame(rows, "unit int, time int, y double, d int, x1 double")
    cells = index_cells(df, PanelSpec(covariates=("x1",)))
    for lam in (1.0, math.inf):
        got, want = joint.fit(cells, 0.0, 0.1, lam, 1e-9, 5000), kernels.joint_fit(cells, 0.0, 0.1, lam, 1e-9, 5000)
        assert got.gamma == pytest.approx(list(want["gamma"]), abs=1e-6)
        assert native.att(got.tau).first()["att"] == pytest.approx(want["att"], abs=1e-6)
    with pytest.raises(InvalidPanel):
        joint.fit(cells, 0.0, 0.0, 0.0)


def test_beyond_dense_panels(spark, monkeypatch):
    """Where no dense panel may be held, the joint method still estimates, predicts and runs its placebo."""
    y, d = factor_panel(16, 12)
    monkeypatch.setattr(kernels, "MOST_CELLS", 10)
    fit = estimate(frame(spark, y, d), options=FitOptions(method="joint", lambdas=(0.1, 0.1, 1.0), n_boot=0))
    assert fit.predict("y0").count() == y.size and fit.diagnose("placebo").count() == 5
    two = estimate(frame(spark, y, d), options=FitOptions(lambdas=(0.1, 0.0, 0.0), n_boot=0))
    rest = two.predictions().where("d = 0 AND y IS NOT NULL")
    assert rest.agg(F.max(F.abs("residuals"))).first()[0] < 1e-9  # the low-rank part takes up what is left
    fit.release()


@pytest.mark.parametrize("lam", [0.0, 0.3, 2.0, 20.0, 1e10])
def test_held_out_cells_equal_refits(lam):
    y, d = factor_panel()
    held = kernels.HeldOut(y, d, None, 0.1, 0.2, lam, 1e-9, 5000)
    for t, u in np.argwhere(d == 0)[::17]:
        w = kernels.joint_weights(y, d, 0.1, 0.2)
        w[t, u] = 0.0
        want = y[t, u] - kernels.fit_joint(y, d, w, lam, tol=1e-9, maxiter=5000)["fitted"][t, u]
        assert held.residual(u, t) == pytest.approx(want, abs=1e-6)
    assert (held.fits > 0) == (lam in (0.3, 2.0))  # the others have closed forms


def test_bounded_search_finds_the_same(spark):
    y, d = factor_panel()
    cells = index_cells(frame(spark, y, d)).cache()
    grids = ([0.0, 0.3, 2.0], [0.0, 1.0], [0.5, 5.0, math.inf])
    for method in ("joint", "twostep"):
        full, scores = search(cells, FitOptions(method=method, cv="exhaustive"), grids, True)
        best, seen = search(cells, FitOptions(method=method, cv="exhaustive", prune=True), grids, True)
        key = lambda r: (r["lam_time"], r["lam_unit"], r["lam_norm"])
        assert key(best) == key(full) and best["q"] == pytest.approx(full["q"], rel=1e-6)
        exact = {key(r): r["q"] for r in scores}
        assert any("at_least" in r for r in seen)
        for r in seen:
            if "at_least" in r:
                assert math.isinf(r["q"]) and full["q"] < r["at_least"] <= exact[key(r)] * (1 + 1e-6)
            else:
                assert r["q"] == pytest.approx(exact[key(r)], rel=1e-6)


def test_bounded_counts_fewer_fits():
    r = np.random.default_rng(0)
    squares = r.exponential(size=(6, 64)) * np.array([1, 1.2, 2, 5, 9, 30])[:, None]

    def wave(ids, lo, hi):
        return {g: (squares[g, lo:hi].sum(), hi - lo, hi - lo) for g in ids}

    exact, below, fits = cv.bounded(list(range(6)), wave)
    assert min(exact, key=exact.get) == squares.sum(axis=1).argmin() and set(exact) | set(below) == set(range(6))
    assert fits < 0.8 * 6 * 64 and all(exact[g] == pytest.approx(squares[g].sum()) for g in exact)
    failing = cv.bounded([0, 1], lambda ids, lo, hi: {g: (1.0, hi - lo - (g == 0), hi - lo) for g in ids})
    assert failing[0][0] == math.inf and math.isfinite(failing[0][1])


def test_cycling_asks_again_what_it_gave_up():
    """A row given up against one bound competes anew where the bound is weaker."""
    q = lambda a, b, c: (a - 1) ** 2 + (b - 2) ** 2 + (c != 1)

    def score(rows, bound):
        least = min([bound, *(q(*r) for r in rows)])
        return [(q(*r), None) if q(*r) <= least else (math.inf, least) for r in rows]

    best, seen = cv.cycle(score, ([0, 1], [0, 2], [0, 1, math.inf]), bounding=True)
    assert (best["lam_time"], best["lam_unit"], best["lam_norm"]) == (1, 2, 1) and best["q"] == 0


def test_tiles(spark, monkeypatch):
    y, d = factor_panel(23, 9, 4, 6)
    y[np.random.default_rng(1).random(y.shape) < 0.2] = np.nan
    cells = index_cells(frame(spark, y, d))
    v = np.where(d == 0, y, np.nan)
    monkeypatch.setattr(distance, "TILE_UNITS", 5)
    got = {(r["i"], r["j"]): (r["sum_sq"], r["n"]) for r in distance.pair_stats(cells).collect()}
    for i in range(23):
        for j in range(23):
            both = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
            if i == j or not both.any():
                assert (i, j) not in got
            else:
                assert got[i, j] == (pytest.approx(((v[both, i] - v[both, j]) ** 2).sum(), rel=1e-12), both.sum())
    shared = [max(got.get((i, j), (0, 0))[1] for j in range(23)) for i in range(4)]
    assert validate.min_valid_pairs(cells).first()[0] == min(shared)
    grid = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.1, 0.7), (2, 0.4, 0.7), (3, 0.4, 0.2)], "g_id int, lam_time double, lam_unit double")
    few = {r["g_id"]: r["q"] for r in cv.scores_zero(cells, grid).collect()}
    for g, lt, lu in ((0, 0.1, 0.0), (1, 0.1, 0.7), (2, 0.4, 0.7), (3, 0.4, 0.2)):
        q = 0.0
        for t, u in np.argwhere(~np.isnan(v)):
            f = kernels.fit_cell(y, kernels.cell_weights(y, d, u, t, lt, lu), 0.0)
            q += (y[t, u] - f["alpha"][u] - f["beta"][t]) ** 2
        assert few[g] == pytest.approx(q, rel=1e-9)
    held = distance.keep_pairs(cells)
    assert distance.pair_stats(held) is distance.pair_stats(held)
    distance.drop_pairs(held)
    assert distance.pair_stats(spark.createDataFrame([], "u int, t int, y double, d int")).count() == 0


def test_sums_and_subspace(spark):
    rows = spark.range(0, 5000, numPartitions=100).selectExpr("spark_partition_id() AS part", "array(double(id), 1.0D) AS v")
    assert tree_sum(rows).tolist() == [4999 * 2500.0, 5000.0]
    assert tree_sum(rows.where("v[1] > 1")) is None
    r = np.random.default_rng(0)
    a = r.normal(size=(60, 60))
    a = a @ a.T
    u, s, share, _ = subspace(lambda q: a @ q, 60, 3, block=6)
    assert s == pytest.approx(np.linalg.eigvalsh(a)[::-1][:3]) and np.abs(a @ u - u * s).max() < 1e-8


def test_workers_use_one_thread(spark):
    def look(frames):
        threads.one_thread()
        for _ in frames:
            np.ones((300, 300)) @ np.ones((300, 300))
            yield pd.DataFrame({"n": threads.threads() or [1]})

    assert {r["n"] for r in spark.range(4).mapInPandas(look, "n int").collect()} == {1}


def test_ordered_scans(spark):
    r = np.random.default_rng(2)
    v = np.unique(np.round(r.normal(size=3000), 3))
    k = r.integers(1, 9, size=len(v))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, k, strict=True)], "v double, k long").repartition(5)
    for slices in (1, 7, 200):
        got = ordered.running(df, "v", {"s": (F.sum, "k", False), "m": (F.max, "k", False), "n": (F.min, "k", True), "z": (F.sum, "k", True)}, slices).toPandas().sort_values("v")
        assert (got.s == np.cumsum(k)).all() and (got.m == np.maximum.accumulate(k)).all()
        assert (got.n == np.minimum.accumulate(k[::-1])[::-1]).all() and (got.z == np.cumsum(k[::-1])[::-1]).all()
    assert ordered.running(df.where("false"), "v", {"s": (F.sum, "k", False)}).count() == 0
    p = [0.01, 0.01, 0.02, 0.02, 0.02, 0.5, 0.03]
    tests = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r["i"]: (r["holm"], r["bh"]) for r in diagnose.multiple(tests, ["i"]).collect()}
    order = np.argsort(p, kind="stable")
    holm = np.maximum.accumulate([min(p[j] * (7 - n), 1) for n, j in enumerate(order)])
    bh = np.minimum.accumulate([min(p[j] * 7 / (n + 1), 1) for n, j in reversed(list(enumerate(order)))])[::-1]
    for n, j in enumerate(order):
        assert got[j] == (pytest.approx(holm[n]), pytest.approx(bh[n]))
    w = spark.createDataFrame([(i, x) for i, x in enumerate([0.3, 0.1, 0.1, 0.1, 0.1, 0.0, 0.0])], "j int, w double")
    assert weights.stats(w, "j", "w").first()["concentration"] == pytest.approx(2 / 7)


def test_factors_and_bias_bound_stay_distributed(spark):
    y, d = factor_panel(13, 11)
    cells = index_cells(frame(spark, y, d)).cache()
    for flip in (False, True):
        low = np.random.default_rng(5).normal(size=(11, 3)) @ np.random.default_rng(6).normal(size=(3, 13))
        if flip:
            low = low[:9]
        rows = spark.createDataFrame([(int(u), int(t), float(low[t, u])) for t in range(low.shape[0]) for u in range(13)], "u int, t int, low double")
        got, want = diagnose.factors_of(rows), diagnose.factors(low)
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-5), k
    full = np.random.default_rng(5).normal(size=(11, 4)) @ np.random.default_rng(6).normal(size=(4, 13))
    rows = spark.createDataFrame([(int(u), int(t), float(full[t, u])) for t in range(11) for u in range(13)], "u int, t int, low double")
    targets = []
    for t, u in np.argwhere(d == 1):
        omega = {r["j"]: r["omega"] for r in weights.omega(cells.where(f"u = {u} AND t = {t}"), cells, 0.4).collect()}
        targets.append((u, t, np.array([omega[j] for j in range(13)]), np.exp(-0.2 * np.abs(np.arange(11) - t))))
    for k in (None, 2):
        got, want = diagnose.triple(cells, rows, 0.2, 0.4, k).first(), diagnose.triple_bias(full, targets, k)
        for name in want:
            assert got[name] == pytest.approx(want[name], rel=1e-5, abs=1e-5), name


def test_failures_warn_and_abort(spark):
    tried = Tried()
    row = lambda ok, n, first: {"q": 1.0, "n_valid": ok, "n_attempted": n, "first_failed": first}
    tried.add((0, 0, 1), row(97, 100, (3, 1)))
    tried.judge()
    tried.add((0, 0, 1), row(80, 100, (2, 9)))
    with pytest.warns(PanelWarning, match=r"\(2, 9\)"):
        tried.judge()
    assert tried.of({"lam_time": 0, "lam_unit": 0, "lam_norm": 1})["first_failed"] == (2, 9)
    tried.add((0, 1, 1), row(0, 300, (5, 5)))
    with pytest.raises(SearchFailed):
        tried.judge()


def test_diagnoses_of_a_search(spark):
    y, d = factor_panel(10, 10, 2, 8)
    fit = estimate(frame(spark, y, d), options=FitOptions(method="joint", n_boot=8, cv="cycling"), grid=([0.0, 0.5], [0.0, 0.5], [1.0, math.inf]))
    found = fit.diagnose("loocv")
    assert found["valid_share"] == 1.0 and found["first_failed"] is None and found["q_min"] == min(r["q"] for r in fit.scores) and found["stage1"]["lam_time"] in (0.0, 0.5)
    assert found["exhaustive_is_cheap"] and found["n_given_up"] == sum("at_least" in r for r in fit.scores)
    assert fit.diagnose("triplerob").first()["rank"] >= 1 and fit.diagnose("vce").first()["se"] > 0
    assert 0 <= fit.diagnose("pretrend").first()["p"] <= 1 and fit.diagnose("sensitivity").count() == 1
    assert fit.diagnose("factors")["nuclear"] >= 0 and "joint" in fit.diagnose("table")
    assert predict.signature(fit.cells.repartition(7)) == fit.signature
    other = replace(fit, cells=fit.cells.withColumn("y", F.when(F.col("u") == 3, F.col("y") + 1e-9).otherwise(F.col("y"))))
    with pytest.raises(InvalidPanel):
        other.predict()


def test_published_penalties(spark):
    found = spark.createDataFrame([("PWT", 0.4, 0.3, 0.05), ("Germany", 0.2, 1.26, 0.011), ("Basque", 0.5, None, 0.006), ("mine", 1.0, 1.0, 1.0)], "data string, lam_time double, lam_unit double, lam_norm double")
    got = {(r["data"], r["penalty"]): r["agrees"] for r in cv.against_published(found).collect()}
    assert len(got) == 9 and got["PWT", "lam_norm"] and not got["Germany", "lam_unit"] and got["Germany", "lam_norm"] and not got["Basque", "lam_time"] and not got["Basque", "lam_unit"]
