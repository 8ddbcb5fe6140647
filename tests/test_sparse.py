"""Fits over the cells that matter, against dense ones; the Gram path against a singular value decomposition."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.operators import factored, kernels, sparse
from panelfx.operators.index import treated_cells
from panelfx.plans.strategy import estimate
from panelfx.spec import FitOptions, InvalidPanel

from test_estimators import frame
from test_joint_and_search import factor_panel


def dense_taus(y, d, lam, x=None):
    out = {}
    for t, u in np.argwhere((d == 1) & np.isfinite(y)):
        fit = kernels.fit_cell(y, kernels.cell_weights(y, d, u, t, lam[0], lam[1]), lam[2], x, 1e-8, 3000)
        own = 0.0 if x is None else np.nan_to_num(x[t, u]) @ fit["gamma"]
        out[u, t] = y[t, u] - fit["alpha"][u] - fit["beta"][t] - fit["low"][t, u] - own
    return out


@pytest.mark.parametrize("lam", [(1.5, 0.4, 0.5), (0.0, 0.0, 2.0), (3.0, 0.0, 1e10), (0.8, 6.0, 0.05)])
def test_equal_to_dense_fits(spark, lam):
    y, d = factor_panel(18, 40, start=33)
    y[3, 5] = y[36, 2] = y[35, 9] = np.nan
    cells = frame(spark, y, d).selectExpr("unit AS u", "time AS t", "y", "d")
    got = sparse.fits(cells, treated_cells(cells), lam, 1e-8, 3000).collect()
    want = dense_taus(y, d, lam)
    assert {(r["u"], r["t"]) for r in got} == set(want)
    for r in got:
        assert r["converged"] == 1 and r["tau"] == pytest.approx(want[r["u"], r["t"]], abs=2e-5)
        assert r["left_out"] >= 0 and 0 <= r["excess"] < (1 if lam[1] > 5 else 0.02)  # where all others weigh little, so does the objective
    controls = int((np.isfinite(y) & (d == 0)).sum())
    if lam[0] >= 1.5:
        assert max(r["n_cells"] for r in got) < 0.9 * controls  # there is something to leave out
    else:
        assert max(r["n_cells"] for r in got) <= controls


def test_bound_holds(spark):
    """The fit, carried on to all cells, is within ``excess`` of the dense objective's minimum."""
    lam = (2.0, 0.5, 0.3)
    y, d = factor_panel(14, 30, start=25)
    cells = frame(spark, y, d).selectExpr("unit AS u", "time AS t", "y", "d")
    rows = sparse.fits(cells, treated_cells(cells), lam, 1e-9, 5000, drop_below=1e-3).collect()
    assert any(r["left_out"] > 0 for r in rows)
    for r in rows:
        w = kernels.cell_weights(y, d, r["u"], r["t"], lam[0], lam[1])
        fit = kernels.fit_cell(y, w, lam[2], None, 1e-9, 5000)
        least = factored.solve(factored.Panel(np.nan_to_num(y), w), lam[2], 1e-9, 5000).objective
        stays = w.max(axis=0) >= 1e-3 * np.delete(w, r["u"], axis=1).max()
        stays[r["u"]] = True
        theta = np.exp(-lam[0] * np.abs(np.arange(len(y)) - r["t"]))[:, None] * (w > 0)
        kept = w * (theta >= 1e-3 * np.minimum(theta.max(axis=0), theta[:, r["u"]].max())) * stays
        part = factored.solve(factored.Panel(np.nan_to_num(y), kept), lam[2], 1e-9, 5000).objective
        assert part <= least * (1 + 1e-6) and least - part <= r["excess"] / (1 - r["excess"]) * part * (1 + 1e-6) + 1e-9
        own = w[:, r["u"]].sum()
        assert min(own, w.sum() - own) * r["left_out"] == pytest.approx((w - kept).sum(), rel=1e-6, abs=1e-12)
        assert fit["converged"] == 1


def test_covariates_guards_and_odd_targets(spark, monkeypatch):
    y, d = factor_panel(12, 20, start=16)
    x = np.random.default_rng(4).normal(size=(*y.shape, 2))
    y = y + x @ np.array([0.7, -1.2])
    y[17, 0] = np.nan
    plain = frame(spark, y, d).selectExpr("unit AS u", "time AS t", "y", "d")
    xs = spark.createDataFrame([(int(u), int(t), [float(v) for v in x[t, u]]) for t, u in np.ndindex(*y.shape)], "u int, t int, x array<double>")
    cells = plain.join(xs, ["u", "t"])
    lam = (0.6, 0.2, 0.4)
    got = {(r["u"], r["t"]): r for r in sparse.fits(cells, treated_cells(cells), lam, 1e-8, 3000).collect()}
    for k, v in dense_taus(y, d, lam, x).items():
        assert got[k]["tau"] == pytest.approx(v, abs=2e-4) and got[k]["excess"] is None
    # a cell without outcome, and a panel without control cells: rows without an effect
    odd = sparse.fits(plain, spark.createDataFrame([(0, 17), (0, 18)], "u int, t int"), lam).orderBy("t").collect()
    assert odd[0]["tau"] is None and odd[0]["converged"] == -1 and odd[1]["tau"] is not None
    none = sparse.fits(plain.withColumn("d", F.lit(1)), spark.createDataFrame([(0, 18)], "u int, t int"), lam).collect()
    assert [(r["tau"], r["converged"], r["n_cells"]) for r in none] == [(None, -1, 0)]
    assert sparse.fits(plain, treated_cells(plain).limit(0), lam).count() == 0
    monkeypatch.setattr(kernels, "MOST_CELLS", 10)
    with pytest.raises(InvalidPanel):
        sparse.fits(plain, treated_cells(plain), lam)


def test_long_panels_are_estimated(spark, monkeypatch):
    """A panel beyond dense fits is estimated where each target's own cells are few enough."""
    y, d = factor_panel(16, 60, start=55)
    options = FitOptions(lambdas=(2.5, 0.1, 0.5), n_boot=0)
    want = estimate(frame(spark, y, d), options=options)
    monkeypatch.setattr(kernels, "MOST_CELLS", 700)  # 960 cells in all, at most 16 x 16 or so for a target
    got = estimate(frame(spark, y, d), options=options)
    assert got.att == pytest.approx(want.att, abs=1e-4) and got.failures["cells"] == 0
    for fit in (want, got):
        fit.release()


@pytest.mark.parametrize("shape", [(27, 25), (25, 27), (6, 300), (300, 6), (1, 5), (5, 5)])
def test_gram_path_equals_decomposition(shape):
    rng = np.random.default_rng(1)
    m = rng.normal(size=shape) * 3
    for level in (0.5, 2.0, 8.0, 1e-9):
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        want = (u * np.maximum(s - level, 0)) @ vt
        assert np.abs(kernels.shrink(m, level) - want).max() < 1e-10 * max(1, s[0])
        left, values = factored.spectrum(m, level)
        assert values[values >= level][: len(s)] == pytest.approx(s[s >= level], rel=1e-9)
        k = int((s >= level).sum())
        assert np.abs(left[:, :k].T @ left[:, :k] - np.eye(k)).max(initial=0) < 1e-8


def test_gram_path_is_left_where_it_loses_digits(monkeypatch):
    """Values far below the greatest are lost in the Gram matrix: there the decomposition itself is used."""
    rng = np.random.default_rng(2)
    u, v = (np.linalg.qr(rng.normal(size=(20, 3)))[0] for _ in range(2))
    m = (u * [1e6, 1.0, 1e-3]) @ v.T
    used = []
    real = np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **k: used.append(1) or real(*a, **k))
    assert factored.spectrum(m, 1e-4)[1][:3] == pytest.approx([1e6, 1.0, 1e-3], rel=1e-5) and used == [1]
    factored.spectrum(m, 5e5)
    assert used == [1]


def test_gram_path_is_faster():
    m = np.random.default_rng(3).normal(size=(27, 25))
    took = []
    for f in (lambda: factored.spectrum(m, 2.0), lambda: np.linalg.svd(m, full_matrices=False)):
        best = np.inf
        for _ in range(7):
            began = time.perf_counter()
            for _ in range(100):
                f()
            best = min(best, time.perf_counter() - began)
        took.append(best)
    print("gram, svd", took)
    assert took[0] < took[1]
