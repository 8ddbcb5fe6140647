"""Diagnostics of a fit: event studies, tests, bootstrap moments, factors, tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, normal_cdf, normal_cdf_column, normal_quantile
from ..functions.ordered import running
from ..functions.stored import fixed
from ..functions.vectors import matrix, tree_sum
from ..shipping import ship
from .index import treated_cells, units
from .weights import omega, theta


def summarize(cells: DataFrame) -> DataFrame:
    """Size, shares of treated cells and moments of the outcome (quartiles as in the outlier check)."""
    from .validate import outliers

    a = cells.agg(
        F.count("y").alias("n_obs"), F.countDistinct("u").alias("n_units"), F.countDistinct("t").alias("n_periods"), F.sum("d").alias("n_treated"), F.avg(F.col("d").cast("double")).alias("treated_share"),
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.min("y").alias("min"), F.max("y").alias("max"),
    )
    q = outliers(cells).select(F.col("q1").alias("p25"), F.col("q3").alias("p75"))
    return a.crossJoin(q)


def event_study(cells: DataFrame, tau: DataFrame, level: float = 95.0, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(h, n, att, se, low, high)``: effects by periods since the unit's adoption; intervals need two cells.

    Every horizon between the least and the greatest has a row; one without cells has n 0.
    """
    at = tau.join(units(cells).where("treated").select("u", "first_t"), "u").withColumn("h", F.col("t") - F.col("first_t"))
    g = at.groupBy("h").agg(F.count("tau").alias("n"), F.avg("tau").alias("att"), F.stddev_samp("tau").alias("sd"))
    span = g.agg(F.explode(F.sequence(F.min("h"), F.max("h"))).alias("h"))
    g = span.join(g, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if low is not None:
        g = g.where(F.col("h") >= low)
    if high is not None:
        g = g.where(F.col("h") <= high)
    z = normal_quantile((1 + level / 100) / 2)
    se = F.when(F.col("n") >= 2, F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return g.withColumn("se", se).select("h", "n", "att", "se", (F.col("att") - z * F.col("se")).alias("low"), (F.col("att") + z * F.col("se")).alias("high"))


def placebo(cells: DataFrame, alpha: DataFrame, beta: DataFrame, leads: int = 5, low: DataFrame | None = None, gamma: list[float] | None = None) -> DataFrame:
    """``(h, n, gap, se)``: residuals of treated units in the last periods before adoption."""
    t = cells.join(units(cells).where("treated").select("u", "first_t"), "u").withColumn("h", F.col("t") - F.col("first_t")).where(f"h BETWEEN {-leads} AND -1 AND y IS NOT NULL")
    t = t.join(alpha, "u").join(beta, "t")
    rest = F.col("y") - F.col("alpha") - F.col("beta")
    if low is not None:
        t = t.join(low, ["u", "t"], "left")
        rest = rest - F.coalesce("low", F.lit(0.0))
    if gamma and "x" in cells.columns:
        for k, c in enumerate(gamma):
            rest = rest - F.coalesce(F.get("x", F.lit(k)), F.lit(0.0)) * c
    g = t.withColumn("r", rest).groupBy("h").agg(F.count("r").alias("n"), F.avg("r").alias("gap"), F.stddev_samp("r").alias("sd"))
    return g.select("h", "n", "gap", F.when(F.col("n") >= 2, F.col("sd") / F.sqrt(F.col("n").cast("double"))).alias("se"))


def pretrend(gaps: DataFrame) -> DataFrame:
    """Wald sum over leads with a positive standard error, and its degrees of freedom."""
    return gaps.where("se > 0").agg(F.coalesce(F.sum((F.col("gap") / F.col("se")) ** 2), F.lit(0.0)).alias("wald"), F.count("*").alias("df"))


def pretrend_p(wald: float, df: int) -> float | None:
    return chi2_sf(wald, df) if df else None


def z_tests(effects: DataFrame, value: str, se: str) -> DataFrame:
    """Two-sided normal p-values."""
    z = F.col(value) / F.col(se)
    return effects.where(F.col(se) > 0).withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf_column(F.abs(z))))


def cell_tests(tau: DataFrame, se: float | None) -> DataFrame:
    """Each treated cell's effect against the estimate's standard error; no rows without one."""
    return z_tests(tau.where("tau IS NOT NULL").select("u", "t", "tau", F.lit(se).cast("double").alias("se")), "tau", "se")


def multiple(tests: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Bonferroni, Holm (running maximum from the least p) and Benjamini-Hochberg (running minimum from the greatest).

    Equal p-values adjust alike: by the first of their ranks under Holm, by the last under Benjamini-Hochberg. So only distinct
    values are ranked, by slices of their order.
    """
    d = fixed(tests.where(F.col(p).isNotNull()))  # rows find their value again by equality
    same = d.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_m"))
    ranked = running(same, "_p", {"_last": (F.sum, "_m", False), "_above": (F.sum, "_m", True)}).withColumn("_k", F.col("_last") + F.col("_above") - F.col("_m"))
    first = F.col("_last") - F.col("_m") + 1
    ranked = ranked.withColumn("_holm", F.least(F.col("_p") * (F.col("_k") - first + 1), F.lit(1.0))).withColumn("_bh", F.least(F.col("_p") * F.col("_k") / F.col("_last"), F.lit(1.0)))
    steps = running(ranked, "_p", {"holm": (F.max, "_holm", False), "bh": (F.min, "_bh", True)})
    steps = steps.select("_p", F.least(F.col("_p") * F.col("_k"), F.lit(1.0)).alias("bonferroni"), "holm", "bh")
    return d.join(steps, F.col(p) == F.col("_p")).drop("_p")


def moments(boot: DataFrame) -> DataFrame:
    """Mean, sd, median, quartile range, percentiles, skewness and kurtosis about the sample sd, Jarque-Bera."""
    a = boot.agg(
        F.count("att").alias("n"), F.avg("att").alias("mean"), F.stddev_samp("att").alias("sd"), F.skewness("att").alias("g1"), F.kurtosis("att").alias("g2"),
        *[F.percentile("att", F.lit(p)).alias(f"p{100 * p:g}".replace(".", "_")) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)],
    )
    share = F.try_divide(F.col("n") - 1, F.col("n"))
    a = a.withColumn("skew", F.when(F.col("sd") > 0, F.col("g1") * F.pow(share, F.lit(1.5)))).withColumn("kurt", F.when(F.col("sd") > 0, (F.col("g2") + 3) * share * share))
    a = a.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("jb", F.col("n") / 6 * (F.col("skew") ** 2 + (F.col("kurt") - 3) ** 2 / 4))
    return a.drop("g1", "g2").withColumn("jb_p", F.exp(-F.col("jb") / 2))


def shapiro_wilk(x: list[float]) -> tuple[float, float] | None:
    """Royston's W and its p-value for 12 to 5000 values, None outside or without spread.

    Fixed values: the published coefficients of the polynomials for the two outer weights and the moments of log(1 - W).
    """
    n, x = len(x), np.sort(np.asarray(x, dtype=float))
    if not 12 <= n <= 5000 or x[0] == x[-1]:
        return None
    m = np.array([normal_quantile((k - 0.375) / (n + 0.25)) for k in range(1, n + 1)])
    mm, u = m @ m, 1 / np.sqrt(n)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / np.sqrt(mm)], u)
    next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / np.sqrt(mm)], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
    a = m / np.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, next_, -last, -next_
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    log_n = np.log(n)
    mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
    sd = np.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    z = (np.log(max(1 - w, 1e-300)) - mean) / sd
    return w, 1 - normal_cdf(z)


def moment_flags(m: DataFrame, att: float, se: float) -> DataFrame:
    return m.select((F.abs("skew") > 2).alias("skewed"), (F.abs(F.col("kurt") - 3) > 7).alias("heavy"), (F.col("jb_p") < 0.01).alias("not_normal"), (F.abs(F.col("mean") - att) / se > 0.3).alias("biased"))


def _lines(low: DataFrame, short: str, long_: str) -> DataFrame:
    """``(line, v)``: a complete ``low(u, t, low)`` as one vector a line of the long side; nulls count as 0."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(short).alias("k"), F.coalesce("low", F.lit(0.0)).alias("v"))))
    return low.groupBy(F.col(long_).alias("line")).agg(F.transform(entries, lambda e: e["v"]).alias("v"))


def singular(low: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame, str]:
    """Singular values of a complete ``low(u, t, low)``, vectors of its shorter side, and the lines of its longer side with its name.

    The products of the shorter side's lines are added in a tree; no more than their square comes here.
    """
    ship(low.sparkSession)
    size = low.agg(F.max("u").alias("u"), F.max("t").alias("t")).first()
    if size["u"] is None:
        return np.zeros(0), np.zeros((0, 0)), _lines(low, "t", "u"), "u"
    short, long_, n = ("t", "u", size["t"] + 1) if size["t"] <= size["u"] else ("u", "t", size["u"] + 1)
    lines = _lines(low, short, long_)

    def add(batches):
        total = np.zeros((n, n))
        for b in batches:
            m = matrix(b.column(0), n)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([total.ravel()], type=pa.list_(pa.float64()))], names=["part", "v"])

    s, v = np.linalg.eigh(tree_sum(lines.select("v").mapInArrow(add, "part int, v array<double>")).reshape(n, n))
    s = np.sqrt(np.maximum(s[::-1], 0))
    return np.where(s > 1e-8 * s[0], s, 0.0), v[:, ::-1], lines, long_


def factors_of(low: DataFrame, k: int = 5) -> dict:
    """``factors`` of a low-rank part of any size, kept where it is."""
    s = singular(low)[0]
    r = low.agg(F.max(F.abs("low")).alias("hi"), F.min(F.abs("low")).alias("lo")).first()
    return factors(np.diag(s), k) | {"max_abs": float(r["hi"] or 0.0), "min_abs": float(r["lo"] or 0.0)}


def factors(low: np.ndarray, k: int = 5) -> dict:
    """Singular values of the low-rank part: the largest, their variance shares, norms, effective rank, extremes."""
    s = np.linalg.svd(np.nan_to_num(low), compute_uv=False) if low.size else np.zeros(0)
    total = float((s**2).sum())
    return {
        "top": s[:k].tolist(), "share": (s[:k] ** 2 / total).tolist() if total else [0.0] * len(s[:k]), "frobenius": float(np.sqrt(total)), "nuclear": float(s.sum()),
        "effective_rank": float(s.sum() / s[0]) if len(s) and s[0] > 0 else 0.0, "max_abs": float(np.abs(low).max(initial=0)), "min_abs": float(np.abs(low).min()) if low.size else 0.0,
    }


def triple(cells: DataFrame, low: DataFrame, lam_time: float, lam_unit: float, k: int | None = None) -> DataFrame:
    """One row (rank, unit, time, rest, product): the factors of the bias bound of the two-step weights, over all treated cells.

    ``unit`` is the mean distance of a treated unit's loadings from its weighted neighbours', ``time`` that of its period's, ``rest`` the nuclear
    mass beyond rank ``k`` (by default the effective rank, rounded up). Loadings are singular vectors times the root of their value.
    """
    spark = cells.sparkSession
    s, v, lines, long_ = singular(low)
    rank = min(len(s), k or (max(1, int(np.ceil(s.sum() / s[0]))) if len(s) and s[0] > 0 else 1))
    root = np.sqrt(s[:rank])
    turn = v[:, :rank] / np.where(root > 0, root, np.inf)  # a line times this: its singular vector times the root

    def load(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(matrix(b.column(1), len(v)) @ turn), type=pa.list_(pa.float64()))], names=["line", "f"])

    long_side = lines.mapInArrow(load, "line int, f array<double>")
    short_side = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v[:, :rank] * root)], "line int, f array<double>")
    unit_f, time_f = (long_side, short_side) if long_ == "u" else (short_side, long_side)
    targets = treated_cells(cells).select("u", "t")
    apart = lambda: F.sqrt(sum(((F.try_divide(F.col(f"m{i}"), F.col("w")) - F.get("own", F.lit(i))) ** 2 for i in range(rank)), F.lit(0.0)))

    def imbalance(weights: DataFrame, keys: list[str], at: str, w: str, loads: DataFrame, own: str) -> DataFrame:
        j = weights.join(loads.withColumnRenamed("line", at), at)
        g = j.groupBy(*keys).agg(F.sum(w).alias("w"), *[F.sum(F.col(w) * F.get("f", F.lit(i))).alias(f"m{i}") for i in range(rank)])
        return g.join(loads.select(F.col("line").alias("_own"), F.col("f").alias("own")), F.col(own) == F.col("_own")).select(*keys, apart().alias("gap"))

    by_unit = imbalance(omega(targets, cells, lam_unit), ["u", "t"], "j", "omega", unit_f, "u").agg(F.avg("gap").alias("unit"))
    by_time = targets.join(imbalance(theta(targets, cells, lam_time), ["t"], "s", "theta", time_f, "t"), "t").agg(F.avg("gap").alias("time"))
    one = by_unit.crossJoin(by_time).withColumn("rest", F.lit(float(s[rank:].sum())))
    return one.select(F.lit(rank).alias("rank"), "unit", "time", "rest", (F.col("unit") * F.col("time") * F.col("rest")).alias("product"))


def triple_bias(low: np.ndarray, targets: list[tuple[int, int, np.ndarray, np.ndarray]], k: int | None = None) -> dict:
    """``triple`` of a dense low-rank part (periods x units), for given (unit, period, unit weights, time weights) of treated cells."""
    u, s, vt = np.linalg.svd(np.nan_to_num(low), full_matrices=False)
    rank = k or max(1, int(np.ceil(s.sum() / s[0]))) if s[0] > 0 else 1
    root = np.sqrt(s[:rank])
    unit_load, time_load = vt[:rank].T * root, u[:, :rank] * root
    by_unit, by_time = [], []
    for i, t, omega_, theta_ in targets:
        by_unit.append(np.linalg.norm(omega_ / max(omega_.sum(), 1e-300) @ unit_load - unit_load[i]))
        by_time.append(np.linalg.norm(theta_ / max(theta_.sum(), 1e-300) @ time_load - time_load[t]))
    a, b, c = float(np.mean(by_unit)), float(np.mean(by_time)), float(s[rank:].sum())
    return {"rank": rank, "unit": a, "time": b, "rest": c, "product": a * b * c}


def unconverged(fits: DataFrame) -> DataFrame:
    """Fits that stopped at the limit (0) or failed (-1)."""
    return fits.where("converged <> 1").select("u", "t", "iters", "converged")


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def table(rows: list[dict], fmt: str = "markdown", decimals: int = 4) -> str:
    """Estimates (name, att, se, low, high, p) as text, markdown, latex or csv."""
    head = ["", "ATT", "SE", "low", "high"]
    num = lambda x: "" if x is None else f"{x:.{decimals}f}"
    body = [[r["name"], num(r.get("att")) + stars(r.get("p")), num(r.get("se")), num(r.get("low")), num(r.get("high"))] for r in rows]
    if fmt == "csv":
        return "\n".join(",".join(x) for x in [["name", *head[1:]], *body])
    if fmt == "latex":
        lines = [" & ".join(x) + r" \\" for x in [head, *body]]
        return "\n".join([r"\begin{tabular}{lrrrr}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
    if fmt == "markdown":
        return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * 5, *body])
    return "\n".join("  ".join(c.rjust(12) for c in x) for x in [head, *body])
