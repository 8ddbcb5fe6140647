"""Leave-one-out search for the penalties."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import SearchFailed
from .distance import neighbour_sums
from .index import units, valid
from .weights import joint_unit, shape

INF = float("inf")
#: The preset grids of the time, unit and norm penalties.
GRIDS = {
    "default": ([0, 0.1, 0.5, 1, 2, 5], [0, 0.1, 0.5, 1, 2, 5], [0, 0.01, 0.1, 1, 10]),
    "fine": ([0, 0.1, 0.3, 0.5, 1, 2, 5], [0, 0.1, 0.3, 0.5, 1, 2, 5], [0, 0.01, 0.0316, 0.1, 0.316, 1, 10]),
    "extended": (
        [0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.75, 1, 1.5, 2, 3, 5],
        [0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.75, 1, 1.2, 1.5, 1.6, 2, 3, 5],
        [0, 0.005, 0.006, 0.01, 0.011, 0.02, 0.05, 0.1, 0.15, 0.151, 0.2, 0.3, 0.5, 0.7, 0.9, 1, 5, 10, INF],
    ),
}
ALIASES = {"standard": "default", "exhaustive": "extended"}
ABORT_SHARE, WARN_SHARE, TIE = 0.50, 0.05, 1e-10


def grid_frame(spark: SparkSession, times: list[float], units: list[float], norms: list[float] | None = None) -> DataFrame:
    """``(g_id, lam_time, lam_unit[, lam_norm])``: the Cartesian product in order, numbered from 0."""
    axes = [times, units] + ([norms] if norms is not None else [])
    names = ["lam_time", "lam_unit", "lam_norm"][: len(axes)]
    rows = [(g, *map(float, c)) for g, c in enumerate(product(*axes))]
    return spark.createDataFrame(rows, "g_id int, " + ", ".join(f"{n} double" for n in names))


def scores_zero(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Leave-one-out score at norm penalty 0 of every grid row: ``(g_id, lam_time, lam_unit, q, n_valid, n_attempted)``.

    Every control cell is left out of its own fit; all cells and grid rows are one plan. Fits start
    afresh, so the result doesn't depend on an order. Distances are shared by all rows of the grid, whose combinations are read here.
    """
    c = valid(cells)
    times = grid.select("lam_time").distinct()
    other = c.select(F.col("u").alias("j"), F.col("t").alias("s"), F.col("y").alias("y_s"))
    periods = c.select("t").distinct()
    th = F.exp(-F.col("lam_time") * F.abs(F.col("t") - F.col("s")))
    sums = other.crossJoin(periods.crossJoin(times)).groupBy("lam_time", "t", "j").agg(F.sum(th).alias("sw"), F.sum(th * F.col("y_s")).alias("swy"))
    at = c.select(F.col("u").alias("j"), "t", "y").join(sums, ["j", "t"])
    # what is left of each cell by its unit's mean, with the cell (as a neighbour) and without it (as the target)
    at = at.select("lam_time", "t", "j", "y", (F.col("y") - F.col("swy") / F.col("sw")).alias("r"), F.when(F.col("sw") - 1 > 1e-12, (F.col("swy") - F.col("y")) / (F.col("sw") - 1)).otherwise(0.0).alias("alpha"))
    keep = ["g_id", "lam_time", "lam_unit", "u", "t", "y", "alpha", "sw", "swr"]
    g = grid.withColumnRenamed("lam_time", "g_time")
    # rows that weight all units alike: a period's sums less the cell's own
    per = at.groupBy("lam_time", "t").agg(F.count("*").cast("double").alias("n"), F.sum("r").alias("sr"))
    alike = at.withColumnRenamed("j", "u").join(per, ["lam_time", "t"]).withColumn("sw", F.col("n") - 1).withColumn("swr", F.col("sr") - F.col("r"))
    alike = alike.join(F.broadcast(g.where("lam_unit = 0")), F.col("lam_time") == F.col("g_time")).select(*keep)
    # the others by tiles of units: no join has a period alone as its key
    rows = grid.where("lam_unit <> 0").select("lam_time", "lam_unit").distinct().collect()  # no more than the grid
    cell = alike
    if rows:
        order = sorted({r["lam_time"] for r in rows})
        wide = at.withColumnRenamed("j", "u").groupBy("u", "t").agg(F.first("y").alias("y"), *[F.max(F.when(F.col("lam_time") == lt, F.col("r"))).alias(f"r{k}") for k, lt in enumerate(order)])
        size = cells.agg((F.max("u") + 1).alias("n"), (F.max("t") + 1).alias("t")).first()
        sums = neighbour_sums(wide, size["n"] or 0, size["t"] or 0, order, [(r["lam_time"], r["lam_unit"]) for r in rows])
        weighted = at.withColumnRenamed("j", "u").select("lam_time", "u", "t", "y", "alpha").join(F.broadcast(g.where("lam_unit <> 0")), F.col("lam_time") == F.col("g_time"))
        cell = weighted.join(sums, ["lam_time", "lam_unit", "u", "t"], "left").select(*keep).unionByName(alike)
    tau = F.col("y") - F.col("alpha") - F.when(F.col("sw") > 0, F.col("swr") / F.col("sw")).otherwise(0.0)
    return _score(cell.withColumn("tau", tau))


def _score(cell: DataFrame) -> DataFrame:
    return cell.groupBy("g_id", "lam_time", "lam_unit").agg(F.sum(F.col("tau") ** 2).alias("q"), F.count("tau").alias("n_valid"), F.count("*").alias("n_attempted"))


def scores_joint(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Leave-one-out score of the joint estimator without a low-rank part, for every row of ``grid(g_id, lam_time, lam_unit)``.

    For a complete panel with simultaneous adoption. Its weights are a product a_t b_i on three blocks of
    cells (controls before and after, treated before), so unit and period effects have closed forms; a cell that is
    left out is missed by e / (1 - h) with e its residual and h its leverage, which is its
    weight times the effective resistance between its unit and its period. No fit is repeated.
    """
    rmse = joint_unit(cells, 0.0).select(F.col("j").alias("u"), "rmse")
    c = cells.join(units(cells).select("u", "treated"), "u").join(rmse, "u").crossJoin(F.broadcast(shape(cells))).crossJoin(F.broadcast(grid))
    c = c.withColumn("pre", F.col("t") < F.col("n_t") - F.col("t_post")).where("NOT treated OR pre")
    c = c.withColumn("a", F.exp(-F.col("lam_time") * F.abs(F.col("t") - (F.col("n_t") - F.col("t_post") / 2)))).withColumn("b", F.when(F.col("rmse").isNull(), 0.0).otherwise(F.exp(-F.col("lam_unit") * F.col("rmse"))))
    g = ["g_id", "lam_time", "lam_unit"]
    c = c.select(*g, "u", "t", "y", "treated", "pre", "a", "b")
    by_unit = c.groupBy("g_id", "u").agg((F.sum(F.col("a") * F.col("y")) / F.sum("a")).alias("m"), F.first("treated").alias("tr"), F.first("b").alias("bu"))
    by_time = c.groupBy("g_id", "t").agg((F.sum(F.col("b") * F.col("y")) / F.sum("b")).alias("n"), F.first("pre").alias("pr"), F.first("a").alias("at"))
    w = F.col("a") * F.col("b")
    mean = lambda k: F.sum(F.when(k, w * F.col("y"))) / F.sum(F.when(k, w))
    control, pre = ~F.col("treated"), F.col("pre")
    means = c.groupBy("g_id").agg(mean(control).alias("mc"), mean(control & pre).alias("mc0"), mean(~control).alias("mt0"))
    sums = by_unit.groupBy("g_id").agg(F.sum("bu").alias("bb"), F.sum(F.when(F.col("tr"), F.col("bu"))).alias("bt")).join(by_time.groupBy("g_id").agg(F.sum("at").alias("aa"), F.sum(F.when(F.col("pr"), F.col("at"))).alias("a0")), "g_id")
    c = c.join(by_unit.select("g_id", "u", "m"), ["g_id", "u"]).join(by_time.select("g_id", "t", "n"), ["g_id", "t"]).join(F.broadcast(means.join(sums, "g_id")), "g_id")
    x = {k: F.col(k) for k in ("a", "b", "aa", "a0", "bb", "bt", "m", "n", "mc", "mc0", "mt0", "y")}
    bc = x["bb"] - x["bt"]
    shift = x["bt"] / x["bb"] * (x["mt0"] - x["mc0"])
    e = F.when(control & ~pre, x["y"] - (x["m"] - x["mc"]) - x["n"]).when(control, x["y"] - (x["m"] - x["mc"]) - x["n"] + shift).otherwise(x["y"] - (x["m"] - x["mc0"]) - x["n"] + shift)
    r = (
        F.when(control & ~pre, 1 / (x["b"] * x["aa"]) + 1 / (x["a"] * bc) - 1 / (x["aa"] * bc))
        .when(control, 1 / (x["b"] * x["aa"]) - 1 / (x["aa"] * bc) + 1 / (x["a"] * x["bb"]) + x["bt"] / (x["bb"] * x["a0"] * bc))
        .otherwise(1 / (x["b"] * x["a0"]) - 1 / (x["a0"] * x["bb"]) + 1 / (x["a"] * x["bb"]))
    )
    left = 1 - w * r
    return _score(c.withColumn("tau", F.when(left > 1e-10, e / left)))


def select(scores: list[dict]) -> dict:
    """The best row: least q; within TIE the larger norm penalty, then the smaller time and unit penalties.

    Rows are folded in grid order, since closeness is not transitive; scores that aren't finite never win.
    """
    best = None
    for row in sorted(scores, key=lambda r: r["g_id"]):
        q = row["q"]
        if q is None or q != q or q == INF:
            continue
        if best is None or q < best["q"] - TIE:
            best = row
        elif abs(q - best["q"]) <= TIE:
            rank = lambda r: (-r.get("lam_norm", 0.0), r["lam_time"], r["lam_unit"])
            if rank(row) < rank(best):
                best = row
    if best is None:
        raise SearchFailed("no grid row has a finite score")
    return best


def best_row(scores: DataFrame) -> DataFrame:
    """The least score as a plan (ties by the same order, exact): for grids without near ties."""
    norm = F.col("lam_norm") if "lam_norm" in scores.columns else F.lit(0.0)
    order = Window.orderBy(F.round("q", 9), -norm, "lam_time", "lam_unit", "g_id")
    return scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def summary(scores: DataFrame) -> DataFrame:
    """Root mean squares, failure shares and tiers of every row."""
    fail = 1 - F.try_divide(F.col("n_valid"), F.col("n_attempted"))
    return scores.withColumn("rmse", F.sqrt(F.try_divide(F.col("q"), F.col("n_valid")))).withColumn("fail_rate", fail).withColumn("tier", F.when(fail > ABORT_SHARE, "abort").when(fail > WARN_SHARE, "warn").otherwise("ok"))


def sensitivity(scores: DataFrame) -> DataFrame:
    """Spread of the scores over the grid and whether the best row lies on its edge."""
    a = scores.agg(F.count("q").alias("n"), F.min("q").alias("q_min"), F.max("q").alias("q_max"), F.avg("q").alias("q_mean"), F.try_divide(F.stddev_samp("q"), F.avg("q")).alias("cv"), F.min("lam_time").alias("t_lo"), F.max("lam_time").alias("t_hi"), F.min("lam_unit").alias("u_lo"), F.max("lam_unit").alias("u_hi"))
    b = best_row(scores).select(F.col("lam_time").alias("bt"), F.col("lam_unit").alias("bu"))
    edge = (F.abs(F.col("bt") - F.col("t_lo")) < 1e-10) | (F.abs(F.col("bt") - F.col("t_hi")) < 1e-10) | (F.abs(F.col("bu") - F.col("u_lo")) < 1e-10) | (F.abs(F.col("bu") - F.col("u_hi")) < 1e-10)
    label = F.when(F.col("cv") < 0.1, "low").when(F.col("cv") < 0.3, "moderate").otherwise("high")
    return a.crossJoin(b).select("n", "q_min", "q_max", "q_mean", "cv", (F.try_divide(F.col("q_max") - F.col("q_min"), F.col("q_min")) * 100).alias("range_pct"), label.alias("label"), edge.alias("on_edge"))


def top(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.orderBy("q", "g_id").limit(k)


#: Shares of the control cells (of 64) that a bounded search looks at in turn.
WAVES = (1, 3, 4, 8, 16, 32)


def bounded(ids: list[int], wave, bound: float = INF) -> tuple[dict[int, float], dict[int, float], int]:
    """Exact scores of the combinations that may be best, lower bounds of those that can't, and how many fits that took.

    ``wave(ids, first, last)`` gives (sum of squares, fits that succeeded, fits tried) for the control cells in those buckets. Once
    some are in, the combination that promises the least is scored in full, and its score bounds the others: sums only grow, so a
    combination goes as soon as its sum passes the bound. A combination with a failed fit has no finite score.
    """
    alive, exact, below, fits = {g: 0.0 for g in ids}, {}, {}, 0

    def look(some: list[int], lo: int, hi: int) -> None:
        nonlocal fits
        if not some or lo >= hi:
            return
        for g, (q, ok, tried) in wave(some, lo, hi).items():
            fits += tried
            if ok < tried or q is None and tried:
                alive.pop(g)
                exact[g] = INF
            else:
                alive[g] += q or 0.0

    at = 0
    for k, size in enumerate(WAVES):
        look(sorted(alive), at, at + size)
        at += size
        first = min(alive, key=lambda g: (alive[g], g), default=None)
        if k and first is not None and alive[first] * sum(WAVES) / at < bound:
            look([first], at, sum(WAVES))
            if first in alive:
                exact[first] = alive.pop(first)
                bound = min(bound, exact[first])
        for g in [g for g, q in alive.items() if q > bound + TIE]:
            below[g] = alive.pop(g)
    return exact | alive, below, fits


def _scored(row: tuple, q: float, low: float | None) -> dict:
    """A score, or (infinite) one that is known to exceed the best by the part of it that was summed."""
    r = {"lam_time": row[0], "lam_unit": row[1], "lam_norm": row[2], "q": q}
    return r if low is None else r | {"at_least": low}


def _pairs_of(score, bounding: bool):
    return score if bounding else lambda rows, _: [(q, None) for q in score(rows)]


def exhaust(score, grids: tuple[list[float], list[float], list[float]], bounding: bool = False) -> tuple[dict, list[dict]]:
    """Every combination, in one call of ``score(rows)``, or of ``score(rows, bound)`` if ``bounding``: that gives pairs of a score and, where it gave up, a lower bound."""
    rows = [tuple(map(float, c)) for c in product(*grids)]
    found = [_scored(r, *q) for r, q in zip(rows, _pairs_of(score, bounding)(rows, INF), strict=True)]
    return {k: v for k, v in select([f | {"g_id": g} for g, f in enumerate(found)]).items() if k != "at_least"}, found


#: Published penalties (time, unit, norm) and root mean squared errors of leave-one-out fits, by data set.
PUBLISHED = {
    "CPS log-wage": ((0.10, 0.00, 0.900), 0.025),
    "CPS urate": ((0.35, 1.60, 0.011), 0.203),
    "PWT": ((0.40, 0.30, 0.006), 0.023),
    "Germany": ((0.20, 1.20, 0.011), 0.025),
    "Basque": ((0.35, 0.00, 0.006), 0.041),
    "Smoking": ((0.40, 0.25, 0.011), 0.085),
    "Boatlift": ((0.20, 0.20, 0.151), 0.115),
}
#: Penalties agree within this share and this distance; those published below NEAR_ZERO within the distance alone.
PENALTY_SHARE, PENALTY_DISTANCE, NEAR_ZERO = 0.10, 0.05, 0.01


def against_published(found: DataFrame) -> DataFrame:
    """``found(data, lam_time, lam_unit, lam_norm)`` beside the published penalties: a row for each penalty, and whether it agrees.

    Data sets without published penalties have no rows; ``in_default`` says whether the default grid has the published value at all.
    """
    rows = [(name, axis, lam, any(abs(g - lam) < TIE for g in GRIDS["default"][k])) for name, (lams, _) in PUBLISHED.items() for k, (axis, lam) in enumerate(zip(("lam_time", "lam_unit", "lam_norm"), lams, strict=True))]
    known = found.sparkSession.createDataFrame(rows, "data string, penalty string, published double, in_default boolean")
    each = found.select("data", F.explode(F.create_map(*[x for c in ("lam_time", "lam_unit", "lam_norm") for x in (F.lit(c), F.col(c).cast("double"))])).alias("penalty", "found"))
    apart = F.abs(F.col("found") - F.col("published"))
    near = F.col("published") < NEAR_ZERO
    agrees = (apart <= PENALTY_DISTANCE) & (near | (apart <= PENALTY_SHARE * F.col("published")))
    return each.join(F.broadcast(known), ["data", "penalty"]).select("data", "penalty", "published", "found", F.coalesce(agrees, F.lit(False)).alias("agrees"), "in_default")


def stability(best: dict, grids: tuple[list[float], list[float], list[float]]) -> dict:
    """Which penalties lie on an edge of their axis, how many combinations there are, and whether trying all of them is cheap."""
    n = len(grids[0]) * len(grids[1]) * len(grids[2])
    edge = {k: best[k] in (min(v), max(v)) for k, v in zip(("lam_time", "lam_unit", "lam_norm"), grids, strict=True)}
    return {"on_edge": [k for k, v in edge.items() if v], "combinations": n, "exhaustive_is_cheap": n <= 125}


def cycle(score, grids: tuple[list[float], list[float], list[float]], rounds: int = 10, tol: float = 1e-6, bounding: bool = False) -> tuple[dict, list[dict]]:
    """Coordinate search. ``score`` as for ``exhaust``, for rows (lam_time, lam_unit, lam_norm); each is scored once.

    Seeds are one-dimensional: time at (unit 0, norm infinite), norm at (0, 0), unit at (time 0, norm
    infinite); then unit, time and norm in turn until q settles. What is known bounds what is asked; a row that was given up
    against one bound is asked again where it competes anew. All rows evaluated are returned.
    """
    times, units_, norms = grids
    score = _pairs_of(score, bounding)
    known: dict[tuple, float] = {}
    given_up: dict[tuple, float] = {}

    def ask(rows: list[tuple]) -> list[dict]:
        bound = min((known[r] for r in rows if r in known), default=INF)
        new = [r for r in dict.fromkeys(rows) if r not in known and given_up.get(r, -INF) <= bound + TIE]
        for r, (q, low) in zip(new, score(new, bound) if new else [], strict=True):
            if low is None:
                known[r] = q
                given_up.pop(r, None)
            else:
                given_up[r] = low
        return [{"g_id": g, "lam_time": r[0], "lam_unit": r[1], "lam_norm": r[2], "q": known.get(r, INF)} for g, r in enumerate(rows)]

    at = {
        "lam_time": select(ask([(t, 0.0, INF) for t in times]))["lam_time"],
        "lam_norm": select(ask([(0.0, 0.0, n) for n in norms]))["lam_norm"],
        "lam_unit": select(ask([(0.0, u, INF) for u in units_]))["lam_unit"],
    }
    last = INF
    best: dict = {}
    for _ in range(rounds):
        for axis, values in (("lam_unit", units_), ("lam_time", times), ("lam_norm", norms)):
            rows = [tuple({**at, axis: v}[k] for k in ("lam_time", "lam_unit", "lam_norm")) for v in values]
            best = select(ask(rows))
            at[axis] = best[axis]
        if abs(last - best["q"]) < tol:
            break
        last = best["q"]
    return best, [_scored(r, q, None) for r, q in known.items()] + [_scored(r, INF, low) for r, low in given_up.items()]
