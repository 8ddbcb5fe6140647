"""Distances between units over shared control periods, by tiles of two blocks of units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .index import valid

#: Cells of a block, and units of one, at most.
TILE_CELLS, TILE_UNITS = 1 << 18, 512
#: A distance without one period is summed anew where that period makes up all but this share.
LOST = 1e-8


def _tiled(values: DataFrame, columns: list[str], n_units: int, n_periods: int, of: Callable, schema: str) -> DataFrame:
    """``of(first, second, same)`` for every two blocks of units, once for a block with itself.

    ``values(u, t, *columns)`` become arrays (columns x periods x units, NaN where there is no row), with the units' numbers. A
    block goes to each of its tiles, so what is dealt out grows with the number of blocks, and no task holds more than two of them.
    """
    ship(values.sparkSession)
    width = max(1, min(TILE_UNITS, TILE_CELLS // max(1, n_periods * len(columns))))
    blocks = max(1, -(-n_units // width))
    k = len(columns)

    def pack(table: pa.Table) -> pa.Table:
        us, at = np.unique(table.column("u").to_numpy(), return_inverse=True)
        v = np.full((k, n_periods, len(us)), np.nan)
        for c, name in enumerate(columns):
            v[c, table.column("t").to_numpy(), at] = table.column(name).to_numpy(zero_copy_only=False)
        return pa.table({"block": table.column("block").slice(0, 1), "us": pa.array([us], type=pa.list_(pa.int32())), "v": pa.array([v.tobytes()], type=pa.binary())})

    packed = values.withColumn("block", F.floor(F.col("u") / width).cast("int")).groupBy("block").applyInArrow(pack, "block int, us array<int>, v binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = packed.select("*", every).select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "us", "v")

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        get = lambda i: (np.array(table.column("us")[i].as_py()), np.frombuffer(table.column("v")[i].as_py()).reshape(k, n_periods, -1))
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        if len(table) < 2 and not same:  # the other block has no values
            return pa.table({n: pa.array([], type=t) for n, t in arrow})
        first = get(0)
        return of(first, first if same else get(1), same)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = [(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))]
    return dealt.groupBy("a", "b").applyInArrow(solve, schema)


def _sizes(cells: DataFrame) -> tuple[int, int]:
    r = cells.agg(F.max("u").alias("u"), F.max("t").alias("t")).first()
    return (0, 0) if r["u"] is None else (r["u"] + 1, r["t"] + 1)


def _shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared differences over shared periods, and their number, for units of two blocks (periods x units)."""
    total = np.zeros((x.shape[1], y.shape[1]))
    for a, b in zip(x, y, strict=True):  # differences themselves: squares of outcomes would cancel
        gap = a[:, None] - b[None, :]
        total += np.where(np.isnan(gap), 0.0, gap * gap)
    return total, (~np.isnan(x)).T.astype(float) @ (~np.isnan(y)).astype(float)


def _pairs(first: tuple, second: tuple, same: bool) -> pa.Table:
    (ui, x), (uj, y) = first, second
    total, n = _shared(x[0], y[0])
    i, j = np.nonzero(n > 0)
    if same:
        i, j = i[ui[i] != uj[j]], j[ui[i] != uj[j]]
    ii, jj, ss, nn = ui[i], uj[j], total[i, j], n[i, j].astype(np.int64)
    if not same:
        ii, jj, ss, nn = np.concatenate([ii, jj]), np.concatenate([jj, ii]), np.tile(ss, 2), np.tile(nn, 2)
    return pa.table({"i": pa.array(ii, type=pa.int32()), "j": pa.array(jj, type=pa.int32()), "sum_sq": ss, "n": nn})


def pair_stats(cells: DataFrame) -> DataFrame:
    """``(i, j, sum_sq, n)`` for ordered pairs i <> j that share a control period; those that ``keep_pairs`` holds for these cells, if any."""
    held = getattr(cells, "_pairs", None)
    if held is not None:
        return held
    return _tiled(valid(cells).select("u", "t", "y"), ["y"], *_sizes(cells), _pairs, "i int, j int, sum_sq double, n long")


def keep_pairs(cells: DataFrame) -> DataFrame:
    """``cells``, whose pairs are from now on worked out once; ``drop_pairs`` frees them."""
    cells._pairs = pair_stats(cells).persist()
    return cells


def drop_pairs(cells: DataFrame) -> None:
    held = getattr(cells, "_pairs", None)
    if held is not None:
        held.unpersist()
        cells._pairs = None


def neighbour_sums(at: DataFrame, n_units: int, n_periods: int, times: list[float], penalties: list[tuple[float, float]]) -> DataFrame:
    """``(lam_time, lam_unit, u, t, sw, swr)``: sums over the other units j of exp(-lam_unit dist) and of that times r, dist without period t.

    ``at(u, t, y, r0, r1, ...)`` has control cells and what each time penalty of ``times`` leaves of them.
    """
    columns = ["y", *(f"r{k}" for k in range(len(times)))]
    by_unit: dict[float, list[float]] = {}
    for lt, lu in penalties:
        by_unit.setdefault(lu, []).append(lt)

    def of(first: tuple, second: tuple, same: bool) -> pa.Table:
        (ui, x), (uj, y) = first, second
        total, n = _shared(x[0], y[0])
        out = []
        for t in range(n_periods):
            i, j = np.flatnonzero(~np.isnan(x[0, t])), np.flatnonzero(~np.isnan(y[0, t]))
            if not len(i) or not len(j):
                continue
            gap = (x[0, t, i][:, None] - y[0, t, j]) ** 2
            whole, left = total[np.ix_(i, j)], n[np.ix_(i, j)] - 1
            rest = np.maximum(whole - gap, 0.0)
            for a, b in np.argwhere((rest <= LOST * whole) & (whole > 0) & (left > 0)):
                d = np.delete(x[0, :, i[a]] - y[0, :, j[b]], t)
                rest[a, b] = np.nansum(d * d)
            dist = np.sqrt(rest / np.maximum(left, 1))
            for lu, its in by_unit.items():
                w = np.where(left > 0, np.exp(-lu * dist), 0.0)
                if same:
                    w[ui[i][:, None] == uj[j]] = 0.0
                for lt in its:
                    k = 1 + times.index(lt)
                    out.append((lt, lu, ui[i], t, w.sum(axis=1), w @ y[k, t, j]))
                    if not same:
                        out.append((lt, lu, uj[j], t, w.sum(axis=0), w.T @ x[k, t, i]))
        many = [len(o[2]) for o in out]
        col = lambda k, kind: pa.array(np.concatenate([np.zeros(0), *(np.broadcast_to(o[k], m) for o, m in zip(out, many, strict=True))]).astype(kind))
        return pa.table({"lam_time": col(0, float), "lam_unit": col(1, float), "u": col(2, np.int32), "t": col(3, np.int32), "sw": col(4, float), "swr": col(5, float)})

    parts = _tiled(at.select("u", "t", *columns), columns, n_units, n_periods, of, "lam_time double, lam_unit double, u int, t int, sw double, swr double")
    return parts.groupBy("lam_time", "lam_unit", "u", "t").agg(F.sum("sw").alias("sw"), F.sum("swr").alias("swr"))


def distances(cells: DataFrame) -> DataFrame:
    """``(i, j, n, dist)`` for all ordered pairs; no shared period: n 0 and dist null; i = j: 0."""
    u = cells.select("u").distinct()
    pairs = u.select(F.col("u").alias("i")).crossJoin(u.select(F.col("u").alias("j")))
    own = valid(cells).groupBy("u").agg(F.count("*").alias("own"))
    s = pair_stats(cells)
    j = pairs.join(s, ["i", "j"], "left").join(own, F.col("i") == F.col("u"), "left")
    same = F.col("i") == F.col("j")
    return j.select("i", "j", F.when(same, F.coalesce("own", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).alias("n"), F.when(same, F.lit(0.0)).otherwise(F.sqrt(F.col("sum_sq") / F.col("n"))).alias("dist"))


def distances_without(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``(u, t, j, n, dist)``: for each target cell (u, t), distances of u to the others without period t."""
    c = valid(cells).select("u", "t", "y")
    s = pair_stats(cells)
    at = targets.select("u", "t").join(s, F.col("u") == F.col("i")).select("u", "t", "j", "sum_sq", "n")
    own = c.select(F.col("u").alias("_u"), F.col("t").alias("_t"), F.col("y").alias("y_own"))
    other = c.select(F.col("u").alias("_j"), F.col("t").alias("_s"), F.col("y").alias("y_other"))
    x = at.join(own, (F.col("u") == F.col("_u")) & (F.col("t") == F.col("_t")), "left").join(other, (F.col("j") == F.col("_j")) & (F.col("t") == F.col("_s")), "left")
    shared = F.col("y_own").isNotNull() & F.col("y_other").isNotNull()
    n = F.col("n") - shared.cast("int")
    left = F.greatest(F.col("sum_sq") - F.when(shared, (F.col("y_own") - F.col("y_other")) ** 2).otherwise(0.0), F.lit(0.0))
    x = x.select("u", "t", "j", "sum_sq", n.alias("n"), left.alias("left"), shared.alias("shared"))
    # where one period makes up nearly all of the sum, subtraction loses the rest: these few are summed anew
    lost = x.where(F.col("shared") & (F.col("n") > 0) & (F.col("left") <= 1e-8 * F.col("sum_sq"))).select("u", "t", "j")
    one, two = c.select("u", F.col("t").alias("s"), F.col("y").alias("y1")), c.select(F.col("u").alias("j"), F.col("t").alias("s"), F.col("y").alias("y2"))
    exact = lost.join(one, "u").where("s <> t").join(two, ["j", "s"]).groupBy("u", "t", "j").agg(F.sum((F.col("y1") - F.col("y2")) ** 2).alias("exact"))
    x = x.join(exact, ["u", "t", "j"], "left")
    return x.select("u", "t", "j", "n", F.when(F.col("n") > 0, F.sqrt(F.coalesce("exact", "left") / F.col("n"))).alias("dist"))


def distance_summary(cells: DataFrame, lam: float = 0.1) -> DataFrame:
    """Mean, spread, extremes, nearest-rank quartiles over unordered pairs, and the weights they imply."""
    d = distances(cells).where("i < j AND dist IS NOT NULL")
    q = d.agg(
        F.count("*").alias("n_pairs"), F.avg("dist").alias("mean"), F.stddev_samp("dist").alias("sd"), F.min("dist").alias("min"), F.max("dist").alias("max"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY dist)").alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)],
    )
    return q.withColumn("weight_p50", F.exp(-lam * F.col("p50"))).withColumn("weight_p75", F.exp(-lam * F.col("p75")))
