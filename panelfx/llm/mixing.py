"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the Kullback-Leibler divergence from one copy each, subject to the token
constraints sum(size * r) = target of every source and r <= 2. The convex dual has one multiplier a
source, and its solution tilts exponentially: r = min(2, exp(lambda * size / mean size)). Newton
iterations on all sources at once (each an aggregate over the distinct sizes of a source, guarded by a
bracket) find the multipliers. Rates are rounded into copies by reproducible uniform numbers; the
threshold of each source is then moved, by histograms, to where its words come nearest its target.

All state per source stays in DataFrames; the driver sees one number a round. A row's copies depend on
nothing but its own id, text and source and on its source's row of the plan, so no row is ever found by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_saved, save, uniform

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL, CAP = 1.5, 2.0
#: Rounding priorities are integers below 2**(LEVELS * LEVEL_BITS), found level by level.
LEVELS, LEVEL_BITS = 3, 10
#: Sources that are shipped to every task; more of them are joined.
MOST_SHIPPED = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``(source, source_size, cells, x0, target)``: one row a source, by code point with null last.

    Weights repeat over the sources; what a source can't take (above ``cap`` times its size) is shared
    again by weight among the others. Sources are ranked in one task: one row each.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("filled"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    n = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(n) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    back, on = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    share = (F.lit(total) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(back), F.lit(0.0))) / F.sum("w").over(on)
    src = src.withColumn("share", share).withColumn("free", F.col("share") <= F.col("most") / F.col("w"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), F.col("share"))))
    src = src.withColumn("level", level.over(everything)["share"])
    target = F.least("most", F.col("w") * F.coalesce("level", F.lit(0.0)))
    return src.select("source", "source_size", "filled", "least", target.alias("target"))


def multipliers(sized: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """The dual's solution: ``(source, lam, mean)`` for sources that have words; an error if it isn't reached."""
    cells = save(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("double").alias("n")), "mix-cells")
    mean = F.col("source_size") / F.col("filled")
    x0, ratio = F.col("least") / mean, F.col("target") / F.col("source_size")
    top = F.log(F.lit(cap)) / x0
    full = ratio >= cap * (1 - 1e-12)
    state = goals.where("filled > 0").select(
        "source", "target", mean.alias("mean"),
        F.when(full, top).otherwise(0.0).alias("lam"),
        F.when(ratio < 1, F.log(ratio) / x0).otherwise(0.0).alias("lo"),
        F.when(ratio < 1, F.lit(0.0)).otherwise(top).alias("hi"),
        full.alias("done"),
    )
    state = save(state, "mix-state")
    for _ in range(rounds):
        at = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        x, lam = F.col("c.size") / F.col("mean"), F.col("lam")
        tilt, words = F.exp(F.least(lam * x, F.log(F.lit(cap)))), F.col("c.n") * F.col("c.size")
        slope = F.sum(F.when(lam * x < F.log(F.lit(cap)), words * x * tilt).otherwise(0.0))
        got = at.groupBy("s.source", "target", "mean", "lam", "lo", "hi", "done").agg(F.sum(words * tilt).alias("got"), slope.alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        done = F.col("done") | (F.abs(gap) <= tolerance * F.col("target")) | (hi - lo <= 1e-14 * F.greatest(F.abs(lo), F.abs(hi)))
        lam = F.when(done, F.col("lam")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        nxt = save(got.select("source", "target", "mean", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "mix-state")
        drop_saved(state)
        state = nxt
        if not state.where("NOT done").limit(1).count():
            break
    else:
        raise RuntimeError(f"the multipliers of some source did not settle in {rounds} rounds")
    drop_saved(cells)
    # sums of doubles differ in their last digits from run to run; the multipliers must not
    out = save(state.select("source", F.round("lam", 10).alias("lam"), "mean"), "mix-solved")
    drop_saved(state)
    return out


def _rates(rows: DataFrame, plan: DataFrame, key: Column, cap: int) -> DataFrame:
    """``rows(_mix_source, _mix_size)`` with their source's plan, rate, whole copies and rounding priority (null where nothing is rounded)."""
    p = F.broadcast(plan) if plan.count() <= MOST_SHIPPED else plan
    rows = rows.join(p.select(*[F.col(c).alias(f"_mix_{c}" if c != "source" else "_mix_own") for c in plan.columns]), F.col("_mix_source").eqNullSafe(F.col("_mix_own")), "left")
    rate = F.when((F.col("_mix_size") > 0) & F.col("_mix_lam").isNotNull(), F.least(F.lit(float(cap)), F.exp(F.col("_mix_lam") * F.col("_mix_size") / F.col("_mix_mean")))).otherwise(0.0)
    rows = rows.withColumn("_mix_rate", rate)
    rows = rows.withColumn("_mix_rate", F.when(F.col("_mix_rate") > cap - 1e-9, float(cap)).otherwise(F.col("_mix_rate"))).withColumn("_mix_base", F.floor("_mix_rate"))
    wide = 1 << (LEVELS * LEVEL_BITS)
    place = F.floor((uniform(key, F.lit("mix")) - (F.col("_mix_rate") - F.col("_mix_base")) + 1) / 2 * wide).cast("long")
    return rows.withColumn("_mix_place", F.when((F.col("_mix_size") > 0) & (F.col("_mix_base") < cap), place))


def _sized(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    return docs.withColumn("_mix_source", F.col(source_col)).withColumn("_mix_size", word_count(F.col(text_col)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: int = int(CAP)) -> DataFrame:
    """``(source, source_size, target, lam, mean, cut)``: what decides over the rows of each source; a saved table.

    ``cut`` is the priority below which a row gets one copy more than its rate's whole part.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    sized = save(_sized(docs.select(id_col, text_col, source_col), text_col, source_col).select(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), key.alias("key")), "mix-sizes")
    goals = save(targets(sized, weights, total, float(cap)), "mix-goals")
    solved = multipliers(sized, goals, float(cap))
    sources = goals.alias("g").join(solved.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left").select("g.source", "source_size", "target", "lam", "mean")
    sources = save(sources, "mix-sources")
    rows = _rates(sized.select(F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), "key"), sources, F.col("key"), cap)
    rows = save(rows.where("_mix_size > 0").select(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_target").alias("target"), F.col("_mix_base").alias("base"), F.col("_mix_place").alias("place")), "mix-rates")
    # how many words each source's thresholds must add to those of the whole copies
    need = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("base"))).alias("need"))
    state = need.select("source", "need", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        bins = rows.where("place IS NOT NULL").select("source", "size", F.shiftright("place", shift).alias("bin"))
        bins = bins.alias("b").join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.shiftright("b.bin", LEVEL_BITS) == F.col("s.prefix")))
        bins = bins.groupBy("s.source", "s.need", "b.bin").agg(F.sum("b.size").cast("double").alias("words"))
        by = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("before", F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        # the first bin that reaches what is needed, or else the last
        short = F.col("before") + F.col("words") < F.col("need")
        hit = F.min_by(F.struct("bin", "before", "words"), F.struct(short.cast("int"), F.when(short, -F.col("bin")).otherwise(F.col("bin"))))
        nxt = save(bins.groupBy("source").agg(hit.alias("h"), F.first("need").alias("need")).select("source", (F.col("need") - F.col("h.before")).alias("need"), F.col("h.bin").alias("prefix"), F.col("h.words").alias("words")), "mix-cut")
        drop_saved(state)
        state = nxt
    # the last bin is taken as a whole if that comes nearer
    cut = state.select("source", (F.col("prefix") + (F.abs(F.col("words") - F.col("need")) <= F.abs(F.col("need"))).cast("long")).alias("cut"))
    out = save(sources.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "cut"), "mix-plan")
    drop_saved(sized, goals, solved, sources, rows, state)
    return out


def decide(docs: DataFrame, made: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = int(CAP)) -> DataFrame:
    """``docs`` with _mix_size, _mix_rate, _mix_copies, _mix_source_size and _mix_target by a plan made of them; no row is shuffled for it."""
    rows = _rates(_sized(docs, text_col, source_col), made, F.xxhash64(F.col(id_col), F.col(text_col)), cap)
    copies = (F.col("_mix_base") + F.coalesce((F.col("_mix_place") < F.col("_mix_cut")).cast("long"), F.lit(0))).cast("long")
    return rows.withColumn("_mix_copies", copies).drop("_mix_own", "_mix_lam", "_mix_mean", "_mix_cut", "_mix_base", "_mix_place", "_mix_source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: int = int(CAP)) -> DataFrame:
    """``(id, source, size, source_size, target, rate, copies, taken)`` for every row.

    Null texts have size 0 and take no words; a null source is a source of its own, last in order.
    Rows that repeat id, text and source get the same copies; rows that share an id only are decided each
    for itself, also those without one. An empty table gives an empty result; extra columns are ignored.
    ``copies`` is 0 to ``cap``.
    """
    own = docs.select(id_col, text_col, source_col)
    rows = decide(own, plan(own, id_col, text_col, source_col, weights, total, cap), id_col, text_col, source_col, cap)
    return rows.select(
        id_col, source_col, F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_rate").alias("rate"),
        F.col("_mix_copies").alias("copies"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: int = int(CAP)) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    rows = decide(docs, plan(docs, id_col, text_col, source_col, weights, total, cap), id_col, text_col, source_col, cap)
    return rows.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int")))).select(*docs.columns)
