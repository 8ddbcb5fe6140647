"""Running totals over a distributed order: no task sees more than a slice of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import fixed

#: Slices of an order, by approximate percentiles.
SLICES = 200


def sliced(df: DataFrame, by: str, slices: int = SLICES) -> DataFrame:
    """``df`` with ``_slice``, a number that rises with ``by``. Equal values share a slice; with distinct ones slices are of about equal size."""
    at = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(by, at, 10_000).alias("c")).first()["c"] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else None  # no more than the slices
    return df.withColumn("_slice", F.lit(0) if edges is None else F.size(F.filter(edges, lambda e: e < F.col(by))))


def running(df: DataFrame, by: str, columns: dict[str, tuple[Callable[[str], Column], str, bool]], slices: int = SLICES) -> DataFrame:
    """``df`` with running aggregates over ascending distinct values of ``by``: name to (sum, max or min; column; from the top).

    Slices run in parallel; what came before a slice (or after it, from the top) is the same aggregate over the slices' totals, of
    which there are as many as slices.
    """
    d = sliced(fixed(df), by, slices)  # a value must fall into one slice at every use
    totals = d.groupBy("_slice").agg(*[f(c).alias(f"_before_{name}") for name, (f, c, _) in columns.items()])
    up = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    down = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_slice").alias("_carried"), *[f(f"_before_{name}").over(down if top else up).alias(f"_before_{name}") for name, (f, c, top) in columns.items()])
    within = Window.partitionBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    joined = d.join(F.broadcast(carried), F.col("_slice") == F.col("_carried"))
    for name, (f, c, top) in columns.items():
        own = f(c).over(within.orderBy(F.col(by).desc() if top else F.col(by)))
        before = F.col(f"_before_{name}")
        both = own + before if f is F.sum else F.greatest(own, before) if f is F.max else F.least(own, before)
        joined = joined.withColumn(name, F.when(before.isNull(), own).otherwise(both))
    return joined.drop("_slice", "_carried", *[f"_before_{name}" for name in columns])
