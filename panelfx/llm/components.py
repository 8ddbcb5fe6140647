"""Connected components by alternating large-star and small-star steps.

Every step is a partially aggregated minimum and an equi-join, so a vertex with a third of all
edges is pre-aggregated in the map tasks and its join is split by AQE's skew handling. Each round
is written to the shared folder; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(u, v)`` of one orderable type to ``(node, root)``; root is the least node reachable.

    Self-loops, repeats and rows with a null end are ignored; nodes without an edge don't appear.
    Empty input gives an empty result, which is saved; ``drop_saved`` deletes its files.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = save(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _mark(nxt)
        drop_saved(e)
        e = nxt
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    star = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    out = save(star.union(star.select(F.col("root").alias("node"), "root").distinct()), "cc-roots")
    drop_saved(e)
    return out


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
