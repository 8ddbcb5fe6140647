"""Vectors of integers from rows of floating point numbers, as the compression and the whitening take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save


def grid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, most: int, extra: dict[str, Column] | None = None, tag: str = "grid") -> tuple[DataFrame, int | None]:
    """``(id, x, *extra)`` with x = floor(scale * component), saved, and the dimension (None without rows).

    Rows whose vector is null or holds null or non-finite components go. The dimension is that of the
    least id's vector (nulls last; the shortest of those that share it); ``x`` is null in rows of another length.
    Whole numbers beyond ``most`` are cut to it, so that sums stay exact.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    kept = rows.where(finite).select(F.col(id_col).alias("id"), v.alias("v"), *[c.alias(k) for k, c in (extra or {}).items()])
    first = kept.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.size("v").alias("d"))).alias("f")).first()["f"]
    dim = None if first is None else first["d"]
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-float(most))), F.lit(float(most)))))
    x = F.when(F.size("v") == F.lit(dim), whole.cast("array<long>"))
    return save(kept.select("id", x.alias("x"), *(extra or {})), tag), dim
