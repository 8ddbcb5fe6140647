"""From a long table to indexed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PanelSpec


def finite(c):
    """NaN and infinities become null."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys and their rank from 0: the window runs over one row a key."""
    return df.select(F.col(key)).distinct().withColumn(name, (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))


def index_cells(df: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """``(unit, time, u, t, y[, d][, x][, w])``; rows without unit, time or treatment are left out.

    Units and periods are numbered by their sorted distinct keys. A non-finite outcome is null.
    """
    spec = spec or PanelSpec()
    has_d = spec.treatment in df.columns
    need = [spec.unit, spec.time] + [spec.treatment] * has_d
    rows = df.dropna(subset=need)
    cols = [F.col(spec.unit).alias("unit"), F.col(spec.time).alias("time"), finite(F.col(spec.outcome)).alias("y")]
    if has_d:
        cols.append(F.col(spec.treatment).cast("int").alias("d"))
    if spec.covariates:
        cols.append(F.array(*[finite(F.col(c)) for c in spec.covariates]).alias("x"))
    if spec.weight:
        cols.append(F.col(spec.weight).cast("double").alias("w"))
    rows = rows.select(*cols)
    rest = [c for c in rows.columns if c not in ("unit", "time")]
    return rows.join(numbered(rows, "unit", "u"), "unit").join(numbered(rows, "time", "t"), "time").select("unit", "time", "u", "t", *rest)


def units(cells: DataFrame) -> DataFrame:
    """``(u, treated, first_t, n_d, n_obs)``, one row a unit."""
    return cells.groupBy("u").agg(
        (F.max("d") == 1).alias("treated"),
        F.min(F.when(F.col("d") == 1, F.col("t"))).alias("first_t"),
        F.sum("d").alias("n_d"),
        F.count("y").alias("n_obs"),
    )


def valid(cells: DataFrame) -> DataFrame:
    """Control cells with an outcome."""
    return cells.where("d = 0 AND y IS NOT NULL")


def treated_cells(cells: DataFrame) -> DataFrame:
    return cells.where("d = 1 AND y IS NOT NULL")
