"""Long panels from files and from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import InvalidSpec

#: Treatment rules on dense unit and period numbers.
RULES = {
    "block": "u % 5 = 0 AND t >= 21",
    "staggered": "u % 4 = 0 AND t >= 12 + 3 * (u % 3)",
    "switching": "u % 5 = 1 AND t BETWEEN 15 AND 20",
}
FORMATS = ("parquet", "csv", "orc", "json")


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A long table in any of FORMATS, or a Stata file where pandas can read it: such a file is one panel's, and comes through the driver."""
    if fmt == "dta":
        import pandas as pd

        return spark.createDataFrame(pd.read_stata(path, convert_categoricals=False))
    if fmt not in FORMATS:
        raise InvalidSpec(f"no format {fmt}")
    return spark.read.format(fmt).options(**options).load(path)


def nation_periods(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    """``(unit, time, y)``: mean order value in thousands, by the customer's nation and calendar period."""
    orders = read_panel(spark, f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = read_panel(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return rows.groupBy(F.col("c_nationkey").alias("unit"), F.date_trunc(period, "o_orderdate").alias("time")).agg((F.avg("o_totalprice") / 1000).alias("y"))


def priority_periods(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    """``(unit, time, y)``: mean order value in thousands, by order priority and period."""
    orders = read_panel(spark, f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.col("o_orderpriority").alias("unit"), F.date_trunc(period, "o_orderdate").alias("time")).agg((F.avg("o_totalprice") / 1000).alias("y"))


def nation_covariate(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    """``(unit, time, x)``: mean quantity of the cell's order lines."""
    orders = read_panel(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_panel(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    lines = read_panel(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    return rows.groupBy(F.col("c_nationkey").alias("unit"), F.date_trunc(period, "o_orderdate").alias("time")).agg(F.avg(F.col("l_quantity").cast("double")).alias("x"))


def nation_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(unit, stratum, psu, w, fpc)``: regions as strata, nations as sampling units, customers as weight."""
    nation = read_panel(spark, f"{sf_dir}/nation.parquet")
    customer = read_panel(spark, f"{sf_dir}/customer.parquet")
    count = customer.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").cast("double").alias("w"))
    joined = count.join(nation, count.c_nationkey == nation.n_nationkey)
    return joined.select(F.col("c_nationkey").alias("unit"), F.col("n_regionkey").cast("long").alias("stratum"), F.col("n_nationkey").cast("long").alias("psu"), "w", F.lit(20.0).alias("fpc"))


def user_days(spark: SparkSession, sf_dir: str, groups: int = 20) -> DataFrame:
    """``(unit, time, y)``: mean event value by group of users and day."""
    events = read_panel(spark, f"{sf_dir}/events.parquet")
    return events.groupBy((F.col("user_id") % groups).alias("unit"), F.date_trunc("day", "ts").alias("time")).agg(F.avg("value").alias("y"))


def treat(cells: DataFrame, rule: str) -> DataFrame:
    """Indexed cells with treatment by one of RULES (or any condition on u and t)."""
    return cells.withColumn("d", F.expr(RULES.get(rule, rule)).cast("int"))
