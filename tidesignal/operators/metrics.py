"""Risk metrics of daily return series: one aggregation per group over columns prepared by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

YEAR = 245


def drawdowns(df: DataFrame, ret: str = "ret", keys: list[str] = ["factor"], order: str = "day") -> DataFrame:
    """Adds ``cum`` (running sum), ``fall`` (below its peak so far), ``wealth`` (compounded) and ``dd`` (relative to its peak).

    Compounding is a running product, so a return of -1 or below takes wealth to zero or past it, and later returns go on from there.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = df.withColumn("cum", F.sum(ret).over(w)).withColumn("wealth", F.product(1 + F.col(ret)).over(w))
    return got.withColumn("fall", F.max("cum").over(w) - F.col("cum")).withColumn("dd", ratio(F.col("wealth"), F.max("wealth").over(w)) - 1)


def episodes(df: DataFrame, keys: list[str] = ["factor"], order: str = "day", dd: str = "dd") -> DataFrame:
    """Completed drawdowns: ``keys, first, length, depth``; the last one of a series counts only if it has ended."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    under = F.round(dd, 12) < 0
    marked = df.withColumn("_u", under).withColumn("_g", F.sum((~under).cast("int")).over(w))
    last = marked.groupBy(*keys).agg(F.max("_g").alias("_last"))
    runs = marked.where("_u").groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.count("*").alias("length"), F.min(dd).alias("depth"))
    return runs.join(last, keys).where("_g < _last").drop("_g", "_last")


def sharpe(ret: str, days: int = YEAR, sample: bool = False) -> Column:
    dev = F.stddev_samp(ret) if sample else F.stddev_pop(ret)
    return ratio(F.avg(ret), F.when(dev > 1e-15, dev)) * F.sqrt(F.lit(float(days)))


def sortino(ret: str) -> Column:
    losses = F.avg(F.when(F.col(ret) < 0, F.col(ret) * F.col(ret)))
    return ratio(F.avg(ret), F.sqrt(losses)) * F.sqrt(F.lit(float(YEAR)))


def summary(df: DataFrame, ret: str = "ret", keys: list[str] = ["factor"], order: str = "day") -> DataFrame:
    """The ten core metrics of every group. One sort for the running columns, one aggregation."""
    run = drawdowns(df, ret, keys, order)
    n = F.count(ret)
    base = run.groupBy(*keys).agg(
        F.sum(ret).alias("return"), (F.sum(ret) * YEAR / n).alias("return_annualized"), F.max("fall").alias("max_dd"), sharpe(ret).alias("sharpe_ratio"),
        sortino(ret).alias("sortino_ratio"), F.max_by("wealth", order).alias("_w"), n.alias("_n"), F.avg(F.when(F.col("dd") < 0, F.col("dd"))).alias("_down"),
        F.avg(F.when(F.col("dd") < 0, F.col("dd") ** 2)).alias("_down2"), F.sqrt(F.avg(F.col("dd") ** 2)).alias("_ulcer"),
    )
    growth = F.pow(F.col("_w"), ratio(F.lit(float(YEAR)), F.col("_n"))) - 1
    recovered = episodes(run, keys, order).groupBy(*keys).agg(F.avg(F.col("length") / F.abs("depth")).alias("avg_recovery"))
    got = base.withColumn("calmar_ratio", F.when(F.col("max_dd") > 0, ratio(F.col("return_annualized"), F.col("max_dd")))).withColumn("sterling_ratio", ratio(growth, -F.col("_down"))).withColumn("burke_ratio", ratio(growth, F.sqrt("_down2"))).withColumn("ulcer_index", F.col("_ulcer") * 100)
    return got.join(recovered, keys, "left").select(*keys, "return", "return_annualized", "max_dd", "sharpe_ratio", "calmar_ratio", "sortino_ratio", "sterling_ratio", "burke_ratio", "ulcer_index", "avg_recovery")
