"""Forward returns, profit and loss, turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import missing_to_null, ratio


def _order(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def forward_return(df: DataFrame, n: int = 1, price: str = "price", keys: list[str] = ["symbol"], order: str = "bar_ts", per_bar: bool = True, out: str = "rtn") -> DataFrame:
    """Return over the next n bars; per bar with zero-price cases as 0, or the whole return with them missing."""
    p = F.col(price)
    ahead = F.lead(price, n).over(_order(keys, order))
    grown = ratio(ahead, p) - 1
    if per_bar:
        grown = F.when(ahead.isNotNull() & (p == 0), F.lit(0.0)).otherwise(grown) / n
    return df.withColumn(out, missing_to_null(grown))


def gains(df: DataFrame, pos: str = "pos", rtn: str = "rtn", out: str = "gp") -> DataFrame:
    return df.withColumn(out, F.col(pos) * F.col(rtn))


def daily_gains(df: DataFrame, shift: int = 1, keys: list[str] = ["symbol"], order: str = "bar_ts", gp: str = "gp", mean_name: str = "return", to_previous: bool = False) -> DataFrame:
    """``symbol, day, gp``: daily sums of gains shifted by ``shift`` bars, and the series ``return``.

    ``return`` is the mean over symbols of each bar, summed by day, then averaged once more with the symbols' sums.
    """
    key = keys[-1]
    rest = keys[:-1]
    across = df.groupBy(*rest, order).agg(F.avg(gp).alias(gp)).withColumn(key, F.lit(mean_name))
    rows = df.select(*keys, order, gp).unionByName(across.select(*keys, order, gp))
    moved = rows if to_previous else rows.withColumn(gp, F.lag(gp, shift).over(_order(keys, order)))
    sums = moved.groupBy(*keys, F.to_date(order).alias("day")).agg(F.sum(gp).alias("gp"))
    total = sums.groupBy(*rest, "day").agg(F.avg("gp").alias("gp")).withColumn(key, F.lit(mean_name))
    return sums.where(F.col(key) != mean_name).unionByName(total.select(*sums.columns))


def turnover(df: DataFrame, shift: int = 1, pos: str = "pos", keys: list[str] = ["symbol"], order: str = "bar_ts", discrete: bool = True, mean_name: str = "avg") -> DataFrame:
    """``symbol, day, hsr``: half the absolute change, summed (discrete) or averaged (continuous) by day, and the mean over symbols."""
    change = F.abs(F.col(pos) - F.lag(pos, shift).over(_order(keys, order))) / 2
    fold = F.sum if discrete else F.avg
    by_day = df.select(*keys, F.to_date(order).alias("day"), change.alias("_c")).groupBy(*keys, "day").agg(fold("_c").alias("hsr"))
    mean = by_day.groupBy(*keys[:-1], "day").agg(F.avg("hsr").alias("hsr")).withColumn(keys[-1], F.lit(mean_name))
    return by_day.unionByName(mean.select(*by_day.columns))


def net(gains_by_day: DataFrame, turnover_by_day: DataFrame, fee: float, keys: list[str] = [], direction: int = 1) -> DataFrame:
    """``day, net``: return times direction less fee times mean turnover; missing counts as 0."""
    g = gains_by_day.where("symbol = 'return'").select(*keys, "day", "gp")
    h = turnover_by_day.where("symbol = 'avg'").select(*keys, "day", "hsr")
    return g.join(h, [*keys, "day"], "left").withColumn("net", F.coalesce(F.col("gp") * direction - fee * F.col("hsr"), F.lit(0.0)))
