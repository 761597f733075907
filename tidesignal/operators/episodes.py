"""Trades, segments and spans as gaps and islands over position series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trades(df: DataFrame, pos: str = "pos", price: str = "price", keys: list[str] = ["symbol"], order: str = "bar_ts") -> DataFrame:
    """One row per round trip: ``trade_type, direction, open_time, open_price, close_time, close_price``.

    Only exact moves among -1, 0 and 1 count. Going flat closes at that bar's price, a flip at the previous one; a trade that is
    open at the end is dropped. A missing position neither opens nor closes.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(pos).over(w)
    exact = F.col(pos).isin(-1.0, 0.0, 1.0) & before.isin(-1.0, 0.0, 1.0) & (F.col(pos) != before)
    moves = df.select(*keys, order, pos, price, before.alias("_b"), F.lag(price).over(w).alias("_p"), exact.alias("_m")).where("_m")
    nxt = lambda c: F.lead(c).over(w)
    flip = F.col("_b") * F.col(pos) < 0
    closing = F.when(flip, F.col("_p")).otherwise(F.col(price))
    legs = moves.withColumn("_close", closing).withColumn("close_time", nxt(order)).withColumn("close_price", nxt("_close"))
    return legs.where((F.col(pos) != 0) & F.col("close_time").isNotNull()).select(*keys, F.when(F.col(pos) > 0, "long").otherwise("short").alias("trade_type"), F.col(pos).cast("long").alias("direction"), F.col(order).alias("open_time"), F.col(price).alias("open_price"), "close_time", "close_price")


def trade_returns(t: DataFrame, fee: float) -> DataFrame:
    """Logarithmic return in the trade's direction less the fee, and seconds held."""
    made = F.ln(F.col("close_price") / F.col("open_price")) * F.col("direction") - fee
    return t.withColumn("net_return", made).withColumn("holding_seconds", F.unix_timestamp(F.col("close_time").cast("timestamp")) - F.unix_timestamp(F.col("open_time").cast("timestamp")))


def segments(df: DataFrame, pos: str = "pos", keys: list[str] = ["symbol"], order: str = "bar_ts") -> DataFrame:
    """Adds ``segment``, a running number of runs of equal positions (missing equals missing)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(pos).eqNullSafe(F.lag(pos).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_c", changed).withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def spans(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """Maximal runs of rows where ``flag`` holds: ``keys, first, last, bars``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    g = df.withColumn("_g", F.sum((~F.coalesce(F.col(flag), F.lit(False))).cast("int")).over(w))
    return g.where(F.col(flag)).groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("bars")).drop("_g")


def returns_before(t: DataFrame, bars: DataFrame, lookbacks: list[int], keys: list[str] = ["symbol"], order: str = "bar_ts", price: str = "price") -> DataFrame:
    """Adds ``pre_n``: return over n bars that end one bar before the opening, the start held at the first bar."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first(price).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.coalesce(F.lag(price, 1).over(w), first)
    marks = bars.select(*keys, F.col(order).alias("open_time"), *((F.try_divide(end, F.coalesce(F.lag(price, n + 1).over(w), first)) - 1).alias(f"pre_{n}") for n in lookbacks))
    return t.join(marks, [*keys, "open_time"], "left")
