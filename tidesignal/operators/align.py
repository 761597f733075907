"""Alignment, as-of joins, upserts and consistency of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written


def to_columns(panel: DataFrame, symbols: DataFrame, order: str = "bar_ts", key: str = "symbol") -> DataFrame:
    """Every (time, wanted symbol), missing where the panel has none."""
    grid = panel.select(order).distinct().crossJoin(symbols.select(key).distinct())
    return grid.join(panel, [order, key], "left")


def to_index(panel: DataFrame, index: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Reindex to the rows of ``index`` (left) or to the common ones (inner)."""
    return index.select(*on).distinct().join(panel, on, how)


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """The number of each row, from 1, in a total order of the whole table, without one task for all rows.

    Rows are spread by ranges of the order and written; a row's number is that inside its range after the rows of the ranges before,
    which are counted as one row a range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, inside).join(before, "_range").withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_range", "_before")


def duplicated(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for a valid primary."""
    return df.groupBy(*on).count().where("count > 1")


def expand(single: DataFrame, symbols: DataFrame, key: str = "symbol") -> DataFrame:
    """One series for every symbol."""
    return single.crossJoin(symbols.select(key).distinct())


def trim(panel: DataFrame, by: DataFrame, value: str, order: str = "bar_ts") -> DataFrame:
    """Rows between the first and the last time at which ``by`` has any value."""
    ends = by.where(F.col(value).isNotNull()).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    return panel.join(F.broadcast(ends), (F.col(order) >= F.col("_a")) & (F.col(order) <= F.col("_b"))).drop("_a", "_b")  # one row


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str, out: str | None = None, span: str = "day", ahead: bool = False, strict: bool = False) -> DataFrame:
    """The last value of ``right`` at or before each row of ``left``; ``ahead``: the first one at or after it; ``strict``: not at its own time.

    A series is cut into spans of time, and every span starts with the value that the spans before it leave, which is a scan over one
    row a span. So no task has a whole series. Missing values, and values without a time, take no part; of several values at one time
    the greatest holds (ahead: the least); rows of ``left`` without a time get none.
    """
    held = right.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(*keys, order, F.col(value).alias("_r"), F.lit(False).alias("_left"))
    asked = left.withColumns({"_r": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(True)})
    cut = F.to_date(order) if span == "day" else F.trunc(order, span)
    both = asked.unionByName(held, allowMissingColumns=True).withColumns({"_span": cut, "_entry": F.lit(False)})
    way = lambda c: F.col(c).desc() if ahead else F.col(c).asc()
    last = (F.min if ahead else F.max)(F.when(F.col("_r").isNotNull(), F.struct(order, "_r")))
    before = Window.partitionBy(*keys).orderBy(way("_span")).rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    left_by = both.where("_span is not null").groupBy(*keys, "_span").agg(last.alias("_last")).withColumn("_held", F.last("_last", ignorenulls=True).over(before))
    entry = left_by.where("_held is not null").select(*keys, "_span", F.col("_held._r").alias("_r"), F.lit(False).alias("_left"), F.lit(True).alias("_entry"))
    tied = F.col("_left").desc() if strict else F.col("_left").asc()
    w = Window.partitionBy(*keys, "_span").orderBy(F.col("_entry").desc(), way(order), tied, way("_r")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(entry, allowMissingColumns=True).withColumn(out or value, F.last("_r", ignorenulls=True).over(w))
    return found.where("_left").drop("_r", "_left", "_span", "_entry")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Union of rows; where both have a row the new one wins, also with its missing values."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    values = [c for c in old.columns if c not in on]
    return o.join(n, on, "full").select(*on, *(F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values))


def mismatches(old: DataFrame, new: DataFrame, on: list[str], value: str) -> DataFrame:
    """Rows of the overlap whose values differ, a missing one being equal to a missing one only."""
    return old.select(*on, F.col(value).alias("old")).join(new.select(*on, F.col(value).alias("new")), on).where(~F.col("old").eqNullSafe(F.col("new")))


def append(old: DataFrame, new: DataFrame, on: list[str], value: str) -> DataFrame:
    """``old`` with the rows of ``new``; raises where both have a value of a row and the values differ. Rows without a value are dropped."""
    o = old.where(F.col(value).isNotNull())
    n = new.where(F.col(value).isNotNull())
    off = mismatches(o, n, on, value)
    first = off.orderBy(*on).first()
    if first is not None:
        raise ValueError(f"{off.count()} rows are inconsistent, the first {first}")
    return upsert(o, n, on)


def same_columns(frames: list[DataFrame], key: str = "symbol") -> DataFrame:
    """Symbols that all frames have."""
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.intersect(f.select(key).distinct())
    return out


def interpolate(df: DataFrame, value: str, keys: list[str], order: str, out: str | None = None) -> DataFrame:
    """Linear between the neighbours by row number; edges hold the nearest value."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = df.withColumn("_k", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_k"))
    a, b = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)
    ka, kb = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    n = n.select("*", a.alias("_a"), b.alias("_b"), ka.alias("_ka"), kb.alias("_kb"))
    mid = F.col("_a") + (F.col("_b") - F.col("_a")) * F.try_divide(F.col("_k") - F.col("_ka"), F.col("_kb") - F.col("_ka"))
    return n.withColumn(out or value, F.coalesce(F.col(value), mid, "_a", "_b")).drop("_k", "_a", "_b", "_ka", "_kb")


def clock(ts: str) -> Column:
    return F.date_format(ts, "HH:mm:ss")
