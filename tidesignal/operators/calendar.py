"""Trading calendars and rolling periods."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def intraday(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """Equally spaced stamps: ``left_edge`` and ``right_edge`` (HH:mm)."""
    at = lambda t: F.lit(f"2000-01-01 {t}:00").cast("timestamp_ntz")
    step = F.expr(f"interval {minutes} minutes")
    left = spark.range(1).select(F.explode(F.sequence(at(start), at(end) - step, step)).alias("t"))
    return left.select(F.date_format("t", "HH:mm").alias("left_edge"), F.date_format(F.col("t") + step, "HH:mm").alias("right_edge"))


def previous(calendar: DataFrame, days_back: int = 0, day: str = "day") -> DataFrame:
    """The last trading day before ``days_back`` calendar days earlier, by one range window over the calendar."""
    n = calendar.withColumn("_n", F.unix_date(day))
    w = Window.orderBy("_n").rangeBetween(Window.unboundedPreceding, -days_back - 1)  # a calendar: some thousand rows
    return n.withColumn("previous", F.max(day).over(w)).drop("_n")


def expiries(spark: SparkSession, first: str, last: str, calendar: DataFrame) -> DataFrame:
    """Third Fridays of the months, moved to the next trading day."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    friday = F.date_add(F.next_day(F.date_sub(F.trunc("month", "month"), 1), "Fri"), 14)
    both = months.select(friday.alias("d"), "month").unionByName(calendar.select(F.col("day").alias("d"), F.col("day").alias("t")), allowMissingColumns=True)
    w = Window.orderBy("d").rangeBetween(0, Window.unboundedFollowing)
    return both.withColumn("d", F.unix_date("d")).withColumn("expiry", F.first("t", ignorenulls=True).over(w)).where("month is not null").select("month", "expiry")


def period_name(start: Column, end: Column) -> Column:
    return F.concat_ws("_", F.date_format(start, "yyMMdd"), F.date_format(end, "yyMMdd"))


def parse_delta(text: str) -> tuple[int, int]:
    """Months and days of a text such as ``2 years, 3 months``."""
    size = {"year": (12, 0), "month": (1, 0), "week": (0, 7), "day": (0, 1)}
    months = days_ = 0
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)\s*(year|month|week|day)s?", part)
        if not m:
            raise ValueError(f"not a span of time: {part}")
        a, b = size[m[2]]
        months, days_ = months + a * int(m[1]), days_ + b * int(m[1])
    return months, days_


def _shift(d: dt.date, months: int) -> dt.date:
    k = d.year * 12 + d.month - 1 + months
    first = dt.date(k // 12, k % 12 + 1, 1)
    last = (dt.date((k + 1) // 12, (k + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return first.replace(day=min(d.day, last))


def rolling(fit_from: str, predict_from: str, until: str, step_months: int, window_months: int) -> list[tuple[dt.date, dt.date, dt.date, dt.date]]:
    """(fit_start, fit_end, pred_start, pred_end): each fit ends the day before its prediction starts; the last one ends at ``until``."""
    start, first, last = (dt.date.fromisoformat(x) for x in (fit_from, predict_from, until))
    out, k = [], 0
    while (cut := _shift(first, k * step_months)) <= last:
        nxt = _shift(first, (k + 1) * step_months)
        out.append((max(_shift(cut, -window_months), start), cut - dt.timedelta(1), cut, min(nxt - dt.timedelta(1), last)))
        k += 1
    return out


MODES = ("rolling", "update", "update_predict")


def of_mode(periods: list[tuple], mode: str) -> list[int]:
    """Numbers of the periods a mode works on: all, the last, or the last whose prediction is longer than a day."""
    last = len(periods) - 1
    if mode == "rolling":
        return list(range(len(periods)))
    if mode == "update":
        return [last]
    if mode == "update_predict":
        return [last - 1 if periods[-1][2] == periods[-1][3] and last else last]
    raise ValueError(f"unknown mode: {mode}")
