"""Tidy panels and tables from the standard tables.

* ``bars``: events by type and hour, as (symbol, bar_ts, price, factor); hours without an event are missing, as in real sessions.
* ``daily``: line items by return flag and ship date, as (symbol, day, price, factor).
* ``evaluations``: metrics for each (test, process, factor), from line items and parts.
* ``returns``: line items by supplier group and ship date, as (factor, day, ret, turnover).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").cast("double")
    return (
        table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), hour.alias("bar_ts"), "value", k.alias("k"))
        .groupBy("symbol", "bar_ts").agg(F.round(F.avg("value"), 6).alias("price"), F.round(F.avg("k"), 6).alias("factor"))
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity")
        .groupBy("symbol", "day").agg(F.round(F.avg("l_extendedprice"), 6).alias("price"), F.round(F.avg("l_quantity"), 6).alias("factor"))
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of each supplier group: (factor, day, ret), small numbers of both signs."""
    return (
        table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 12).alias("factor"), F.to_date("l_shipdate").alias("day"), "l_discount", "l_quantity")
        .groupBy("factor", "day").agg(F.round((F.avg("l_quantity") - 25.5) / 1000, 6).alias("ret"), F.round(F.avg("l_discount") * 10, 6).alias("turnover"))
    )


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat(F.lit("t"), F.col("l_suppkey") % 4).alias("test_name"), F.concat(F.col("p_type"), F.lit("_TS20ma")).alias("process_name"), F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("-w"), F.col("p_size") % 3, F.lit("d-i"), F.col("p_size") % 2).alias("factor"), F.to_date("l_shipdate").alias("day"), "l_quantity", "l_discount", "l_tax")
    )


def factor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily gains of each evaluated factor: (test_name, process_name, factor, day, gain), as ``returns`` has them of supplier groups."""
    return _evaluated(spark, sf_dir).groupBy("test_name", "process_name", "factor", "day").agg(F.round((F.avg("l_quantity") - 25.5) / 1000, 6).alias("gain"))


def evaluations(spark: SparkSession, sf_dir: str, first: str | None = None) -> DataFrame:
    """Metrics of each (test, process, factor); with ``first``, over days from that one on."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = _evaluated(spark, sf_dir)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    return (
        rows
        .groupBy("test_name", "process_name", "factor")
        .agg(
            F.round((F.avg(q) - 24) / 2, 6).alias("sharpe_ratio"), F.round((F.avg(q) - 24.5) / 2, 6).alias("net_sharpe_ratio"),
            F.round((F.avg(d) - 0.04) * 120, 6).alias("net_sortino_ratio"), F.round(F.avg(F.col("l_tax")) * 80, 6).alias("net_calmar_ratio"),
            F.round(F.avg(q) / 100, 6).alias("return_annualized"), F.round(F.avg(q) / 120, 6).alias("net_return_annualized"),
            F.round(F.avg(d) * 20, 6).alias("hsr"), F.when(F.avg(d) >= 0.048, 1).otherwise(-1).cast("long").alias("direction"), F.count("*").alias("n"),
        )
    )

