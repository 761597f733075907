"""Helpers to register a query next to its SQL twin; SQL pieces that twins share."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..registry import register

#: The adapters of ``sources.panels`` as SQL.
BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts, round(avg(value), 6) AS price,
  round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS factor FROM events GROUP BY 1, 2)"""
DAILY = """daily AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice), 6) AS price, round(avg(l_quantity), 6) AS factor
  FROM lineitem GROUP BY 1, 2)"""
RETURNS = """rets AS (SELECT 's' || (l_suppkey % 12) AS factor, CAST(l_shipdate AS DATE) AS day, round((avg(l_quantity) - 25.5) / 1000, 6) AS ret, round(avg(l_discount) * 10, 6) AS turnover
  FROM lineitem GROUP BY 1, 2)"""
EVALS = """evals AS (SELECT 't' || (l_suppkey % 4) AS test_name, p_type || '_TS20ma' AS process_name, replace(p_brand, '#', '') || '-w' || (p_size % 3) || 'd-i' || (p_size % 2) AS factor,
  round((avg(l_quantity) - 24) / 2, 6) AS sharpe_ratio, round((avg(l_quantity) - 24.5) / 2, 6) AS net_sharpe_ratio, round((avg(l_discount) - 0.04) * 120, 6) AS net_sortino_ratio,
  round(avg(l_tax) * 80, 6) AS net_calmar_ratio, round(avg(l_quantity) / 100, 6) AS return_annualized, round(avg(l_quantity) / 120, 6) AS net_return_annualized,
  round(avg(l_discount) * 20, 6) AS hsr, CASE WHEN avg(l_discount) >= 0.048 THEN 1 ELSE -1 END::BIGINT AS direction, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
#: Scaled signal over 20 bars, as scl_minmax then (x - 0.5) * 2.
SIGNAL = BARS + """,
sigraw AS (SELECT *, quantile_cont(factor, 0.02) OVER w AS lo, quantile_cont(factor, 0.98) OVER w AS hi, count(factor) OVER w AS n
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sig AS (SELECT symbol, bar_ts, price, factor, CASE WHEN n >= 10 AND hi <> lo AND factor IS NOT NULL THEN round((least(greatest((factor - lo) / (hi - lo), 0), 1) - 0.5) * 2, 6) END AS s FROM sigraw)"""


def query(name: str, sql: str | None = None, head: str = "", recursive: bool = False):
    """Register ``f(spark, sf_dir)`` under ``name``; ``head`` holds the WITH clauses that go before ``sql``."""

    def add(f):
        text = None if sql is None else (f"WITH {'RECURSIVE ' if recursive else ''}{head} {sql}" if head else sql)
        register(name, f, text)
        return f

    return add


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_text(c):
    return F.date_format(c, "yyyy-MM-dd")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
DAY = "strftime({}, '%Y-%m-%d')"


@functools.lru_cache
def ts(c: str = "bar_ts") -> str:
    return STAMP.format(c)


@functools.lru_cache
def dt(c: str = "day") -> str:
    return DAY.format(c)
