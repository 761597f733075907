"""Filters, best tests, ranks and grid choices over evaluation tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def _above(**limits: float) -> Column:
    out = F.lit(True)
    for name, least in limits.items():
        out = out & (F.col(name) > least)
    return out


def _per_trade(least: float) -> Column:
    return ratio(F.col("net_return_annualized"), F.col("hsr")) / 245 > least


#: Fixed thresholds of the customary filters.
FILTERS: dict[str, Callable[[], Column]] = {
    "v0": lambda: _above(sharpe_ratio=2),
    "v1": lambda: _above(sharpe_ratio=2) & (ratio(F.col("return_annualized"), F.col("hsr")) > 0.145),
    "v2": lambda: _above(sharpe_ratio=1.75),
    "v3": lambda: _above(net_sharpe_ratio=1.75),
    "v4": lambda: _above(net_sharpe_ratio=1.6),
    "v5": lambda: _above(net_sortino_ratio=1.5),
    "v6": lambda: _above(net_sharpe_ratio=1.8),
    "v7": lambda: _above(net_sharpe_ratio=1.9),
    "v8": lambda: _above(net_sharpe_ratio=2.0),
    "v9": lambda: _above(net_sharpe_ratio=2.2),
    "v10": lambda: _above(net_sharpe_ratio=1.8) & _per_trade(0.001),
    "v11": lambda: _above(net_sharpe_ratio=1.8) & _per_trade(0.0012),
    "v12": lambda: _above(net_sharpe_ratio=1.8, net_calmar_ratio=2.5),
    "v13": lambda: _above(net_sharpe_ratio=1.8, net_calmar_ratio=4),
    "v14": lambda: _above(net_sharpe_ratio=1.8, net_calmar_ratio=2.5) & _per_trade(0.0012),
    "v15": lambda: _above(net_sharpe_ratio=1.8, net_calmar_ratio=4) & _per_trade(0.001),
    "v16": lambda: _above(net_sharpe_ratio=1.0, direction=0),
    "v17": lambda: _above(net_sharpe_ratio=0.9, direction=0),
    "v18": lambda: _above(net_sharpe_ratio=1.4),
}


def passing(df: DataFrame, name: str) -> DataFrame:
    return df.where(FILTERS[name]())


def passing_or_top(df: DataFrame, cond: Column, least: int, by: str, pool: Column, ties: list[str]) -> DataFrame:
    """Rows that pass; if fewer than ``least`` do, the best of the pool by ``by`` instead.

    The count and the ranking are two small aggregates: top-n is taken by TakeOrdered, not by a window over one partition.
    """
    good = df.where(cond)
    n = good.agg(F.count("*").alias("_n"))
    top = df.where(pool).orderBy(F.col(by).desc_nulls_last(), *ties).limit(least)
    return good.join(F.broadcast(n.where(f"_n >= {least}").select(F.lit(1).alias("_1"))), F.lit(True), "left_semi").unionByName(top.join(F.broadcast(n.where(f"_n < {least}").select(F.lit(1).alias("_1"))), F.lit(True), "left_semi"))


OPERATORS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
OPERATORS |= {"greater": OPERATORS[">"], "greater_equal": OPERATORS[">="], "less": OPERATORS["<"], "less_equal": OPERATORS["<="], "equal": OPERATORS["=="]}


def dynamic(df: DataFrame, conditions: list[dict], reference: Column | None = None, least: int = 0, by: str = "net_sharpe_ratio", ties: list[str] = ["test_name", "process_name", "factor"], names: Column | None = None) -> DataFrame:
    """Conditions ``target, operator, threshold``; with ``is_multiplier`` the threshold scales the reference row's value."""
    pool = df.where(names) if names is not None else df
    scaled = [c["target"] for c in conditions if c.get("is_multiplier")]
    if scaled:
        if reference is None:
            raise ValueError("multiplier thresholds need a reference row")
        ref = df.where(reference).orderBy(*ties).limit(1).select(*(F.col(t).alias(f"_ref_{t}") for t in dict.fromkeys(scaled)))
        pool = pool.crossJoin(F.broadcast(ref))  # one row
    cond = F.lit(True)
    for c in conditions:
        limit = F.lit(c["threshold"]) * F.col(f"_ref_{c['target']}") if c.get("is_multiplier") else F.lit(c["threshold"])
        cond = cond & OPERATORS[c["operator"]](F.col(c["target"]), limit)
    out = passing_or_top(pool, cond, least, by, F.lit(True), ties) if least else pool.where(cond)
    return out.select(*df.columns)


def best_test(df: DataFrame, by: str, keys: list[str] = ["process_name", "factor"], ties: list[str] = ["test_name"]) -> DataFrame:
    """The best test of each key: per column the first value that is not missing, in order of the metric."""
    order = [F.col(by).desc_nulls_last(), *ties]
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = [c for c in df.columns if c not in keys]
    got = df.select(*keys, F.row_number().over(w).alias("_k"), *(F.first(c, ignorenulls=True).over(whole).alias(c) for c in rest))
    return got.where("_k = 1").drop("_k").select(*df.columns)


def top_n(df: DataFrame, by: str, n: int, keys: list[str], ties: list[str], descending: bool = True) -> DataFrame:
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    return df.withColumn("_k", F.row_number().over(w)).where(f"_k <= {n}").drop("_k")


def neighbours_pass(grid: DataFrame, passed: str, rows: str, cols: str, keys: list[str] = []) -> DataFrame:
    """Cells that pass together with their four neighbours on the grid of distinct values; edges take themselves."""
    by_row = Window.partitionBy(*keys, cols).orderBy(rows)
    by_col = Window.partitionBy(*keys, rows).orderBy(cols)
    p = F.col(passed)
    around = [F.coalesce(f(passed, 1).over(w), p) for f in (F.lag, F.lead) for w in (by_row, by_col)]
    out = p
    for a in around:
        out = out & a
    return grid.withColumn("robust", out)


def strip_ma(process: Column, factor: Column) -> tuple[Column, Column]:
    """Process without its ``_TS…ma`` suffix, factor without its last ``-part``."""
    return F.regexp_replace(process, r"_TS\d+ma.*$", ""), F.regexp_replace(factor, r"-[^-]*$", "")
