"""Filters applied to alphas by name, for every alpha under every filter at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a filter's value ``v`` changes a signal ``s``; a missing ``v`` gives no signal unless the function does not use it.
APPLY: dict[str, Callable[[Column, Column], Column]] = {
    "mul": lambda s, v: s * v,
    "cond_mul": lambda s, v: F.when(s > 0, s * v).when(s < 0, s * (1 - v)).otherwise(s),
    "mask": lambda s, v: F.when(v > 0.5, s).when(v.isNotNull(), F.lit(0.0)),
}


def by_name(df: DataFrame, name: str, s: str = "s", v: str = "v", out: str = "s") -> DataFrame:
    return df.withColumn(out, APPLY[name](F.col(s), F.col(v)))


def batch(alphas: DataFrame, filters: DataFrame, names: list[str], functions: list[str], keys: list[str] = ["symbol", "bar_ts"]) -> DataFrame:
    """``alpha, filter, fn, keys, v, s``: every row of ``alphas`` under each filter of ``names`` by each function.

    ``alphas`` has ``alpha, keys, s``; ``filters`` has ``filter, keys, v``. The two lists are parameters, so an alpha's row is
    copied once for each filter and joined on (filter, keys); functions are columns of the same row, unfolded after the join.
    A filter without rows, or without a row for a bar, leaves ``v`` missing.
    """
    dealt = alphas.withColumn("filter", F.explode(F.array(*map(F.lit, names))))
    both = dealt.join(filters.select("filter", *keys, "v"), ["filter", *keys], "left")
    made = F.explode(F.array(*(F.struct(F.lit(f).alias("fn"), APPLY[f](F.col("s"), F.col("v")).alias("s")) for f in functions)))
    return both.withColumn("_m", made).select("alpha", "filter", F.col("_m.fn").alias("fn"), *keys, "v", F.col("_m.s").alias("s"))


def paired(alphas: DataFrame, pairs: DataFrame, suffixes: list[str], keys: list[str] = ["symbol", "bar_ts"]) -> DataFrame:
    """``suffix, keys, up, down, s``: a signal above zero times the pair's ``up``, one below zero times ``down``, others as they are.

    ``suffixes`` is a list of parameters: an alpha's row is copied once for each, and joined on (suffix, keys).
    """
    dealt = alphas.select(*keys, "s").withColumn("suffix", F.explode(F.array(*map(F.lit, suffixes))))
    both = dealt.join(pairs, ["suffix", *keys], "left")
    s = F.col("s")
    return both.withColumn("s", F.when(s > 0, s * F.col("up")).when(s < 0, s * F.col("down")).otherwise(s))


def summary(applied: DataFrame) -> DataFrame:
    """``alpha, filter, fn, bars, matched, ok, mean_signal``: a pair is not ``ok`` if its filter has no row for any bar."""
    got = applied.groupBy("alpha", "filter", "fn").agg(F.count("*").alias("bars"), F.count("v").alias("matched"), F.avg("s").alias("mean_signal"))
    return got.withColumn("ok", F.col("matched") > 0)
