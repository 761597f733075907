"""Trade rules: a signal becomes a position in -1, 0, 1.

The common rule has a window form (``reopening``), one sort a series and no Python. Rules with finitely many states run over stretches of a
series in parallel (``machines``). The others keep prices, extremes or counts along the series and run as one call for each (series, batch
of parameter sets): a grid spreads over tasks, and a series is copied ``BATCHES`` times at most.

Common contract: missing before the first value stays missing, later a missing bar holds the position; comparisons are strict.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import machines

NAN = float("nan")


def reopening(df: DataFrame, value: str = "s", open_at: float = 0.8, close_at: float = 0.0, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "pos") -> DataFrame:
    """Close first, then open, within one bar; exact while |close_at| <= open_at. Two window passes over one sort."""
    if abs(close_at) > open_at:
        raise ValueError("the window form needs |close_at| <= open_at; use run_rule('v0_1')")
    x = F.col(value)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(x > open_at, 1).when(x < -open_at, -1)
    marked = df.withColumn("_g", F.count(event).over(upto)).withColumn("_d", F.last(event, ignorenulls=True).over(upto)).withColumn("_seen", F.count(x).over(upto))
    left = F.coalesce(((F.col("_d") == 1) & (x < close_at)) | ((F.col("_d") == -1) & (x > -close_at)), F.lit(False))
    gone = F.max(left.cast("int")).over(Window.partitionBy(*keys, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    pos = F.when(gone == 1, 0).otherwise(F.coalesce("_d", F.lit(0))).cast("double")
    return marked.withColumn(out, F.when(F.col("_seen") > 0, pos)).drop("_g", "_d", "_seen")


def _wish(x: float, open_at: float) -> int:
    return 1 if x > open_at else -1 if x < -open_at else 0


def voted(bars: pd.DataFrame, open_at: float, close_at: float, window: int = 5, needed: int = 3) -> list[float]:
    """So many hits of a buffer of flags; while flat, a bar adds a flag for each side and drops one at most."""
    side, flat, held, out = 0, [], [], []
    for v in bars["s"].tolist():
        if not side:
            flat += [v > open_at, v < -open_at]
            flat = flat[1:] if len(flat) > window else flat
            if sum(flat) >= needed:
                side, flat = (1 if v > open_at else -1), []
        else:
            held.append(side * v < close_at)
            held = held[1:] if len(held) > window else held
            if sum(held) >= needed:
                side, held = 0, []
        out.append(float(side))
    return out


def stopped(bars: pd.DataFrame, open_at: float, close_at: float, loss: float, profit: float, trailing: bool = True, renew: bool = False) -> list[float]:
    """Price stops before the signal: a loss from entry, then a fall from the best price (or a fixed gain); ``renew`` restarts both on a new signal."""
    side, seen, entry, best, out = 0, False, 0.0, 0.0, []
    for v, p in zip(bars["s"].tolist(), bars["price"].tolist()):
        if math.isnan(v) or math.isnan(p):
            out.append(float(side) if seen else NAN)
            continue
        seen = True
        if not side:
            side = _wish(v, open_at)
            entry = best = p
        else:
            if renew and _wish(v, open_at) == side:
                entry = best = p
            best = max(best, p) if side > 0 else min(best, p)
            taken = side * p <= side * best * (1 - side * profit) if trailing else side * p >= side * entry * (1 + side * profit)
            if side * p <= side * entry * (1 - side * loss) or taken or side * v < close_at:
                side = 0
        out.append(float(side))
    return out


def reversal(bars: pd.DataFrame, threshold: float = 0.8, watch: int = 15, least: int = 3, slope: float = 0.05, hold: int = 30, retrigger: bool = False, restart: bool = False, extreme: bool = False) -> list[float]:
    """After a breach, open against it once the signal has come back faster than ``slope`` a bar, within ``watch`` bars; hold ``hold`` bars.

    ``restart``: each breach restarts the watch. ``extreme``: the slope is measured from the running extreme.
    """
    side, seen, since, at, mark, mark_at, out = 0, False, 0, None, 0.0, 0, []
    for k, v in enumerate(bars["s"].tolist()):
        if math.isnan(v):
            out.append(float(side) if seen else NAN)
            continue
        seen = True
        breach = _wish(v, threshold)
        if side and (k - since >= hold or retrigger and breach == -side):
            side, at = 0, None
        if not side:
            if at is None or restart and breach:
                if breach:
                    at, mark, mark_at = k, v, k
            else:
                sign = 1 if mark > 0 else -1
                if extreme and v * sign > abs(mark):
                    mark, mark_at = v, k
                past, base = k - at, k - (mark_at if extreme else at)
                if past > watch:
                    at = None
                elif past >= least and (base >= 1 or not extreme) and sign * v < sign * (mark - base * slope * sign):
                    side, since, at = -sign, k, None
        out.append(float(side))
    return out


def reversal_timed(bars: pd.DataFrame, threshold: float = 0.8, watch: int = 15, least: int = 3, slope: float = 0.05, slope_bars: int = 5, hold: int = 30, close_on_breach: bool = True, gap: float = 240, cooldown: float = 30, lookback: float = 5, stop: float | None = None, stop_after: int = 15, distance: float | None = None) -> list[float]:
    """``reversal`` with session gaps, a cooldown after them, a stretch free of breaches before a watch, and bars counted inclusively.

    ``stop``: least return, checked after ``stop_after`` bars. ``distance``: come back by so much from the extreme instead of by slope.
    A missing bar while flat gives a missing position.
    """
    s, price = bars["s"].tolist(), bars["price"].tolist()
    t = (bars["bar_ts"].to_numpy("datetime64[s]").astype("int64") / 60.0).tolist()
    side, since, entry, at, trigger_, mark, last, cool = 0, None, 0.0, None, 0.0, None, None, None
    out = []
    for k, v in enumerate(s):
        if math.isnan(v) or stop is not None and math.isnan(price[k]):
            out.append(float(side) if side else NAN)
            continue
        if last is not None and t[k] - last > gap:
            at, mark, cool = None, None, t[k] + cooldown
        last = t[k]
        if cool is not None:
            if t[k] < cool:
                out.append(float(side))
                continue
            cool = None
        if stop is not None and side and k - since + 1 >= stop_after:
            made = price[k] / entry - 1 if side > 0 else 1 - price[k] / entry
            if made < stop:
                side, at = 0, None
                out.append(0.0)
                continue
        breach = _wish(v, threshold)
        if side and (k - since + 1 > hold or close_on_breach and breach):
            side, at, mark = 0, None, None
        if not side:
            if at is None:
                if breach:
                    clean = True
                    j = k - 1
                    while lookback > 0 and j >= 0 and t[j] >= t[k] - lookback:
                        clean &= not _wish(s[j], threshold)
                        j -= 1
                    if clean:
                        at, trigger_, mark = k, v, v
            else:
                past, sign = k - at + 1, 1 if trigger_ > 0 else -1
                if past > watch:
                    at = mark = None
                elif distance is not None:
                    if sign * v > sign * mark:
                        mark = v
                    if sign * (mark - v) >= distance:
                        side, since, entry, at = -sign, k, price[k], None
                elif past >= least and sign * v < sign * (trigger_ - slope * min(past, slope_bars) * sign):
                    side, since, entry, at = -sign, k, price[k], None
        out.append(float(side))
    return out


#: Rules with a state that is not finite, by name; each takes the bars of one series (s, price, bar_ts) and its parameters.
RULES: dict[str, Callable[..., list[float]]] = {
    "v2": voted,
    "v4": lambda b, **k: stopped(b, **k),
    "v5": lambda b, **k: stopped(b, renew=True, **k),
    "v6": lambda b, **k: stopped(b, renew=True, trailing=False, **k),
    "rev": reversal,
    "rev1": lambda b, **k: reversal(b, restart=True, **k),
    "rev2": lambda b, **k: reversal(b, extreme=True, **k),
    "rev3": reversal_timed,
    "rev4": lambda b, **k: reversal_timed(b, **({"stop": -0.001} | k)),
    "rev5": lambda b, **k: reversal_timed(b, **({"distance": 0.2} | k)),
}


#: Groups that the parameter sets of a grid are dealt into; each gets one copy of a series.
BATCHES = 32


def run_rule(df: DataFrame, rule: str, params: list[dict], keys: list[str] = ["symbol"], order: str = "bar_ts", value: str = "s", price: str = "price", out: str = "pos") -> DataFrame:
    """Mean position over the parameter sets (missing ones skipped) of every bar: ``keys, order, out``.

    A series is copied once for each batch of parameter sets, and a batch gives one sum and count a bar, whatever its sets.
    """
    base = df.select(*keys, F.col(order).alias("bar_ts"), F.col(value).cast("double").alias("s"), F.col(price).cast("double").alias("price"))
    if rule in machines.MACHINES:
        return _mean(machines.run(base.drop("price"), rule, params, keys), keys, order, out)
    made = RULES[rule]
    batches = min(BATCHES, len(params))
    grid = base.withColumn("_batch", F.explode(F.array(*(F.lit(k) for k in range(batches)))))
    schema = T.StructType([*(base.schema[k] for k in keys), base.schema["bar_ts"], T.StructField("_sum", T.DoubleType()), T.StructField("_sets", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ts", ignore_index=True)
        each = [np.array(made(pdf, **p), float) for p in params[int(pdf["_batch"].iloc[0]) :: batches]]
        pdf["_sum"] = np.sum([np.nan_to_num(x) for x in each], axis=0)
        pdf["_sets"] = np.sum([~np.isnan(x) for x in each], axis=0)
        return pdf[[*keys, "bar_ts", "_sum", "_sets"]]

    got = grid.groupBy(*keys, "_batch").applyInPandas(run, schema)
    if batches > 1:
        got = got.groupBy(*keys, "bar_ts").agg(F.sum("_sum").alias("_sum"), F.sum("_sets").alias("_sets"))
    return _mean(got, keys, order, out)


def _mean(got: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    return got.select(*keys, F.col("bar_ts").alias(order), F.try_divide("_sum", "_sets").alias(out))
