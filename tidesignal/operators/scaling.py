"""Rolling scalers of a signal, per group and ordered by time.

Frames are rows: the trailing ``window`` rows with the current one. Short frames stay in window expressions. A sliding frame costs its
length for every row there, so beyond ``NATIVE_ROWS`` a series is cut into stretches of ``window`` rows, each sent to a task of its own with the stretch before it. There sums are
differences of running sums and percentiles come from a wavelet matrix (``functions.frames``), so the work is linear in rows and
logarithmic in the window. Stretches are counted from the numbers of rows in spans of time, so no task has a whole series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clip, ratio
from ..functions.frames import Frames, trailing

NATIVE_ROWS = 500
#: Rows of a series are counted in spans of so many days, or units of a number that orders them.
SPAN_DAYS, SPAN_ROWS = 32, 65_536


def _frame(keys: list[str], order: str, window: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)


def _unit(x: Column, low: Column, high: Column) -> Column:
    return clip(ratio(x - low, high - low), 0.0, 1.0)


def minmax(df: DataFrame, value: str, window: int, q: float = 0.02, min_periods: int = 10, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled", native: bool | None = None) -> DataFrame:
    """(x - Q_q) / (Q_{1-q} - Q_q) of the trailing rows, clipped to 0..1; NULL for a zero range or too few values."""
    if native if native is not None else window <= NATIVE_ROWS:
        w = _frame(keys, order, window)
        level = lambda p: F.percentile(value, F.lit(p)).over(w)
        enough = F.count(value).over(w) >= min_periods
        return df.withColumn("_lo", level(q)).withColumn("_hi", level(1 - q)).withColumn(out, F.when(enough, _unit(F.col(value), F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")

    def run(pdf: pd.DataFrame) -> None:
        x = pdf[value].to_numpy(float)
        frames, at = Frames(x), trailing(len(x), window)
        low, high = (np.where(frames.count(*at) >= min_periods, frames.quantile(*at, p), np.nan) for p in (q, 1 - q))
        pdf[out] = _clipped(_over(x - low, high - low))

    return _per_group(df, window, keys, order, [out], run)


def _over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Quotient; NaN for a zero divisor."""
    return np.divide(x, y, out=np.full(len(x), np.nan), where=y != 0)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 1)


def numbered_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``_at``: the number of each row in its series, from 0.

    Rows are counted in spans of time (of the order's unit, if it is a number) and numbered inside their span; the numbers of rows in
    the spans before are a running sum over one row a span.
    """
    o = F.col(order)
    timed = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    spanned = df.withColumn("_span", F.floor((F.unix_date(o.cast("date")) if timed else o) / (SPAN_DAYS if timed else SPAN_ROWS)))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spanned.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate([*keys, "_span"])), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate([*keys, "_span"])]
    inside = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order))
    return spanned.join(sizes, same).withColumn("_at", F.col("_before") + inside - 1).select(*df.columns, "_at")


def _per_group(df: DataFrame, window: int, keys: list[str], order: str, outs: list[str], run: Callable[[pd.DataFrame], None]) -> DataFrame:
    """``outs`` that ``run`` adds to the ordered rows of a stretch; rows of the stretch before it are context only."""
    cut = numbered_rows(df, keys, order).select(*df.columns, F.floor(F.col("_at") / window).cast("int").alias("_n"))
    both = cut.withColumn("_part", F.explode(F.array(F.col("_n"), F.col("_n") + 1)))
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outs)])

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_n"] == pdf["_part"]
        if not own.any():  # beyond the end of the series
            return pd.DataFrame(columns=schema.names)
        pdf = pdf.sort_values(order, ignore_index=True)
        run(pdf)
        return pdf.loc[pdf["_n"] == pdf["_part"], schema.names]

    done = both.groupBy(*keys, "_part").applyInPandas(stretch, schema)
    return done.withColumns({o: F.nanvl(o, F.lit(None).cast("double")) for o in outs})


def _moving(df: DataFrame, sums: dict[str, Column], window: int, keys: list[str], order: str) -> DataFrame:
    """Sums over the frame as differences of running sums; for whole and half numbers, which lose nothing so."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumns({f"_r{k}": F.sum(c).over(upto) for k, c in enumerate(sums.values())})
    return run.withColumns({name: F.col(f"_r{k}") - F.coalesce(F.lag(f"_r{k}", window).over(w), F.lit(0)) for k, name in enumerate(sums)}).drop(*(f"_r{k}" for k in range(len(sums))))


def rolling_quantiles(df: DataFrame, value: str, window: int, levels: dict[str, float], keys: list[str], order: str) -> DataFrame:
    """Columns of the frame's quantiles."""
    if window <= NATIVE_ROWS:
        return df.withColumns({name: F.percentile(value, F.lit(p)).over(_frame(keys, order, window)) for name, p in levels.items()})

    def run(pdf: pd.DataFrame) -> None:
        x = pdf[value].to_numpy(float)
        frames, at = Frames(x), trailing(len(x), window)
        for name, p in levels.items():
            pdf[name] = frames.quantile(*at, p)

    return _per_group(df, window, keys, order, list(levels), run)


def minmax_by_sign(df: DataFrame, value: str, window: int, q: float = 0.02, min_periods: int = 10, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled") -> DataFrame:
    """Positive and negative values scaled apart into the upper and the lower half; zero gives NULL."""
    if window > NATIVE_ROWS:

        def run(pdf: pd.DataFrame) -> None:
            x = pdf[value].to_numpy(float)
            at = trailing(len(x), window)
            ends = []
            for side in (x > 0, x < 0):
                f = Frames(np.where(side, x, np.nan))
                ends += [np.where(f.count(*at) >= min_periods, f.quantile(*at, p), np.nan) for p in (q, 1 - q)]
            ul, uh, dl, dh = ends
            upper, lower = 0.5 + 0.5 * _over(x - ul, uh - ul), 0.5 * _over(x - dh, dl - dh)
            pdf[out] = _clipped(np.where(x > 0, upper, np.where(x < 0, lower, np.nan)))

        return _per_group(df, window, keys, order, [out], run)
    w, x = _frame(keys, order, window), F.col(value)
    up, down = F.when(x > 0, x), F.when(x < 0, x)
    level = lambda c, p: F.when(F.count(c).over(w) >= min_periods, F.percentile(c, F.lit(p)).over(w))
    upper = 0.5 + 0.5 * ratio(x - level(up, q), level(up, 1 - q) - level(up, q))
    lower = 0.5 * ratio(x - level(down, 1 - q), level(down, q) - level(down, 1 - q))
    return df.withColumn(out, clip(F.when(x > 0, upper).when(x < 0, lower), 0.0, 1.0))


def zero_share(df: DataFrame, value: str, window: int, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "zero_share") -> DataFrame:
    """Share of the frame below zero plus half of that at zero; missing rows count in the denominator."""
    x = F.col(value)
    sums = {"_hits": F.when(x < 0, 1.0).when(x == 0, 0.5).otherwise(0.0), "_known": x.isNotNull().cast("long"), "_rows": F.lit(1).cast("long")}
    return _moving(df, sums, window, keys, order).withColumn(out, F.when(F.col("_known") >= 1, F.col("_hits") / F.col("_rows"))).drop(*sums)


def quantile_at(df: DataFrame, value: str, level: str, window: int, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "centre") -> DataFrame:
    """Quantile of the frame at a level that each row brings: interpolation in the frame's sorted array."""
    if window > NATIVE_ROWS:

        def run(pdf: pd.DataFrame) -> None:
            x = pdf[value].to_numpy(float)
            pdf[out] = Frames(x).quantile(*trailing(len(x), window), pdf[level].to_numpy(float))

        return _per_group(df, window, keys, order, [out], run)
    w = _frame(keys, order, window)
    got = df.withColumn("_a", F.array_sort(F.collect_list(value).over(w)))
    at = (F.size("_a") - 1) * F.col(level)
    low = F.floor(at).cast("int")
    a, b = F.get("_a", low), F.get("_a", F.least(low + 1, F.size("_a") - 1))
    return got.withColumn(out, F.when((F.size("_a") > 0) & F.col(level).isNotNull(), a + (b - a) * (at - low))).drop("_a")


def _centre(pdf: pd.DataFrame, frames: Frames, ret: str, window: int, rtn_window: int) -> tuple[np.ndarray, np.ndarray]:
    """The lagged zero share of the returns, and the quantile of the trailing frame at it."""
    r = pdf[ret].to_numpy(float)
    a, z = trailing(len(r), window - rtn_window)
    total = lambda x: (c := np.concatenate(([0.0], np.cumsum(x))))[z] - c[a]
    with np.errstate(invalid="ignore"):
        flat = np.where(total(~np.isnan(r)) >= 1, total((r < 0) + 0.5 * (r == 0)) / np.maximum(z - a, 1), np.nan)
    lagged = np.concatenate((np.full(min(rtn_window, len(r)), np.nan), flat[: max(len(r) - rtn_window, 0)]))
    return lagged, frames.quantile(*trailing(len(r), window), lagged)


def minmax_around(df: DataFrame, value: str, ret: str, window: int, rtn_window: int, q: float = 0.02, min_periods: int = 1, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled", strict: bool = False) -> DataFrame:
    """Scaled around the value at the lagged zero share of returns.

    Below the centre the usual form lacks its offset, so it collapses to 0 after the clip; ``strict`` adds the offset.
    """
    offset = 0.5 if strict else 0.0
    if window > NATIVE_ROWS:

        def run(pdf: pd.DataFrame) -> None:
            x = pdf[value].to_numpy(float)
            frames, at = Frames(x), trailing(len(x), window)
            _, c = _centre(pdf, frames, ret, window, rtn_window)
            low, high = frames.quantile(*at, q), frames.quantile(*at, 1 - q)
            upper, lower = 0.5 + 0.5 * _over(x - c, high - c), offset + 0.5 * _over(x - c, c - low)
            pdf[out] = np.where(frames.count(*at) >= min_periods, _clipped(np.where(x > c, upper, np.where(x < c, lower, np.nan))), np.nan)

        return _per_group(df, window, keys, order, [out], run)
    flow = zero_share(df, ret, window - rtn_window, keys, order, "_z").withColumn("_z", F.lag("_z", rtn_window).over(Window.partitionBy(*keys).orderBy(order)))
    flow = quantile_at(flow, value, "_z", window, keys, order, "_c")
    x, c = F.col(value), F.col("_c")
    flow = _moving(flow, {"_known": x.isNotNull().cast("long")}, window, keys, order)
    enough = F.col("_known") >= min_periods
    flow = rolling_quantiles(flow, value, window, {"_lo": q, "_hi": 1 - q}, keys, order)
    upper = 0.5 + 0.5 * ratio(x - c, F.col("_hi") - c)
    lower = offset + 0.5 * ratio(x - c, c - F.col("_lo"))
    return flow.withColumn(out, F.when(enough, clip(F.when(x > c, upper).when(x < c, lower), 0.0, 1.0))).drop("_z", "_c", "_lo", "_hi", "_known")


def zscore_around(df: DataFrame, value: str, ret: str, window: int, rtn_window: int, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled", **kw) -> DataFrame:
    """(x - centre) / rolling deviation, then ``minmax``."""
    if window > NATIVE_ROWS:

        def run(pdf: pd.DataFrame) -> None:
            x = pdf[value].to_numpy(float)
            _, c = _centre(pdf, Frames(x), ret, window, rtn_window)
            pdf["_s"] = _over(x - c, pd.Series(x).rolling(window, min_periods=2).std().to_numpy())

        return minmax(_per_group(df, window, keys, order, ["_s"], run), "_s", window, keys=keys, order=order, out=out, **kw).drop("_s")
    w = _frame(keys, order, window)
    flow = zero_share(df, ret, window - rtn_window, keys, order, "_z").withColumn("_z", F.lag("_z", rtn_window).over(Window.partitionBy(*keys).orderBy(order)))
    flow = quantile_at(flow, value, "_z", window, keys, order, "_c").withColumn("_d", F.stddev_samp(value).over(w))
    flow = flow.withColumn("_s", ratio(F.col(value) - F.col("_c"), F.col("_d")))
    return minmax(flow, "_s", window, keys=keys, order=order, out=out, **kw).drop("_z", "_c", "_s", "_d")


def rolling_percentile(df: DataFrame, value: str, window: int, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled") -> DataFrame:
    """Share of the prior values of the frame that are at most the current one; 0 for a missing current value."""
    x = F.col(value)
    if window <= NATIVE_ROWS:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, -1)
        got = df.withColumn("_a", F.collect_list(value).over(w))
        share = ratio(F.size(F.filter("_a", lambda v: v <= x)), F.size("_a"))
        return got.withColumn(out, F.when(F.size("_a") > 0, F.coalesce(F.when(x.isNotNull(), share), F.lit(0.0)))).drop("_a")

    def run(pdf: pd.DataFrame) -> None:
        x = pdf[value].to_numpy(float)
        share = Frames(x).share(*trailing(len(x), window - 1, 1), x)
        pdf[out] = np.where(np.isnan(x) & ~np.isnan(share), 0.0, share)

    return _per_group(df, window, keys, order, [out], run)


def percentile_around(df: DataFrame, value: str, ret: str, window: int, rtn_window: int, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled") -> DataFrame:
    """Above the centre 0.5 + half the share among rows above it; below, half the share among rows below it."""
    if window > NATIVE_ROWS:

        def centre(pdf: pd.DataFrame) -> None:
            pdf["_c"] = _centre(pdf, Frames(pdf[value].to_numpy(float)), ret, window, rtn_window)[1]

        def run(pdf: pd.DataFrame) -> None:
            x, c = pdf[value].to_numpy(float), pdf["_c"].to_numpy(float)
            at = trailing(len(x), window - 1, 1)
            up, down = (Frames(np.where(side, x, np.nan)).share(*at, x) for side in (x > c, x < c))
            pdf[out] = np.where(x > c, 0.5 + 0.5 * up, np.where(x < c, 0.5 * down, np.nan))

        with_centre = _per_group(df, window, keys, order, ["_c"], centre)  # rows of the frame need their own centres, which look back as far
        return _per_group(with_centre, window, keys, order, [out], run).drop("_c")
    flow = zero_share(df, ret, window - rtn_window, keys, order, "_z").withColumn("_z", F.lag("_z", rtn_window).over(Window.partitionBy(*keys).orderBy(order)))
    flow = quantile_at(flow, value, "_z", window, keys, order, "_c")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, -1)
    x, c = F.col(value), F.col("_c")
    flow = flow.withColumn("_up", F.collect_list(F.when(x > c, x)).over(w)).withColumn("_down", F.collect_list(F.when(x < c, x)).over(w))
    share = lambda a: ratio(F.size(F.filter(a, lambda v: v <= x)), F.size(a))
    return flow.withColumn(out, F.when(x > c, 0.5 + 0.5 * share("_up")).when(x < c, 0.5 * share("_down"))).drop("_z", "_c", "_up", "_down")


def percentile_vs_zero(df: DataFrame, value: str, ret: str, window: int, rtn_window: int, keys: list[str] = ["symbol"], order: str = "bar_ts", out: str = "scaled", strict: bool = False) -> DataFrame:
    """Percentile of the value against the zero share of returns, with the same lower-half form as ``minmax_around``."""
    offset = 0.5 if strict else 0.0
    if window > NATIVE_ROWS:

        def run(pdf: pd.DataFrame) -> None:
            x = pdf[value].to_numpy(float)
            frames = Frames(x)
            z, _ = _centre(pdf, frames, ret, window, rtn_window)
            p = frames.share(*trailing(len(x), window - 1, 1), x)
            p = np.where(np.isnan(x) & ~np.isnan(p), 0.0, p)
            upper, lower = 0.5 + 0.5 * _over(p - z, 1 - z), offset + 0.5 * _over(p - z, z)
            pdf[out] = _clipped(np.where(p > z, upper, np.where(p < z, lower, np.nan)))

        return _per_group(df, window, keys, order, [out], run)
    flow = rolling_percentile(df, value, window, keys, order, "_p")
    flow = zero_share(flow, ret, window - rtn_window, keys, order, "_z").withColumn("_z", F.lag("_z", rtn_window).over(Window.partitionBy(*keys).orderBy(order)))
    p, z = F.col("_p"), F.col("_z")
    lower = offset + 0.5 * ratio(p - z, z)
    return flow.withColumn(out, clip(F.when(p > z, 0.5 + 0.5 * ratio(p - z, 1 - z)).when(p < z, lower), 0.0, 1.0)).drop("_p", "_z")


SCALERS = {"minmax": minmax, "minmax_sep": minmax_by_sign, "rolling_percentile": rolling_percentile, "minmax_his": minmax_around, "zscore_his": zscore_around, "percentile_adj": percentile_around, "percentile_zero": percentile_vs_zero}


def normalise(df: DataFrame, value: str, method: str | None, window: int, out: str = "scaled", **kw) -> DataFrame:
    """A scaler by name, moved from 0..1 to -1..1; without a method only a signal that is nowhere negative is moved."""
    if method is None:
        least = df.agg(F.min(value).alias("_m"))
        return df.crossJoin(F.broadcast(least)).withColumn(out, F.when(F.col("_m") >= 0, (F.col(value) - 0.5) * 2).otherwise(F.col(value))).drop("_m")  # one row
    if method not in SCALERS:
        raise ValueError(f"unknown scaler {method}")
    return SCALERS[method](df, value, window=window, out=out, **kw).withColumn(out, (F.col(out) - 0.5) * 2)
