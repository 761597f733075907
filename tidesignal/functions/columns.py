"""Column helpers. NaN never enters a plan: missing is NULL, division by zero is NULL, clips keep NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """``least``/``greatest`` skip nulls, so a null is kept apart."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def side_clip(x: Column, choice: str) -> Column:
    """The whole signal, its positive part or its negative part."""
    if choice == "pos":
        return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    if choice == "neg":
        return F.when(x.isNotNull(), F.least(x, F.lit(0.0)))
    return x


def missing_to_null(x: Column, infinite: bool = True) -> Column:
    """NaN, and infinities if asked, become NULL."""
    bad = F.isnan(x) | ((F.abs(x) == F.lit(float("inf"))) if infinite else F.lit(False))
    return F.when(~bad, x)


def band_to_middle(x: Column, threshold: float) -> Column:
    return F.when((x > threshold) & (x < 1 - threshold), F.lit(0.5)).otherwise(x)


def vol_gate(vol: Column, k: float, level: float) -> Column:
    """Rises with volatility, one half at ``level``."""
    return 1 / (1 + F.exp(-k * (vol - level)))


def trend_gate(score: Column, k: float, level: float) -> Column:
    """Falls with the trend score, one half at ``level``."""
    return 1 / (1 + F.exp(k * (score - level)))


def soft_or(a: Column, b: Column) -> Column:
    return 1 - (1 - a) * (1 - b)


def skew_unbiased(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 2, ratio(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2))


def kurt_unbiased(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 3, ratio((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation by centred moments; NULL on constants and for pairs with a missing side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    varies = lambda c: F.stddev_pop(c) > 1e-12 * F.max(F.abs(c))  # noqa: E731  more than rounding makes of a constant
    return F.when(varies(a) & varies(b), ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def trading_minutes(text: Column) -> Column:
    """Minutes of a duration such as ``1d2h30min``; a day is one trading session of four hours."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))
    return part("d") * 240 + part("h") * 60 + part("min") + F.floor(part("s(?:$|\\D)") / 60)


def session_minutes(text: str) -> int:
    """``trading_minutes`` on the driver, for window sizes."""
    import re

    size = {"d": 240, "h": 60, "min": 1}
    parts = re.findall(r"(\d+)(d|h|min|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text}")
    seconds = sum(int(n) for n, u in parts if u == "s")
    return sum(int(n) * size[u] for n, u in parts if u != "s") + math.floor(seconds / 60)


def timedelta_seconds(text: Column) -> Column:
    """Seconds of a span such as ``1 days 02:03:04``, ``2h 30min``, ``-90s`` or ``1.5m``; NULL for any other text."""
    number, clock = r"\d+(?:\.\d+)?", r"(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?"
    units = "d|days?|h|hrs?|hours?|m|mins?|minutes?|s|secs?|seconds?|ms|millis|milliseconds?"
    whole = rf"^-?\s*(?=\S)(?:{number}\s*(?:{units})(?![a-z])\s*)*(?:{clock})?$"
    pair = F.lit(rf"({number})\s*([a-z]+)")

    def size(u: Column) -> Column:
        return F.when(u.startswith("d"), 86400.0).when(u.startswith("h"), 3600.0).when(u.startswith("s"), 1.0).when(u.startswith("ms") | u.startswith("milli"), 0.001).otherwise(60.0)

    def seconds(t: Column) -> Column:
        spans = F.zip_with(F.regexp_extract_all(t, pair, F.lit(1)), F.regexp_extract_all(t, pair, F.lit(2)), lambda n, u: n.cast("double") * size(u))
        hms = F.zip_with(F.array(*(F.regexp_extract(t, clock, k) for k in (1, 2, 3))), F.array(F.lit(3600.0), F.lit(60.0), F.lit(1.0)), lambda n, u: F.when(n != "", n.cast("double") * u).otherwise(0.0))
        total = F.aggregate(F.concat(spans, hms), F.lit(0.0), lambda a, x: a + x)
        return F.when(t.rlike(whole), F.when(t.startswith("-"), -total).otherwise(total))

    return F.transform(F.array(F.lower(F.trim(text))), seconds)[0]  # the text is worked out once
