"""Rules as machines over stretches against loops over whole series, bar by bar."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidesignal.operators import machines, rules

NAN = float("nan")


def _wish(x, open_at):
    return 1 if x > open_at else -1 if x < -open_at else 0


def trigger(bars: pd.DataFrame, open_at: float, close_at: float, reopen: bool = False, gap: float | None = None, at_gap: str = "none", end: str | None = None, quiet: str | None = None, longs: bool = True, shorts: bool = True) -> list[float]:
    """Open beyond +-open_at, close when the signal falls back through close_at on its side.

    ``gap`` (minutes to the next bar) and ``end`` (HH:MM) may flatten: ``rest`` gives 0 and ends the bar, ``restore`` does so and takes
    the same side again after the gap, ``pass`` flattens and goes on, ``block`` flattens and forbids opening. From ``quiet`` to ``end``
    nothing is opened.
    """
    x, when = bars["s"].to_numpy(float), bars["bar_ts"].to_numpy("datetime64[s]")
    ahead = np.append(np.diff(when).astype("timedelta64[s]").astype(float) / 60, 0.0)
    wide = ahead > gap if gap is not None else np.zeros(len(x), bool)
    clock = pd.DatetimeIndex(when).strftime("%H:%M") if end or quiet else None
    side, seen, parked, out = 0, False, 0, []
    for k, v in enumerate(x.tolist()):
        if at_gap == "restore" and k and wide[k - 1] and parked:
            side, parked = parked, 0
        last = clock is not None and end is not None and clock[k] == end
        shut = False
        if wide[k] or last:
            if side and (longs if side > 0 else shorts):
                if at_gap in ("rest", "restore"):
                    parked = side if at_gap == "restore" else 0
                    side = 0
                    out.append(0.0)
                    continue
                side = 0
            shut = at_gap == "block"
        elif quiet is not None and end is not None and quiet <= clock[k] < end:
            shut = True
        if math.isnan(v):
            out.append(float(side) if seen else NAN)
            continue
        seen = True
        held = side
        if side and side * v < close_at:
            side = 0
        if not side and not shut and (reopen or not held):
            side = _wish(v, open_at)
        out.append(float(side))
    return out


def one_sided(bars: pd.DataFrame, direction: int, open_at: float, close_at: float) -> list[float]:
    """Always in the market: ``direction`` from its opening to its closing signal, the other side else."""
    side, seen, out = -direction, False, []
    for v in bars["s"].tolist():
        if not math.isnan(v):
            seen = True
            if side == direction:
                side = -direction if direction * v < close_at else side
            elif direction * v > open_at:
                side = direction
        out.append(float(side) if seen else NAN)
    return out


def confirmed(bars: pd.DataFrame, open_at: float, close_at: float, bars_needed: int = 3) -> list[float]:
    """As many bars in a row are needed to open or to close; both sides share one count."""
    side, streak, out = 0, 0, []
    for v in bars["s"].tolist():
        hit = _wish(v, open_at) if not side else side * v < close_at
        streak = streak + 1 if hit else 0
        if streak >= bars_needed:
            side, streak = (_wish(v, open_at) if not side else 0), 0
        out.append(float(side))
    return out


def next_day(bars: pd.DataFrame, open_at: float, close_at: float) -> list[float]:
    """Long only; a closing signal acts at the next day's first bar, unless that bar opens anew."""
    side, seen, due, day, out = 0, False, False, None, []
    for v, today in zip(bars["s"].tolist(), bars["bar_ts"].dt.date):
        if today != day:
            if day is not None or due:
                if due and not v > open_at:
                    side = 0
                due = False
            day = today
        if math.isnan(v):
            out.append(float(side) if seen else NAN)
            continue
        seen = True
        if side and v < close_at:
            due = True
        if not side and v > open_at:
            side, due = 1, False
        out.append(float(side))
    return out


LOOPS = {
    "v0": trigger, "v0_1": lambda b, **k: trigger(b, reopen=True, **k), "binary": one_sided, "v1": confirmed, "v3": trigger,
    "v3_1": lambda b, **k: trigger(b, at_gap="rest", **k), "v3_2": lambda b, **k: trigger(b, at_gap="restore", **k), "v3_3": lambda b, **k: trigger(b, at_gap="pass", reopen=True, **k),
    "v3_4": lambda b, **k: trigger(b, at_gap="block", reopen=True, **k), "v3_5": lambda b, **k: trigger(b, at_gap="block", reopen=True, **k), "v3_4_t1": next_day,
}
PAIRS = [{"open_at": o, "close_at": c} for o, c in itertools.product((0.2, 0.5, 0.9), (-0.3, 0.0, 0.4))]
SETS = {
    "binary": [p | {"direction": d} for p in PAIRS for d in (1, -1)],
    "v1": [p | {"bars_needed": n} for p in PAIRS for n in (1, 2, 4)],
    "v3_1": [p | {"gap": g} for p in PAIRS for g in (90.0, 2000.0)],
    "v3_2": [p | {"gap": g, "end": e} for p in PAIRS for g, e in ((90.0, None), (200.0, "14:00"))] + [PAIRS[0] | {"gap": 90.0, "longs": False}],
    "v3_3": [p | {"gap": 90.0} for p in PAIRS],
    "v3_4": [p | {"gap": 90.0, "end": "14:00"} for p in PAIRS],
    "v3_5": [p | {"gap": 90.0, "end": "14:00", "quiet": "11:00"} for p in PAIRS],
}


def _frame(rows):
    return pd.DataFrame(rows, columns=["symbol", "bar_ts", "s"])


@pytest.fixture(scope="module")
def bars():
    r, rows = random.Random(3), []
    for symbol, n in (("a", 700), ("b", 90), ("c", 1), (None, 30)):
        t = dt.datetime(2023, 12, 28, 9)
        for _ in range(n):
            v = None if r.random() < 0.1 or len(rows) < 3 else round(r.gauss(0, 0.6), 2)
            rows.append((symbol, t, v))
            t += dt.timedelta(minutes=r.choice([60, 60, 60, 120, 300, 1500]))
    return rows


@pytest.mark.parametrize("rule", sorted(machines.MACHINES))
def test_stretches_equal_the_loop(spark, monkeypatch, bars, rule):
    monkeypatch.setattr(machines, "SPAN_DAYS", 3)
    monkeypatch.setattr(machines, "SETS", 4)
    params = SETS.get(rule, PAIRS)
    df = spark.createDataFrame(random.Random(1).sample(bars, len(bars)), "symbol string, bar_ts timestamp_ntz, s double").withColumn("price", F.lit(1.0))
    got = {(r["symbol"], r["bar_ts"]): r["pos"] for r in rules.run_rule(df, rule, params).collect()}
    want = {}
    for symbol, g in _frame(bars).groupby("symbol", dropna=False):
        each = np.array([LOOPS[rule](g.assign(s=g["s"].astype(float)).reset_index(drop=True), **p) for p in params])
        known = (~np.isnan(each)).sum(0)
        for k, t in enumerate(g["bar_ts"]):
            want[None if symbol != symbol else symbol, t.to_pydatetime()] = np.nansum(each[:, k]) / known[k] if known[k] else None
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-12), (rule, k)


def test_one_series_is_many_groups_and_one_exchange(spark):
    df = spark.range(40_000).select(F.lit("a").alias("symbol"), F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, id * 10)").alias("bar_ts"), F.sin(F.col("id")).alias("s"), F.lit(1.0).alias("price"))
    out = rules.run_rule(df, "v3", PAIRS)
    assert out.count() == 40_000 and df.select(F.floor(F.unix_date(F.col("bar_ts").cast("date")) / machines.SPAN_DAYS)).distinct().count() > 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_dates_as_time_and_an_empty_table(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), v) for k, v in enumerate([None, 0.9, 0.1, -0.1, -0.9, 0.2])]
    df = spark.createDataFrame(rows, "symbol string, bar_ts date, s double").withColumn("price", F.lit(1.0))
    got = rules.run_rule(df, "v0", [{"open_at": 0.8, "close_at": 0.0}]).orderBy("bar_ts").collect()
    assert [r["pos"] for r in got] == [None, 1, 1, 0, -1, 0]
    assert rules.run_rule(df.limit(0), "v0", PAIRS).count() == 0


def test_maps_of_stretches_compose():
    m, _ = machines.MACHINES["v3_2"](machines.Bars(np.array([0.0]), np.array(["2024-01-01"], "datetime64[us]"), None), 0.5, 0.1, gap=90.0)
    r = np.random.default_rng(0)
    used = np.flatnonzero(~np.isnan(m.output).all(1))
    codes = r.choice(used, (3, 500))
    whole = machines.exits(m.table, codes)
    parts = [machines.exits(m.table, codes[:, a : a + 71]) for a in range(0, 500, 71)]
    for k in range(3):
        at = np.arange(m.table.shape[1])
        for p in parts:
            at = p[k][at]
        assert at.tolist() == whole[k].tolist()
    total, known = machines.replay(m, codes, np.zeros(3, int))
    at = np.zeros(3, int)
    for k in range(500):
        out = m.output[codes[:, k], at]
        assert total[k] == np.nansum(out) and known[k] == (~np.isnan(out)).sum()
        at = m.table[codes[:, k], at]
