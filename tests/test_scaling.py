"""The forms of the scalers for long frames give what the window expressions give, over the borders of their stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesignal.functions.frames import Frames
from tidesignal.operators import scaling

MORE = {"minmax_his": True, "zscore_his": True, "percentile_adj": True, "percentile_zero": True}


@pytest.mark.parametrize("name", sorted(scaling.SCALERS))
def test_long_frames_equal_window_expressions(spark, monkeypatch, name):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 230), ("b", 41), ("c", 12), ("d", 1), (None, 25)):
        for k in range(n):
            v = None if rng.random() < 0.1 else float(np.round(rng.normal(), 1))
            rows.append((s, k, v, None if rng.random() < 0.05 else float(np.round(rng.normal(), 1)), "x"))
    df = spark.createDataFrame(rows, "symbol string, bar_ts long, v double, ret double, tag string")
    args = {"window": 20} | ({"ret": "ret", "rtn_window": 5} if name in MORE else {})
    show = lambda: {(r["symbol"], r["bar_ts"]): r["scaled"] for r in scaling.SCALERS[name](df, "v", **args).select("symbol", "bar_ts", F.round("scaled", 9).alias("scaled"), "tag").collect()}
    short = show()
    monkeypatch.setattr(scaling, "NATIVE_ROWS", 5)
    monkeypatch.setattr(scaling, "SPAN_ROWS", 37)
    long = show()
    assert short.keys() == long.keys() and sum(x is not None for x in short.values()) > 100
    for k in short:
        assert short[k] == pytest.approx(long[k], abs=1e-9) if short[k] is not None else long[k] is None, (k, short[k], long[k])


def test_work_is_linear_in_rows_and_one_series_is_many_groups(spark):
    df = spark.range(6000).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_ts"), F.sin(F.col("id")).alias("v"), F.cos(F.col("id")).alias("ret"))
    got = scaling.SCALERS["percentile_adj"](df, "v", window=600, ret="ret", rtn_window=60)
    assert got.count() == 6000 and got.where("scaled is not null").count() > 5000


def test_no_task_has_a_whole_series(spark):
    df = spark.range(6000).select(F.lit("a").alias("symbol"), F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, id)").alias("bar_ts"), F.sin(F.col("id")).alias("v"), F.cos(F.col("id")).alias("ret"))
    plan = scaling.minmax_around(df, "v", "ret", 600, 60)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_span" in line for line in windows)
    got = scaling.numbered_rows(df, ["symbol"], "bar_ts").orderBy("bar_ts").select("_at").collect()
    assert [r[0] for r in got] == list(range(6000))


def test_order_statistics_of_frames():
    rng = np.random.default_rng(0)
    for n, kinds in ((1, 1), (7, 3), (200, 12), (300, 1000)):
        x = rng.integers(0, kinds, n).astype(float)
        x[rng.random(n) < 0.2] = np.nan
        f, a = Frames(x), rng.integers(0, n + 1, 400)
        z = np.maximum(a, rng.integers(0, n + 1, 400))
        level, v = rng.random(400), rng.integers(-1, kinds + 1, 400).astype(float)
        got, share = f.quantile(a, z, level), f.share(a, z, v)
        for k in range(400):
            part = x[a[k] : z[k]]
            part = part[~np.isnan(part)]
            if not len(part):
                assert np.isnan(got[k]) and np.isnan(share[k])
            else:
                assert got[k] == pytest.approx(np.quantile(part, level[k])) and share[k] == pytest.approx((part <= v[k]).mean())
    empty = Frames(np.full(3, np.nan))
    assert np.isnan(empty.quantile(np.array([0]), np.array([3]), 0.5)).all() and empty.up_to(np.array([0]), np.array([3]), np.array([1.0])).tolist() == [0]
