"""Compositions against plain versions: clustering of chosen factors, cross-validated models, chosen trade methods."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import plain_linkage
from tidesignal import plans, registry  # noqa: F401
from tidesignal.operators import align, models, pnl, rules
from tidesignal.plans import models as jobs
from tidesignal.plans.core import FEE, signal
from tidesignal.sources import panels

KEYS = ["test_name", "process_name", "factor"]


def groups_of(days, chosen, limit):
    """0-filled daily gains of each chosen factor and its group."""
    d = days.merge(chosen, on=KEYS)
    d["key"] = list(zip(*(d[k] for k in KEYS)))
    wide = d.pivot(index="day", columns="key", values="gain")
    wide = wide.reindex(pd.date_range(wide.index.min(), wide.index.max()).date).fillna(0.0)
    wide = wide[sorted(wide.columns)]
    got = plain_linkage.cut(plain_linkage.linkage(1 - np.abs(np.corrcoef(wide.to_numpy().T)), "average"), wide.shape[1], limit)
    return {frozenset(k for k, g in zip(wide.columns, got) if g == n) for n in set(got)}


def test_cl_period_filters_three_periods_and_clusters_the_factors_themselves(spark, small):
    whole, recent, latest = (panels.evaluations(spark, small, d).toPandas().set_index(KEYS) for d in (None, "1997-01-01", "2000-01-01"))
    best = whole.reset_index().sort_values(["net_sharpe_ratio", "test_name"], ascending=[False, True]).groupby(["process_name", "factor"]).head(1)
    best = best[(best.net_sharpe_ratio > 0.9) & (best.direction > 0)]
    ok = lambda e, k: k in e.index and e.loc[k, "net_sharpe_ratio"] > 0
    want = best[[ok(recent, k) and ok(latest, k) for k in zip(*(best[c] for c in KEYS))]][KEYS]
    assert 2 < len(want) < len(best)
    got = registry.queries()["cl_period"](spark, small).toPandas()
    assert sorted(map(tuple, got[KEYS].values)) == sorted(map(tuple, want.values))
    made = {frozenset(map(tuple, g[KEYS].values)) for _, g in got.groupby("group")}
    assert made == groups_of(panels.factor_days(spark, small).toPandas(), want, 0.95)


def test_sel_pipeline_cluster(spark, small):
    whole, recent = (panels.evaluations(spark, small, d).toPandas() for d in (None, "1997-01-01"))
    both = whole[whole.net_sharpe_ratio > 0.8].merge(recent[recent.net_sharpe_ratio > 0.2][KEYS], on=KEYS)
    want = both.sort_values(["net_sharpe_ratio", "test_name"], ascending=[False, True]).groupby(["process_name", "factor"]).head(1)[KEYS]
    got = registry.queries()["sel_pipeline_cluster"](spark, small).toPandas()
    assert len(want) > 2 and sorted(map(tuple, got[KEYS].values)) == sorted(map(tuple, want.values))
    made = {frozenset(map(tuple, g[KEYS].values)) for _, g in got.groupby("group")}
    assert made == groups_of(panels.factor_days(spark, small).toPandas(), want, 0.95)


def test_ridge_alpha_by_contiguous_folds(spark):
    rng = np.random.default_rng(3)
    n = 203
    x = rng.normal(size=(n, 2))
    y = x @ [0.4, -0.2] + 1 + rng.normal(size=n) * 2
    alphas = [0.1, 1.0, 30.0, 300.0]
    want = {}
    for a in alphas:
        scores = []
        for part in np.array_split(np.arange(n), 5):  # the first parts are longer, as in the library
            rest = np.setdiff1d(np.arange(n), part)
            m, my = x[rest].mean(0), y[rest].mean()
            beta = np.linalg.solve((x[rest] - m).T @ (x[rest] - m) + a * np.eye(2), (x[rest] - m).T @ (y[rest] - my))
            left = y[part] - my - (x[part] - m) @ beta
            scores.append(1 - (left @ left) / ((y[part] - y[part].mean()) ** 2).sum())
        want[a] = np.mean(scores)
    rows = [("a" if k < 77 else "b", k, float(x[k, 0]), float(x[k, 1]), float(y[k])) for k in rng.permutation(n).tolist()]
    best, got = models.ridge_alpha(spark.createDataFrame(rows, "symbol string, t long, g1 double, g2 double, y double"), ["g1", "g2"], alphas, ["symbol", "t"])
    assert best == max(want, key=want.get) and got == pytest.approx(want)


def test_boosting_rounds_stop_where_folds_get_no_better(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(a), float(b), float(e)) for k, (a, b, e) in enumerate(rng.normal(size=(150, 3)))]
    noise = models.design(spark.createDataFrame(rows, "t long, g1 double, g2 double, y double").unpivot(["t", "y"], ["g1", "g2"], "g", "v"), "g", "v", ["t", "y"], ["g1", "g2"])
    best, errors = models.rounds_by_folds(noise, ["t"], rounds=5, patience=2)
    assert len(errors) == 5 and best == 1 and errors == sorted(errors)  # a label without signal is not fitted to the end


def test_trade_methods_are_chosen_on_the_fit_window(spark, small):
    got = jobs.method_positions(spark, small, "2024-01-15", "2024-01-20", least=-1e9).toPandas()
    s = signal(spark, small)
    net, pos = {}, {}
    for a, b in ((0.4, 0.1), (0.6, 0.2), (0.8, 0.0), (0.9, 0.5)):
        p = rules.reopening(s, open_at=a, close_at=b)
        pos[a] = p.where("bar_ts >= timestamp_ntz'2024-01-15' and bar_ts < timestamp_ntz'2024-01-20'").toPandas().set_index(["symbol", "bar_ts"])["pos"]
        known = p.where("bar_ts < timestamp_ntz'2024-01-15'")
        r = pnl.net(pnl.daily_gains(pnl.gains(pnl.forward_return(known))), pnl.turnover(known), FEE).toPandas()["net"]
        net[a] = r.mean() / r.std(ddof=0) * 245**0.5
    every = pd.concat(pos, axis=1).mean(axis=1, skipna=False)
    assert got.set_index(["symbol", "bar_ts"])["pos"].sort_index().to_numpy() == pytest.approx(every.sort_index().to_numpy(), nan_ok=True)
    limit = sorted(net.values())[1] + 1e-9  # two of four pass
    some = pd.concat({k: v for k, v in pos.items() if net[k] > limit}, axis=1).mean(axis=1, skipna=False)
    got = jobs.method_positions(spark, small, "2024-01-15", "2024-01-20", least=limit).toPandas()
    assert not some.equals(every) and got.set_index(["symbol", "bar_ts"])["pos"].sort_index().to_numpy() == pytest.approx(some.sort_index().to_numpy(), nan_ok=True)


def test_append_refuses_changed_rows(spark):
    old, same, changed = (spark.createDataFrame(r, "k int, v double") for r in ([(1, 1.0), (2, 2.0), (4, None)], [(2, 2.0), (3, 3.0)], [(2, 2.5), (3, 3.0)]))
    assert sorted(align.append(old, same, ["k"], "v").collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    with pytest.raises(ValueError, match="1 rows are inconsistent"):
        align.append(old, changed, ["k"], "v")


def test_sel_copy_without_a_factor_that_passes(spark, small, tmp_path):
    for name in ("lineitem", "part"):
        rows = panels.table(spark, small, name)
        (rows.withColumn("l_quantity", F.lit(20.0)) if name == "lineitem" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = registry.queries()["sel_copy"](spark, str(tmp_path))
    assert got.count() == 0 and got.dtypes == registry.queries()["sel_copy"](spark, small).dtypes
