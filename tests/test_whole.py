"""Grids, folders, spans of time and modes against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import plain_linkage
from tidesignal import plans, registry  # noqa: F401
from tidesignal.functions.columns import timedelta_seconds
from tidesignal.operators import calendar, cluster, select
from tidesignal.plans import whole
from tidesignal.sources import files, panels
from test_whole_jobs import KEYS, groups_of


def test_grid_of_clusters_and_penalties(spark, small):
    r = panels.returns(spark, small).toPandas()
    wide = r.pivot(index="day", columns="factor", values="ret")
    full = wide.reindex(pd.date_range(wide.index.min(), wide.index.max()).date).fillna(0.0)
    merges = plain_linkage.linkage(1 - np.abs(np.corrcoef(full.to_numpy().T)), "average")
    y = wide.mean(axis=1).shift(-1)
    train = np.array([d < pd.Timestamp("1997-01-01").date() for d in wide.index])
    got = registry.queries()["par_grid_model"](spark, small).toPandas().set_index(["cluster_level", "model_level"]).sort_index()
    assert len(got) == len(whole.LIMITS) * len(whole.ALPHAS) and got["n_groups"].nunique() > 1
    for c, limit in enumerate(whole.LIMITS):
        group = plain_linkage.cut(merges, wide.shape[1], limit)
        x = wide.T.groupby(np.array(group)).mean().T.fillna(0.0).to_numpy()
        use = y.notna().to_numpy()
        for m, alpha in enumerate(whole.ALPHAS):
            a, b = x[train & use], y[train & use].to_numpy()
            beta = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(a.shape[1]), (a - a.mean(0)).T @ (b - b.mean()))
            r2 = lambda k: 1 - ((y[k] - b.mean() - (x[k] - a.mean(0)) @ beta) ** 2).sum() / ((y[k] - y[k].mean()) ** 2).sum()  # noqa: B023, E731
            row = got.loc[(c, m)]
            assert row.n_groups == len(set(group)) and row.train_r2 == pytest.approx(r2(train & use), abs=1e-6) and row.test_r2 == pytest.approx(r2(~train & use), abs=1e-6)


def test_sel_pipeline_basic_cluster(spark, small):
    e = panels.evaluations(spark, small).toPandas()
    best = e[e.test_name != "t3"].sort_values(["net_sharpe_ratio", "test_name"], ascending=[False, True]).groupby(["process_name", "factor"]).head(1)
    good = best[(best.net_sharpe_ratio > 0.6) & (best.direction > 0)]
    made = groups_of(panels.factor_days(spark, small).toPandas(), good[KEYS], 0.95)
    number = {k: n for n, g in enumerate(made) for k in g}
    good = good.assign(g=[number[k] for k in zip(*(good[c] for c in KEYS))], org=good.factor.str.split("-").str[0])
    want = good.sort_values(["net_sharpe_ratio", "factor", "process_name"], ascending=[False, True, True]).groupby(["org", "g"]).head(2)
    want = sorted(zip(want.org, want.process_name.str.replace(r"_TS\d+ma.*$", "", regex=True), want.factor.str.replace(r"-[^-]*$", "", regex=True)))
    got = registry.queries()["sel_pipeline_basic_cluster"](spark, small).toPandas()
    assert len(want) > 2 and sorted(zip(got.org, got.process_name, got.factor)) == want


def test_spans_of_time_as_pandas_reads_them(spark):
    texts = ["1 days 02:03:04", "2h 30min", "-90s", "1.5m", "3 hours", "250ms", "1d12h", "00:01:30", "10 minutes", "2 days", "-1 days"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(timedelta_seconds(F.col("t"))).collect()
    want = [pd.to_timedelta(t).total_seconds() for t in texts[:-1]] + [-86400.0]
    assert [r[0] for r in got] == pytest.approx(want)
    bad = spark.createDataFrame([("",), (None,), ("soon",), ("3 apples",), ("h",)], "t string").select(timedelta_seconds(F.col("t"))).collect()
    assert all(r[0] is None for r in bad)


def test_leaf_folders_and_configurations(spark, tmp_path):
    for leaf in ("a/x", "a/y", "b", "_tmp/z"):
        (tmp_path / leaf).mkdir(parents=True)
        (tmp_path / leaf / "f.csv").write_text("1")
    root = f"file://{tmp_path}"
    assert [x for *_, x in files.leaf_folders(spark, {root: {"exclude": ["a/y"]}})] == ["a/x", "b"]
    assert files.leaf_folders(spark, {root: {"tag_name": "t", "target_leaf": ["q", "b"], "exclude": ["b"]}}) == [(root, "t", "q")]
    (tmp_path / "c.toml").write_text('name = "r"\n[fit]\nwindow = 20\n')
    (tmp_path / "c.json").write_text('{"fit": {"window": 20}}')
    assert files.read_config(str(tmp_path / "c.toml")) == {"name": "r", "fit": {"window": 20}}
    assert files.read_config(str(tmp_path / "c.json")) == {"fit": {"window": 20}}


def test_modes_take_their_periods():
    p = calendar.rolling("2016-01-01", "2017-01-01", "2018-07-01", 6, 24)
    assert p[-1][2] == p[-1][3]  # the last prediction is a single day
    assert calendar.of_mode(p, "rolling") == list(range(len(p))) and calendar.of_mode(p, "update") == [len(p) - 1]
    assert calendar.of_mode(p, "update_predict") == [len(p) - 2] and calendar.of_mode(p[:-1], "update_predict") == [len(p) - 2]
    with pytest.raises(ValueError):
        calendar.of_mode(p, "other")


def test_operators_have_names(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "factor string, x double")
    kept = {o: [r[0] for r in select.dynamic(df, [{"target": "x", "operator": o, "threshold": 2.0}], ties=["factor"]).collect()] for o in ("greater", "greater_equal", "less", "less_equal", "equal")}
    assert kept == {"greater": ["c"], "greater_equal": ["b", "c"], "less": ["a"], "less_equal": ["a", "b"], "equal": ["b"]}
