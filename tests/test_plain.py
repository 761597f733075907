"""Queries without a SQL twin against plain versions, and tables in a database."""

import itertools
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import oracle
import plain_linkage
from tidesignal import plans, registry  # noqa: F401
from tidesignal.operators import cluster, models, scaling
from tidesignal.plans import whole
from tidesignal.plans.models import _fit, _matrix
from tidesignal.sources import jdbc, panels


def filled(r):
    """Factor to its daily returns over the whole calendar, missing days as 0."""
    days = pd.date_range(r.day.min(), r.day.max()).date
    return {f: [dict(zip(g.day, g.ret)).get(d, 0.0) for d in days] for f, g in r.groupby("factor")}


def merged(series, limit):
    """Groups by average linkage, from the definition: the mean distance of all pairs between two groups, merged while it is within the limit."""
    dist = {frozenset(p): 1 - abs(statistics.correlation(series[p[0]], series[p[1]])) for p in itertools.combinations(sorted(series), 2)}
    made = [{f} for f in sorted(series)]
    while len(made) > 1:
        far = {(i, j): statistics.mean(dist[frozenset((a, b))] for a in made[i] for b in made[j]) for i, j in itertools.combinations(range(len(made)), 2)}
        (i, j), least = min(far.items(), key=lambda x: x[1])
        if least > limit:
            break
        made[i] |= made.pop(j)
    return {frozenset(g) for g in made}


def test_cl_linkage(spark, small):
    want = merged(filled(panels.returns(spark, small).toPandas()), 0.97)
    got = registry.queries()["cl_linkage"](spark, small).toPandas()
    assert 1 < len(want) and {frozenset(g.factor) for _, g in got.groupby("group")} == want
    assert sorted(got.group.unique()) == list(range(1, len(want) + 1))


def test_agg_cluster_count_period(spark, small):
    r = panels.returns(spark, small).toPandas()
    got = registry.queries()["agg_cluster_count_period"](spark, small).toPandas().set_index("period")
    for name, first, last in whole._SELECTED:
        part = r[(r.day >= pd.Timestamp(first).date()) & (r.day <= pd.Timestamp(last).date())]
        assert tuple(got.loc[name, ["factors", "groups"]]) == (part.factor.nunique(), len(merged(filled(part), 0.9)))


def test_ev_corr_dedup(spark, small):
    r = panels.returns(spark, small).toPandas()
    series, kept = filled(r), []
    for f in sorted(series, key=lambda f: (-r[r.factor == f].ret.sum(), f)):
        if all(abs(statistics.correlation(series[f], series[k])) <= 0.02 for k in kept):
            kept.append(f)
    got = registry.queries()["ev_corr_dedup"](spark, small).toPandas().sort_values("place")
    assert 1 < len(kept) < len(series) and list(got.factor) == kept and list(got.place) == list(range(len(kept)))


def fit_by_hand(y, lags, skip):
    """Rows one by one, Gauss on the normal equations: t value of the level, squared error, rows."""
    rows = [([y[t], *(y[t - k + 1] - y[t - k] for k in range(1, lags + 1)), 1.0], y[t + 1] - y[t]) for t in range(skip, len(y) - 1)]
    x, d = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ d
    left = sum((b - sum(u * v for u, v in zip(a, beta))) ** 2 for a, b in rows)
    return beta[0] / math.sqrt(inv[0, 0] * left / (len(rows) - len(beta))), left, len(rows)


def adf_by_hand(y):
    most = min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2)
    score = {}
    for k in range(most + 1):
        _, left, n = fit_by_hand(y, k, most)
        like = -n / 2 * (math.log(2 * math.pi) + math.log(left / n) + 1)
        score[k] = 2 * (k + 2) - 2 * like
    k = min(score, key=score.get)
    return fit_by_hand(y, k, k)[0], k


def test_ev_adf(spark, small):
    b = panels.bars(spark, small).toPandas()
    got = registry.queries()["ev_adf"](spark, small).toPandas().set_index("symbol")
    for s, g in b.groupby("symbol"):
        t, k = adf_by_hand(g.sort_values("bar_ts").price.dropna().tolist())
        assert got.loc[s, "statistic"] == pytest.approx(t, abs=1e-4) and got.loc[s, "lags"] == k and got.loc[s, "stationary"] == (t < -2.8615)


def test_unit_roots_walks_and_odd_series(spark, monkeypatch):
    rng = np.random.default_rng(5)
    noise, walk, far = rng.normal(size=400), np.cumsum(rng.normal(size=400)), 1e6 + np.cumsum(rng.normal(size=333))
    series = {"noise": noise, "walk": walk, "far": far, "one": [1.0], "three": [1.0, 2.0, 3.0], "flat": [4.0] * 50, "none": [None, float("nan")]}
    monkeypatch.setattr(models, "ADF_BLOCK", 64)  # many blocks a series
    monkeypatch.setattr(models, "ADF_CONTEXT", 32)
    rows = [(s, k, None if v is None else float(v)) for s, x in series.items() for k, v in enumerate(x)] + [(None, 0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, k long, v double")
    got = {r["symbol"]: r for r in models.stationary(df, "v", "symbol", "k").collect()}
    assert got.keys() == series.keys()
    assert got["noise"]["p_value"] < 1e-6 and got["noise"]["stationary"] and got["walk"]["p_value"] > 0.05 and not got["walk"]["stationary"]
    for s in ("noise", "walk", "far"):
        t, lags = adf_by_hand([float(v) - 1e6 * (s == "far") for v in series[s]])
        assert got[s]["statistic"] == pytest.approx(t, abs=1e-5) and got[s]["lags"] == lags
    for s in ("one", "three", "flat", "none"):
        assert got[s]["statistic"] is None and got[s]["p_value"] == 1.0 and not got[s]["stationary"]
    assert models.stationary(df.limit(0), "v", "symbol", "k").count() == 0
    # the published critical values are where the p-value passes their level
    assert [models.adf_p_value(models.ADF_CRITICAL[x][0]) for x in (0.01, 0.05, 0.1)] == pytest.approx([0.01, 0.05, 0.1], abs=5e-4)



def test_change_points_against_all_segmentations():
    rng = np.random.default_rng(11)
    for n, least, penalty in [(9, 1, 0.5), (10, 2, 0.3), (11, 3, 1.0), (12, 2, 50.0)]:
        y = rng.normal(size=n) + np.repeat([0, 3, -2], [n // 3, n // 3, n - 2 * (n // 3)])
        best = math.inf, None
        for k in range(n):
            for inner in itertools.combinations(range(1, n), k):
                ends = [*inner, n]
                parts = [y[a:b] for a, b in zip([0, *inner], ends)]
                if min(map(len, parts)) >= least:
                    best = min(best, (sum(((p - p.mean()) ** 2).sum() for p in parts) + penalty * k, ends))
        assert models.change_points(y, penalty, least) == best[1]


def test_ep_regime(spark, small):
    b = panels.bars(spark, small).toPandas().sort_values(["symbol", "bar_ts"])
    got = registry.queries()["ep_regime"](spark, small).toPandas().set_index(["symbol", "ts"])["label"]
    assert len(got) == len(b)
    for (s, _), g in b.groupby(["symbol", b.bar_ts.dt.to_period("M")]):
        y = [math.log(v) for v in g.price.interpolate(limit_direction="both")]
        z = (np.array(y) - statistics.mean(y)) / statistics.pstdev(y)
        n, least, penalty = len(y), 5, 10.0
        best = {0: (0.0, [])}  # without pruning
        for t in range(least, n + 1):
            best[t] = min((best[a][0] + ((z[a:t] - z[a:t].mean()) ** 2).sum() + penalty, [*best[a][1], t]) for a in best if t - a >= least)
        ends = best[n][1]
        moves = [0.0] + [q - p for p, q in zip(y, y[1:])]
        spans = list(zip([0, *ends[:-1]], ends))
        vol = [statistics.pstdev(moves[i:j]) for i, j in spans]
        slope = [abs(statistics.linear_regression(range(j - i), y[i:j]).slope) for i, j in spans]
        for (i, j), v, m in zip(spans, vol, slope):
            label = ("High" if v > statistics.median(vol) else "Low") + "_Vol_" + ("Trend" if m > statistics.median(slope) else "Range")
            for at, p in zip(g.bar_ts.iloc[i:j], g.price.iloc[i:j]):
                assert got[s, at.strftime("%Y-%m-%d %H:%M:%S")] == ("Unknown" if p != p else label)


def test_md_lasso(spark, small):
    m = _fit(spark, small).select("g1", "g2", "y").toPandas().to_numpy(float)
    x, y = m[:, :2] - m[:, :2].mean(0), m[:, 2] - m[:, 2].mean()
    beta = np.zeros(2)
    for _ in range(5000):  # coordinate descent on half the mean squared error plus 1e-4 times the absolute values
        for k in range(2):
            rest = y - x @ beta + x[:, k] * beta[k]
            c = x[:, k] @ rest / len(y)
            beta[k] = math.copysign(max(abs(c) - 1e-4, 0), c) / (x[:, k] @ x[:, k] / len(y))
    got = registry.queries()["md_lasso"](spark, small).first()
    assert (got.b1, got.b2) == pytest.approx(tuple(beta), abs=2e-5)
    assert got.intercept == pytest.approx(m[:, 2].mean() - m[:, :2].mean(0) @ beta, abs=2e-5)


def test_md_ranker_linear(spark, small):
    labelled = models.rank_labels(_fit(spark, small).drop("features"), "y", "bar_ts", 4).select("symbol", "bar_ts", "g1", "g2", "label").toPandas()
    d = []
    for _, g in labelled.groupby("bar_ts"):
        rows = sorted(g[["label", "symbol", "g1", "g2"]].values.tolist())
        d += [(rows[i][2] - rows[i - k][2], rows[i][3] - rows[i - k][3]) for k in (1, 2, 4, 8, 16) for i in range(k, len(rows)) if rows[i][0] > rows[i - k][0]]
    d = np.array(d)
    w = np.zeros(2)
    for _ in range(50):  # Newton; a pair and its reverse cost the same
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-4 * np.eye(2), -(d.T @ p) / len(d) + 1e-4 * w)
    x = _matrix(spark, small).select("symbol", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "g1", "g2").toPandas().set_index(["symbol", "ts"])
    got = registry.queries()["md_ranker_linear"](spark, small).toPandas().set_index(["symbol", "ts"])["score"]
    assert len(got) == len(x) and (got - (x.g1 * w[0] + x.g2 * w[1])).abs().max() < 5e-5


def test_gbm_importances_count_splits(spark, small):
    m = _fit(spark, small)
    model = models.boosted(2, 2).fit(m)
    got = models.importances(model, ["g1", "g2"])
    inner = sum((t.numNodes - 1) // 2 for t in model.trees)  # every inner node splits once
    assert sum(k for _, k, _ in got) == inner > 0 and sum(g for *_, g in got) == pytest.approx(1)


@pytest.mark.parametrize("method, query", [("minmax_his", "scl_minmax_his"), ("zscore_his", "scl_zscore_his"), ("percentile_adj", "scl_adj_pct"), ("percentile_zero", "scl_pct_adj"), ("rolling_percentile", "scl_rolling_pct")])
def test_scl_dispatch_moves_each_scaler(spark, small, method, query):
    assert set(scaling.SCALERS) >= {method}
    want = oracle.connect(small).execute(f"SELECT symbol, ts, (scaled - 0.5) * 2 AS scaled FROM ({registry.oracle_sql()[query]})").df()
    got = registry.queries()["scl_dispatch"](spark, small).where(F.col("method") == method).drop("method").toPandas()
    both = got.merge(want, on=["symbol", "ts"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) and (both.scaled.isna() == both.scaled_w.isna()).all()
    assert (both.scaled - both.scaled_w).abs().max() < 3e-5


def test_tables_in_a_database(spark):
    url, opts = "jdbc:derby:memory:tests;create=true", {"createTableColumnTypes": "level varchar(8)"}
    df = lambda rows: spark.createDataFrame(rows, "id long, level string, alerted int")
    jdbc.create(df([]), url, "messages", opts)
    assert jdbc.upsert(df([(1, "info", 0), (2, "warn", 0)]), url, "messages", ["id"], opts) == 2
    again = df([(2, "error", 0), (3, "info", None)])
    assert jdbc.upsert(again.unionByName(again), url, "messages", ["id"], opts) == 2  # rows that a repeated task wrote twice count once
    assert jdbc.mark(df([(1, "", 0), (9, "", 0)]), url, "messages", "alerted") == 1
    assert sorted(map(tuple, jdbc.read(spark, url, "messages").collect())) == [(1, "info", 1), (2, "error", 0), (3, "info", None)]
    open_ = jdbc.read(spark, url, "messages").where("alerted = 0 and level in ('error', 'warn')").select("id")
    assert [r[0] for r in open_.collect()] == [2] and "PushedFilters: [*IsNotNull(alerted), *EqualTo(alerted,0)" in open_._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)missing"):
        jdbc.mark(df([(1, "", 0)]), url, "missing", "alerted")


def test_a_replayed_batch_changes_nothing(spark):
    url, opts = "jdbc:derby:memory:tests;create=true", {"createTableColumnTypes": "v varchar(8)"}
    df = lambda rows: spark.createDataFrame(rows, "id long, t long, v string")
    jdbc.create(df([]), url, "latest", opts)
    jdbc.create_ledger(spark, url, "latest")
    put = lambda rows, n: jdbc.upsert_batch(df(rows), n, url, "latest", ["id"], "t", "o'neil", opts)
    assert put([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], 0)
    assert put([(1, 6, "late"), (2, 2, "d"), (3, 1, "e")], 1)
    want = [(1, 7, "b"), (2, 2, "d"), (3, 1, "e")]
    assert sorted(map(tuple, jdbc.read(spark, url, "latest").collect())) == want
    jdbc.execute(spark, url, ['DELETE FROM "latest" WHERE "id" = 2'])
    assert not put([(1, 6, "late"), (2, 2, "d"), (3, 1, "e")], 1)  # run again after its transaction
    assert sorted(map(tuple, jdbc.read(spark, url, "latest").collect())) == [w for w in want if w[0] != 2]
    with pytest.raises(Exception, match="(?i)duplicate"):  # rows and number stand or fall together
        jdbc.execute(spark, url, ['DELETE FROM "latest"', """INSERT INTO "latest_batches" VALUES ('o''neil', 1)"""])
    assert jdbc.read(spark, url, "latest").count() == 2 and put([], 2)


@pytest.mark.parametrize("seed, n, share", [(1, 12, 0.1), (2, 40, 0.04), (3, 40, 0.3), (4, 1, 0.0)])
def test_rounds_of_joins_equal_plain_passes(spark, seed, n, share):
    rng = np.random.default_rng(seed)
    names = [f"f{k:02d}" for k in range(n)]
    corr = {p: float(rng.choice([-0.9, 0.9]) if rng.random() < share else 0.1) for p in itertools.combinations(names, 2)}
    pairs = spark.createDataFrame([(*p, c) for p, c in corr.items()], "a string, b string, corr double")
    rank = rng.permutation(n).tolist()
    ranked = spark.createDataFrame(list(zip(names, rank)), "factor string, rank int")
    kept = []
    for k in np.argsort(rank):
        if all(abs(corr[tuple(sorted((names[k], x)))]) <= 0.5 for x in kept):
            kept.append(names[k])
    assert [r.factor for r in cluster.greedy_dedup(pairs, ranked, 0.5).orderBy("rank").collect()] == kept
    far = np.ones((n, n))
    for (a, b), c in corr.items():
        far[names.index(a), names.index(b)] = far[names.index(b), names.index(a)] = 1 - abs(c)
    want = plain_linkage.cut(plain_linkage.linkage(far, "single"), n, 0.5)
    got = {r.factor: r.group for r in cluster.single_linkage(pairs, ranked.select("factor"), 0.5).collect()}
    assert got == {f: names[want.index(g)] for f, g in zip(names, want)}
