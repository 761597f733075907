"""Boosted trees against plain ones, bar by bar and pair by pair."""

import itertools
import math

import numpy as np
import pytest

from tidesignal import plans, registry  # noqa: F401
from tidesignal.operators import boosting, models
from tidesignal.plans.models import _fit, _later, _matrix


def grow(x, t, w, depth):
    """A tree by exhaustive search: the split with the least weighted squared error, down to ``depth``."""
    mean = (w * t).sum() / w.sum()
    best = (1e-12, None)
    for f in range(x.shape[1]) if depth else ():
        cuts = np.unique(x[:, f])
        for c in (cuts[1:] + cuts[:-1]) / 2:
            m = x[:, f] <= c
            gain = sum((w[s] * t[s]).sum() ** 2 / w[s].sum() for s in (m, ~m)) - (w * t).sum() ** 2 / w.sum()
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, c))
    if best[1] is None:
        return lambda z: np.full(len(z), mean)
    f, c = best[1]
    m = x[:, f] <= c
    low, high = grow(x[m], t[m], w[m], depth - 1), grow(x[~m], t[~m], w[~m], depth - 1)
    return lambda z: np.where(z[:, f] <= c, low(z), high(z))


def plain(x, held, gradient, loss, base, rounds, depth, rate, patience):
    score, losses, steps, best = np.full(len(x), base), [], [], 0
    losses.append(loss(score))
    for k in range(rounds):
        g, h = gradient(score)
        use = ~held & (h > 0)
        steps.append(rate * grow(x[use], g[use] / h[use], h[use], depth)(x))
        score = score + steps[-1]
        losses.append(loss(score))
        if losses[-1] < losses[best]:
            best = k + 1
        elif k + 1 - best >= patience:
            break
    return base + sum(steps[:best], np.zeros(len(x))), best, losses


def test_regression_equals_plain_boosting(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 2))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) + 0.3 * r.normal(size=400)
    held = np.arange(400) >= 300
    rows = [(k, *map(float, x[k]), float(y[k]), bool(held[k])) for k in r.permutation(400).tolist()]
    df = spark.createDataFrame(rows, "k long, g1 double, g2 double, y double, later boolean")
    model = boosting.regression(df, ["g1", "g2"], validation="later", rounds=4, depth=2, rate=0.5, patience=2, bins=512)
    want, best, losses = plain(x, held, lambda s: (y - s, np.ones(400)), lambda s: np.mean((y - s)[held] ** 2), y[~held].mean(), 4, 2, 0.5, 2)
    got = [v[0] for v in df.orderBy("k").select(model.score()).collect()]
    assert len(model.trees) == best and model.losses == pytest.approx(losses) and got == pytest.approx(want)
    inner = sum(n.left >= 0 for t in model.trees for n in t)
    assert sum(k for _, k, _ in model.importances()) == inner > 0 and sum(g for *_, g in model.importances()) == pytest.approx(1)


def test_a_label_without_signal_stops_early(spark):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(float(a), float(b), k >= 100) for k, (a, b) in enumerate(r.normal(size=(160, 2)))], "g1 double, y double, later boolean")
    model = boosting.regression(df, ["g1"], validation="later", rounds=9, patience=2)
    assert len(model.losses) <= 6 and len(model.trees) <= 3


def pairs(label, score):
    """Gradients of a group from each pair; ``label`` and ``score`` in the order of keys."""
    n = len(label)
    place = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (-score[i], i)))}
    most = sum((2**v - 1) / math.log2(k + 2) for k, v in enumerate(sorted(label, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i, j in itertools.permutations(range(n), 2):
        if most > 0 and label[i] > label[j]:
            wrong = 1 / (1 + math.exp(score[i] - score[j]))
            swap = abs((2 ** label[i] - 2 ** label[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / most
            g[i], g[j] = g[i] + swap * wrong, g[j] - swap * wrong
            h[i], h[j] = h[i] + swap * wrong * (1 - wrong), h[j] + swap * wrong * (1 - wrong)
    return g, h


@pytest.mark.parametrize("at_once", [2, 1024])
def test_gradients_of_a_group(monkeypatch, at_once):
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", at_once)
    r = np.random.default_rng(0)
    for n in (1, 2, 7):
        label, score = r.integers(0, 4, n).astype(float), np.round(r.normal(size=n), 1)
        got, want = boosting.lambdas(label, score), pairs(label.tolist(), score.tolist())
        assert got[0] == pytest.approx(np.array(want[0])) and got[1] == pytest.approx(np.array(want[1]))


def test_ranking_equals_plain_boosting(spark):
    r = np.random.default_rng(4)
    x, n = r.normal(size=(400, 2)), 400
    group = np.arange(n) // 8
    label = np.clip(np.round(x[:, 0] - 0.5 * x[:, 1] + 1.5 + 0.3 * r.normal(size=n)), 0, 3)
    held = group >= 40
    df = spark.createDataFrame([(int(group[k]), f"k{k:03d}", *map(float, x[k]), float(label[k]), bool(held[k])) for k in range(n)], "t int, symbol string, g1 double, g2 double, label double, later boolean")
    model = boosting.ranking(df, ["g1", "g2"], "t", validation="later", rounds=4, depth=1, rate=0.5, patience=2, bins=512)
    each = [np.flatnonzero(group == k) for k in range(50)]

    def gradient(s):
        g, h = np.zeros(n), np.zeros(n)
        for rows in each:
            g[rows], h[rows] = pairs(label[rows].tolist(), s[rows].tolist())
        return g, h

    loss = lambda s: -np.mean([boosting.ndcg(label[rows], s[rows]) for rows in each[40:]])
    want, best, losses = plain(x, held, gradient, loss, 0.0, 4, 1, 0.5, 2)
    got = [v[0] for v in df.orderBy("symbol").select(model.score()).collect()]
    assert len(model.trees) == best > 0 and model.losses == pytest.approx(losses) and got == pytest.approx(want, abs=1e-9)


def test_trees_rank_what_a_line_cannot(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 2))
    label = np.digitize(np.abs(x[:, 0]) + 0.2 * x[:, 1], [0.4, 0.8, 1.4]).astype(float)
    df = spark.createDataFrame([(k // 10, f"s{k % 10}", *map(float, x[k]), float(label[k]), k >= 400) for k in range(600)], "t int, symbol string, g1 double, g2 double, label double, later boolean")
    model = boosting.ranking(df, ["g1", "g2"], "t", validation="later", rounds=8, rate=0.5)
    line = models.ranker().fit(models.ranked_pairs(df.where("not later"), ["g1", "g2"], "t")).coefficients
    both = df.where("later").withColumn("tree", model.score()).selectExpr("*", f"g1 * {line[0]} + g2 * {line[1]} as line")
    assert boosting.mean_ndcg(both, "t", "symbol", "label", "tree") > boosting.mean_ndcg(both, "t", "symbol", "label", "line") + 0.03


def test_ndcg():
    assert boosting.ndcg(np.array([3.0, 1.0, 0.0]), np.array([9.0, 5.0, 1.0])) == 1.0 and boosting.ndcg(np.zeros(3), np.arange(3.0)) == 1.0
    assert boosting.ndcg(np.array([0.0, 1.0]), np.array([1.0, 0.0])) == pytest.approx(1 / math.log2(3))


def test_registered_queries(spark, small):
    x = _matrix(spark, small)
    for name, col in (("md_gbm", "prediction"), ("md_ranker", "score")):
        got = registry.queries()[name](spark, small)
        assert got.count() == x.count() and got.where(f"{col} is null").count() == 0
    rows = _later(_fit(spark, small)).groupBy("_later").count().collect()
    assert {r["_later"] for r in rows} == {True, False}
