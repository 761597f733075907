"""Blocked correlations and distributed average linkage against whole matrices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_linkage
from tidesignal.operators import cluster


def _series(spark, n, days, seed=0, offset=0.0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(max(2, n // 4), days))
    x = base[r.integers(0, len(base), n)] * r.choice([-1, 1], n)[:, None] + r.normal(size=(n, days)) * 0.7 + offset
    x[r.random(x.shape) < 0.1] = 0.0
    first = dt.date(2020, 1, 1)
    rows = [(f"f{i:03d}", first + dt.timedelta(days=k), float(x[i, k])) for i in range(n) for k in range(days) if x[i, k] != 0.0 or k in (0, days - 1)]
    return spark.createDataFrame(rows, "factor string, day date, v double"), x


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_blocked_correlations(spark, monkeypatch, offset):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    monkeypatch.setattr(cluster, "DAYS", 13)
    df, x = _series(spark, 41, 60, offset=offset)
    x[7] = 0.0
    df = df.where("factor <> 'f007'")
    names = df.select("factor").distinct().union(spark.createDataFrame([("f007",)], "factor string"))
    got = {(r["a"], r["b"]): r["corr"] for r in cluster.correlations(df, names, cluster.calendar(df)).collect()}
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x)
    assert len(got) == 41 * 40 // 2
    for (a, b), c in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert i < j and (c is None if 7 in (i, j) else c == pytest.approx(want[i, j], abs=1e-7))


def test_a_limit_and_parts_are_applied_inside(spark):
    df, x = _series(spark, 30, 50)
    names = df.select("factor").distinct()
    want = np.abs(np.corrcoef(x))
    near = cluster.correlations(df, names, cluster.calendar(df), keep=lambda c: np.abs(c) > 0.4).collect()
    assert {(r["a"], r["b"]) for r in near} == {(f"f{i:03d}", f"f{j:03d}") for i in range(30) for j in range(i + 1, 30) if want[i, j] > 0.4}
    parts = names.withColumn("part", F.when(F.col("factor") < "f020", F.substring("factor", 4, 1)))
    got = cluster.correlations(df, parts, cluster.calendar(df)).collect()
    assert {(r["a"], r["b"]) for r in got} == {(f"f{i:03d}", f"f{j:03d}") for i in range(20) for j in range(i + 1, 20) if i % 10 == j % 10}
    plan = cluster.correlations(df, names, cluster.calendar(df))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "factor string, day date, v double")
    names = spark.createDataFrame([("a",)], "factor string")
    assert cluster.correlations(none, names, cluster.calendar(none)).count() == 0
    one = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "factor string, day date, v double")
    assert [tuple(r) for r in cluster.groups(one, names, 0.5).collect()] == [("a", 1)]


def test_average_linkage_equals_the_sequential_one_on_200_matrices(spark):
    r = np.random.default_rng(7)
    pairs, want, limit = [], {}, 0.6
    for m in range(200):
        n = int(r.integers(2, 14))
        d = r.random((n, n))
        d = (d + d.T) / 2
        name = lambda i: f"m{m:03d}-{i:02d}"
        pairs += [(name(i), name(j), float(1 - d[i, j])) for i in range(n) for j in range(i + 1, n)]
        for i, g in enumerate(plain_linkage.cut(plain_linkage.linkage(d), n, limit)):
            want[name(i)] = (m, g)
    names = spark.createDataFrame([(k,) for k in want], "factor string")
    got = {x["factor"]: x["group"] for x in cluster.average_linkage(spark.createDataFrame(pairs, "a string, b string, corr double"), names, limit).collect()}
    of, wanted = {}, {}
    for k in want:
        of.setdefault(got[k], set()).add(k)
        wanted.setdefault(want[k], set()).add(k)
    assert sorted(map(sorted, of.values())) == sorted(map(sorted, wanted.values()))
    first = [min(of[g]) for g in sorted(of)]
    assert sorted(of) == list(range(1, len(of) + 1)) and first == sorted(first)


def test_groups_of_series(spark):
    df, x = _series(spark, 60, 80, seed=3)
    got = {r["factor"]: r["group"] for r in cluster.groups(df, df.select("factor").distinct(), 0.5).collect()}
    want = plain_linkage.cut(plain_linkage.linkage(1 - np.abs(np.corrcoef(x))), 60, 0.5)
    assert [got[f"f{i:03d}"] for i in range(60)] == want and 1 < max(want) < 60


def test_more_factors_than_a_matrix_on_the_driver_would_hold(spark):
    r = np.random.default_rng(1)
    day = F.expr("date_add(date'2024-01-01', d)")
    df = spark.range(2500).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("factor"), F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("d"))
    df = df.select("factor", day.alias("day"), (F.hash("d", (F.col("id") / 3).cast("long")) / 2.0**31 + F.hash("id", "d") / 2.0**36).alias("v"))
    got = cluster.groups(df, df.select("factor").distinct(), 0.2)
    assert got.count() == 2500 and abs(got.agg(F.max("group")).first()[0] - 834) <= 2, r
