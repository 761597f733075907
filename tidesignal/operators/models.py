"""Models over a tidy design matrix, unit-root test, regimes by change points."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written
from .scaling import numbered_rows


def design(panel: DataFrame, group: str, value: str, keys: list[str], names: list[str]) -> DataFrame:
    """One column a group (missing as 0), one row a key; ``features`` for pyspark.ml."""
    wide = panel.groupBy(*keys).pivot(group, names).agg(F.avg(value)).na.fill(0.0, names)
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide)


def linear(kind: str = "linear", alpha: float = 0.0, n: int = 1, spread: float = 1.0):
    """Linear, ridge or lasso. Ridge takes ``alpha`` in the scale of sums of squares: ``n`` rows, ``spread`` the label's population deviation.

    The library divides the quadratic penalty by the label's deviation, so it is multiplied in here.
    """
    if kind == "ridge":
        return LinearRegression(labelCol="y", regParam=alpha / n * spread, elasticNetParam=0.0, standardization=False, solver="normal")
    if kind == "lasso":
        return LinearRegression(labelCol="y", regParam=alpha, elasticNetParam=1.0, standardization=False)
    return LinearRegression(labelCol="y", solver="normal")


def ridge_alpha(df: DataFrame, names: list[str], alphas: list[float], keys: list[str], folds: int = 5) -> tuple[float, dict[float, float]]:
    """The alpha with the best mean R2 over contiguous folds in order of ``keys``, the first of equals, and all means.

    Folds come from row numbers within the first key and the sizes of the keys before it; each fold is one row of moments, so the
    data are read once for all alphas.
    """
    first, rest = keys[0], keys[1:]
    sizes = [(r[0], r[1]) for r in df.groupBy(first).count().orderBy(first).collect()]
    n = sum(s for _, s in sizes)
    if n < folds:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    starts, at = [], 0
    for k, s in sizes:
        starts.append((k, at))
        at += s
    offset = df.sparkSession.createDataFrame(starts, f"{first} {df.schema[first].dataType.simpleString()}, _at long")
    row = F.col("_at") + F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1
    long = n // folds + 1
    cut_at = (n % folds) * long  # the first folds have one row more
    fold = F.when(row < cut_at, F.floor(row / long)).otherwise(n % folds + F.floor((row - cut_at) / max(n // folds, 1)))
    cols = [*names, "y"]
    sums = [F.sum(F.col(a)).alias(f"s_{i}") for i, a in enumerate(cols)]
    crosses = [F.sum(F.col(a) * F.col(b)).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    got = df.join(F.broadcast(offset), first).withColumn("_fold", fold).groupBy("_fold").agg(F.count("*").alias("n"), *sums, *crosses).collect()
    p = len(names)

    def moments(r) -> tuple[float, np.ndarray, np.ndarray]:
        c = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], float)
        return float(r["n"]), np.array([r[f"s_{i}"] for i in range(p + 1)], float), c

    parts = [moments(r) for r in got]
    total = [sum(x[k] for x in parts) for k in range(3)]
    means = {}
    for alpha in alphas:
        scores = []
        for m, s, c in parts:
            tn, ts, tc = total[0] - m, total[1] - s, total[2] - c
            centred = tc - np.outer(ts, ts) / tn
            beta = np.linalg.lstsq(centred[:p, :p] + alpha * np.eye(p), centred[:p, p], rcond=None)[0]
            b = np.append(-beta, 1.0)  # y less prediction without the constant
            const = (ts[p] - ts[:p] @ beta) / tn
            left = b @ c @ b - 2 * const * (b @ s) + m * const * const
            spread = c[p, p] - s[p] * s[p] / m
            scores.append(1 - left / spread if spread > 0 else 0.0)
        means[alpha] = float(np.mean(scores))
    return max(alphas, key=lambda a: means[a]), means


def ridge_grid(panel: DataFrame, label: DataFrame, split: str, alphas: list[float]) -> DataFrame:
    """Ridge fits of all configurations and penalties: ``cluster_level, model_level, n_groups, train_r2, test_r2``.

    ``panel`` has ``config, group, day, v``, where a missing day counts as 0; ``label`` has ``day, y``. Days before ``split`` are fitted,
    the others judged. Sums of products over the days of each part are one join and aggregation for the whole grid; only these matrices,
    whose size is that of the configurations' groups, reach the driver.
    """
    days = label.select("day", F.when(F.col("day") < F.lit(split).cast("date"), "train").otherwise("test").alias("part"), "y")
    configs = F.broadcast(panel.select("config").distinct())
    fixed = days.crossJoin(configs).select("config", "day", "part", F.explode(F.array(F.struct(F.lit(-1).alias("g"), F.lit(1.0).alias("v")), F.struct(F.lit(0).alias("g"), F.col("y").alias("v")))).alias("x")).select("config", "day", "part", "x.*")
    rows = panel.select("config", "day", F.col("group").alias("g"), "v").join(days.select("day", "part"), "day").select("config", "day", "part", "g", "v").unionByName(fixed)
    a, b = (rows.select("config", "day", "part", F.col("g").alias(f"g{c}"), F.col("v").alias(f"v{c}")) for c in "ab")
    got = a.join(b, ["config", "day", "part"]).where("ga <= gb").groupBy("config", "part", "ga", "gb").agg(F.sum(F.col("va") * F.col("vb")).alias("c")).toPandas()
    out = []
    for config, rest in got.groupby("config"):
        names = sorted(set(rest["gb"]))  # the constant, the label, the groups
        at = {g: k for k, g in enumerate(names)}
        c = {part: np.zeros((len(names), len(names))) for part in ("train", "test")}
        for part, ga, gb, v in rest[["part", "ga", "gb", "c"]].itertuples(index=False):
            c[part][at[ga], at[gb]] = c[part][at[gb], at[ga]] = v
        n, s, q = c["train"][0, 0], c["train"][0, 1:], c["train"][1:, 1:]
        if not n:
            raise ValueError(f"no days before {split}")
        centred = q - np.outer(s, s) / n
        for level, alpha in enumerate(alphas):
            beta = np.linalg.lstsq(centred[1:, 1:] + alpha * np.eye(len(names) - 2), centred[1:, 0], rcond=None)[0]
            left = np.concatenate([[-(s[0] - s[1:] @ beta) / n, 1.0], -beta])  # label less prediction
            r2 = []
            for part in ("train", "test"):
                m = c[part]
                spread = m[1, 1] - m[0, 1] ** 2 / m[0, 0] if m[0, 0] else 0.0
                r2.append(float(1 - left @ m @ left / spread) if spread > 0 else None)
            out.append((int(config), level, len(names) - 2, *r2))
    return panel.sparkSession.createDataFrame(out, "cluster_level int, model_level int, n_groups int, train_r2 double, test_r2 double")


def rounds_by_folds(df: DataFrame, keys: list[str], rounds: int = 10, depth: int = 3, patience: int = 3, folds: int = 5, seed: int = 7) -> tuple[int, list[float]]:
    """Rounds of ``boosted`` with the least mean squared error over the folds, up to where ``patience`` rounds bring no better one."""
    cut_up = df.withColumn("_fold", F.pmod(F.xxhash64(*keys), F.lit(folds))).persist()
    errors = []
    try:
        for k in range(folds):
            held = cut_up.where(F.col("_fold") == k)
            if not held.isEmpty():
                errors.append(boosted(rounds, depth, seed).fit(cut_up.where(F.col("_fold") != k)).evaluateEachIteration(held, "squared"))
    finally:
        cut_up.unpersist()
    mean = [float(x) for x in np.mean(errors, axis=0)]
    best = 0
    for k, e in enumerate(mean):
        if e < mean[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1, mean


def boosted(rounds: int = 10, depth: int = 3, seed: int = 7):
    return GBTRegressor(labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed)


MODELS = {"linear": linear, "ridge": lambda **k: linear("ridge", **k), "lasso": lambda **k: linear("lasso", **k), "gbm": boosted}


def rank_labels(df: DataFrame, value: str, order: str, buckets: int, out: str = "label") -> DataFrame:
    """Cross-sectional percentile rank (ties share their mean rank), cut into equal buckets from 0."""
    w = Window.partitionBy(order)
    pct = (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(order, value)) - 1) / F.lit(2.0)) / F.count(value).over(w)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.least(F.ceil(pct * buckets - 1e-9), F.lit(buckets)).cast("int") - 1))


def ranked_pairs(df: DataFrame, names: list[str], group: str, label: str = "label", key: str = "symbol", places: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """``features, y``: differences of two rows of one group with different labels, each in both directions; ``y`` is 1 if the better is first.

    Rows stand in order of (label, key) within their group, and each meets the rows some ``places`` before it, so a group of n rows gives
    at most 2 n pairs a place, never all pairs. Rows without a label or with a missing feature take no part.
    """
    known = df.where(" and ".join(f"{c} is not null" for c in [label, *names]))
    w = Window.partitionBy(group).orderBy(label, key)
    before = [F.lag(F.struct(label, *names), k).over(w).alias(f"_b{k}") for k in places]
    met = known.select(label, *names, *before).withColumn("_b", F.explode(F.array(*(f"_b{k}" for k in places)))).where(F.col(f"_b.{label}") < F.col(label))
    both = met.withColumn("_way", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    diff = both.select(*(((F.col(c) - F.col(f"_b.{c}")) * F.col("_way")).alias(c) for c in names), (F.col("_way") > 0).cast("double").alias("y"))
    return VectorAssembler(inputCols=names, outputCol="features").transform(diff)


def ranker(penalty: float = 1e-4):
    """Pairwise linear ranker, to be fitted on ``ranked_pairs``: a row's score is the coefficients' product with its features."""
    return LogisticRegression(labelCol="y", regParam=penalty, fitIntercept=False, standardization=False, tol=1e-10, maxIter=200)


def importances(model, names: list[str]) -> list[tuple[str, int, float]]:
    """(name, splits, gain) of a boosted model's features: how often trees split on it, and its share of the gain."""
    splits = [0] * len(names)
    for k in re.findall(r"If \(feature (\d+) ", model.toDebugString):
        splits[int(k)] += 1
    return [(n, splits[k], float(model.featureImportances[k])) for k, n in enumerate(names)]


# fixed values: coefficients of the response surface for the critical values of the unit-root test with a constant
ADF_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786), 0.05: (-2.86154, -2.8903, -4.234), 0.10: (-2.56677, -1.5384, -2.809)}
# fixed values: the normal quantile of the test's p-value as a polynomial of the statistic, up to the bound and above it
ADF_P_BOUND, ADF_P_LOW, ADF_P_HIGH = -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_MIN, ADF_P_MAX = -18.83, 2.74
#: Rows of a series whose cross-moments one task adds up, and rows before them that it reads for their lags: enough for 10^12 rows.
ADF_BLOCK, ADF_CONTEXT = 32_768, 4_096


def adf_p_value(t: float) -> float:
    """Probability of a statistic as low as ``t`` under a unit root."""
    if t != t or t > ADF_P_MAX:
        return 1.0
    if t < ADF_P_MIN:
        return 0.0
    x = sum(c * t**k for k, c in enumerate(ADF_P_LOW if t <= ADF_P_BOUND else ADF_P_HIGH))
    return math.erfc(-x / math.sqrt(2)) / 2


def _moments(y: np.ndarray, first: int, most: int) -> np.ndarray:
    """Cross-moments of level, lagged differences, constant and difference of the rows from ``first`` on."""
    d, total = np.diff(y), np.zeros((most + 3, most + 3))
    for a in range(first, len(y), 4096):
        b = min(a + 4096, len(y))
        x = np.column_stack([y[a - 1 : b - 1], *(d[a - 1 - k : b - 1 - k] for k in range(1, most + 1)), np.ones(b - a), d[a - 1 : b - 1]])
        total += x.T @ x
    return total


def _solve(m: np.ndarray, lags: int) -> tuple[float, float, float]:
    """Coefficient of the level, its variance over that of the error, and the squared error, from cross-moments."""
    at = [0, len(m) - 2, *range(1, lags + 1)]
    size = np.sqrt(np.diag(m)[at])
    size[size == 0] = 1.0
    inverse = np.linalg.pinv(m[np.ix_(at, at)] / np.outer(size, size), hermitian=True)
    beta = inverse @ (m[at, -1] / size)
    left = float(m[-1, -1] - beta @ (m[at, -1] / size))
    return float(beta[0] / size[0]), float(inverse[0, 0] / size[0] ** 2), left if left > 1e-13 * m[-1, -1] else 0.0


def _statistic(m: np.ndarray, head: np.ndarray, n: int, most: int) -> tuple[float, int]:
    """t value of the level and the number of lags with the least information criterion, the fewest of equals.

    Lags are compared over the rows that have all ``most`` of them; the chosen regression also has the rows of ``head`` before these.
    """
    rows = n - 1 - most
    scores = []
    for lags in range(most + 1):
        left = _solve(m, lags)[2]
        scores.append(rows * math.log(left / rows) + 2 * (lags + 2) if left > 0 else -math.inf)
    lags = int(np.argmin(scores))
    some = [*range(lags + 1), most + 1, most + 2]
    beta, spread, left = _solve(m[np.ix_(some, some)] + _moments(head, lags + 1, lags), lags)
    var = spread * left / max(n - 1 - lags - (lags + 2), 1)
    return (beta / math.sqrt(var) if var > 0 else float("nan")), lags


def stationary(df: DataFrame, value: str, key: str, order: str, level: float = 0.05) -> DataFrame:
    """``key, statistic, p_value, lags, critical, stationary``: the unit root is rejected at ``level``; a series that fails the test is not stationary.

    The statistic is the t value of the level in the regression of differences on level, lagged differences and a constant, with up to
    12 (n / 100)^(1/4) lags. Its cross-moments are added up over blocks of a series, so no task has a whole one; a small system a
    series is left to solve. Missing values are left out; constant and very short series have no statistic; rows without a key take no part.
    """
    known = df.where(F.col(key).isNotNull())
    y = known.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_y"))
    rows = written(numbered_rows(y, ["_k"], "_o"))
    n = F.count("*")
    most = F.least(F.ceil(12 * F.pow(n / 100, 0.25)), F.floor(n / 2) - 2).cast("int")
    sizes = rows.groupBy("_k").agg(n.alias("n"), F.avg("_y").alias("mean"), F.when(F.min("_y") < F.max("_y"), most).otherwise(-1).alias("most"))
    parts = sizes.where("most >= 0").withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ADF_BLOCK).cast("int"))))
    own = F.floor(F.col("_at") / ADF_BLOCK).cast("int")
    both = F.when(F.col("_at") % ADF_BLOCK >= ADF_BLOCK - ADF_CONTEXT, F.array(own, own + 1)).otherwise(F.array(own))
    block, context = ADF_BLOCK, ADF_CONTEXT

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        y, lags, start, at = pdf["_y"].to_numpy() - pdf["mean"].iloc[0], int(pdf["most"].iloc[0]), int(pdf["_at"].iloc[0]), int(pdf["_part"].iloc[0])
        if lags >= context:
            raise ValueError(f"{lags} lags reach beyond the rows before a block")
        m = _moments(y, max(at * block, lags + 1) - start, lags)
        return pd.DataFrame({"_k": [pdf["_k"].iloc[0]], "m": [m.ravel()], "head": [y[: lags + 1] if at == 0 else None]})

    name = df.schema[key].dataType.simpleString()
    cells = rows.withColumn("_part", F.explode(both)).join(parts, ["_k", "_part"]).groupBy("_k", "_part").applyInPandas(add, f"_k {name}, m array<double>, head array<double>")
    cells = written(cells)
    sums = cells.select("_k", F.posexplode("m").alias("at", "v")).groupBy("_k", "at").agg(F.sum("v").alias("v")).groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("m"))
    heads = cells.where("head is not null").select("_k", "head")
    a, b, c = ADF_CRITICAL[level]

    def solve(batches):
        for pdf in batches:
            out = []
            for k, n, most, m, head in zip(pdf["_k"], pdf["n"].fillna(0).astype(int), pdf["most"], pdf["m"], pdf["head"]):
                t, lags = (float("nan"), 0) if m is None else _statistic(np.reshape(m, (int(most) + 3, -1)), np.asarray(head), n, int(most))
                used = max(n - 1 - lags, 0)
                p = adf_p_value(t)
                out.append((k, t, p, lags, a + b / max(used, 1) + c / max(used, 1) ** 2, p < level))
            yield pd.DataFrame(out, columns=["_k", "statistic", "p_value", "lags", "critical", "stationary"])

    every = known.select(F.col(key).alias("_k")).distinct().join(sizes, "_k", "left").join(sums, "_k", "left").join(heads, "_k", "left")
    got = every.select("_k", "n", "most", "m", "head").mapInPandas(solve, f"_k {name}, statistic double, p_value double, lags int, critical double, stationary boolean")
    return got.withColumnRenamed("_k", key)


def change_points(y: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Ends of the segments that minimise squared error plus ``penalty`` a segment; candidates that cannot win are pruned."""
    n = len(y)
    s, q = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    best, before = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    open_ = np.array([0])
    for t in range(least, n + 1):
        able = open_[t - open_ >= least]
        if len(able):
            c = best[able] + cost(able, t) + penalty
            k = int(c.argmin())
            best[t], before[t] = c[k], able[k]
            drop = set(able[c - penalty > best[t]].tolist())
            open_ = np.array([o for o in open_.tolist() if o not in drop])
        open_ = np.append(open_, t - least + 1) if t - least + 1 >= least else open_
    ends, t = [], n
    while t > 0:
        ends.append(t)
        t = int(before[t])
    return ends[::-1]


def regimes(df: DataFrame, keys: list[str], order: str, price: str, penalty: float = 10.0, least: int = 5) -> DataFrame:
    """Labels Low/High volatility x Range/Trend of segments between change points, one chunk (``keys``) a task.

    Volatility and slope of each segment are compared with their medians over the chunk's segments. Missing prices are bridged
    for the search and stay ``Unknown``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p = pdf[price].astype(float)
        filled = p.interpolate(limit_direction="both").to_numpy()
        if len(pdf) < 2 * least or np.isnan(filled).all():
            pdf["label"] = "Unknown"
            return pdf[[*keys, order, "label"]]
        y = np.log(filled)
        step = np.diff(y, prepend=y[0])
        ends = change_points((y - y.mean()) / (y.std() or 1.0), penalty, least)
        starts = [0, *ends[:-1]]
        vol = np.array([step[a:b].std() for a, b in zip(starts, ends)])
        slope = np.array([abs(np.polyfit(np.arange(b - a), y[a:b], 1)[0]) if b - a > 1 else 0.0 for a, b in zip(starts, ends)])
        label = np.repeat([("High" if v > np.median(vol) else "Low") + "_Vol_" + ("Trend" if g > np.median(slope) else "Range") for v, g in zip(vol, slope)], np.diff([0, *ends]))
        pdf["label"] = np.where(p.isna(), "Unknown", label)
        return pdf[[*keys, order, "label"]]

    schema = df.select(*keys, order).withColumn("label", F.lit(None).cast("string")).schema
    return df.select(*keys, order, price).groupBy(*keys).applyInPandas(run, schema)
