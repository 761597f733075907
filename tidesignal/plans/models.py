"""Queries for clustering, models, regimes, sources and sinks, and the streaming rule."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators import align, apply, boosting, cluster, metrics, models, pnl, rules, select
from ..sources import files, panels
from ..streaming import rule as stream
from .core import _POS, FEE, positions, signal
from .kit import BARS, EVALS, RETURNS, SIGNAL, day_text, dt, query, stamp, ts

#: Every series on every calendar day from the first to the last, missing days as 0.
_PAIRS = RETURNS + """, calendar AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM rets),
filled AS (SELECT f.factor, c.day, coalesce(r.ret, 0) AS ret FROM (SELECT DISTINCT factor FROM rets) f CROSS JOIN calendar c LEFT JOIN rets r ON r.factor = f.factor AND r.day = c.day),
pc AS (SELECT a.factor AS a, b.factor AS b, corr(a.ret, b.ret) AS c FROM filled a JOIN filled b ON a.day = b.day AND a.factor < b.factor GROUP BY 1, 2)"""


def _pairs(spark, sf):
    r = cluster.written(panels.returns(spark, sf))  # daily values, read several times
    return cluster.correlations(r, r.select("factor").distinct(), cluster.calendar(r), value="ret")


def _folder(spark) -> str:
    from pyspark import SparkFiles

    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or SparkFiles.getRootDirectory()
    return f"{base.rstrip('/')}/tide-{uuid.uuid4().hex}"


@query("jn_self_ijpairs", "SELECT a, b, round(c, 6) AS corr FROM pc", _PAIRS)
def _(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round("corr", 6).alias("corr"))


@query("cl_corr_dist", "SELECT a, b, round(1 - abs(c), 6) AS distance FROM pc UNION ALL SELECT b, a, round(1 - abs(c), 6) FROM pc UNION ALL SELECT DISTINCT factor, factor, 0.0::DOUBLE FROM rets", _PAIRS)
def _(spark, sf):
    p = _pairs(spark, sf).select("a", "b", F.round(1 - F.abs("corr"), 6).alias("distance"))
    own = panels.returns(spark, sf).select(F.col("factor").alias("a"), F.col("factor").alias("b"), F.lit(0.0).alias("distance")).distinct()
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(own)


@query("cl_gp_matrix", f"SELECT f.factor, {dt('d.day')} AS day, round(coalesce(ret, 0) * CASE WHEN f.factor IN ('s1', 's2') THEN -1 ELSE 1 END, 6) + 0 AS gp FROM (SELECT DISTINCT factor FROM rets) f CROSS JOIN (SELECT DISTINCT day FROM rets) d LEFT JOIN rets r ON r.factor = f.factor AND r.day = d.day", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf)
    full = r.select("day").distinct().crossJoin(r.select("factor").distinct()).join(r, ["factor", "day"], "left")
    return full.select("factor", day_text("day").alias("day"), (F.round(F.coalesce("ret", F.lit(0.0)) * F.when(F.col("factor").isin("s1", "s2"), -1).otherwise(1), 6) + 0).alias("gp"))


@query("cl_linkage")
def _(spark, sf):
    r = panels.returns(spark, sf)
    return cluster.groups(r, None, 0.97, value="ret")


_CHOSEN = ["test_name", "process_name", "factor"]


def _clustered(spark, sf, chosen, limit: float):
    """``chosen`` with the group of each (process, factor), by correlation of their own daily gains over all days, missing ones as 0."""
    own = panels.factor_days(spark, sf).join(chosen, _CHOSEN, "left_semi").withColumn("key", F.to_json(F.array(*_CHOSEN)))
    keyed = chosen.withColumn("key", F.to_json(F.array(*_CHOSEN)))
    g = cluster.groups(own, keyed.select("key").distinct(), limit, key="key", value="gain")
    return keyed.join(g.withColumnRenamed("factor", "key"), "key").drop("key")


def _recent(spark, sf, chosen, first: str, least: float):
    """Rows of ``chosen`` whose evaluation from ``first`` on passes too; a factor without one does not."""
    return chosen.join(panels.evaluations(spark, sf, first).where(F.col("net_sharpe_ratio") > least), _CHOSEN, "left_semi")


@query("cl_period")
def _(spark, sf):
    good = select.best_test(panels.evaluations(spark, sf), "net_sharpe_ratio").where("net_sharpe_ratio > 0.9 and direction > 0").select(*_CHOSEN, "direction")
    good = _recent(spark, sf, _recent(spark, sf, good, "1997-01-01", 0.0), "2000-01-01", 0.0)
    return _clustered(spark, sf, good, 0.95)


@query("sel_pipeline_cluster")
def _(spark, sf):
    e = panels.evaluations(spark, sf).where("net_sharpe_ratio > 0.8")
    both = _recent(spark, sf, e, "1997-01-01", 0.2)  # all tests that pass in each period, then the best of them
    return _clustered(spark, sf, select.best_test(both, "net_sharpe_ratio").select(*_CHOSEN), 0.95)


@query("ev_corr_dedup")
def _(spark, sf):
    totals = panels.returns(spark, sf).groupBy("factor").agg(F.sum("ret").alias("s"))
    ranked = totals.select("factor", F.row_number().over(Window.orderBy(F.desc("s"), "factor")).alias("rank"))  # one row a factor
    r = cluster.written(panels.returns(spark, sf))
    far = cluster.correlations(r, r.select("factor").distinct(), cluster.calendar(r), value="ret", keep=lambda c: abs(c) > 0.02)
    kept = cluster.greedy_dedup(far, ranked, 0.02)
    return kept.select((F.row_number().over(Window.orderBy("rank")) - 1).alias("place"), "factor")


@query("cl_linkage_single", """, near AS (SELECT a, b FROM pc WHERE 1 - abs(c) <= 0.97 UNION ALL SELECT b, a FROM pc WHERE 1 - abs(c) <= 0.97),
reach AS (SELECT DISTINCT factor, factor AS other FROM rets UNION SELECT factor, b FROM reach JOIN near ON other = a) SELECT factor, min(other) AS "group" FROM reach GROUP BY 1""", _PAIRS, recursive=True)
def _(spark, sf):
    r = cluster.written(panels.returns(spark, sf))
    names = r.select("factor").distinct()
    near = cluster.correlations(r, names, cluster.calendar(r), value="ret", keep=lambda c: 1 - abs(c) <= 0.97)
    return cluster.single_linkage(near, names, 0.97)


@query("ev_adf")
def _(spark, sf):
    got = models.stationary(panels.bars(spark, sf), "price", "symbol", "bar_ts")
    return got.select("symbol", F.round("statistic", 4).alias("statistic"), F.round("p_value", 4).alias("p_value"), "lags", F.round("critical", 4).alias("critical"), "stationary")


@query("ep_regime")
def _(spark, sf):
    b = panels.bars(spark, sf).withColumn("month", F.date_format("bar_ts", "yyyy-MM"))
    return models.regimes(b, ["symbol", "month"], "bar_ts", "price").select("symbol", stamp("bar_ts").alias("ts"), "label")


_MAT = SIGNAL + """, mx AS (SELECT a.symbol, a.bar_ts, coalesce(a.s, 0) AS g1, coalesce(lag(a.s) OVER w, 0) AS g2, lead(a.price) OVER w / a.price - 1 AS y FROM sig a WINDOW w AS (PARTITION BY a.symbol ORDER BY a.bar_ts)),
fit AS (SELECT * FROM mx WHERE y IS NOT NULL AND bar_ts < TIMESTAMP '2024-01-20')"""


def _matrix(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    s = signal(spark, sf)
    both = s.select("symbol", "bar_ts", F.col("s").alias("g1"), F.lag("s").over(w).alias("g2"))
    tidy = both.unpivot(["symbol", "bar_ts"], ["g1", "g2"], "g", "v")
    y = pnl.forward_return(s, 1, per_bar=False, out="y").select("symbol", "bar_ts", "y")
    return models.design(tidy, "g", "v", ["symbol", "bar_ts"], ["g1", "g2"]).join(y, ["symbol", "bar_ts"])


def _fit(spark, sf):
    return _matrix(spark, sf).where("y is not null and bar_ts < timestamp_ntz'2024-01-20'")


@query("md_matrix", f"SELECT symbol, {ts()} AS ts, round(g1, 6) AS g1, round(g2, 6) AS g2, round(y, 6) AS y FROM fit", _MAT)
def _(spark, sf):
    return _fit(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.round("g1", 6).alias("g1"), F.round("g2", 6).alias("g2"), F.round("y", 6).alias("y"))


_OLS = """, mo AS (SELECT avg(g1) AS m1, avg(g2) AS m2, avg(y) AS my, {v}(g1) + {a} / count(*) AS v1, {v}(g2) + {a} / count(*) AS v2, covar_pop(g1, g2) AS c12, covar_pop(g1, y) AS c1, covar_pop(g2, y) AS c2 FROM fit),
be AS (SELECT m1, m2, my, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM mo)
SELECT round(b1, 5) AS b1, round(b2, 5) AS b2, round(my - b1 * m1 - b2 * m2, 5) AS intercept FROM be"""


def _coefficients(spark, model):
    return spark.createDataFrame([(round(float(model.coefficients[0]), 5), round(float(model.coefficients[1]), 5), round(float(model.intercept), 5))], "b1 double, b2 double, intercept double")


@query("md_linear", _OLS.format(v="var_pop", a="0.0"), _MAT)
def _(spark, sf):
    return _coefficients(spark, models.linear().fit(_fit(spark, sf)))


@query("md_ridge", _OLS.format(v="var_pop", a="100.0"), _MAT)
def _(spark, sf):
    m = _fit(spark, sf)
    n, spread = m.agg(F.count("*"), F.stddev_pop("y")).first()
    return _coefficients(spark, models.linear("ridge", 100.0, n, spread).fit(m))


@query("md_ridge_cv")
def _(spark, sf):
    m = _fit(spark, sf)
    alpha, _ = models.ridge_alpha(m, ["g1", "g2"], [1.0, 10.0, 100.0, 1000.0], ["symbol", "bar_ts"])
    n, spread = m.agg(F.count("*"), F.stddev_pop("y")).first()
    return _coefficients(spark, models.linear("ridge", alpha, n, spread).fit(m)).withColumn("alpha", F.lit(alpha))


@query("md_lasso")
def _(spark, sf):
    return _coefficients(spark, models.linear("lasso", 1e-4).fit(_fit(spark, sf)))


@query("md_average", f"SELECT symbol, {ts()} AS ts, round((g1 + g2) / 2, 9) AS prediction FROM mx", _MAT)
def _(spark, sf):
    return _matrix(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.round((F.col("g1") + F.col("g2")) / 2, 9).alias("prediction"))


def _later(rows, share: float = 0.2):
    """``_later``: the last part of the fit window in time, for validation."""
    first, last = rows.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    return rows.withColumn("_later", F.col("bar_ts") > F.lit(first + (last - first) * (1 - share)) if first else F.lit(False))


def _boosted(spark, sf):
    return boosting.regression(_later(_fit(spark, sf).drop("features")), ["g1", "g2"], validation="_later")


@query("md_gbm")
def _(spark, sf):
    """Predictions of boosted trees; the last fifth of the fit window ends the fit when it gets no better."""
    return _matrix(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.round(_boosted(spark, sf).score(), 6).alias("prediction"))


@query("md_gbm_importance")
def _(spark, sf):
    got = _boosted(spark, sf).importances()
    return spark.createDataFrame([(n, k, round(g, 6)) for n, k, g in got], "feature string, splits int, gain double")


@query("md_ranker")
def _(spark, sf):
    """Scores of all bars by boosted trees that learn the order of next returns among the series of each bar of the fit window."""
    labelled = _later(models.rank_labels(_fit(spark, sf).drop("features"), "y", "bar_ts", 4))
    model = boosting.ranking(labelled, ["g1", "g2"], "bar_ts", validation="_later")
    return _matrix(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.round(model.score(), 6).alias("score"))


@query("md_ranker_linear")
def _(spark, sf):
    """The same by a pairwise linear ranker."""
    labelled = models.rank_labels(_fit(spark, sf).drop("features"), "y", "bar_ts", 4)
    fitted = models.ranker().fit(models.ranked_pairs(labelled, ["g1", "g2"], "bar_ts")).coefficients
    score = F.col("g1") * float(fitted[0]) + F.col("g2") * float(fitted[1])
    return _matrix(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.round(score, 5).alias("score"))


@query("md_ranker_labels", f"SELECT symbol, {ts()} AS ts, least(ceil((rank() OVER (PARTITION BY bar_ts ORDER BY factor) + (count(*) OVER (PARTITION BY bar_ts, factor) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY bar_ts) * 4 - 1e-9), 4)::INTEGER - 1 AS label FROM bars", BARS)
def _(spark, sf):
    return models.rank_labels(panels.bars(spark, sf), "factor", "bar_ts", 4).select("symbol", stamp("bar_ts").alias("ts"), "label")


@query("md_predict_append", f"SELECT symbol, {ts()} AS ts, round((g1 + g2) / 2, 9) AS prediction FROM mx WHERE bar_ts < TIMESTAMP '2024-01-25'", _MAT)
def _(spark, sf):
    p = _matrix(spark, sf).select("symbol", "bar_ts", F.round((F.col("g1") + F.col("g2")) / 2, 9).alias("prediction"))
    old, new = p.where("bar_ts < timestamp_ntz'2024-01-20'"), p.where("bar_ts >= timestamp_ntz'2024-01-15' and bar_ts < timestamp_ntz'2024-01-25'")
    return align.upsert(old, new, ["symbol", "bar_ts"]).select("symbol", stamp("bar_ts").alias("ts"), "prediction")


@query("mg_trade_method", f"""SELECT symbol, {ts()} AS ts, round(avg(pos), 6) AS pos FROM (SELECT symbol, bar_ts, pos FROM pos UNION ALL SELECT symbol, bar_ts, CASE WHEN s IS NOT NULL THEN sign(s)::DOUBLE END FROM sig) WHERE bar_ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2""", _POS)
def _(spark, sf):
    a = positions(spark, sf).select("symbol", "bar_ts", "pos")
    b = signal(spark, sf).select("symbol", "bar_ts", F.signum("s").alias("pos"))
    return a.unionByName(b).where("bar_ts >= timestamp_ntz'2024-01-20'").groupBy("symbol", stamp("bar_ts").alias("ts")).agg(F.round(F.avg("pos"), 6).alias("pos"))


def method_positions(spark, sf, fit_end: str, end: str, methods=((0.4, 0.1), (0.6, 0.2), (0.8, 0.0), (0.9, 0.5)), least: float = 0.0):
    """Mean position over ``[fit_end, end)`` of the methods (open, close) whose net daily Sharpe ratio before ``fit_end`` is above ``least``.

    A bar that a chosen method has no position for has none; without a chosen method there are no rows.
    """
    s = signal(spark, sf)
    each = [rules.reopening(s, open_at=a, close_at=b).withColumn("method", F.lit(f"{a}/{b}")) for a, b in methods]
    pos = each[0]
    for p in each[1:]:
        pos = pos.unionByName(p)
    keys = ["method", "symbol"]
    known = pos.where(F.col("bar_ts") < F.lit(fit_end).cast("timestamp_ntz"))
    g = pnl.daily_gains(pnl.gains(pnl.forward_return(known, keys=keys)), keys=keys)
    daily = pnl.net(g, pnl.turnover(known, keys=keys), FEE, ["method"])
    chosen = daily.groupBy("method").agg(metrics.sharpe("net").alias("sharpe")).where(F.col("sharpe") > least)
    later = pos.where((F.col("bar_ts") >= F.lit(fit_end).cast("timestamp_ntz")) & (F.col("bar_ts") < F.lit(end).cast("timestamp_ntz")))
    mean = F.when(F.count("pos") == F.count("*"), F.avg("pos"))
    return later.join(F.broadcast(chosen.select("method")), "method").groupBy("symbol", "bar_ts").agg(mean.alias("pos"))  # a list of methods


@query("mg_trade_method_fit")
def _(spark, sf):
    old = method_positions(spark, sf, "2024-01-15", "2024-01-20")
    got = align.append(old, method_positions(spark, sf, "2024-01-20", "2024-01-27"), ["symbol", "bar_ts"], "pos")
    return got.select("symbol", stamp("bar_ts").alias("ts"), F.round("pos", 6).alias("pos"))


# --- sources and sinks

@query("src_parquet", f"SELECT symbol, {ts()} AS ts, factor AS value FROM bars WHERE factor IS NOT NULL", BARS)
def _(spark, sf):
    at = _folder(spark)
    b = panels.bars(spark, sf)
    b.groupBy("bar_ts").pivot("symbol", ["click", "error", "purchase", "signup", "view"]).agg(F.first("factor")).write.parquet(f"{at}/wide.parquet")
    return files.read_wide(spark, f"{at}/wide.parquet", "bar_ts").where("value is not null").select("symbol", stamp("bar_ts").alias("ts"), "value")


@query("src_csv", "SELECT test_name, process_name, factor, direction FROM evals", EVALS)
def _(spark, sf):
    at = _folder(spark)
    panels.evaluations(spark, sf).select("test_name", "process_name", "factor", "direction").write.csv(at, header=True)
    return files.read_table(spark, at, "test_name string, process_name string, factor string, direction long")


#: Stat lines of every order day, by priority (the folder) and status (the symbol); the rate in parts of 1.
_STAT = """lines AS (SELECT o_orderpriority AS source, o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS day,
  CAST(round(1 - (count(*) % 3) / (count(*) + 7.0), 4) AS DOUBLE) AS complete_rate, CAST(count(*) % 3 AS DOUBLE) AS missing FROM orders GROUP BY 1, 2, 3),
stat AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY source, symbol ORDER BY day DESC) = 1)"""


def _stat(spark, sf):
    """The stat lines written as text files, a folder for each priority, and read back: the last line of each symbol there."""
    at, n = _folder(spark), F.count("*")
    rows = panels.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("symbol"), F.to_date("o_orderdate").alias("day"))
    made = rows.agg(F.round(1 - (n % 3) / (n + 7), 4).cast("string").alias("rate"), (n % 3).cast("string").alias("missing"))
    made.select("source", F.format_string("%s, %s, Trade Complete Rate: %s, Inc Missing Num: %s", F.col("day").cast("string"), "symbol", "rate", "missing").alias("value")).write.partitionBy("source").text(at)
    return files.read_stat(spark, at, "source")


@query("src_stat", f"SELECT source, symbol, {dt()} AS day, complete_rate, missing FROM stat", _STAT)
def _(spark, sf):
    return _stat(spark, sf).select("source", "symbol", day_text("day").alias("day"), "complete_rate", "missing")


@query("agg_stat_file", """SELECT source, count(*) FILTER (complete_rate < 1) AS trade_incomplete_count, min(complete_rate) FILTER (complete_rate < 1) AS trade_min,
  round(avg(complete_rate) FILTER (complete_rate < 1), 9) AS trade_mean, count(*) FILTER (missing > 0) AS inc_missing_count, max(missing) FILTER (missing > 0) AS inc_max,
  round(avg(missing) FILTER (missing > 0), 9) AS inc_mean FROM stat GROUP BY 1""", _STAT)
def _(spark, sf):
    """How complete each stat folder is, from its latest lines."""
    got = files.stat_summary(_stat(spark, sf), ["source"])
    return got.withColumns({c: F.round(c, 9) for c in ("trade_mean", "inc_mean")})


@query("src_json", "SELECT test_name AS root_dir, process_name, factor FROM evals WHERE net_sharpe_ratio > 0.5", EVALS)
def _(spark, sf):
    """Selections written as JSON lists of triples, a list for each process, and read back as rows."""
    at = _folder(spark)
    chosen = panels.evaluations(spark, sf).where("net_sharpe_ratio > 0.5")
    lists = chosen.groupBy("test_name", "process_name").agg(F.collect_list(F.array("test_name", "process_name", "factor")).alias("x"))
    lists.select(F.to_json("x")).write.text(at)
    return files.read_selection(spark, at)


_PAIRED = SIGNAL + """, up AS (SELECT 'level' AS suffix, symbol, bar_ts, round(price / 100, 6) AS up FROM bars WHERE factor > 40 UNION ALL SELECT 'share', symbol, bar_ts, round(factor / 100, 6) FROM bars WHERE factor IS NOT NULL),
down AS (SELECT 'level' AS suffix, symbol, bar_ts, round(1 - price / 100, 6) AS down FROM bars UNION ALL SELECT 'share', symbol, bar_ts, round(1 - factor / 100, 6) FROM bars WHERE factor < 60)"""


@query("src_filters", f"""SELECT suffix, symbol, {ts()} AS ts, up, down, round(CASE WHEN s > 0 THEN s * up WHEN s < 0 THEN s * down ELSE s END, 9) + 0 AS s
  FROM sig CROSS JOIN (VALUES ('level'), ('share')) n(suffix) LEFT JOIN up USING (suffix, symbol, bar_ts) LEFT JOIN down USING (suffix, symbol, bar_ts)""", _PAIRED)
def _(spark, sf):
    """Filter panels in folders by name, told to be pairs by their names, and applied to a signal; a filter without its other half isn't read."""
    at = _folder(spark)
    p, f = F.col("price") / 100, F.col("factor") / 100
    made = {"pos_level": (p, "factor > 40"), "neg_level": (1 - p, "true"), "pos_share": (f, "true"), "neg_share": (1 - f, "factor < 60"), "pos_alone": (p, "true")}
    panel = F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.when(F.expr(c), F.round(v, 6)).alias("v")) for n, (v, c) in made.items()))).alias("x")
    files.write_panel(panels.bars(spark, sf).select("symbol", "bar_ts", panel).select("symbol", "bar_ts", "x.*").where("v is not null"), at, ["filter"])
    got = apply.paired(signal(spark, sf), files.paired_filters(spark, at), ["level", "share"])
    return got.select("suffix", "symbol", stamp("bar_ts").alias("ts"), "up", "down", (F.round("s", 9) + 0).alias("s"))


@query("src_glob", "SELECT test_name AS name, count(*) AS n, round(max(net_sharpe_ratio), 6) AS best FROM evals WHERE test_name <> 't0' GROUP BY 1", EVALS)
def _(spark, sf):
    """Evaluation files found by a pattern of folders; each row's test is told by the path of its file."""
    at = _folder(spark)
    files.write_panel(panels.evaluations(spark, sf), at, ["test_name"])
    rows = spark.read.parquet(f"{at}/test_name=t[1-9]*")  # without a base path the folders give no column
    name = F.regexp_extract(F.input_file_name(), "test_name=([^/]+)/", 1)
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.round(F.max("net_sharpe_ratio"), 6).alias("best"))


@query("src_calendar", f"SELECT DISTINCT {dt('CAST(o_orderdate AS DATE)')} AS day FROM orders WHERE isodow(o_orderdate) < 6")
def _(spark, sf):
    return panels.table(spark, sf, "orders").where("weekday(o_orderdate) < 5").select(day_text("o_orderdate").alias("day")).distinct()


@query("snk_parquet_csv", f"SELECT symbol, {ts()} AS ts, pos FROM pos", _POS)
def _(spark, sf):
    at = _folder(spark)
    files.write_panel(positions(spark, sf).select("symbol", "bar_ts", "pos"), at, ["symbol"])
    return spark.read.parquet(at).select(F.col("symbol").cast("string").alias("symbol"), stamp("bar_ts").alias("ts"), "pos")


@query("snk_per_symbol_csv", "SELECT symbol, count(*) AS n FROM pos GROUP BY 1", _POS)
def _(spark, sf):
    at = _folder(spark)
    files.write_per_symbol(positions(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), "pos"), at)
    return spark.read.csv(at, header=True).groupBy("symbol").agg(F.count("*").alias("n"))


@query("snk_mysql_upsert", "SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def _(spark, sf):
    o = panels.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "o_orderstatus")
    return files.last_write(o, ["o_custkey", "o_orderpriority"], "o_orderdate").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")


@query("snk_mysql_read", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return panels.table(spark, sf, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("snk_mysql_update", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END::INTEGER AS alerted FROM orders")
def _(spark, sf):
    m = panels.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("alerted"))
    return files.mark_alerted(m, m.where("id % 7 = 0")).select("id", "alerted")


@query("st_online_rule", f"SELECT symbol, {ts()} AS ts, pos FROM pos", _POS)
def _(spark, sf):
    """The rule in batch up to a day, then as a stream of the weeks after it that starts from the batch run's last sides."""
    at, day = _folder(spark), F.lit("2024-01-16").cast("timestamp_ntz")
    s = cluster.written(signal(spark, sf).select("symbol", "bar_ts", "s"))
    known = rules.reopening(s.where(F.col("bar_ts") < day), open_at=0.6, close_at=0.2).select("symbol", "bar_ts", "pos")
    later = s.where(F.col("bar_ts") >= day).withColumn("bar_ts", F.col("bar_ts").cast("timestamp"))
    stream.write_weeks(later, f"{at}/in")
    got = stream.replay(spark, f"{at}/in", "symbol string, bar_ts timestamp, s double", 0.6, 0.2, f"{at}/state", f"{at}/out", start=stream.closing_state(known))
    rows = known.withColumn("bar_ts", F.col("bar_ts").cast("timestamp")).unionByName(got.where("not late").select("symbol", "bar_ts", "pos"))
    return rows.select("symbol", stamp("bar_ts").alias("ts"), "pos")


@query("udf_models", _OLS.format(v="var_pop", a="0.0").replace("SELECT round(b1", "SELECT 'linear' AS model, round(b1") + " UNION ALL SELECT 'ridge', b1, b2, intercept FROM (WITH " + _MAT + _OLS.format(v="var_pop", a="10.0") + ")", _MAT)
def _(spark, sf):
    """Models called by their names with their parameters."""
    m = _fit(spark, sf)
    n, spread = m.agg(F.count("*"), F.stddev_pop("y")).first()
    params = {"linear": {}, "ridge": {"alpha": 10.0, "n": n, "spread": spread}}
    rows = [_coefficients(spark, models.MODELS[k](**p).fit(m)).withColumn("model", F.lit(k)) for k, p in params.items()]
    return rows[0].unionByName(rows[1])


@query("ev_dynamic_names", "SELECT process_name, t AS transform, process_name || '_' || t AS process FROM (SELECT DISTINCT process_name FROM evals), (VALUES ('ma5'), ('ma20')) x(t)", EVALS)
def _(spark, sf):
    t = F.explode(F.array(F.lit("ma5"), F.lit("ma20")))
    return panels.evaluations(spark, sf).select("process_name").distinct().withColumn("transform", t).withColumn("process", F.concat_ws("_", "process_name", "transform"))
