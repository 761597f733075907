"""Queries for aggregations, evaluation rows, resampling and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, kurt_unbiased, ratio, skew_unbiased, trading_minutes
from ..operators import calendar, episodes, metrics
from ..sources import panels
from .core import _POS, gained, net_daily, positions, signal
from .kit import BARS, DAILY, EVALS, RETURNS, SIGNAL, day_text, dt, query, stamp, ts
from .tables import _NETSQL, _TRADES, _trades


def _b(spark, sf):
    return panels.bars(spark, sf)


def _e(spark, sf):
    return panels.evaluations(spark, sf)


def _r(c, n=6):
    return F.round(c, n)


_NEXT = _POS + """, gi AS (SELECT *, lead(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts) AS nx FROM gain),
gc AS (SELECT *, CASE WHEN date_diff('day', CAST(bar_ts AS DATE), CAST(nx AS DATE)) = 0 THEN 'intraday' WHEN date_diff('day', CAST(bar_ts AS DATE), CAST(nx AS DATE)) = 1 THEN 'overnight'
  WHEN isodow(bar_ts) = 5 AND isodow(nx) = 1 THEN 'weekend' ELSE 'holiday' END AS kind FROM gi WHERE nx IS NOT NULL)"""


@query("agg_interval", "SELECT symbol, kind, CASE WHEN pos > 0 THEN 'long' ELSE 'short' END AS side, round(avg(gp), 11) AS mean_gp, round(sum(gp), 6) AS sum_gp, count(*) AS n FROM gc WHERE pos <> 0 GROUP BY 1, 2, 3", _NEXT)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    g = gained(spark, sf).withColumn("nx", F.lead("bar_ts").over(w)).where("nx is not null and pos <> 0")
    gap = F.datediff("nx", "bar_ts")
    kind = F.when(gap == 0, "intraday").when(gap == 1, "overnight").when((F.weekday("bar_ts") == 4) & (F.weekday("nx") == 0), "weekend").otherwise("holiday")
    return g.groupBy("symbol", kind.alias("kind"), F.when(F.col("pos") > 0, "long").otherwise("short").alias("side")).agg(_r(F.avg("gp"), 11).alias("mean_gp"), _r(F.sum("gp")).alias("sum_gp"), F.count("*").alias("n"))


@query("agg_dist", "SELECT symbol, count(price) AS n, round(avg(price), 11) AS mean, round(median(price), 11) AS median, round(stddev_samp(price), 6) AS std, round(skewness(price), 5) AS skew, round(kurtosis(price), 5) AS kurt, min(price) AS least, max(price) AS most FROM bars GROUP BY 1", BARS)
def _(spark, sf):
    p = F.col("price")
    return _b(spark, sf).groupBy("symbol").agg(F.count(p).alias("n"), _r(F.avg(p), 11).alias("mean"), _r(F.median(p), 11).alias("median"), _r(F.stddev_samp(p)).alias("std"), _r(skew_unbiased(p), 5).alias("skew"), _r(kurt_unbiased(p), 5).alias("kurt"), F.min(p).alias("least"), F.max(p).alias("most"))


_DEC = BARS + """, rk AS (SELECT symbol, factor, lead(price) OVER (PARTITION BY symbol ORDER BY bar_ts) / price - 1 AS rtn, row_number() OVER (PARTITION BY symbol ORDER BY factor, bar_ts) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""


@query("agg_decile", "SELECT symbol, greatest(((r - 1) * 10 + n - 2) // (n - 1) - 1, 0)::BIGINT AS decile, count(*) AS n, round(avg(rtn), 11) AS mean_rtn FROM rk GROUP BY 1, 2", _DEC)
def _(spark, sf):
    w = Window.partitionBy("symbol")
    b = _b(spark, sf).withColumn("rtn", ratio(F.lead("price").over(w.orderBy("bar_ts")), F.col("price")) - 1).withColumn("r", F.row_number().over(w.orderBy("factor", "bar_ts"))).withColumn("n", F.count("*").over(w))
    decile = F.greatest(F.expr("((r - 1) * 10 + n - 2) div (n - 1) - 1"), F.lit(0)).cast("long")
    return b.groupBy("symbol", decile.alias("decile")).agg(F.count("*").alias("n"), _r(F.avg("rtn"), 11).alias("mean_rtn"))


@query("agg_intraday", "SELECT symbol, strftime(bar_ts, '%H:%M') AS hm, round(avg(price), 11) AS price, round(avg(factor), 11) AS factor FROM bars GROUP BY 1, 2", BARS)
def _(spark, sf):
    return _b(spark, sf).groupBy("symbol", F.date_format("bar_ts", "HH:mm").alias("hm")).agg(_r(F.avg("price"), 11).alias("price"), _r(F.avg("factor"), 11).alias("factor"))


@query("agg_week_minute", "SELECT (isodow(ts) - 1)::BIGINT AS weekday, strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%H:%M') AS hm, round(sum(value), 4) AS total, round(avg(value), 11) AS mean FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = panels.table(spark, sf, "events").select("value", F.weekday("ts").cast("long").alias("weekday"), (F.hour("ts") * 60 + F.floor(F.minute("ts") / 5) * 5).alias("m"))
    hm = F.concat(F.lpad(F.floor(F.col("m") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("m") % 60).cast("string"), 2, "0"))
    return e.groupBy("weekday", hm.alias("hm")).agg(_r(F.sum("value"), 4).alias("total"), _r(F.avg("value"), 11).alias("mean"))


@query("agg_minute_inst", f"SELECT symbol, strftime(open_time, '%H:%M') AS hm, count(*) AS n, round(sum({_NETSQL}), 6) AS total FROM trades GROUP BY GROUPING SETS ((symbol, hm), (hm))", _TRADES)
def _(spark, sf):
    t = episodes.trade_returns(_trades(spark, sf), 0.00024).withColumn("hm", F.date_format("open_time", "HH:mm"))
    return t.groupingSets([[F.col("symbol"), F.col("hm")], [F.col("hm")]], "symbol", "hm").agg(F.count("*").alias("n"), _r(F.sum("net_return")).alias("total"))


_MONTHS = list(range(1, 13))


@query("agg_month_pivot", "SELECT factor, year(day)::INTEGER AS year, " + ", ".join(f"round(sum(ret) FILTER (month(day) = {m}), 6) AS m{m}" for m in _MONTHS) + " FROM rets GROUP BY 1, 2", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf).withColumn("month", F.concat(F.lit("m"), F.month("day"))).groupBy("factor", F.year("day").alias("year")).pivot("month", [f"m{m}" for m in _MONTHS])
    return r.agg(_r(F.sum("ret")))


@query("agg_year", "SELECT factor, year(day)::INTEGER AS year, round(sum(ret), 6) AS total, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245), 5) AS sharpe, count(*) AS days FROM rets GROUP BY 1, 2", RETURNS)
def _(spark, sf):
    return panels.returns(spark, sf).groupBy("factor", F.year("day").alias("year")).agg(_r(F.sum("ret")).alias("total"), _r(metrics.sharpe("ret"), 5).alias("sharpe"), F.count("*").alias("days"))


@query("agg_week_groups", "SELECT factor, strftime(date_trunc('week', day), '%Y-%m-%d') AS week, round(sum(ret), 6) + 0 AS total FROM rets GROUP BY 1, 2", RETURNS)
def _(spark, sf):
    return panels.returns(spark, sf).groupBy("factor", day_text(F.date_trunc("week", "day")).alias("week")).agg(_r(F.sum("ret")).alias("total"))


@query("agg_day_cumsum", f"SELECT symbol, {ts()} AS ts, round(sum(factor) OVER (PARTITION BY symbol, CAST(bar_ts AS DATE) ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum FROM bars", BARS)
def _(spark, sf):
    w = Window.partitionBy("symbol", F.to_date("bar_ts")).orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    return _b(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), _r(F.sum("factor").over(w), 9).alias("cum"))


_TESTS = ["t0", "t1", "t2", "t3"]


@query("agg_pivot_stats", "SELECT process_name, " + ", ".join(f"round(avg(net_sharpe_ratio) FILTER (test_name = '{t}'), 11) AS {t}_mean, round(quantile_cont(net_sharpe_ratio, 0.9) FILTER (test_name = '{t}'), 11) AS {t}_high, count(*) FILTER (test_name = '{t}') AS {t}_n" for t in _TESTS) + " FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    s = F.col("net_sharpe_ratio")
    return _e(spark, sf).groupBy("process_name").pivot("test_name", _TESTS).agg(_r(F.avg(s), 11).alias("mean"), _r(F.percentile(s, F.lit(0.9)), 11).alias("high"), F.count(F.lit(1)).alias("n")).na.fill(0, [f"{t}_n" for t in _TESTS])


@query("agg_group_stats", "SELECT process_name, round(avg(sharpe_ratio), 11) AS mean, round(median(sharpe_ratio), 11) AS median, round(stddev_samp(sharpe_ratio), 6) AS std, round(quantile_cont(sharpe_ratio, 0.1), 11) AS p10, round(quantile_cont(sharpe_ratio, 0.9), 11) AS p90, max(sharpe_ratio) AS most, min(sharpe_ratio) AS least, count(*) AS n, count(*) FILTER (sharpe_ratio > 1) AS valid FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    s = F.col("sharpe_ratio")
    return _e(spark, sf).groupBy("process_name").agg(_r(F.avg(s), 11).alias("mean"), _r(F.median(s), 11).alias("median"), _r(F.stddev_samp(s)).alias("std"), _r(F.percentile(s, F.lit(0.1)), 11).alias("p10"), _r(F.percentile(s, F.lit(0.9)), 11).alias("p90"), F.max(s).alias("most"), F.min(s).alias("least"), F.count("*").alias("n"), F.count_if(s > 1).alias("valid"))


@query("agg_describe", "SELECT process_name, count(hsr) AS n, round(avg(hsr), 9) AS mean, round(stddev_samp(hsr), 9) AS std, min(hsr) AS least, round(quantile_cont(hsr, 0.25), 9) AS q1, round(quantile_cont(hsr, 0.5), 9) AS q2, round(quantile_cont(hsr, 0.75), 9) AS q3, max(hsr) AS most FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    s = F.col("hsr")
    q = lambda p: _r(F.percentile(s, F.lit(p)), 9)
    return _e(spark, sf).groupBy("process_name").agg(F.count(s).alias("n"), _r(F.avg(s), 9).alias("mean"), _r(F.stddev_samp(s), 9).alias("std"), F.min(s).alias("least"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(s).alias("most"))


@query("agg_rank", "SELECT test_name, process_name, factor, rank() OVER (PARTITION BY test_name ORDER BY net_sharpe_ratio DESC) AS rank_min, round((rank() OVER (PARTITION BY test_name ORDER BY hsr) + (count(*) OVER (PARTITION BY test_name, hsr) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY test_name), 9) AS pct FROM evals", EVALS)
def _(spark, sf):
    w = Window.partitionBy("test_name")
    pct = (F.rank().over(w.orderBy("hsr")) + (F.count("*").over(Window.partitionBy("test_name", "hsr")) - 1) / F.lit(2.0)) / F.count("*").over(w)
    return _e(spark, sf).select("test_name", "process_name", "factor", F.rank().over(w.orderBy(F.desc("net_sharpe_ratio"))).cast("long").alias("rank_min"), _r(pct, 9).alias("pct"))


_METRICS = ["sharpe_ratio", "net_sortino_ratio", "net_calmar_ratio", "hsr"]


@query("agg_corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM evals" for i, a in enumerate(_METRICS) for b in _METRICS[i + 1 :]), EVALS)
def _(spark, sf):
    pairs = [(a, b) for i, a in enumerate(_METRICS) for b in _METRICS[i + 1 :]]
    row = _e(spark, sf).agg(*(correlation(F.col(a), F.col(b)).alias(f"{a}~{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _r(F.col(f"`{a}~{b}`")).alias("corr")) for a, b in pairs))).alias("x")).select("x.*")


@query("agg_bins", f"SELECT least(greatest(ceil(vol / 10)::INTEGER - 1, 0), 9) AS bin, count(*) AS n, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(sum(net), 6) AS total FROM (SELECT {_NETSQL} AS net, s.factor AS vol FROM trades t JOIN sig s ON s.symbol = t.symbol AND s.bar_ts = t.open_time) GROUP BY 1", _TRADES)
def _(spark, sf):
    t = episodes.trade_returns(_trades(spark, sf), 0.00024).join(signal(spark, sf).select("symbol", F.col("bar_ts").alias("open_time"), F.col("factor").alias("vol")), ["symbol", "open_time"])
    bin_ = F.least(F.greatest(F.ceil(F.col("vol") / 10).cast("int") - 1, F.lit(0)), F.lit(9))  # right-closed, the lowest included
    return t.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), _r(F.avg(F.when(F.col("net_return") > 0, 1.0).otherwise(0.0))).alias("win_rate"), _r(F.sum("net_return")).alias("total"))


@query("agg_hist", "SELECT process_name, floor(net_sharpe_ratio * 4)::BIGINT AS bin, count(*) AS n FROM evals GROUP BY 1, 2", EVALS)
def _(spark, sf):
    return _e(spark, sf).groupBy("process_name", F.floor(F.col("net_sharpe_ratio") * 4).alias("bin")).agg(F.count("*").alias("n"))


_LABEL = _POS + """, lb AS (SELECT g.*, CASE WHEN f.factor > 50 THEN 'High_Vol' ELSE 'Low_Vol' END || CASE WHEN g.price > 30 THEN '_Trend' ELSE '_Range' END AS label FROM gain g JOIN bars f USING (symbol, bar_ts))"""


def _labelled(spark, sf):
    g = gained(spark, sf)
    return g.withColumn("label", F.concat(F.when(F.col("factor") > 50, "High_Vol").otherwise("Low_Vol"), F.when(F.col("price") > 30, "_Trend").otherwise("_Range")))


@query("agg_label_pos", "SELECT label, sign(pos)::INTEGER AS side, round(sum(gp), 6) AS total, count(*) AS minutes, round(count(*) / (sum(count(*)) OVER (PARTITION BY label))::DOUBLE, 6) AS share FROM lb WHERE pos IS NOT NULL GROUP BY 1, 2", _LABEL)
def _(spark, sf):
    g = _labelled(spark, sf).where("pos is not null").groupBy("label", F.signum("pos").cast("int").alias("side")).agg(_r(F.sum("gp")).alias("total"), F.count("*").alias("minutes"))
    return g.withColumn("share", _r(F.col("minutes") / F.sum("minutes").over(Window.partitionBy("label"))))


@query("agg_value_counts", "SELECT label, count(*) AS n FROM lb GROUP BY 1", _LABEL)
def _(spark, sf):
    return _labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query("agg_year_filter", "SELECT year(day)::INTEGER AS year, k AS kind, round(avg(ret), 11) AS mean, count(*) AS n, round(stddev_samp(ret), 6) AS std FROM rets, (VALUES ('neg'), ('pos'), ('all')) t(k) WHERE k = 'all' OR (k = 'neg' AND ret < 0) OR (k = 'pos' AND ret > 0) GROUP BY 1, 2", RETURNS)
def _(spark, sf):
    kind = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("ret") < 0, "neg"), F.when(F.col("ret") > 0, "pos"))))
    r = panels.returns(spark, sf).select(F.year("day").alias("year"), "ret", kind.alias("kind"))
    return r.groupBy("year", "kind").agg(_r(F.avg("ret"), 11).alias("mean"), F.count("*").alias("n"), _r(F.stddev_samp("ret")).alias("std"))


@query("agg_weekday_pos", "SELECT (isodow(bar_ts) - 1)::BIGINT AS weekday, sign(pos)::INTEGER AS side, round(avg(gp), 11) + 0 AS mean, round(median(gp), 11) + 0 AS median, round(stddev_samp(gp), 6) AS std, count(*) AS n FROM gain WHERE pos IS NOT NULL GROUP BY 1, 2", _POS)
def _(spark, sf):
    g = gained(spark, sf).where("pos is not null")
    return g.groupBy(F.weekday("bar_ts").cast("long").alias("weekday"), F.signum("pos").cast("int").alias("side")).agg(_r(F.avg("gp"), 11).alias("mean"), _r(F.median("gp"), 11).alias("median"), _r(F.stddev_samp("gp")).alias("std"), F.count("*").alias("n"))


@query("agg_corr_cond", "SELECT symbol, round(corr(s, rtn), 5) AS overall, round(corr(s, rtn) FILTER (s > 0), 5) AS long_only, round(corr(s, rtn) FILTER (s < 0), 5) AS short_only FROM gain GROUP BY 1", _POS)
def _(spark, sf):
    s, r = F.col("s"), F.col("rtn")
    part = lambda c: correlation(F.when(c, s), r)
    return gained(spark, sf).groupBy("symbol").agg(_r(correlation(s, r), 5).alias("overall"), _r(part(s > 0), 5).alias("long_only"), _r(part(s < 0), 5).alias("short_only"))


@query("agg_category", "SELECT process_name, " + ", ".join(f"count(*) FILTER (test_name = '{t}') AS {t}_n, count(DISTINCT CASE WHEN test_name = '{t}' THEN split_part(factor, '-', 1) END) AS {t}_groups" for t in _TESTS) + " FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    g = _e(spark, sf).withColumn("org", F.split("factor", "-")[0]).groupBy("process_name").pivot("test_name", _TESTS).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("org").alias("groups"))
    return g.na.fill(0)


@query("agg_nunique", "SELECT test_name, count(DISTINCT factor) AS factors, count(DISTINCT process_name) AS processes FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    return _e(spark, sf).groupBy("test_name").agg(F.countDistinct("factor").alias("factors"), F.countDistinct("process_name").alias("processes"))


@query("agg_diff_stats", "SELECT a.symbol, count(*) AS n, round(avg(abs(a.factor - b.factor)), 11) AS mean_diff, max(abs(a.factor - b.factor)) AS max_diff, round(stddev_samp(abs(a.factor - b.factor)), 6) AS std_diff, round(avg(abs(a.factor - b.factor) / greatest(abs(a.factor), 1e-10)), 5) AS rel_diff, round(corr(a.factor, b.factor), 6) AS corr FROM bars a JOIN (SELECT symbol, bar_ts, round(factor + price / 100, 6) AS factor FROM bars) b USING (symbol, bar_ts) GROUP BY 1", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    other = b.select("symbol", "bar_ts", F.round(F.col("factor") + F.col("price") / 100, 6).alias("f2"))
    d = F.abs(F.col("factor") - F.col("f2"))
    return b.join(other, ["symbol", "bar_ts"]).groupBy("symbol").agg(F.count("*").alias("n"), _r(F.avg(d), 11).alias("mean_diff"), F.max(d).alias("max_diff"), _r(F.stddev_samp(d)).alias("std_diff"), _r(F.avg(d / F.greatest(F.abs("factor"), F.lit(1e-10))), 5).alias("rel_diff"), _r(correlation(F.col("factor"), F.col("f2"))).alias("corr"))


@query("st_two_sources", f"SELECT {dt('CAST(a.bar_ts AS DATE)')} AS day, count(*) AS n, round(max(abs(a.price - b.price)), 6) AS max_diff FROM bars a JOIN (SELECT symbol, bar_ts, round(price * 1.01, 6) AS price FROM bars) b USING (symbol, bar_ts) WHERE CAST(a.bar_ts AS DATE) = DATE '2024-01-15' GROUP BY 1", BARS)
def _(spark, sf):
    b = _b(spark, sf).where("to_date(bar_ts) = date'2024-01-15'")
    live = b.select("symbol", "bar_ts", F.round(F.col("price") * 1.01, 6).alias("live"))
    return b.join(live, ["symbol", "bar_ts"]).groupBy(day_text("bar_ts").alias("day")).agg(F.count("*").alias("n"), _r(F.max(F.abs(F.col("price") - F.col("live")))).alias("max_diff"))


@query("agg_momrev_pivot", "SELECT split_part(factor, '-', 1) AS indicator, " + ", ".join(f"round(avg(net_sharpe_ratio) FILTER (split_part(factor, '-', 2) = 'w{k}d'), 11) AS w{k}d" for k in range(3)) + " FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    e = _e(spark, sf).withColumn("indicator", F.split("factor", "-")[0]).withColumn("transform", F.split("factor", "-")[1])
    return e.groupBy("indicator").pivot("transform", ["w0d", "w1d", "w2d"]).agg(_r(F.avg("net_sharpe_ratio"), 11))


@query("agg_param_pivot", "SELECT split_part(factor, '-', 2) AS dp, " + ", ".join(f"round(avg(hsr) FILTER (test_name = '{t}'), 11) AS {t}" for t in _TESTS) + " FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    return _e(spark, sf).withColumn("dp", F.split("factor", "-")[1]).groupBy("dp").pivot("test_name", _TESTS).agg(_r(F.avg("hsr"), 11))


@query("agg_mean_p90", "SELECT process_name, round(avg(net_calmar_ratio), 11) AS mean, round(quantile_cont(net_calmar_ratio, 0.9), 11) AS p90 FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    return _e(spark, sf).groupBy("process_name").agg(_r(F.avg("net_calmar_ratio"), 11).alias("mean"), _r(F.percentile("net_calmar_ratio", F.lit(0.9)), 11).alias("p90"))


_TB = EVALS + ", gm AS (SELECT factor, round(avg(net_sharpe_ratio), 11) AS m FROM evals GROUP BY 1)"


@query("agg_top_bottom", "SELECT * FROM (SELECT factor, m, 'top' AS part FROM gm ORDER BY m DESC, factor LIMIT 5) UNION ALL SELECT * FROM (SELECT factor, m, 'bottom' FROM gm ORDER BY m, factor LIMIT 5)", _TB)
def _(spark, sf):
    g = _e(spark, sf).groupBy("factor").agg(_r(F.avg("net_sharpe_ratio"), 11).alias("m"))
    return g.orderBy(F.desc("m"), "factor").limit(5).withColumn("part", F.lit("top")).unionByName(g.orderBy("m", "factor").limit(5).withColumn("part", F.lit("bottom")))


@query("agg_best_worst", "SELECT part, factor, total FROM (SELECT factor, total, row_number() OVER (ORDER BY total DESC, factor) AS a, row_number() OVER (ORDER BY total, factor) AS b FROM (SELECT factor, round(sum(ret), 6) AS total FROM rets GROUP BY 1)), (VALUES ('best'), ('worst')) p(part) WHERE (part = 'best' AND a <= 3) OR (part = 'worst' AND b <= 3)", RETURNS)
def _(spark, sf):
    g = panels.returns(spark, sf).groupBy("factor").agg(_r(F.sum("ret")).alias("total"))
    return g.orderBy(F.desc("total"), "factor").limit(3).select(F.lit("best").alias("part"), "factor", "total").unionByName(g.orderBy("total", "factor").limit(3).select(F.lit("worst").alias("part"), "factor", "total"))


@query("agg_year_metric_cmp", "SELECT CASE WHEN right(factor, 1) IN ('1', '3', '5', '7', '9') THEN 'odd' ELSE 'even' END AS dir, factor, year(day)::INTEGER AS year, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245), 5) AS sharpe FROM rets GROUP BY 1, 2, 3", RETURNS)
def _(spark, sf):
    side = F.when(F.substring("factor", -1, 1).isin("1", "3", "5", "7", "9"), "odd").otherwise("even")
    return panels.returns(spark, sf).groupBy(side.alias("dir"), "factor", F.year("day").alias("year")).agg(_r(metrics.sharpe("ret"), 5).alias("sharpe"))


@query("agg_year_curve", f"SELECT factor, {dt()} AS day, round((product(1 + ret) OVER (PARTITION BY factor, year(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS curve FROM rets", RETURNS)
def _(spark, sf):
    w = Window.partitionBy("factor", F.year("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return panels.returns(spark, sf).select("factor", day_text("day").alias("day"), _r(F.product(1 + F.col("ret")).over(w), 8).alias("curve"))


@query("agg_cmp_table", "SELECT factor, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side, printf('%.2f', CAST(round(CAST(round(avg(net_sharpe_ratio), 6) AS DECIMAL(18, 6)), 2) AS DOUBLE) + 0) AS sharpe, printf('%.2f', CAST(round(CAST(round(avg(hsr), 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)) AS hsr FROM evals GROUP BY 1, 2", EVALS)
def _(spark, sf):
    side = F.when(F.col("direction") > 0, "long").otherwise("short")
    return _e(spark, sf).groupBy("factor", side.alias("side")).agg(F.format_string("%.2f", F.round(_r(F.avg("net_sharpe_ratio")), 2) + 0).alias("sharpe"), F.format_string("%.2f", F.round(_r(F.avg("hsr")), 2)).alias("hsr"))


@query("agg_cum_excess", f"SELECT a.factor, {dt('a.day')} AS day, round(sum(a.ret - b.ret) OVER (PARTITION BY a.factor ORDER BY a.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0 AS excess FROM rets a JOIN (SELECT * FROM rets WHERE factor = 's0') b ON a.day = b.day WHERE a.factor <> 's0'", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf)
    base = r.where("factor = 's0'").select("day", F.col("ret").alias("base"))
    w = Window.partitionBy("factor").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return r.where("factor <> 's0'").join(base, "day").select("factor", day_text("day").alias("day"), (_r(F.sum(F.col("ret") - F.col("base")).over(w)) + 0).alias("excess"))


@query("agg_cluster_count", "SELECT test_name, count(*) AS factors, max(direction) + 1 AS groups FROM evals GROUP BY 1", EVALS)
def _(spark, sf):
    return _e(spark, sf).groupBy("test_name").agg(F.count("*").alias("factors"), (F.max("direction") + 1).alias("groups"))


for _n, _u in (("rsm_day", "day"), ("rsm_month", "month"), ("rsm_year", "year")):
    def _rsm(unit):
        def f(spark, sf):
            return _b(spark, sf).groupBy("symbol", day_text(F.date_trunc(unit, "bar_ts")).alias("bin")).agg(_r(F.sum("factor"), 4).alias("total"), _r(F.avg("price"), 9).alias("mean"))
        return f

    query(_n, f"SELECT symbol, strftime(date_trunc('{_u}', bar_ts), '%Y-%m-%d') AS bin, round(sum(factor), 4) AS total, round(avg(price), 9) AS mean FROM bars GROUP BY 1, 2", BARS)(_rsm(_u))


# --- evaluation rows

_PERIODS = "(VALUES (0, DATE '1995-01-01', DATE '1996-12-31'), (1, DATE '1996-01-01', DATE '1998-12-31'), (2, DATE '1998-06-01', DATE '2001-12-31')) p(pid, a, z)"


def _periods(spark):
    import datetime as d

    return spark.createDataFrame([(0, d.date(1995, 1, 1), d.date(1996, 12, 31)), (1, d.date(1996, 1, 1), d.date(1998, 12, 31)), (2, d.date(1998, 6, 1), d.date(2001, 12, 31))], "pid int, a date, z date")


@query("ev_row", f"""SELECT pid, factor, direction::BIGINT AS direction, days, round(valid / days::DOUBLE, 6) AS valid_prop, round(total * direction, 6) AS total, round(sharpe * direction, 5) AS sharpe, round(hsr, 6) AS hsr, round(hsr_std, 6) AS hsr_std, round((total * direction - 0.0004 * hsr * days) / days * 245, 5) AS net_annual
  FROM (SELECT pid, factor, CASE WHEN sum(ret) > 0 THEN 1 ELSE -1 END AS direction, count(*) AS days, count(*) FILTER (ret <> 0) AS valid, sum(ret) AS total, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245) AS sharpe, avg(turnover) AS hsr, stddev_samp(turnover) AS hsr_std FROM rets JOIN {_PERIODS} ON day BETWEEN a AND z GROUP BY 1, 2)""", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf).join(F.broadcast(_periods(spark)), F.col("day").between(F.col("a"), F.col("z")))  # three periods
    g = r.groupBy("pid", "factor").agg(F.when(F.sum("ret") > 0, 1).otherwise(-1).cast("long").alias("direction"), F.count("*").alias("days"), F.count_if(F.col("ret") != 0).alias("valid"), F.sum("ret").alias("t"), metrics.sharpe("ret").alias("s"), F.avg("turnover").alias("h"), F.stddev_samp("turnover").alias("hs"))
    net = (F.col("t") * F.col("direction") - 0.0004 * F.col("h") * F.col("days")) / F.col("days") * 245
    return g.select("pid", "factor", "direction", "days", _r(F.col("valid") / F.col("days")).alias("valid_prop"), _r(F.col("t") * F.col("direction")).alias("total"), _r(F.col("s") * F.col("direction"), 5).alias("sharpe"), _r("h").alias("hsr"), _r("hs").alias("hsr_std"), _r(net, 5).alias("net_annual"))


@query("ev_net", f"SELECT pid, factor, year(day)::INTEGER AS year, round(sum(ret - 0.0004 * turnover), 6) AS net, count(*) AS days FROM rets JOIN {_PERIODS} ON day BETWEEN a AND z GROUP BY 1, 2, 3", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf).join(F.broadcast(_periods(spark)), F.col("day").between(F.col("a"), F.col("z")))
    return r.groupBy("pid", "factor", F.year("day").alias("year")).agg(_r(F.sum(F.col("ret") - 0.0004 * F.col("turnover"))).alias("net"), F.count("*").alias("days"))


@query("ev_by_net", "SELECT round(sum(ret), 6) AS total, round(stddev_pop(ret), 6) AS dev, round(max(ret), 6) AS best, round(min(ret), 6) AS worst FROM net", _POS)
def _(spark, sf):
    n = net_daily(spark, sf)
    return n.agg(_r(F.sum("net")).alias("total"), _r(F.stddev_pop("net")).alias("dev"), _r(F.max("net")).alias("best"), _r(F.min("net")).alias("worst"))


@query("ev_trendrev_corr", " UNION ALL ".join(f"SELECT {n} AS lookback, round(avg(c), 5) AS corr FROM (SELECT symbol, corr(r, s) AS c FROM (SELECT symbol, s, lag(price, 2) OVER w / lag(price, {n + 2}) OVER w - 1 AS r FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) GROUP BY 1)" for n in (5, 10, 20)), SIGNAL)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    s = signal(spark, sf)
    for n in (5, 10, 20):
        s = s.withColumn(f"r{n}", ratio(F.lag("price", 2).over(w), F.lag("price", n + 2).over(w)) - 1)
    g = s.groupBy("symbol").agg(*(correlation(F.col(f"r{n}"), F.col("s")).alias(f"c{n}") for n in (5, 10, 20)))
    row = g.agg(*(_r(F.avg(f"c{n}"), 5).alias(f"c{n}") for n in (5, 10, 20)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("lookback"), F.col(f"c{n}").alias("corr")) for n in (5, 10, 20)))).alias("x")).select("x.*")


@query("ev_mom_corr", " UNION ALL ".join(f"SELECT symbol, {n} AS lookback, round(corr(coalesce(r, 0), coalesce(s, 0)), 5) AS corr FROM (SELECT symbol, s, price / lag(price, {n}) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS r FROM sig) GROUP BY 1" for n in (3, 6)), SIGNAL)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    s = signal(spark, sf).select("symbol", F.coalesce("s", F.lit(0.0)).alias("s"), *(F.coalesce(ratio(F.col("price"), F.lag("price", n).over(w)) - 1, F.lit(0.0)).alias(f"r{n}") for n in (3, 6)))
    g = s.groupBy("symbol").agg(*(_r(correlation(F.col(f"r{n}"), F.col("s")), 5).alias(f"c{n}") for n in (3, 6)))
    return g.select("symbol", F.explode(F.array(*(F.struct(F.lit(n).alias("lookback"), F.col(f"c{n}").alias("corr")) for n in (3, 6)))).alias("x")).select("symbol", "x.*")


@query("ev_sharpe_gp", f"SELECT factor, count(*) AS days, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(245), 5) AS sharpe FROM (SELECT f.factor, d.day, coalesce(ret, 0) AS r FROM (SELECT DISTINCT factor FROM rets) f, (SELECT unnest(generate_series(DATE '1995-01-02', DATE '2001-11-04', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN rets ON rets.factor = f.factor AND rets.day = d.day) GROUP BY 1", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf)
    spine = calendar.days(spark, "1995-01-02", "2001-11-04")
    full = r.select("factor").distinct().crossJoin(F.broadcast(spine)).join(r, ["factor", "day"], "left").withColumn("r", F.coalesce("ret", F.lit(0.0)))  # a calendar
    return full.groupBy("factor").agg(F.count("*").alias("days"), _r(metrics.sharpe("r"), 5).alias("sharpe"))


@query("ev_pos_ratio", "SELECT symbol, CASE WHEN p > 0.5 THEN 1 - p ELSE p END AS pos_ratio FROM (SELECT symbol, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END), 6) AS p FROM sig GROUP BY 1)", SIGNAL)
def _(spark, sf):
    g = signal(spark, sf).groupBy("symbol").agg(_r(F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0))).alias("p"))
    return g.select("symbol", F.when(F.col("p") > 0.5, 1 - F.col("p")).otherwise(F.col("p")).alias("pos_ratio"))


@query("m_ext_ppt", "SELECT test_name, process_name, factor, round(net_return_annualized / nullif(hsr, 0) / 245, 8) AS net_ppt FROM evals", EVALS)
def _(spark, sf):
    return _e(spark, sf).select("test_name", "process_name", "factor", _r(ratio(F.col("net_return_annualized"), F.col("hsr")) / 245, 8).alias("net_ppt"))


# --- calendar and strings

_SPAN = "concat(CAST(l_linenumber AS INTEGER), 'd', CAST(l_suppkey % 4 AS INTEGER), 'h', CAST(l_partkey % 60 AS INTEGER), 'min')"


@query("cal_parse_time", f"SELECT {_SPAN} AS text, max(CAST(l_linenumber * 240 + l_suppkey % 4 * 60 + l_partkey % 60 AS BIGINT)) AS minutes, count(*) AS lines FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Spans of time that the line items spell out, in trading minutes."""
    number = lambda c: F.col(c).cast("int").cast("string")
    lines = panels.table(spark, sf, "lineitem").withColumns({"h": F.col("l_suppkey") % 4, "m": F.col("l_partkey") % 60})
    text = F.concat(number("l_linenumber"), F.lit("d"), number("h"), F.lit("h"), number("m"), F.lit("min"))
    return lines.groupBy(text.alias("text")).agg(F.count("*").alias("lines")).select("text", trading_minutes(F.col("text")).cast("long").alias("minutes"), "lines")


_TD = "td AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE isodow(o_orderdate) < 6  AND o_orderpriority = '1-URGENT')"


def _trading(spark, sf):
    return panels.table(spark, sf, "orders").where("weekday(o_orderdate) < 5 and o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day")).distinct()


@query("cal_prev", f"SELECT {dt('d')} AS day, {dt('lag(d) OVER (ORDER BY d)')} AS previous FROM td", _TD)
def _(spark, sf):
    return calendar.previous(_trading(spark, sf)).select(day_text("day").alias("day"), day_text("previous").alias("previous"))


@query("cal_prev_n", f"SELECT {dt('a.d')} AS day, {dt('max(b.d)')} AS previous FROM td a LEFT JOIN td b ON b.d < a.d - 10 GROUP BY 1", _TD)
def _(spark, sf):
    return calendar.previous(_trading(spark, sf), days_back=10).select(day_text("day").alias("day"), day_text("previous").alias("previous"))


@query("cal_trading_days", f"SELECT {dt('d')} AS day FROM td WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'", _TD)
def _(spark, sf):
    return _trading(spark, sf).where("day between date'1996-01-01' and date'1996-06-30'").select(day_text("day").alias("day"))


@query("cal_third_friday", f"""SELECT ym, {dt('min(d)')} AS expiry FROM (SELECT strftime(m, '%Y-%m') AS ym, m::DATE + ((5 - isodow(m) + 7) % 7)::INTEGER + 14 AS f FROM (SELECT unnest(generate_series(DATE '1995-06-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS m)) JOIN td ON d >= f GROUP BY 1""", _TD)
def _(spark, sf):
    return calendar.expiries(spark, "1995-06-01", "1997-12-01", _trading(spark, sf)).select(F.date_format("month", "yyyy-MM").alias("ym"), day_text("expiry").alias("expiry"))


@query("cal_contract", "SELECT o_orderkey, 'IC' || strftime(CAST(o_orderdate AS DATE) + 1, '%y%m') AS contract FROM orders")
def _(spark, sf):
    return panels.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("IC"), F.date_format(F.date_add("o_orderdate", 1), "yyMM")).alias("contract"))


def _order_days(spark, sf):
    return panels.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))


@query("cal_daily_range", f"""SELECT {dt('c.day')} AS day, count(o.o_orderkey) AS orders
  FROM (SELECT CAST(unnest(generate_series(DATE '1996-02-25', DATE '1996-03-05', INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = c.day GROUP BY 1""")
def _(spark, sf):
    """Orders of every day of a range, over a leap day; days without any have 0."""
    n = _order_days(spark, sf).groupBy("day").agg(F.count("*").alias("orders"))
    return calendar.days(spark, "1996-02-25", "1996-03-05").join(n, "day", "left").select(day_text("day").alias("day"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("cal_intraday_grid", """SELECT strftime(g.t, '%H:%M') AS left_edge, count(e.ts) AS events
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 09:30:00', TIMESTAMP '2024-01-02 11:25:00', INTERVAL 5 MINUTES)) AS t) g
  LEFT JOIN events e ON strftime(e.ts, '%H:%M') >= strftime(g.t, '%H:%M') AND strftime(e.ts, '%H:%M') < strftime(g.t + INTERVAL 5 MINUTES, '%H:%M') GROUP BY 1""")
def _(spark, sf):
    """Events of all days in each interval of a session."""
    at = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 5) * 5
    edge = F.format_string("%02d:%02d", F.floor(at / 60), at % 60)
    n = panels.table(spark, sf, "events").groupBy(edge.alias("left_edge")).agg(F.count("*").alias("events"))
    return calendar.intraday(spark, "09:30", "11:30", 5).join(n, "left_edge", "left").select("left_edge", F.coalesce("events", F.lit(0)).alias("events"))


def _in_periods(spark, sf, periods, name: str):
    """Orders in the fit and the prediction span of each period."""
    p = spark.createDataFrame([(k, *each) for k, each in periods], f"{name} int, fit_start date, fit_end date, pred_start date, pred_end date")
    n = _order_days(spark, sf).groupBy("day").agg(F.count("*").alias("n"))  # one row a day
    inside = lambda part: F.coalesce(F.sum(F.when(F.col("day").between(F.col(f"{part}_start"), F.col(f"{part}_end")), F.col("n"))), F.lit(0))
    keys = [name, "fit_start", "fit_end", "pred_start", "pred_end"]
    both = n.join(F.broadcast(p), F.col("day").between(F.col("fit_start"), F.col("pred_end"))).groupBy(*keys).agg(inside("fit").alias("fit_orders"), inside("pred").alias("pred_orders"))  # a list of periods
    return both.select(name, *(day_text(c).alias(c) for c in keys[1:]), "fit_orders", "pred_orders")


def _in_periods_sql(name: str, values: str) -> str:
    return f"""SELECT {name}, {', '.join(f"{dt(c)} AS {c}" for c in ('fit_start', 'fit_end', 'pred_start', 'pred_end'))}, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN fit_start AND fit_end) AS fit_orders, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN pred_start AND pred_end) AS pred_orders
  FROM (VALUES {values}) t({name}, fit_start, fit_end, pred_start, pred_end) JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN fit_start AND pred_end GROUP BY 1, 2, 3, 4, 5"""


@query("cal_rolling", _in_periods_sql("pid", "(0, DATE '1993-01-01', DATE '1993-12-31', DATE '1994-01-01', DATE '1994-06-30'), (1, DATE '1993-01-01', DATE '1994-06-30', DATE '1994-07-01', DATE '1994-12-31'), (2, DATE '1993-01-01', DATE '1994-12-31', DATE '1995-01-01', DATE '1995-06-30')"))
def _(spark, sf):
    periods = calendar.rolling("1993-01-01", "1994-01-01", "1995-06-30", step_months=6, window_months=24)
    return _in_periods(spark, sf, list(enumerate(periods)), "pid")


@query("cal_lb_lists", _in_periods_sql("months", "(6, DATE '1993-07-01', DATE '1993-12-31', DATE '1994-01-01', DATE '1994-06-30'), (12, DATE '1993-01-01', DATE '1993-12-31', DATE '1994-01-01', DATE '1994-06-30'), (24, DATE '1993-01-01', DATE '1993-12-31', DATE '1994-01-01', DATE '1994-06-30')"))
def _(spark, sf):
    return _in_periods(spark, sf, [(m, calendar.rolling("1993-01-01", "1994-01-01", "1994-06-30", 6, m)[0]) for m in (6, 12, 24)], "months")


@query("cal_period_name", "SELECT DISTINCT strftime(day, '%y%m%d') || '_' || strftime(day + 30, '%y%m%d') AS name FROM rets", RETURNS)
def _(spark, sf):
    return panels.returns(spark, sf).select(calendar.period_name(F.col("day"), F.date_add("day", 30)).alias("name")).distinct()


@query("cal_relativedelta", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 27 MONTHS, '%Y-%m-%d') AS later FROM orders")
def _(spark, sf):
    months, days = calendar.parse_delta("2 years, 3 months")
    return panels.table(spark, sf, "orders").select("o_orderkey", day_text(F.date_add(F.add_months("o_orderdate", months), days)).alias("later"))


@query("cal_tosec", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS second_of_day FROM events")
def _(spark, sf):
    e = panels.table(spark, sf, "events")
    return e.select("event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))).cast("long").alias("second_of_day"))


@query("fn_str", r"SELECT DISTINCT p_name, regexp_matches(p_name, '^s.*ring$') AS hit, split_part(p_name, ' ', 2) AS second, regexp_extract(p_brand, '#(\d+)', 1) AS num, ends_with(p_type, 'Y') AS y FROM part")
def _(spark, sf):
    return panels.table(spark, sf, "part").select("p_name", F.col("p_name").rlike("^s.*ring$").alias("hit"), F.split("p_name", " ")[1].alias("second"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("num"), F.col("p_type").endswith("Y").alias("y")).distinct()


@query("fn_math", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity) + sqrt(l_extendedprice) + exp(l_tax) + abs(l_discount - 0.05) + sign(l_tax - 0.04) + least(greatest(l_quantity, 5), 20), 6) AS v FROM lineitem")
def _(spark, sf):
    v = F.ln("l_quantity") + F.sqrt("l_extendedprice") + F.exp("l_tax") + F.abs(F.col("l_discount") - 0.05) + F.signum(F.col("l_tax") - 0.04) + F.least(F.greatest("l_quantity", F.lit(5)), F.lit(20))
    return panels.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(v).alias("v"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return panels.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
