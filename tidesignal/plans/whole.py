"""Whole jobs, from selection or filter to evaluation, and the registries called by name."""

from __future__ import annotations

import functools
import re
import uuid

from pyspark import SparkFiles
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import soft_or, timedelta_seconds
from ..operators import apply, calendar, cluster, metrics, models, pnl, rules, scaling, select
from ..registry import oracle_sql
from ..sources import files, jdbc, panels, tables
from .core import _POS, FEE, RULE_PARAMS, W, positions, signal
from .kit import BARS, EVALS, RETURNS, SIGNAL, query, stamp, ts
from .models import _CHOSEN, _clustered, _folder
from .tables import _GROUPS, _SOFT, _group_means, _overlay, _trend

KEYS = ", ".join(_CHOSEN)


def _list(spark, rows, schema):
    """A list of parameters; its length does not depend on the data, so joins may broadcast it."""
    return F.broadcast(spark.createDataFrame(rows, schema))


# --- filters and alphas by name

_APPLY = SIGNAL + """, fv AS (SELECT symbol, bar_ts, round(price / 100, 6) AS vol FROM bars WHERE factor > 40),
alphas AS (SELECT 'ahead' AS alpha, symbol, bar_ts, s FROM sig UNION ALL SELECT 'against', symbol, bar_ts, -s FROM sig),
filters AS (SELECT 'vol' AS filter, symbol, bar_ts, vol AS v FROM fv UNION ALL SELECT 'calm', symbol, bar_ts, 1 - vol FROM fv),
applied AS (SELECT alpha, filter, fn, symbol, bar_ts, v, CASE fn WHEN 'mul' THEN s * v WHEN 'mask' THEN CASE WHEN v > 0.5 THEN s WHEN v IS NOT NULL THEN 0 END
    ELSE CASE WHEN s > 0 THEN s * v WHEN s < 0 THEN s * (1 - v) ELSE s END END AS s
  FROM alphas CROSS JOIN (VALUES ('vol'), ('calm'), ('absent')) n(filter) CROSS JOIN (VALUES ('mul'), ('cond_mul'), ('mask')) u(fn) LEFT JOIN filters USING (filter, symbol, bar_ts))"""


def _applied(spark, sf):
    s, f = _overlay(spark, sf)
    s = s.select("symbol", "bar_ts", "s")
    alphas = s.withColumn("alpha", F.lit("ahead")).unionByName(s.select("symbol", "bar_ts", (-F.col("s")).alias("s")).withColumn("alpha", F.lit("against")))
    # both filters are columns of one row, so the bars are read once
    filters = f.select("symbol", "bar_ts", F.explode(F.array(F.struct(F.lit("vol").alias("filter"), F.col("vol").alias("v")), F.struct(F.lit("calm").alias("filter"), (1 - F.col("vol")).alias("v")))).alias("x")).select("x.filter", "symbol", "bar_ts", "x.v")
    return apply.batch(alphas, filters, ["vol", "calm", "absent"], ["mul", "cond_mul", "mask"])


@query("ap_batch", "SELECT alpha, filter, fn, count(*) AS bars, count(v) AS matched, count(v) > 0 AS ok, round(avg(s), 9) AS mean_signal FROM applied GROUP BY 1, 2, 3", _APPLY)
def _(spark, sf):
    return apply.summary(_applied(spark, sf)).withColumn("mean_signal", F.round("mean_signal", 9))


@query("udf_apply", f"SELECT fn, symbol, {ts()} AS ts, round(s, 9) + 0 AS s FROM applied WHERE alpha = 'against' AND filter = 'vol'", _APPLY)
def _(spark, sf):
    a, f = _overlay(spark, sf)
    both = a.select("symbol", "bar_ts", (-F.col("s")).alias("s")).join(f.withColumnRenamed("vol", "v"), ["symbol", "bar_ts"], "left")
    out = None
    for name in ("mul", "cond_mul", "mask"):
        one = apply.by_name(both, name).select(F.lit(name).alias("fn"), "symbol", stamp("bar_ts").alias("ts"), (F.round("s", 9) + 0).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out


_CALLED = ("binary", "rev", "v0", "v1", "v3", "v5")


@query("udf_rules", " UNION ALL ".join(f"SELECT '{r}' AS rule, symbol, count(*) AS bars, count(pos) AS known, round(sum(pos), 3) + 0 AS total FROM ({oracle_sql()[f'tr_{r}']}) GROUP BY symbol" for r in _CALLED))
def _(spark, sf):
    """Rules called by their names with the parameter sets of their own queries."""
    out = None
    for r in _CALLED:
        one = rules.run_rule(signal(spark, sf), r, RULE_PARAMS[r]).withColumn("rule", F.lit(r)).select("rule", "symbol", F.round("pos", 6).alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("rule", "symbol").agg(F.count("*").alias("bars"), F.count("pos").alias("known"), (F.round(F.sum("pos"), 3) + 0).alias("total"))


_PER = "net_return_annualized / nullif(hsr, 0) / 245"
_FILTERS = {
    "v0": "sharpe_ratio > 2", "v1": "sharpe_ratio > 2 AND return_annualized / nullif(hsr, 0) > 0.145", "v2": "sharpe_ratio > 1.75", "v3": "net_sharpe_ratio > 1.75",
    "v4": "net_sharpe_ratio > 1.6", "v5": "net_sortino_ratio > 1.5", "v6": "net_sharpe_ratio > 1.8", "v7": "net_sharpe_ratio > 1.9", "v8": "net_sharpe_ratio > 2",
    "v9": "net_sharpe_ratio > 2.2", "v10": f"net_sharpe_ratio > 1.8 AND {_PER} > 0.001", "v11": f"net_sharpe_ratio > 1.8 AND {_PER} > 0.0012",
    "v12": "net_sharpe_ratio > 1.8 AND net_calmar_ratio > 2.5", "v13": "net_sharpe_ratio > 1.8 AND net_calmar_ratio > 4",
    "v14": f"net_sharpe_ratio > 1.8 AND net_calmar_ratio > 2.5 AND {_PER} > 0.0012", "v15": f"net_sharpe_ratio > 1.8 AND net_calmar_ratio > 4 AND {_PER} > 0.001",
    "v16": "net_sharpe_ratio > 1 AND direction > 0", "v17": "net_sharpe_ratio > 0.9 AND direction > 0", "v18": "net_sharpe_ratio > 1.4",
}


@query("udf_filters", " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER ({c}) AS kept FROM evals" for n, c in _FILTERS.items()), EVALS)
def _(spark, sf):
    names = sorted(select.FILTERS)
    counts = panels.evaluations(spark, sf).agg(*(F.count_if(select.FILTERS[n]()).alias(n) for n in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("kept")) for n in names))).alias("x")).select("x.*")


# --- selection

_DAYS = EVALS + """, fd AS (SELECT 't' || (l_suppkey % 4) AS test_name, p_type || '_TS20ma' AS process_name, replace(p_brand, '#', '') || '-w' || (p_size % 3) || 'd-i' || (p_size % 2) AS factor,
  CAST(l_shipdate AS DATE) AS day, round((avg(l_quantity) - 25.5) / 1000, 6) AS gain FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


@query("sel_copy", f"SELECT {KEYS}, 'picked' AS tag_name, count(*) AS days, round(sum(gain), 6) AS total FROM fd JOIN (SELECT {KEYS} FROM evals WHERE net_sharpe_ratio > 1.5) USING ({KEYS}) GROUP BY {KEYS}", _DAYS)
def _(spark, sf):
    """Daily rows of the factors that pass, written under a new tag and read from there."""
    at = _folder(spark)
    chosen = panels.evaluations(spark, sf).where("net_sharpe_ratio > 1.5").select(*_CHOSEN)
    picked = panels.factor_days(spark, sf).join(chosen, _CHOSEN, "left_semi").withColumn("tag_name", F.lit("picked"))
    files.write_panel(picked, at, ["tag_name"])
    # the schema is given, as no factor may pass and then there is no file to tell it
    return spark.read.schema(picked.schema).parquet(at).groupBy(*_CHOSEN, "tag_name").agg(F.count("*").alias("days"), F.round(F.sum("gain"), 6).alias("total"))


@query("sel_pipeline_basic_cluster")
def _(spark, sf):
    """Best tests that pass, clustered; the two best of each original factor's group, without the suffixes of their transforms."""
    best = select.best_test(panels.evaluations(spark, sf).where("test_name <> 't3'"), "net_sharpe_ratio")
    good = best.where("net_sharpe_ratio > 0.6 and direction > 0").select(*_CHOSEN, "net_sharpe_ratio").withColumn("org", F.split("factor", "-")[0])
    top = select.top_n(_clustered(spark, sf, good, 0.95), "net_sharpe_ratio", 2, ["org", "group"], ["factor", "process_name"])
    p, f = select.strip_ma(F.col("process_name"), F.col("factor"))
    return top.select("org", "group", p.alias("process_name"), f.alias("factor"))


# --- periods

PERIODS = calendar.rolling("1995-01-01", "1997-01-01", "1998-06-30", step_months=6, window_months=24)
_MODES = [(mode, pid, *PERIODS[pid]) for mode in calendar.MODES for pid in calendar.of_mode(PERIODS, mode)]
_INC = RETURNS + ", pm(mode, pid, fs, fe, ps, pe) AS (VALUES ('rolling', 0, DATE '1995-01-01', DATE '1996-12-31', DATE '1997-01-01', DATE '1997-06-30'), ('rolling', 1, DATE '1995-07-01', DATE '1997-06-30', DATE '1997-07-01', DATE '1997-12-31'), ('rolling', 2, DATE '1996-01-01', DATE '1997-12-31', DATE '1998-01-01', DATE '1998-06-30'), ('update', 2, DATE '1996-01-01', DATE '1997-12-31', DATE '1998-01-01', DATE '1998-06-30'), ('update_predict', 2, DATE '1996-01-01', DATE '1997-12-31', DATE '1998-01-01', DATE '1998-06-30'))"


@query("st_incremental", """SELECT mode, pid::INTEGER AS pid, factor, (CASE WHEN fitted > 0 THEN 1 ELSE -1 END)::INTEGER AS direction, fitted + 0 AS fitted, round(CASE WHEN fitted > 0 THEN 1 ELSE -1 END * later, 6) + 0 AS predicted
  FROM (SELECT mode, pid, factor, round(sum(ret) FILTER (day <= fe), 6) AS fitted, sum(ret) FILTER (day >= ps) AS later FROM rets JOIN pm ON day BETWEEN fs AND pe GROUP BY 1, 2, 3)""", _INC)
def _(spark, sf):
    """Each mode fits a direction and applies it to the days after, for the periods that the mode asks for, in one pass over the days."""
    p = _list(spark, _MODES, "mode string, pid int, fs date, fe date, ps date, pe date")
    r = panels.returns(spark, sf).join(p, F.col("day").between(F.col("fs"), F.col("pe")))
    got = r.groupBy("mode", "pid", "factor").agg(F.round(F.sum(F.when(F.col("day") <= F.col("fe"), F.col("ret"))), 6).alias("fitted"), F.sum(F.when(F.col("day") >= F.col("ps"), F.col("ret"))).alias("later"))
    sign = F.when(F.col("fitted") > 0, 1).otherwise(-1)
    return got.select("mode", "pid", "factor", sign.alias("direction"), (F.col("fitted") + 0).alias("fitted"), (F.round(sign * F.col("later"), 6) + 0).alias("predicted"))


_SELECTED = [("950101_950630", "1995-01-01", "1995-06-30"), ("960101_960630", "1996-01-01", "1996-06-30"), ("970101_970630", "1997-01-01", "1997-06-30")]
_JUDGED = [("951001_960331", "1995-10-01", "1996-03-31"), ("961001_970331", "1996-10-01", "1997-03-31"), ("980101_980630", "1998-01-01", "1998-06-30")]
_rows = lambda rows: ", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in rows)
_DYN = RETURNS + f""", sp(select_period, a, z) AS (VALUES {_rows(_SELECTED)}), ep(period, f, l) AS (VALUES {_rows(_JUDGED)}),
pick AS (SELECT select_period, factor FROM rets JOIN sp ON day BETWEEN a AND z GROUP BY 1, 2 HAVING round(sum(ret), 6) > 0),
matched AS (SELECT period, f, l, arg_max(select_period, z) AS select_period FROM ep JOIN sp ON z < f GROUP BY 1, 2, 3),
tf AS (SELECT factor, day, ret, round(sum(ret) OVER w5, 6) AS ma5, round(sum(ret) OVER w20, 6) AS ma20 FROM rets
  WINDOW w5 AS (PARTITION BY factor ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY factor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
moved AS (SELECT factor, day, 'ma5' AS t, sign(ma5) * ret AS gain FROM tf UNION ALL SELECT factor, day, 'ma20', sign(ma20) * ret FROM tf)"""


@query("ev_dynamic", """SELECT period, select_period, factor || '_' || t AS process, count(gain) AS days, round(sum(gain), 6) + 0 AS total, round(avg(gain) / nullif(stddev_pop(gain), 0) * sqrt(245), 5) AS sharpe
  FROM moved JOIN pick USING (factor) JOIN matched USING (select_period) WHERE day BETWEEN f AND l GROUP BY 1, 2, 3""", _DYN)
def _(spark, sf):
    """Factors chosen in the latest select period before each evaluation, under each transform, evaluated over that period's days."""
    r = panels.returns(spark, sf)
    dates = lambda rows, cols: _list(spark, [(n, a, z) for n, a, z in rows], "n string, a string, z string").select(F.col("n").alias(cols[0]), F.col("a").cast("date").alias(cols[1]), F.col("z").cast("date").alias(cols[2]))
    sp, ep = dates(_SELECTED, ("select_period", "a", "z")), dates(_JUDGED, ("period", "f", "l"))
    pick = r.join(F.broadcast(sp), F.col("day").between(F.col("a"), F.col("z"))).groupBy("select_period", "factor").agg(F.round(F.sum("ret"), 6).alias("x")).where("x > 0").select("select_period", "factor")
    matched = ep.join(F.broadcast(sp), F.col("z") < F.col("f")).groupBy("period", "f", "l").agg(F.max_by("select_period", "z").alias("select_period"))
    w = Window.partitionBy("factor").orderBy("day")
    tails = [F.struct(F.lit(f"ma{n}").alias("t"), (F.signum(F.round(F.sum("ret").over(w.rowsBetween(-n, -1)), 6)) * F.col("ret")).alias("gain")) for n in (5, 20)]
    moved = r.select("factor", "day", F.array(*tails).alias("x")).select("factor", "day", F.explode("x").alias("x")).select("factor", "day", "x.*")
    judged = moved.join(F.broadcast(matched), F.col("day").between(F.col("f"), F.col("l"))).join(pick, ["select_period", "factor"], "left_semi")
    got = judged.groupBy("period", "select_period", F.concat_ws("_", "factor", "t").alias("process"))
    return got.agg(F.count("gain").alias("days"), (F.round(F.sum("gain"), 6) + 0).alias("total"), F.round(metrics.sharpe("gain"), 5).alias("sharpe"))


# --- grids

_WALK = [(0, "2024-01-10", "2024-01-17"), (1, "2024-01-17", "2024-01-24"), (2, "2024-01-24", "2024-01-31")]
_TUNE = _SOFT + """, nx AS (SELECT symbol, bar_ts, lead(price) OVER (PARTITION BY symbol ORDER BY bar_ts) / price - 1 AS rtn FROM bars),
cell AS (SELECT k, t, h, symbol, CAST(bar_ts AS DATE) AS day, sum(rtn * s * (1 - (1 - 1 / (1 + exp(-k * (vol - t)))) * (1 - 1 / (1 + exp(5.0 * (score - h)))))) AS g
  FROM tr JOIN fv USING (symbol, bar_ts) JOIN nx USING (symbol, bar_ts), (VALUES (4.0::DOUBLE), (8.0::DOUBLE)) a(k), (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) b(t), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) c(h) GROUP BY 1, 2, 3, 4, 5),
byday AS (SELECT k, t, h, day, avg(g) AS g FROM cell GROUP BY 1, 2, 3, 4),
wf AS (SELECT pid, k, t, h, round(avg(g) FILTER (day < cut) / nullif(stddev_pop(g) FILTER (day < cut), 0) * sqrt(245), 6) AS fit_sharpe, count(g) FILTER (day >= cut) AS days, sum(g) FILTER (day >= cut) AS total
  FROM byday JOIN (VALUES (0, DATE '2024-01-10', DATE '2024-01-17'), (1, DATE '2024-01-17', DATE '2024-01-24'), (2, DATE '2024-01-24', DATE '2024-01-31')) p(pid, cut, upto) ON day < upto GROUP BY 1, 2, 3, 4)"""


@query("ap_grid_tune", """SELECT pid::INTEGER AS pid, k, t, h, fit_sharpe, days, round(total, 8) + 0 AS total FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY fit_sharpe DESC NULLS LAST, k, t, h) AS r FROM wf) WHERE r = 1""", _TUNE)
def _(spark, sf):
    """The grid's cells filter the signal, gain by day, and the best cell of each fit window is followed over the days after it."""
    _, f = _overlay(spark, sf)
    cells = [(k, t, h) for k in (4.0, 8.0) for t in (0.2, 0.3) for h in (0.0, 0.1)]
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(h).alias("h")) for k, t, h in cells)))
    both = pnl.forward_return(_trend(spark, sf)).join(f, ["symbol", "bar_ts"]).withColumn("g", grid)
    gate = soft_or(1 / (1 + F.exp(-F.col("g.k") * (F.col("vol") - F.col("g.t")))), 1 / (1 + F.exp(5.0 * (F.col("score") - F.col("g.h")))))
    names = [F.col(f"g.{c}").alias(c) for c in "kth"]
    byday = both.groupBy(*names, "symbol", F.to_date("bar_ts").alias("day")).agg(F.sum(F.col("rtn") * F.col("s") * gate).alias("x")).groupBy("k", "t", "h", "day").agg(F.avg("x").alias("x"))
    p = _list(spark, _WALK, "pid int, cut string, upto string").select("pid", F.col("cut").cast("date").alias("cut"), F.col("upto").cast("date").alias("upto"))
    known = F.col("day") < F.col("cut")
    walked = byday.join(F.broadcast(p), F.col("day") < F.col("upto")).withColumn("fit", F.when(known, F.col("x"))).withColumn("later", F.when(~known, F.col("x")))
    each = walked.groupBy("pid", "k", "t", "h").agg(F.round(metrics.sharpe("fit"), 6).alias("fit_sharpe"), F.count("later").alias("days"), F.sum("later").alias("total"))
    best = select.top_n(each, "fit_sharpe", 1, ["pid"], ["k", "t", "h"])
    return best.select("pid", "k", "t", "h", "fit_sharpe", "days", (F.round("total", 8) + 0).alias("total"))


LIMITS, ALPHAS = (0.9, 0.97, 0.99), (0.0, 0.001, 0.01, 0.1)


def grid_panel(spark, sf, limits=LIMITS):
    """``config, group, day, v``: mean return of each cluster of factors at each linkage limit, and ``day, y``: the mean return of the next day."""
    r = panels.returns(spark, sf)
    at = [cluster.groups(r, None, limit, value="ret").withColumn("config", F.lit(k)) for k, limit in enumerate(limits)]
    g = functools.reduce(lambda x, y: x.unionByName(y), at)
    panel = r.join(g, "factor").groupBy("config", "group", "day").agg(F.avg("ret").alias("v"))
    byday = r.groupBy("day").agg(F.avg("ret").alias("m"))
    return panel, byday.select("day", F.lead("m").over(Window.orderBy("day")).alias("y")).where("y is not null")  # one row a day


@query("par_grid_model")
def _(spark, sf):
    """Every cluster level with every penalty: fit until the end of 1996, judged on the days after it."""
    panel, label = grid_panel(spark, sf)
    return models.ridge_grid(panel, label, "1997-01-01", list(ALPHAS))


@query("agg_cluster_count_period")
def _(spark, sf):
    """Factors and cluster groups of each period: ``period, factors, groups``."""
    out = []
    for name, first, last in _SELECTED:
        r = panels.returns(spark, sf).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        g = cluster.groups(r, None, 0.9, value="ret")
        out.append(g.agg(F.lit(name).alias("period"), F.count("*").alias("factors"), F.max("group").alias("groups")))
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- merge, test, evaluate

_MERGED = _POS.replace("CASE WHEN n >= 10", "coalesce(CASE WHEN n >= 10", 1).replace(" END AS s FROM sigraw", " END, 0) AS s FROM sigraw", 1).replace(BARS, f"bars AS (WITH {_GROUPS} SELECT 'merged' AS symbol, bar_ts, p.price, m.factor FROM (SELECT bar_ts, round(avg(v), 9) AS factor FROM g GROUP BY 1) m JOIN (SELECT bar_ts, round(avg(price), 9) AS price FROM bars GROUP BY 1) p USING (bar_ts))", 1)


@query("mg_period", "SELECT 'merged' AS name, count(*) AS days, round(sum(ret), 6) + 0 AS total, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245), 5) AS sharpe, round(avg(hsr), 6) AS hsr FROM net", _MERGED)
def _(spark, sf):
    """Means of groups, their mean, rescaled and written; then the rule is run over it and judged after fees, against the mean price."""
    at = _folder(spark)
    m = _group_means(spark, sf).groupBy("bar_ts").agg(F.round(F.avg("v"), 9).alias("factor"))
    price = panels.bars(spark, sf).groupBy("bar_ts").agg(F.round(F.avg("price"), 9).alias("price"))
    one = m.join(price, "bar_ts").withColumn("symbol", F.lit("merged"))
    files.write_panel(scaling.normalise(one, "factor", "minmax", W, out="s").withColumn("s", F.coalesce(F.round("s", 6), F.lit(0.0))), at)
    pos = pnl.gains(pnl.forward_return(rules.reopening(spark.read.parquet(at), open_at=0.6, close_at=0.2)))
    n = pnl.net(pnl.daily_gains(pos), pnl.turnover(pos), FEE).withColumn("net", F.round("net", 9))
    return n.agg(F.lit("merged").alias("name"), F.count("*").alias("days"), (F.round(F.sum("net"), 6) + 0).alias("total"), F.round(metrics.sharpe("net"), 5).alias("sharpe"), F.round(F.avg("hsr"), 6).alias("hsr"))


_LIVE = _POS + ", live AS (WITH " + _POS.replace("FROM events GROUP BY", "FROM events WHERE ts >= TIMESTAMP '2024-01-14 12:00:00' GROUP BY", 1) + " SELECT symbol, bar_ts, pos FROM pos)"


@query("st_rt_compare", """SELECT a.symbol, count(*) AS bars, count(*) FILTER (a.pos IS DISTINCT FROM b.pos) AS differ, max(abs(coalesce(a.pos, 0) - coalesce(b.pos, 0))) AS max_diff
  FROM pos a LEFT JOIN live b USING (symbol, bar_ts) WHERE CAST(a.bar_ts AS DATE) = DATE '2024-01-15' GROUP BY 1""", _LIVE)
def _(spark, sf):
    """Positions of a day by the whole history against those of a run that was started half a day before."""
    late = panels.bars(spark, sf).where("bar_ts >= timestamp_ntz'2024-01-14 12:00:00'")
    s = scaling.normalise(late, "factor", "minmax", W, out="s").withColumn("s", F.round("s", 6))
    live = rules.reopening(s, open_at=0.6, close_at=0.2).select("symbol", "bar_ts", F.col("pos").alias("live"))
    day = "to_date(bar_ts) = date'2024-01-15'"
    both = positions(spark, sf).where(day).join(live.where(day), ["symbol", "bar_ts"], "left")
    gap = F.abs(F.coalesce("pos", F.lit(0.0)) - F.coalesce("live", F.lit(0.0)))
    return both.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(~F.col("pos").eqNullSafe(F.col("live"))).alias("differ"), F.max(gap).alias("max_diff"))


# --- spans of time, folders

@query("cal_td", """SELECT event_id, x::DOUBLE AS seconds, (x // 60)::BIGINT AS minutes FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60
  WHEN 1 THEN day(ts) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) ELSE minute(ts) * 60 + 30 END::BIGINT AS x FROM events)""")
def _(spark, sf):
    e = panels.table(spark, sf, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.hour("ts"), F.lit("h "), F.minute("ts"), F.lit("min"))).when(k == 1, F.concat(F.day("ts"), F.lit(" days "), F.date_format("ts", "HH:mm:ss"))).otherwise(F.concat(F.minute("ts"), F.lit(".5m")))
    seconds = timedelta_seconds(text)
    return e.select("event_id", seconds.alias("seconds"), F.floor(seconds / 60).cast("long").alias("minutes"))


@query("src_leafdirs", "SELECT DISTINCT 'evals' AS tag_name, 'test_name=' || test_name || '/direction=' || direction AS leaf FROM evals WHERE NOT (test_name = 't3' AND direction = -1)", EVALS)
def _(spark, sf):
    at = _folder(spark)
    files.write_panel(panels.evaluations(spark, sf), at, ["test_name", "direction"])
    got = files.leaf_folders(spark, {at: {"tag_name": "evals", "exclude": ["test_name=t3/direction=-1"]}})
    return spark.createDataFrame([(tag, leaf) for _, tag, leaf in got], "tag_name string, leaf string")


@query("src_pattern", "SELECT DISTINCT symbol AS name FROM bars WHERE symbol LIKE '%i%'", BARS)
def _(spark, sf):
    at = _folder(spark)
    files.write_panel(panels.bars(spark, sf), at, ["symbol"])
    return spark.createDataFrame([(n,) for n in files.list_factors(spark, at, r"symbol=(.*i.*)")], "name string")


_CONFIGS = {".toml": """symbols = ["click", "view"]

[rule]
open_at = 0.6
close_at = 0.2
""", ".yaml": """symbols: [error, signup]
rule:
  open_at: 0.6
  close_at: 0.2
"""}  # fmt: skip


@query("src_config", f"SELECT CASE WHEN symbol IN ('click', 'view') THEN '.toml' ELSE '.yaml' END AS config, symbol, {ts()} AS ts, pos FROM pos WHERE symbol IN ('click', 'view', 'error', 'signup')", _POS)
def _(spark, sf):
    """The rule under configurations read from any store: which symbols, and the rule's levels."""
    at, out = _folder(spark), None
    for kind, text in _CONFIGS.items():
        files.write_text(spark, f"{at}/run{kind}", text)
        c = files.load_config(spark, f"{at}/run{kind}")
        one = rules.reopening(signal(spark, sf).where(F.col("symbol").isin(c["symbols"])), **c["rule"]).select(F.lit(kind).alias("config"), "symbol", stamp("bar_ts").alias("ts"), "pos")
        out = one if out is None else out.unionByName(one)
    return out


def _store(spark):
    """The module that keeps status tables, and where: a database, or a shared folder if executors stand apart from the driver and none is named.

    ``spark.tidesignal.jdbc.url`` names the database; where it is unset, a local session has one on its own disk.
    """
    url = spark.conf.get("spark.tidesignal.jdbc.url", "")
    if url or re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return jdbc, url or f"jdbc:derby:{SparkFiles.getRootDirectory()}/tidesignal;create=true"
    return tables, _folder(spark)


@query("snk_jdbc", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE 'first' END AS status FROM orders
  WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 7 <> 0""")
def _(spark, sf):
    """A status table in a database (``_store``): written, upserted, marked, and read back by filters that the database applies."""
    store, at = _store(spark)
    o = panels.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    rows = lambda where, status: o.where(where).select("id", F.lit(status).alias("status"), F.lit(0).alias("alerted"))
    name, typed = f"status_{uuid.uuid4().hex[:12]}", {"createTableColumnTypes": "status varchar(16)"}
    store.create(rows("id % 2 = 0", "first"), at, name, typed, ["id"])
    store.upsert(rows("id % 2 = 0", "first"), at, name, ["id"], typed)
    store.upsert(rows("id % 3 = 0", "again"), at, name, ["id"], typed)
    store.mark(o.where("id % 7 = 0"), at, name, "alerted")
    return store.read(spark, at, name).where("alerted = 0 and status in ('first', 'again')").select("id", "status")


@query("snk_stream_upsert", """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def _(spark, sf):
    """The last event of each user, kept in a database (``_store``) by a stream of four batches; each batch is run twice, the second time without effect."""
    (store, at), path, name = _store(spark), _folder(spark), f"last_{uuid.uuid4().hex[:12]}"
    e = panels.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    e.repartitionByRange(max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "event_id").write.parquet(f"{path}/events")
    typed = {"createTableColumnTypes": "event_type varchar(64)"}
    store.create(e, at, name, typed, ["user_id"])
    store.create_ledger(spark, at, name)
    quarter = -(-len(spark.read.schema(e.schema).parquet(f"{path}/events").inputFiles()) // 4)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", quarter).parquet(f"{path}/events")
    for run in ("first", "again"):  # a new checkpoint starts the stream anew: the same batches under the same numbers
        store.upsert_stream(stream, at, name, ["user_id"], "event_id", "last-event", f"{path}/{run}", typed).awaitTermination()
    return store.read(spark, at, name)
