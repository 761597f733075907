"""Queries for alignment, predicates, joins, selection, set operations and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import missing_to_null, ratio, soft_or, trend_gate, vol_gate
from ..operators import align, episodes, select
from ..sources import panels
from .core import _POS, gained, positions, signal
from .kit import BARS, DAILY, EVALS, RETURNS, SIGNAL, day_text, dt, query, stamp, ts

EARLY = "timestamp_ntz'2024-01-10'"


def _b(spark, sf):
    return panels.bars(spark, sf)


def _e(spark, sf):
    return panels.evaluations(spark, sf)


# --- alignment and projection

@query("aln_columns", f"""SELECT {ts('i.bar_ts')} AS ts, s.symbol, b.price FROM (SELECT DISTINCT bar_ts FROM bars) i, (VALUES ('click'), ('view'), ('absent')) s(symbol)
  LEFT JOIN bars b ON b.bar_ts = i.bar_ts AND b.symbol = s.symbol""", BARS)
def _(spark, sf):
    want = spark.createDataFrame([("click",), ("view",), ("absent",)], "symbol string")
    return align.to_columns(_b(spark, sf).select("bar_ts", "symbol", "price"), want).select(stamp("bar_ts").alias("ts"), "symbol", "price")


_TWO = BARS + """, a AS (SELECT bar_ts, price FROM bars WHERE symbol = 'click'), c AS (SELECT bar_ts, factor FROM bars WHERE symbol = 'view')"""


def _two(spark, sf):
    b = _b(spark, sf)
    return b.where("symbol = 'click'").select("bar_ts", "price"), b.where("symbol = 'view'").select("bar_ts", "factor")


for _name, _how, _join in (("aln_index_inner", "inner", "JOIN"), ("aln_index_left", "left", "LEFT JOIN"), ("jn_index_inner", "inner", "JOIN"), ("jn_reindex_left", "left", "LEFT JOIN"), ("jn_outer_index", "full", "FULL JOIN")):
    def _make(how):
        def f(spark, sf):
            a, c = _two(spark, sf)
            return a.join(c, "bar_ts", how).select(stamp("bar_ts").alias("ts"), "price", "factor")
        return f

    query(_name, f"SELECT {ts('bar_ts')} AS ts, price, factor FROM a {_join} c USING (bar_ts)", _TWO)(_make(_how))


@query("aln_primary", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return align.duplicated(panels.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderstatus", F.col("count").alias("n"))


@query("aln_sort_cols", "SELECT DISTINCT symbol FROM bars WHERE bar_ts < TIMESTAMP '2024-01-10' INTERSECT SELECT DISTINCT symbol FROM bars WHERE symbol > 'd'", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    return align.same_columns([b.where(f"bar_ts < {EARLY}"), b.where("symbol > 'd'")])


_MAP = "(VALUES ('click', 'IM'), ('view', 'IC'), ('purchase', 'IF'), ('error', 'IH')) m(symbol, future)"


@query("aln_his", f"SELECT m.future AS symbol, {ts('r.bar_ts')} AS ts, b.factor FROM (SELECT DISTINCT bar_ts FROM bars WHERE symbol = 'click') r CROSS JOIN (SELECT * FROM {_MAP} WHERE future IN ('IM', 'IC')) m LEFT JOIN bars b ON b.bar_ts = r.bar_ts AND b.symbol = m.symbol", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    codes = spark.createDataFrame([("click", "IM"), ("view", "IC"), ("purchase", "IF"), ("error", "IH")], "symbol string, future string")
    named = b.join(F.broadcast(codes), "symbol").select(F.col("future").alias("symbol"), "bar_ts", "factor")  # four rows
    index = b.where("symbol = 'click'").select("bar_ts")
    grid = align.expand(index.distinct(), codes.where("future in ('IM', 'IC')").select(F.col("future").alias("symbol")))
    return grid.join(named, ["bar_ts", "symbol"], "left").select("symbol", stamp("bar_ts").alias("ts"), "factor")


@query("prj_rename", f"SELECT coalesce(m.future, b.symbol) AS symbol, {ts()} AS ts, price FROM bars b LEFT JOIN {_MAP} USING (symbol)", BARS)
def _(spark, sf):
    return _b(spark, sf).replace({"click": "IM", "view": "IC", "purchase": "IF", "error": "IH"}, subset=["symbol"]).select("symbol", stamp("bar_ts").alias("ts"), "price")


@query("aln_trim", f"SELECT symbol, {ts()} AS ts, price FROM bars WHERE bar_ts BETWEEN (SELECT min(bar_ts) FROM bars WHERE symbol = 'error' AND factor > 95) AND (SELECT max(bar_ts) FROM bars WHERE symbol = 'error' AND factor > 95)", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    return align.trim(b, b.where("symbol = 'error' and factor > 95"), "factor").select("symbol", stamp("bar_ts").alias("ts"), "price")


@query("aln_expand", f"SELECT s.symbol, {ts('a.bar_ts')} AS ts, a.factor FROM (SELECT * FROM bars WHERE symbol = 'click') a, (SELECT DISTINCT symbol FROM bars) s", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    return align.expand(b.where("symbol = 'click'").select("bar_ts", "factor"), b).select("symbol", stamp("bar_ts").alias("ts"), "factor")


@query("prj_mask", f"SELECT symbol, {ts()} AS ts, CASE WHEN factor IS NOT NULL AND lead(price) OVER (PARTITION BY symbol ORDER BY bar_ts) IS NOT NULL THEN factor END AS factor FROM bars", BARS)
def _(spark, sf):
    nxt = F.lead("price").over(Window.partitionBy("symbol").orderBy("bar_ts"))
    return _b(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.when(F.col("factor").isNotNull() & nxt.isNotNull(), F.col("factor")).alias("factor"))


@query("prj_ifneg", f"SELECT symbol, {ts()} AS ts, round(CASE WHEN (SELECT min(factor) FROM bars) >= 0 THEN (factor - 0.5) * 2 ELSE factor END, 6) AS factor FROM bars", BARS)
def _(spark, sf):
    from ..operators.scaling import normalise

    return normalise(_b(spark, sf), "factor", None, 1, out="f").select("symbol", stamp("bar_ts").alias("ts"), F.round("f", 6).alias("factor"))


@query("flt_period", f"SELECT 'closed' AS kind, symbol, {ts()} AS ts FROM bars WHERE bar_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' UNION ALL SELECT 'half_open', symbol, {ts()} FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts < TIMESTAMP '2024-01-06'", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    a = b.where("bar_ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-06'").select(F.lit("closed").alias("kind"), "symbol", stamp("bar_ts").alias("ts"))
    return a.unionByName(b.where("bar_ts >= timestamp_ntz'2024-01-05' and bar_ts < timestamp_ntz'2024-01-06'").select(F.lit("half_open").alias("kind"), "symbol", stamp("bar_ts").alias("ts")))


@query("flt_time_of_day", f"SELECT symbol, {ts()} AS ts, price FROM bars WHERE strftime(bar_ts, '%H:%M:%S') IN ('14:00:00', '09:00:00')", BARS)
def _(spark, sf):
    return _b(spark, sf).where(align.clock("bar_ts").isin("14:00:00", "09:00:00")).select("symbol", stamp("bar_ts").alias("ts"), "price")


@query("flt_allnull_zero", f"SELECT {ts()} AS ts FROM (SELECT bar_ts, nullif(pos, 0) AS p FROM pos) GROUP BY bar_ts HAVING count(p) > 0", _POS)
def _(spark, sf):
    return positions(spark, sf).groupBy("bar_ts").agg(F.count(F.nullif("pos", F.lit(0.0))).alias("n")).where("n > 0").select(stamp("bar_ts").alias("ts"))


@query("fil_const", f"SELECT symbol, {ts()} AS ts, coalesce(pos, 0) AS pos, CASE WHEN isinf(1 / x) OR isnan(1 / x) THEN NULL ELSE round(1 / x, 6) END AS inv FROM (SELECT *, round(factor - 50, 0)::DOUBLE AS x FROM bars JOIN pos USING (symbol, bar_ts))", _POS)
def _(spark, sf):
    b = _b(spark, sf).join(positions(spark, sf).select("symbol", "bar_ts", "pos"), ["symbol", "bar_ts"])
    inv = missing_to_null(ratio(F.lit(1.0), F.round(F.col("factor") - 50, 0)))
    return b.select("symbol", stamp("bar_ts").alias("ts"), F.coalesce("pos", F.lit(0.0)).alias("pos"), F.round(inv, 6).alias("inv"))


@query("fil_interp", f"""SELECT symbol, {ts()} AS ts, round(coalesce(v, a + (b - a) * (k - ka) / nullif(kb - ka, 0)::DOUBLE, a, b), 9) AS v FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER back AS a, first_value(v IGNORE NULLS) OVER fwd AS b, last_value(kv IGNORE NULLS) OVER back AS ka, first_value(kv IGNORE NULLS) OVER fwd AS kb
  FROM (SELECT *, CASE WHEN factor < 60 THEN factor END AS v, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k, CASE WHEN factor < 60 THEN row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) END AS kv FROM bars)
  WINDOW back AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fwd AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", BARS)
def _(spark, sf):
    b = _b(spark, sf).withColumn("v", F.when(F.col("factor") < 60, F.col("factor")))
    return align.interpolate(b, "v", ["symbol"], "bar_ts").select("symbol", stamp("bar_ts").alias("ts"), F.round("v", 9).alias("v"))


# --- filters

_KEYS = "test_name, process_name, factor"
_PPT = "net_return_annualized / nullif(hsr, 0) / 245"
_FILTER_SQL = {
    "v0": "sharpe_ratio > 2", "v1": "sharpe_ratio > 2 AND return_annualized / nullif(hsr, 0) > 0.145", "v2": "sharpe_ratio > 1.75", "v3": "net_sharpe_ratio > 1.75", "v4": "net_sharpe_ratio > 1.6",
    "v5": "net_sortino_ratio > 1.5", "v6": "net_sharpe_ratio > 1.8", "v7": "net_sharpe_ratio > 1.9", "v8": "net_sharpe_ratio > 2.0", "v9": "net_sharpe_ratio > 2.2",
    "v10": f"net_sharpe_ratio > 1.8 AND {_PPT} > 0.001", "v11": f"net_sharpe_ratio > 1.8 AND {_PPT} > 0.0012", "v12": "net_sharpe_ratio > 1.8 AND net_calmar_ratio > 2.5", "v13": "net_sharpe_ratio > 1.8 AND net_calmar_ratio > 4",
    "v14": f"net_sharpe_ratio > 1.8 AND net_calmar_ratio > 2.5 AND {_PPT} > 0.0012", "v15": f"net_sharpe_ratio > 1.8 AND net_calmar_ratio > 4 AND {_PPT} > 0.001", "v16": "net_sharpe_ratio > 1.0 AND direction > 0", "v18": "net_sharpe_ratio > 1.4",
}


def _filter(name):
    return lambda spark, sf: select.passing(_e(spark, sf), name).select("test_name", "process_name", "factor", "net_sharpe_ratio")


for _v, _c in _FILTER_SQL.items():
    query(f"flt_{_v}", f"SELECT {_KEYS}, net_sharpe_ratio FROM evals WHERE {_c}", EVALS)(_filter(_v))


@query("flt_v17", f"""SELECT {_KEYS}, net_sharpe_ratio FROM evals WHERE net_sharpe_ratio > 2.7 AND direction > 0 AND (SELECT count(*) FROM evals WHERE net_sharpe_ratio > 2.7 AND direction > 0) >= 5
  UNION ALL SELECT * FROM (SELECT {_KEYS}, net_sharpe_ratio FROM evals WHERE direction > 0 AND (SELECT count(*) FROM evals WHERE net_sharpe_ratio > 2.7 AND direction > 0) < 5 ORDER BY net_sharpe_ratio DESC, {_KEYS} LIMIT 5)""", EVALS)
def _(spark, sf):
    d = F.col("direction") > 0
    return select.passing_or_top(_e(spark, sf), (F.col("net_sharpe_ratio") > 2.7) & d, 5, "net_sharpe_ratio", d, ["test_name", "process_name", "factor"]).select("test_name", "process_name", "factor", "net_sharpe_ratio")


@query("flt_dynamic", f"""SELECT {_KEYS}, net_sharpe_ratio FROM evals, (SELECT net_sharpe_ratio AS r FROM evals WHERE factor = 'Brand1-w0d-i0' ORDER BY {_KEYS} LIMIT 1)
  WHERE net_sharpe_ratio > 1.2 * r AND net_calmar_ratio >= 3 AND direction == 1""", EVALS)
def _(spark, sf):
    rules = [{"target": "net_sharpe_ratio", "operator": ">", "threshold": 1.2, "is_multiplier": True}, {"target": "net_calmar_ratio", "operator": ">=", "threshold": 3}, {"target": "direction", "operator": "==", "threshold": 1}]
    return select.dynamic(_e(spark, sf), rules, F.col("factor") == "Brand1-w0d-i0").select("test_name", "process_name", "factor", "net_sharpe_ratio")


@query("flt_dynamic_name", f"""SELECT {_KEYS}, net_sharpe_ratio FROM evals WHERE (regexp_matches(factor, '^Brand1') OR regexp_matches(factor, 'w2d')) AND NOT regexp_matches(factor, 'i1$') AND net_sharpe_ratio > 0.8""", EVALS)
def _(spark, sf):
    names = (F.col("factor").rlike("^Brand1") | F.col("factor").rlike("w2d")) & ~F.col("factor").rlike("i1$")
    return select.dynamic(_e(spark, sf), [{"target": "net_sharpe_ratio", "operator": ">", "threshold": 0.8}], names=names).select("test_name", "process_name", "factor", "net_sharpe_ratio")


@query("flt_long_short", f"SELECT {_KEYS}, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side FROM evals WHERE (direction > 0 AND net_sharpe_ratio > 1) OR (direction < 0 AND net_sharpe_ratio > 0.5)", EVALS)
def _(spark, sf):
    long = F.col("direction") > 0
    return _e(spark, sf).where((long & (F.col("net_sharpe_ratio") > 1)) | (~long & (F.col("net_sharpe_ratio") > 0.5))).select("test_name", "process_name", "factor", F.when(long, "long").otherwise("short").alias("side"))


@query("flt_select_v0", f"SELECT {_KEYS} FROM evals WHERE sharpe_ratio > 1.5 AND n > 20 AND abs(hsr - 1) < 0.1", EVALS)
def _(spark, sf):
    return _e(spark, sf).where((F.col("sharpe_ratio") > 1.5) & (F.col("n") > 20) & (F.abs(F.col("hsr") - 1) < 0.1)).select("test_name", "process_name", "factor")


@query("flt_valid_v0", "SELECT process_name, factor, bool_and(hsr < 1.2) AND bool_and(sharpe_ratio > 0.2) AS valid FROM evals GROUP BY 1, 2", EVALS)
def _(spark, sf):
    return _e(spark, sf).groupBy("process_name", "factor").agg((F.bool_and(F.col("hsr") < 1.2) & F.bool_and(F.col("sharpe_ratio") > 0.2)).alias("valid"))


@query("flt_multi_period", "SELECT a.process_name, a.factor FROM (SELECT * FROM evals WHERE test_name = 't0') a LEFT JOIN (SELECT * FROM evals WHERE test_name = 't1') b USING (process_name, factor) WHERE a.net_sharpe_ratio > 0.6 AND b.net_sharpe_ratio > 0.4", EVALS)
def _(spark, sf):
    e = _e(spark, sf)
    b = e.where("test_name = 't1'").select("process_name", "factor", F.col("net_sharpe_ratio").alias("later"))
    return e.where("test_name = 't0'").join(b, ["process_name", "factor"], "left").where("net_sharpe_ratio > 0.6 and later > 0.4").select("process_name", "factor")


@query("flt_target", f"SELECT {_KEYS} FROM evals WHERE test_name = 't2' AND process_name = 'ECONOMY_TS20ma'", EVALS)
def _(spark, sf):
    cond = F.lit(True)
    for k, v in {"test_name": "t2", "process_name": "ECONOMY_TS20ma"}.items():
        cond = cond & (F.col(k) == v)
    return _e(spark, sf).where(cond).select("test_name", "process_name", "factor")


_GRIDSQL = """grid AS (SELECT l_linenumber AS openthres, CAST(l_quantity / 5 AS INTEGER) AS closethres, round(avg(l_discount) * 40, 6) AS net_sharpe_ratio, round(avg(l_tax) * 50, 6) AS ppt, round(max(l_extendedprice) / 1e5, 6) AS max_dd FROM lineitem GROUP BY 1, 2),
cells AS (SELECT *, net_sharpe_ratio > 1.98 AND ppt > 1.9 AND max_dd < 1.2 AS ok FROM grid)"""


def _grid(spark, sf):
    g = panels.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("openthres"), F.round(F.col("l_quantity") / 5).cast("int").alias("closethres"))
    g = g.agg(F.round(F.avg("l_discount") * 40, 6).alias("net_sharpe_ratio"), F.round(F.avg("l_tax") * 50, 6).alias("ppt"), F.round(F.max("l_extendedprice") / 1e5, 6).alias("max_dd"))
    return g.withColumn("ok", (F.col("net_sharpe_ratio") > 1.98) & (F.col("ppt") > 1.9) & (F.col("max_dd") < 1.2))


_GRIDSQL = _GRIDSQL.replace("CAST(l_quantity / 5 AS INTEGER)", "CAST(round(l_quantity / 5) AS INTEGER)")


@query("flt_wf_cond", "SELECT openthres, closethres, net_sharpe_ratio FROM cells WHERE ok", _GRIDSQL)
def _(spark, sf):
    return _grid(spark, sf).where("ok").select("openthres", "closethres", "net_sharpe_ratio")


@query("flt_wf_neighbors", """SELECT openthres, closethres, ok AND coalesce(lag(ok) OVER r, ok) AND coalesce(lead(ok) OVER r, ok) AND coalesce(lag(ok) OVER c, ok) AND coalesce(lead(ok) OVER c, ok) AS robust FROM cells
  WINDOW r AS (PARTITION BY closethres ORDER BY openthres), c AS (PARTITION BY openthres ORDER BY closethres)""", _GRIDSQL)
def _(spark, sf):
    return select.neighbours_pass(_grid(spark, sf), "ok", "openthres", "closethres").select("openthres", "closethres", "robust")


@query("flt_wf_topn", "SELECT openthres, closethres, ok FROM (SELECT *, row_number() OVER (ORDER BY ok DESC, net_sharpe_ratio DESC, openthres, closethres) AS k FROM cells) WHERE k <= greatest(8, (SELECT count(*) FROM cells WHERE ok))", _GRIDSQL)
def _(spark, sf):
    g = _grid(spark, sf)  # a parameter grid: a few hundred cells
    n = g.agg(F.greatest(F.lit(8), F.count_if("ok")).alias("most"))
    w = Window.orderBy(F.col("ok").desc(), F.col("net_sharpe_ratio").desc(), "openthres", "closethres")
    return g.withColumn("k", F.row_number().over(w)).crossJoin(F.broadcast(n)).where("k <= most").select("openthres", "closethres", "ok")


# --- joins

@query("jn_outer_keys", "SELECT process_name, factor, a.net_sharpe_ratio AS s0, b.net_sharpe_ratio AS s1 FROM (SELECT * FROM evals WHERE test_name = 't0' AND n > 25) a FULL JOIN (SELECT * FROM evals WHERE test_name = 't1' AND n > 25) b USING (process_name, factor)", EVALS)
def _(spark, sf):
    e = _e(spark, sf).where("n > 25")
    side = lambda t, c: e.where(F.col("test_name") == t).select("process_name", "factor", F.col("net_sharpe_ratio").alias(c))
    return side("t0", "s0").join(side("t1", "s1"), ["process_name", "factor"], "full")


@query("jn_ffill_asof", f"""SELECT a.symbol, {ts('a.bar_ts')} AS ts, b.price FROM (SELECT symbol, bar_ts FROM bars) a ASOF LEFT JOIN (SELECT symbol, bar_ts, price FROM bars WHERE factor > 60) b ON a.symbol = b.symbol AND a.bar_ts >= b.bar_ts""", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    return align.asof(b.select("symbol", "bar_ts"), b.where("factor > 60"), ["symbol"], "bar_ts", "price").select("symbol", stamp("bar_ts").alias("ts"), "price")


_NIGHT = BARS + """, c AS (SELECT symbol, bar_ts, price, CAST(bar_ts AS DATE) AS d FROM bars WHERE strftime(bar_ts, '%H') = '14'), o AS (SELECT symbol, price, CAST(bar_ts AS DATE) AS d FROM bars WHERE strftime(bar_ts, '%H') = '09'),
nx AS (SELECT c.symbol, c.d, c.price AS close_price, min(o.d) AS open_day FROM c LEFT JOIN o ON o.symbol = c.symbol AND o.d >= c.d + 1 GROUP BY 1, 2, 3)"""


def _nights(spark, sf):
    b = _b(spark, sf).withColumn("d", F.to_date("bar_ts"))
    at = lambda h: b.where(F.date_format("bar_ts", "HH") == h)
    opens = at("09").where("price is not null").select("symbol", "d", F.struct("d", F.col("price").alias("open_price")).alias("o"))
    closes = at("14").where("price is not null").select("symbol", "d", F.col("price").alias("close_price"))
    nxt = align.asof(closes, opens, ["symbol"], "d", "o", span="month", ahead=True, strict=True)
    return nxt.select("symbol", "d", "close_price", F.col("o.d").alias("open_day"), "o.open_price")


@query("jn_next_open", f"SELECT symbol, {dt('d')} AS day, close_price, {dt('open_day')} AS open_day FROM nx", _NIGHT)
def _(spark, sf):
    return _nights(spark, sf).select("symbol", day_text("d").alias("day"), "close_price", day_text("open_day").alias("open_day"))


@query("agg_overnight", "SELECT nx.symbol, year(nx.d)::INTEGER AS year, round(avg((o.price / nx.close_price - 1) * 100), 5) AS mean_pct, count(o.price) AS n FROM nx LEFT JOIN o ON o.symbol = nx.symbol AND o.d = nx.open_day GROUP BY 1, 2", _NIGHT)
def _(spark, sf):
    n = _nights(spark, sf).withColumn("r", (ratio(F.col("open_price"), F.col("close_price")) - 1) * 100)
    return n.groupBy("symbol", F.year("d").alias("year")).agg(F.round(F.avg("r"), 5).alias("mean_pct"), F.count("r").alias("n"))


@query("jn_period_match", f"SELECT o_orderkey, max(p.pid)::INTEGER AS pid FROM orders o JOIN (VALUES (1, DATE '1995-12-31'), (2, DATE '1996-12-31'), (3, DATE '1997-12-31'), (4, DATE '1998-12-31')) p(pid, fit_end) ON p.fit_end <= CAST(o.o_orderdate AS DATE) GROUP BY 1")
def _(spark, sf):
    import datetime

    ends = spark.createDataFrame([(k, datetime.date(1994 + k, 12, 31)) for k in (1, 2, 3, 4)], "pid int, fit_end date")
    o = panels.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.join(F.broadcast(ends), F.col("fit_end") <= F.col("d")).groupBy("o_orderkey").agg(F.max("pid").alias("pid"))  # four periods


_UP = BARS + """, old AS (SELECT symbol, bar_ts, price FROM bars WHERE bar_ts < TIMESTAMP '2024-01-20'), fresh AS (SELECT symbol, bar_ts, CASE WHEN factor > 50 THEN price + 1 END AS price FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-10')"""


def _old_new(spark, sf):
    b = _b(spark, sf)
    return b.where("bar_ts < timestamp_ntz'2024-01-20'").select("symbol", "bar_ts", "price"), b.where("bar_ts >= timestamp_ntz'2024-01-10'").select("symbol", "bar_ts", F.when(F.col("factor") > 50, F.col("price") + 1).alias("price"))


@query("jn_upsert", f"SELECT symbol, {ts()} AS ts, round(CASE WHEN hit THEN f.price ELSE o.price END, 6) AS price FROM old o FULL JOIN (SELECT *, true AS hit FROM fresh) f USING (symbol, bar_ts)", _UP)
def _(spark, sf):
    return align.upsert(*_old_new(spark, sf), ["symbol", "bar_ts"]).select("symbol", stamp("bar_ts").alias("ts"), F.round("price", 6).alias("price"))


@query("ev_consistency", f"SELECT symbol, count(*) AS n, {ts('min(bar_ts)')} AS first_ts FROM old o JOIN fresh f USING (symbol, bar_ts) WHERE o.price IS DISTINCT FROM f.price GROUP BY 1", _UP)
def _(spark, sf):
    bad = align.mismatches(*_old_new(spark, sf), ["symbol", "bar_ts"], "price")
    return bad.groupBy("symbol").agg(F.count("*").alias("n"), stamp(F.min("bar_ts")).alias("first_ts"))


@query("st_append_check", "SELECT (SELECT count(*) FROM old o JOIN fresh f USING (symbol, bar_ts) WHERE o.price IS DISTINCT FROM f.price) AS changed, (SELECT count(*) FROM (SELECT symbol, bar_ts FROM old UNION SELECT symbol, bar_ts FROM fresh)) AS total", _UP)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    changed = align.mismatches(old, new, ["symbol", "bar_ts"], "price").agg(F.count("*").alias("changed"))
    return changed.crossJoin(F.broadcast(align.upsert(old, new, ["symbol", "bar_ts"]).agg(F.count("*").alias("total"))))  # one row each


@query("jn_semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def _(spark, sf):
    rich = panels.table(spark, sf, "customer").where("c_acctbal > 9000")
    return panels.table(spark, sf, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("jn_anti_diff", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    return panels.table(spark, sf, "customer").join(panels.table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn_cross_grid", """SELECT a.range / 10.0::DOUBLE AS openthres, b.range / 10.0::DOUBLE AS closethres, count(*) FILTER (s > a.range / 10.0::DOUBLE) AS opened, count(*) FILTER (s < b.range / 10.0::DOUBLE) AS closed
  FROM sig, range(3, 10) a, range(-4, 5) b WHERE b.range <= a.range GROUP BY 1, 2""", SIGNAL)
def _(spark, sf):
    """Bars beyond the opening and below the closing level, for every pair of a grid of levels."""
    a = spark.range(3, 10).select((F.col("id") / 10.0).alias("openthres"), F.col("id").alias("a"))
    b = spark.range(-4, 5).select((F.col("id") / 10.0).alias("closethres"), F.col("id").alias("b"))
    grid = a.crossJoin(F.broadcast(b)).where("b <= a").select("openthres", "closethres")  # a parameter grid
    counted = signal(spark, sf).crossJoin(F.broadcast(grid)).groupBy("openthres", "closethres")  # a grid of 63 cells
    return counted.agg(F.count_if(F.col("s") > F.col("openthres")).alias("opened"), F.count_if(F.col("s") < F.col("closethres")).alias("closed"))


# --- selection and merging

@query("sel_best_test", """SELECT process_name, factor, test_name, round(net_sharpe_ratio, 6) AS net_sharpe_ratio, direction FROM (SELECT *, row_number() OVER (PARTITION BY process_name, factor ORDER BY net_sharpe_ratio DESC NULLS LAST, test_name) AS k FROM evals) WHERE k = 1""", EVALS)
def _(spark, sf):
    return select.best_test(_e(spark, sf), "net_sharpe_ratio").select("process_name", "factor", "test_name", "net_sharpe_ratio", "direction")


@query("sel_topn_group", f"SELECT {_KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY process_name ORDER BY net_calmar_ratio DESC NULLS LAST, factor, test_name) AS k FROM evals) WHERE k <= 4", EVALS)
def _(spark, sf):
    return select.top_n(_e(spark, sf), "net_calmar_ratio", 4, ["process_name"], ["factor", "test_name"]).select("test_name", "process_name", "factor")


@query("sel_strip_ma", r"SELECT DISTINCT regexp_replace(process_name, '_TS\d+ma.*$', '') AS process_name, regexp_replace(factor, '-[^-]*$', '') AS factor FROM evals", EVALS)
def _(spark, sf):
    p, f = select.strip_ma(F.col("process_name"), F.col("factor"))
    return _e(spark, sf).select(p.alias("process_name"), f.alias("factor")).distinct()


@query("sel_dedup", "SELECT DISTINCT process_name, factor FROM evals", EVALS)
def _(spark, sf):
    return _e(spark, sf).select("process_name", "factor").dropDuplicates()


@query("sel_org_fac", r"SELECT DISTINCT factor, split_part(factor, '-', 1) AS org_fac, regexp_extract(factor, 'w(\d+)d', 1) AS w, regexp_extract(factor, 'i(\d+)', 1) AS i FROM evals", EVALS)
def _(spark, sf):
    return _e(spark, sf).select("factor", F.split("factor", "-")[0].alias("org_fac"), F.regexp_extract("factor", r"w(\d+)d", 1).alias("w"), F.regexp_extract("factor", r"i(\d+)", 1).alias("i")).distinct()


_PIPE = EVALS + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY process_name, factor ORDER BY net_sharpe_ratio DESC NULLS LAST, test_name) AS k FROM evals WHERE test_name <> 't3') WHERE k = 1),
good AS (SELECT *, split_part(factor, '-', 1) AS org FROM best WHERE net_sharpe_ratio > 0.6 AND direction > 0)"""


@query("sel_pipeline_basic", r"SELECT org, regexp_replace(process_name, '_TS\d+ma.*$', '') AS process_name, regexp_replace(factor, '-[^-]*$', '') AS factor FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY net_sharpe_ratio DESC, factor, process_name) AS t FROM good) WHERE t <= 2", _PIPE)
def _(spark, sf):
    best = select.best_test(_e(spark, sf).where("test_name <> 't3'"), "net_sharpe_ratio")
    good = best.where("net_sharpe_ratio > 0.6 and direction > 0").withColumn("org", F.split("factor", "-")[0])
    p, f = select.strip_ma(F.col("process_name"), F.col("factor"))
    return select.top_n(good, "net_sharpe_ratio", 2, ["org"], ["factor", "process_name"]).select("org", p.alias("process_name"), f.alias("factor"))


@query("sel_pipeline", "SELECT a.process_name, a.factor, a.test_name FROM best a JOIN (SELECT process_name, factor FROM evals WHERE test_name = 't3' AND net_sharpe_ratio > 0.2) b USING (process_name, factor) WHERE a.net_sharpe_ratio > 0.8", _PIPE)
def _(spark, sf):
    e = _e(spark, sf)
    recent = e.where("test_name = 't3' and net_sharpe_ratio > 0.2").select("process_name", "factor")
    return select.best_test(e.where("test_name <> 't3'"), "net_sharpe_ratio").where("net_sharpe_ratio > 0.8").join(recent, ["process_name", "factor"]).select("process_name", "factor", "test_name")


@query("sel_copy_list", f"SELECT {_KEYS}, 'picked' AS tag_name FROM evals WHERE net_sharpe_ratio > 1.5", EVALS)
def _(spark, sf):
    return _e(spark, sf).where("net_sharpe_ratio > 1.5").select("test_name", "process_name", "factor", F.lit("picked").alias("tag_name"))


_WTS = SIGNAL + ", wt(symbol, w) AS (VALUES ('click', 0.5::DOUBLE), ('view', 0.3::DOUBLE), ('purchase', 0.2::DOUBLE))"


@query("mg_weighted_avg", f"SELECT {ts()} AS ts, round(sum(s * w), 9) AS merged FROM sig JOIN wt USING (symbol) GROUP BY bar_ts HAVING count(*) = 3 AND count(s) = 3", _WTS)
def _(spark, sf):
    weights = spark.createDataFrame([("click", 5.0), ("view", 3.0), ("purchase", 2.0)], "symbol string, w double")
    total = weights.agg(F.sum("w").alias("z"))
    shares = weights.crossJoin(F.broadcast(total)).select("symbol", (F.col("w") / F.col("z")).alias("w"))
    got = signal(spark, sf).join(F.broadcast(shares), "symbol").groupBy("bar_ts").agg(F.sum(F.col("s") * F.col("w")).alias("m"), F.count("*").alias("n"), F.count("s").alias("k"))
    return got.where("n = 3 and k = 3").select(stamp("bar_ts").alias("ts"), F.round("m", 9).alias("merged"))


_GROUPS = SIGNAL + """, g AS (SELECT bar_ts, CASE WHEN symbol IN ('click', 'view') THEN 1 ELSE 2 END AS grp, avg(coalesce(s, 0) * CASE WHEN symbol = 'error' THEN -1 ELSE 1 END) AS v FROM sig GROUP BY 1, 2)"""


def _group_means(spark, sf):
    s = signal(spark, sf).withColumn("grp", F.when(F.col("symbol").isin("click", "view"), 1).otherwise(2))
    v = F.coalesce("s", F.lit(0.0)) * F.when(F.col("symbol") == "error", -1).otherwise(1)
    return s.groupBy("bar_ts", "grp").agg(F.avg(v).alias("v"))


@query("mg_group", f"SELECT {ts()} AS ts, grp::INTEGER AS grp, round(v, 9) AS v FROM g", _GROUPS)
def _(spark, sf):
    return _group_means(spark, sf).select(stamp("bar_ts").alias("ts"), "grp", F.round("v", 9).alias("v"))


@query("mg_period_mean", f"SELECT {ts()} AS ts, round(avg(v), 9) AS merged FROM g GROUP BY bar_ts", _GROUPS)
def _(spark, sf):
    return _group_means(spark, sf).groupBy("bar_ts").agg(F.avg("v").alias("m")).select(stamp("bar_ts").alias("ts"), F.round("m", 9).alias("merged"))


@query("mg_load_group", f"SELECT {ts()} AS ts, round(sum(s * w) / sum(w), 9) AS merged FROM sig JOIN wt USING (symbol) WHERE s IS NOT NULL GROUP BY bar_ts", _WTS)
def _(spark, sf):
    weights = spark.createDataFrame([("click", 0.5), ("view", 0.3), ("purchase", 0.2)], "symbol string, w double")
    got = signal(spark, sf).where("s is not null").join(F.broadcast(weights), "symbol").groupBy("bar_ts").agg(ratio(F.sum(F.col("s") * F.col("w")), F.sum("w")).alias("m"))
    return got.select(stamp("bar_ts").alias("ts"), F.round("m", 9).alias("merged"))


@query("mg_models", f"SELECT {ts()} AS ts, round(avg(greatest(pos, 0)) FILTER (symbol IN ('click', 'view')) + avg(least(pos, 0)) FILTER (symbol IN ('error', 'purchase')), 9) AS merged FROM pos WHERE pos IS NOT NULL GROUP BY bar_ts", _POS)
def _(spark, sf):
    p = positions(spark, sf).where("pos is not null")
    long = F.avg(F.when(F.col("symbol").isin("click", "view"), F.greatest("pos", F.lit(0.0))))
    short = F.avg(F.when(F.col("symbol").isin("error", "purchase"), F.least("pos", F.lit(0.0))))
    return p.groupBy("bar_ts").agg((long + short).alias("m")).select(stamp("bar_ts").alias("ts"), F.round("m", 9).alias("merged"))


@query("md_merge_pred", f"SELECT {ts()} AS ts, CASE WHEN count(s) = 5 THEN round(avg(s), 9) END AS merged FROM sig GROUP BY bar_ts", SIGNAL)
def _(spark, sf):
    got = signal(spark, sf).groupBy("bar_ts").agg(F.when(F.count("s") == 5, F.avg("s")).alias("m"))
    return got.select(stamp("bar_ts").alias("ts"), F.round("m", 9).alias("merged"))


# --- overlays

_OVER = SIGNAL + """, al AS (SELECT * FROM sig), fv AS (SELECT symbol, bar_ts, round(price / 100, 6) AS vol FROM bars WHERE factor > 40)"""


def _overlay(spark, sf):
    return signal(spark, sf), _b(spark, sf).where("factor > 40").select("symbol", "bar_ts", F.round(F.col("price") / 100, 6).alias("vol"))


@query("ap_mul", f"SELECT symbol, {ts()} AS ts, round(s * vol, 6) AS s FROM al LEFT JOIN fv USING (symbol, bar_ts)", _OVER)
def _(spark, sf):
    a, f = _overlay(spark, sf)
    return a.join(f, ["symbol", "bar_ts"], "left").select("symbol", stamp("bar_ts").alias("ts"), F.round(F.col("s") * F.col("vol"), 6).alias("s"))


@query("ap_cond_mul", f"SELECT symbol, {ts()} AS ts, round(CASE WHEN s > 0 THEN s * vol WHEN s < 0 THEN s * (1 - vol) ELSE s END, 6) AS s FROM al LEFT JOIN fv USING (symbol, bar_ts)", _OVER)
def _(spark, sf):
    a, f = _overlay(spark, sf)
    s, v = F.col("s"), F.col("vol")
    return a.join(f, ["symbol", "bar_ts"], "left").select("symbol", stamp("bar_ts").alias("ts"), F.round(F.when(s > 0, s * v).when(s < 0, s * (1 - v)).otherwise(s), 6).alias("s"))


@query("ap_vol_gate", f"SELECT symbol, {ts()} AS ts, round(1 / (1 + exp(-8.0 * (vol - 0.3))), 6) AS gate FROM fv", _OVER)
def _(spark, sf):
    _, f = _overlay(spark, sf)
    return f.select("symbol", stamp("bar_ts").alias("ts"), F.round(vol_gate(F.col("vol"), 8.0, 0.3), 6).alias("gate"))


_TREND = SIGNAL + """, tr AS (SELECT symbol, bar_ts, s, (0.6 * (p2 / lag(p2, 5) OVER w - 1) + 0.4 * (p2 / lag(p2, 10) OVER w - 1)) * sign(s) AS score FROM (SELECT *, lag(price, 2) OVER (PARTITION BY symbol ORDER BY bar_ts) AS p2 FROM sig) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))"""


def _trend(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    p = signal(spark, sf).withColumn("p2", F.lag("price", 2).over(w))
    change = lambda n: ratio(F.col("p2"), F.lag("p2", n).over(w)) - 1
    return p.withColumn("score", (0.6 * change(5) + 0.4 * change(10)) * F.signum("s"))


@query("ap_trend_score", f"SELECT symbol, {ts()} AS ts, round(score, 6) + 0 AS score FROM tr", _TREND)
def _(spark, sf):
    return _trend(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), (F.round("score", 6) + 0).alias("score"))


@query("ap_trend_gate", f"SELECT symbol, {ts()} AS ts, round(1 / (1 + exp(5.0 * (score - 0.1))), 6) AS gate FROM tr", _TREND)
def _(spark, sf):
    return _trend(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), F.round(trend_gate(F.col("score"), 5.0, 0.1), 6).alias("gate"))


_SOFT = _TREND + ", fv AS (SELECT symbol, bar_ts, round(price / 100, 6) AS vol FROM bars WHERE factor > 40)"


@query("ap_soft_and", f"SELECT symbol, {ts()} AS ts, round(1 - (1 - 1 / (1 + exp(-8.0 * (vol - 0.3)))) * (1 - 1 / (1 + exp(5.0 * (score - 0.1)))), 6) AS gate FROM tr JOIN fv USING (symbol, bar_ts)", _SOFT)
def _(spark, sf):
    _, f = _overlay(spark, sf)
    both = _trend(spark, sf).join(f, ["symbol", "bar_ts"])
    return both.select("symbol", stamp("bar_ts").alias("ts"), F.round(soft_or(vol_gate(F.col("vol"), 8.0, 0.3), trend_gate(F.col("score"), 5.0, 0.1)), 6).alias("gate"))


@query("ap_grid_mean", """SELECT k::DOUBLE AS k, t::DOUBLE AS t, h::DOUBLE AS h, symbol, round(avg(s * (1 - (1 - 1 / (1 + exp(-k * (vol - t)))) * (1 - 1 / (1 + exp(5.0 * (score - h)))))), 6) AS mean_signal
  FROM tr JOIN fv USING (symbol, bar_ts), (VALUES (4.0::DOUBLE), (8.0::DOUBLE)) a(k), (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) b(t), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) c(h) GROUP BY 1, 2, 3, 4""", _SOFT)
def _(spark, sf):
    _, f = _overlay(spark, sf)
    cells = [(k, t, h) for k in (4.0, 8.0) for t in (0.2, 0.3) for h in (0.0, 0.1)]
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(h).alias("h")) for k, t, h in cells)))
    both = _trend(spark, sf).join(f, ["symbol", "bar_ts"]).withColumn("g", grid)
    gate = soft_or(1 / (1 + F.exp(-F.col("g.k") * (F.col("vol") - F.col("g.t")))), 1 / (1 + F.exp(5.0 * (F.col("score") - F.col("g.h")))))
    return both.groupBy(F.col("g.k").alias("k"), F.col("g.t").alias("t"), F.col("g.h").alias("h"), "symbol").agg(F.round(F.avg(F.col("s") * gate), 6).alias("mean_signal"))


@query("ap_levels", "SELECT f.level, symbol, count(*) AS n, round(avg(s * f.level), 6) AS mean_signal FROM sig, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) f(level) WHERE s IS NOT NULL GROUP BY 1, 2", SIGNAL)
def _(spark, sf):
    levels = F.explode(F.array(*(F.lit(x) for x in (0.5, 1.0, 1.5))))
    s = signal(spark, sf).where("s is not null").withColumn("level", levels)
    return s.groupBy("level", "symbol").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s") * F.col("level")), 6).alias("mean_signal"))


# --- trades

_TRADES = _POS + """, mv AS (SELECT *, lag(pos) OVER w AS b, lag(price) OVER w AS pp FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
mm AS (SELECT *, CASE WHEN b * pos < 0 THEN pp ELSE price END AS cl FROM mv WHERE pos IN (-1, 0, 1) AND b IN (-1, 0, 1) AND pos <> b),
trades AS (SELECT * FROM (SELECT symbol, CASE WHEN pos > 0 THEN 'long' ELSE 'short' END AS trade_type, pos::BIGINT AS direction, bar_ts AS open_time, price AS open_price, lead(bar_ts) OVER w AS close_time, lead(cl) OVER w AS close_price, pos FROM mm WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) WHERE pos <> 0 AND close_time IS NOT NULL)"""


def _trades(spark, sf):
    return episodes.trades(positions(spark, sf))


@query("ep_trades", f"SELECT symbol, trade_type, direction, {ts('open_time')} AS open_time, open_price, {ts('close_time')} AS close_time, close_price FROM trades", _TRADES)
def _(spark, sf):
    return _trades(spark, sf).select("symbol", "trade_type", "direction", stamp("open_time").alias("open_time"), "open_price", stamp("close_time").alias("close_time"), "close_price")


_NETSQL = "ln(close_price / open_price) * direction - 0.00024"


@query("ep_trade_net", f"SELECT symbol, {ts('open_time')} AS open_time, round({_NETSQL}, 6) AS net_return, date_diff('second', open_time, close_time)::BIGINT AS holding_seconds FROM trades", _TRADES)
def _(spark, sf):
    t = episodes.trade_returns(_trades(spark, sf), 0.00024)
    return t.select("symbol", stamp("open_time").alias("open_time"), F.round("net_return", 6).alias("net_return"), "holding_seconds")


@query("ep_pre_returns", f"""SELECT t.symbol, {ts('t.open_time')} AS open_time, round(m.p5, 6) AS pre_5, round(m.p15, 6) AS pre_15 FROM trades t JOIN (SELECT symbol, bar_ts, coalesce(lag(price, 1) OVER w, f) / coalesce(lag(price, 6) OVER w, f) - 1 AS p5, coalesce(lag(price, 1) OVER w, f) / coalesce(lag(price, 16) OVER w, f) - 1 AS p15
  FROM (SELECT *, first_value(price) OVER (PARTITION BY symbol ORDER BY bar_ts) AS f FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) m ON m.symbol = t.symbol AND m.bar_ts = t.open_time""", _TRADES)
def _(spark, sf):
    t = episodes.returns_before(_trades(spark, sf), _b(spark, sf), [5, 15])
    return t.select("symbol", stamp("open_time").alias("open_time"), F.round("pre_5", 6).alias("pre_5"), F.round("pre_15", 6).alias("pre_15"))


@query("agg_trend_rev", f"""SELECT kind, size, count(*) AS n, round(avg(net), 6) AS mean_net FROM (SELECT {_NETSQL} AS net, CASE WHEN p = 0 THEN 'flat' WHEN sign(p) = direction THEN 'trend' ELSE 'reversal' END AS kind, CASE WHEN abs(p) > 0.3 THEN 'big' WHEN abs(p) > 0.1 THEN 'mid' ELSE 'small' END AS size FROM (
  SELECT t.*, round(m.p5, 6) AS p FROM trades t JOIN (SELECT symbol, bar_ts, coalesce(lag(price, 1) OVER w, f) / coalesce(lag(price, 6) OVER w, f) - 1 AS p5 FROM (SELECT *, first_value(price) OVER (PARTITION BY symbol ORDER BY bar_ts) AS f FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) m ON m.symbol = t.symbol AND m.bar_ts = t.open_time)) GROUP BY 1, 2""", _TRADES)
def _(spark, sf):
    t = episodes.trade_returns(episodes.returns_before(_trades(spark, sf), _b(spark, sf), [5]), 0.00024).withColumn("p", F.round("pre_5", 6))
    kind = F.when(F.col("p") == 0, "flat").when(F.signum("p") == F.col("direction"), "trend").otherwise("reversal")
    size = F.when(F.abs("p") > 0.3, "big").when(F.abs("p") > 0.1, "mid").otherwise("small")
    return t.groupBy(kind.alias("kind"), size.alias("size")).agg(F.count("*").alias("n"), F.round(F.avg("net_return"), 6).alias("mean_net"))


_SEGS = _POS + """, sg AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM (SELECT *, CASE WHEN pos IS DISTINCT FROM lag(pos) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM gain WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)))"""


def _segments(spark, sf):
    return episodes.segments(gained(spark, sf))


@query("ep_segments", f"SELECT symbol, segment::BIGINT AS segment, any_value(pos) AS pos, count(*) AS bars, round(sum(gp), 6) AS total, coalesce(round(sum(gp), 9) > 0, false) AS profit FROM sg GROUP BY 1, 2", _SEGS)
def _(spark, sf):
    s = _segments(spark, sf).groupBy("symbol", "segment").agg(F.first("pos").alias("pos"), F.count("*").alias("bars"), F.sum("gp").alias("t"))
    return s.select("symbol", "segment", "pos", "bars", F.round("t", 6).alias("total"), F.coalesce(F.round("t", 9) > 0, F.lit(False)).alias("profit"))


@query("ep_subtrades", f"""SELECT t.symbol, {ts('t.open_time')} AS open_time, count(*) AS bars_on FROM trades t JOIN sig s ON s.symbol = t.symbol AND s.bar_ts >= t.open_time AND s.bar_ts < t.close_time WHERE s.s * t.direction > 0.6 GROUP BY 1, 2""", _TRADES)
def _(spark, sf):
    # the trade of a bar is the last one opened: an as-of, not a range join
    t, s = _trades(spark, sf), signal(spark, sf)
    tagged = align.asof(s, t.withColumn("bar_ts", F.col("open_time")).withColumn("t", F.struct("open_time", "close_time", "direction")), ["symbol"], "bar_ts", "t")
    on = tagged.where((F.col("bar_ts") < F.col("t.close_time")) & (F.col("s") * F.col("t.direction") > 0.6))
    return on.groupBy("symbol", stamp("t.open_time").alias("open_time")).agg(F.count("*").alias("bars_on"))


@query("ep_subtrade_stats", f"SELECT symbol, trade_type, count(*) AS n, round(avg({_NETSQL}), 6) AS mean_net, round(median({_NETSQL}), 6) AS median_net, round(sum({_NETSQL}), 6) AS total FROM trades GROUP BY GROUPING SETS ((symbol, trade_type), (symbol), ())", _TRADES)
def _(spark, sf):
    t = episodes.trade_returns(_trades(spark, sf), 0.00024)
    return t.groupingSets([[F.col("symbol"), F.col("trade_type")], [F.col("symbol")], []], "symbol", "trade_type").agg(F.count("*").alias("n"), F.round(F.avg("net_return"), 6).alias("mean_net"), F.round(F.median("net_return"), 6).alias("median_net"), F.round(F.sum("net_return"), 6).alias("total"))


@query("m_trade_dd", f"SELECT t.symbol, {ts('t.open_time')} AS open_time, round(least(0, min((b.price / t.open_price - 1) * t.direction)) * 100, 5) + 0 AS worst_pct FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar_ts >= t.open_time AND b.bar_ts < t.close_time GROUP BY 1, 2", _TRADES)
def _(spark, sf):
    t = _trades(spark, sf).withColumn("bar_ts", F.col("open_time")).withColumn("t", F.struct("open_time", "close_time", "open_price", "direction"))
    tagged = align.asof(_b(spark, sf), t, ["symbol"], "bar_ts", "t").where(F.col("bar_ts") < F.col("t.close_time"))
    move = (ratio(F.col("price"), F.col("t.open_price")) - 1) * F.col("t.direction")
    return tagged.groupBy("symbol", stamp("t.open_time").alias("open_time")).agg((F.round(F.least(F.lit(0.0), F.min(move)) * 100, 5) + 0).alias("worst_pct"))


# --- sorts, limits, sets, windows

@query("srt_values", "SELECT factor, net_sharpe_ratio, row_number() OVER (ORDER BY CASE WHEN direction > 0 THEN net_sharpe_ratio END DESC NULLS LAST, test_name, process_name, factor) AS k FROM evals WHERE test_name = 't1'", EVALS)
def _(spark, sf):
    key = F.when(F.col("direction") > 0, F.col("net_sharpe_ratio"))
    e = _e(spark, sf).where("test_name = 't1'")
    order = [key.desc_nulls_last(), "test_name", "process_name", "factor"]
    return align.numbered(e, order, "k").select("factor", "net_sharpe_ratio", "k")


@query("srt_index", f"SELECT DISTINCT {dt()} AS day FROM daily ORDER BY 1", DAILY)
def _(spark, sf):
    return panels.daily(spark, sf).select(day_text("day").alias("day")).distinct().orderBy("day")


@query("srt_argsort", "SELECT factor, test_name, rank() OVER (PARTITION BY process_name ORDER BY hsr DESC, factor, test_name) AS k FROM evals", EVALS)
def _(spark, sf):
    w = Window.partitionBy("process_name").orderBy(F.col("hsr").desc(), "factor", "test_name")
    return _e(spark, sf).select("factor", "test_name", F.row_number().over(w).cast("long").alias("k"))


@query("lim_head_tail", "(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10) UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)")
def _(spark, sf):
    o = panels.table(spark, sf, "orders")
    head = o.orderBy("o_orderdate", "o_orderkey").limit(10).select(F.lit("head").alias("part"), "o_orderkey")
    return head.unionByName(o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select(F.lit("tail").alias("part"), "o_orderkey"))


@query("lim_nlargest", "(SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25)")
def _(spark, sf):
    return panels.table(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("lim_stride", f"SELECT symbol, {ts()} AS ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k FROM bars) WHERE (k - 1) % 100 = 0", BARS)
def _(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts"))
    return _b(spark, sf).withColumn("k", k).where("(k - 1) % 100 = 0").select("symbol", stamp("bar_ts").alias("ts"))


@query("set_concat", "SELECT symbol, price, NULL::DOUBLE AS factor FROM bars WHERE symbol = 'click' UNION ALL SELECT symbol, NULL, factor FROM bars WHERE symbol = 'view'", BARS)
def _(spark, sf):
    b = _b(spark, sf)
    return b.where("symbol = 'click'").select("symbol", "price").unionByName(b.where("symbol = 'view'").select("symbol", "factor"), allowMissingColumns=True)


for _name, _op, _f in (("set_union_idx", "UNION", lambda a, b: a.union(b).distinct()), ("set_intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("set_except", "EXCEPT", lambda a, b: a.subtract(b))):
    def _set(f):
        def q(spark, sf):
            b = _b(spark, sf)
            side = lambda s: b.where(F.col("symbol") == s).select(stamp("bar_ts").alias("ts"))
            return f(side("click"), side("error"))
        return q

    query(_name, f"SELECT {ts()} AS ts FROM bars WHERE symbol = 'click' {_op} SELECT {ts()} FROM bars WHERE symbol = 'error'", BARS)(_set(_f))


@query("set_dedup_latest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey) GROUP BY 1")
def _(spark, sf):
    return panels.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def _window(name, sql, col):
    @query(name, f"SELECT symbol, {ts()} AS ts, {sql} AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)", BARS)
    def _(spark, sf):
        return _b(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), col(Window.partitionBy("symbol").orderBy("bar_ts")).alias("v"))


_window("win_shift", "round(lead(price, 2) OVER w - lag(price, 1) OVER w, 6)", lambda w: F.round(F.lead("price", 2).over(w) - F.lag("price", 1).over(w), 6))
_window("win_pct_change", "round(price / lag(price, 5) OVER w - 1, 6)", lambda w: F.round(ratio(F.col("price"), F.lag("price", 5).over(w)) - 1, 6))
_window("win_diff", "round(price - lag(price) OVER w, 6)", lambda w: F.round(F.col("price") - F.lag("price").over(w), 6))
_window("win_rolling", "round(avg(price) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9)", lambda w: F.round(F.avg("price").over(w.rowsBetween(-9, 0)), 9))
_window("win_cum", "round(sum(factor) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4)", lambda w: F.round(F.sum("factor").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4))
_window("win_rolling_time", "round(max(price) OVER (PARTITION BY symbol ORDER BY bar_ts RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW), 6)", lambda w: F.round(F.max("price").over(Window.partitionBy("symbol").orderBy(F.unix_timestamp(F.col("bar_ts").cast("timestamp"))).rangeBetween(-5 * 3600, 0)), 6))


@query("win_rank_cs", f"SELECT symbol, {ts()} AS ts, (rank() OVER w + (count(*) OVER (PARTITION BY bar_ts, factor) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY bar_ts) AS pct FROM bars WINDOW w AS (PARTITION BY bar_ts ORDER BY factor)", BARS)
def _(spark, sf):
    r = F.rank().over(Window.partitionBy("bar_ts").orderBy("factor")) + (F.count("*").over(Window.partitionBy("bar_ts", "factor")) - 1) / F.lit(2.0)
    return _b(spark, sf).select("symbol", stamp("bar_ts").alias("ts"), (r / F.count("*").over(Window.partitionBy("bar_ts"))).alias("pct"))
