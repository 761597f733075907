"""Queries for scalers, rules, profit and loss, and metrics, on hourly bars; and the flagship that chains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import band_to_middle, ratio, side_clip
from ..operators import metrics, pnl, rules, scaling
from ..sources import panels
from .kit import BARS, DAILY, RETURNS, SIGNAL, day_text, dt, query, stamp, ts

W, FEE = 20, 0.0004


def signal(spark: SparkSession, sf: str) -> DataFrame:
    b = scaling.normalise(panels.bars(spark, sf), "factor", "minmax", W, out="s")
    return b.withColumn("s", F.round("s", 6))


def _show(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select("symbol", stamp("bar_ts").alias("ts"), *(F.round(c, digits).alias(c) for c in cols))


@query("bars", f"SELECT symbol, {ts()} AS ts, price, factor FROM bars", BARS)
def _(spark, sf):
    return _show(panels.bars(spark, sf), "price", "factor")


@query("scl_minmax", f"SELECT symbol, {ts()} AS ts, s FROM sig", SIGNAL)
def _(spark, sf):
    return _show(signal(spark, sf), "s")


@query("scl_normalize", f"SELECT symbol, {ts()} AS ts, s FROM sig", SIGNAL)
def _(spark, sf):
    return _show(scaling.normalise(panels.bars(spark, sf), "factor", "minmax", W, out="s", native=False), "s")


_SIGNED = BARS + """, z AS (SELECT symbol, bar_ts, factor - 49.5 AS x FROM bars),
q AS (SELECT *, CASE WHEN x > 0 THEN x END AS u, CASE WHEN x < 0 THEN x END AS d FROM z),
f AS (SELECT *, quantile_cont(u, 0.02) OVER w AS ul, quantile_cont(u, 0.98) OVER w AS uh, count(u) OVER w AS un, quantile_cont(d, 0.02) OVER w AS dl, quantile_cont(d, 0.98) OVER w AS dh, count(d) OVER w AS dn
  FROM q WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))"""


@query("scl_minmax_sep", f"""SELECT symbol, {ts()} AS ts, round(CASE WHEN x > 0 AND un >= 10 AND uh <> ul THEN least(greatest(0.5 + 0.5 * (x - ul) / (uh - ul), 0), 1)
  WHEN x < 0 AND dn >= 10 AND dl <> dh THEN least(greatest(0.5 * (x - dh) / (dl - dh), 0), 1) END, 6) + 0 AS scaled FROM f""", _SIGNED)
def _(spark, sf):
    x = panels.bars(spark, sf).withColumn("x", F.col("factor") - 49.5)
    return _show(scaling.minmax_by_sign(x, "x", 40), "scaled")


@query("scl_zero_pct", f"""SELECT symbol, {ts()} AS ts, round(sum(CASE WHEN x < 0 THEN 1.0 WHEN x = 0 THEN 0.5 ELSE 0 END) OVER w / count(*) OVER w, 6) AS zero_share
  FROM z WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", BARS + ", z AS (SELECT symbol, bar_ts, factor - 49.5 AS x FROM bars)")
def _(spark, sf):
    x = panels.bars(spark, sf).withColumn("x", F.col("factor") - 49.5)
    return _show(scaling.zero_share(x, "x", 30), "zero_share")


@query("scl_rolling_pct", f"""SELECT symbol, {ts()} AS ts, CASE WHEN len(a) > 0 THEN round(len(list_filter(a, lambda v: v <= factor)) / len(a)::DOUBLE, 6) END AS scaled
  FROM (SELECT *, coalesce(list(factor) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING), []) AS a FROM bars)""", BARS)
def _(spark, sf):
    return _show(scaling.rolling_percentile(panels.bars(spark, sf), "factor", 30), "scaled")


_AROUND = BARS + """, r AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS ret FROM bars),
zs AS (SELECT *, CASE WHEN count(ret) OVER w >= 1 THEN sum(CASE WHEN ret < 0 THEN 1.0 WHEN ret = 0 THEN 0.5 ELSE 0 END) OVER w / count(*) OVER w END AS z0 FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
zl AS (SELECT *, lag(z0, 10) OVER (PARTITION BY symbol ORDER BY bar_ts) AS z FROM zs),
ar AS (SELECT *, list_sort(list(factor) OVER w) AS a, quantile_cont(factor, 0.02) OVER w AS lo, quantile_cont(factor, 0.98) OVER w AS hi FROM zl WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
ce AS (SELECT *, CASE WHEN z IS NOT NULL THEN a[CAST(floor((len(a) - 1) * z) AS INTEGER) + 1] + (a[least(CAST(floor((len(a) - 1) * z) AS INTEGER) + 2, len(a))] - a[CAST(floor((len(a) - 1) * z) AS INTEGER) + 1]) * ((len(a) - 1) * z - floor((len(a) - 1) * z)) END AS c FROM ar)"""


def _with_returns(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    return panels.bars(spark, sf).withColumn("ret", ratio(F.col("price"), F.lag("price").over(w)) - 1)


@query("scl_quantile_value", f"SELECT symbol, {ts()} AS ts, round(c, 6) AS centre FROM ce", _AROUND)
def _(spark, sf):
    x = scaling.zero_share(_with_returns(spark, sf), "ret", 20).withColumn("z", F.lag("zero_share", 10).over(Window.partitionBy("symbol").orderBy("bar_ts")))
    return _show(scaling.quantile_at(x, "factor", "z", 30), "centre")


@query("scl_minmax_his", f"""SELECT symbol, {ts()} AS ts, round(CASE WHEN factor > c AND hi <> c THEN least(greatest(0.5 + 0.5 * (factor - c) / (hi - c), 0), 1)
  WHEN factor < c AND c <> lo THEN least(greatest(0.5 * (factor - c) / (c - lo), 0), 1) END, 5) + 0 AS scaled FROM ce""", _AROUND)
def _(spark, sf):
    return _show(scaling.minmax_around(_with_returns(spark, sf), "factor", "ret", 30, 10), "scaled", digits=5)


_Z = _AROUND + """, zz AS (SELECT *, (factor - c) / nullif(stddev_samp(factor) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0) AS x FROM ce),
zq AS (SELECT *, quantile_cont(x, 0.02) OVER w AS xl, quantile_cont(x, 0.98) OVER w AS xh, count(x) OVER w AS n FROM zz WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
_ZSCORE = "CASE WHEN n >= 10 AND xh <> xl AND x IS NOT NULL THEN least(greatest((x - xl) / (xh - xl), 0), 1) END"


@query("scl_zscore_his", f"SELECT symbol, {ts()} AS ts, round({_ZSCORE}, 6) AS scaled FROM zq", _Z)
def _(spark, sf):
    return _show(scaling.zscore_around(_with_returns(spark, sf), "factor", "ret", 30, 10), "scaled")


_ADJ = _AROUND + """, pa AS (SELECT *, list_filter(coalesce(list(factor) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING), []), lambda v: v IS NOT NULL) AS before FROM ce),
pu AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS rn FROM pa),
pp AS (SELECT a.symbol, a.bar_ts, a.factor, a.c, a.z, a.before, count(*) FILTER (b.factor > b.c) AS un, count(*) FILTER (b.factor > b.c AND b.factor <= a.factor) AS u, count(*) FILTER (b.factor < b.c) AS dn, count(*) FILTER (b.factor < b.c AND b.factor <= a.factor) AS d
  FROM pu a LEFT JOIN pu b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 29 AND a.rn - 1 GROUP BY 1, 2, 3, 4, 5, 6)"""
_ADJ_PCT = "CASE WHEN factor > c AND un > 0 THEN 0.5 + 0.5 * u / un::DOUBLE WHEN factor < c AND dn > 0 THEN 0.5 * d / dn::DOUBLE END"
_P = "CASE WHEN len(before) > 0 THEN CASE WHEN factor IS NULL THEN 0.0 ELSE len(list_filter(before, lambda v: v <= factor)) / len(before)::DOUBLE END END"
_PCT_ADJ = "least(greatest(CASE WHEN p > z AND z <> 1 THEN 0.5 + 0.5 * (p - z) / (1 - z) WHEN p < z THEN 0.5 * (p - z) / z END, 0), 1)"
_CLIPPED = f"CASE WHEN (p > z AND z <> 1) OR p < z THEN {_PCT_ADJ} END"


@query("scl_adj_pct", f"SELECT symbol, {ts()} AS ts, round({_ADJ_PCT}, 6) AS scaled FROM pp", _ADJ)
def _(spark, sf):
    return _show(scaling.percentile_around(_with_returns(spark, sf), "factor", "ret", 30, 10), "scaled")


@query("scl_pct_adj", f"SELECT symbol, {ts()} AS ts, round({_CLIPPED}, 6) + 0 AS scaled FROM (SELECT *, {_P} AS p FROM pp)", _ADJ)
def _(spark, sf):
    return _show(scaling.percentile_vs_zero(_with_returns(spark, sf), "factor", "ret", 30, 10), "scaled")


@query("scl_dispatch")
def _(spark, sf):
    b = _with_returns(spark, sf)
    parts = [scaling.normalise(b, "factor", m, 30, **({"ret": "ret", "rtn_window": 10} if "his" in m or "adj" in m or "zero" in m else {})).select(F.lit(m).alias("method"), "symbol", stamp("bar_ts").alias("ts"), F.round("scaled", 6).alias("scaled")) for m in scaling.SCALERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("agg_scale_limit", f"""SELECT symbol, {dt('d')} AS day, round(avg(lo), 6) AS lower, round(avg(hi), 6) AS upper FROM
  (SELECT symbol, CAST(bar_ts AS DATE) AS d, quantile_cont(factor, 0.02) OVER w AS lo, quantile_cont(factor, 0.98) OVER w AS hi FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2""", BARS)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts").rowsBetween(-99, 0)
    b = panels.bars(spark, sf).select("symbol", F.to_date("bar_ts").alias("d"), F.percentile("factor", F.lit(0.02)).over(w).alias("lo"), F.percentile("factor", F.lit(0.98)).over(w).alias("hi"))
    return b.groupBy("symbol", day_text("d").alias("day")).agg(F.round(F.avg("lo"), 6).alias("lower"), F.round(F.avg("hi"), 6).alias("upper"))


# --- trade rules

_SEQ = SIGNAL + """,
sq AS (SELECT symbol, bar_ts, price, s, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS rn,
  date_diff('second', bar_ts, lead(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts)) / 60.0 AS ahead, strftime(bar_ts, '%H:%M') AS hm FROM sig)"""


def _walk(state: str, first: str, step: str, seq: str = "sq") -> str:
    """A recursive walk along each symbol: ``state`` columns, their first values, and their next values from st.* and n.*."""
    return f""", st AS (SELECT symbol, rn, {first} FROM {seq} n WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, {step} FROM st JOIN {seq} n ON n.symbol = st.symbol AND n.rn = st.rn + 1)
SELECT sq.symbol, {ts('sq.bar_ts')} AS ts, st.pos AS pos FROM st JOIN sq ON st.symbol = sq.symbol AND st.rn = sq.rn"""


def _machine(name: str, state: dict[str, str], steps: list[str], seq: str = "sq") -> tuple[str, str]:
    """A recursive walk with a state of several columns: their values before the first bar, then chained steps from st.* and n.*.

    Each step is a list of columns over the one before it; the first may use ``st`` and ``n``. Gives the CTE and its rows.
    """
    cols = ", ".join(state)
    inner = f"SELECT n.symbol, n.rn, {steps[0]} FROM {name} st JOIN {seq} n ON n.symbol = st.symbol AND n.rn = st.rn + 1"
    for s in steps[1:]:
        inner = f"SELECT *, {s} FROM ({inner})"
    new = ", ".join(f"new_{c}" for c in state)
    return f", {name}(symbol, rn, {cols}) AS (SELECT DISTINCT symbol, 0::BIGINT, {', '.join(state.values())} FROM {seq} UNION ALL SELECT symbol, rn, {new} FROM ({inner}))", f"SELECT symbol, rn, pos FROM {name} WHERE rn > 0"


def _mean_of(machines: list[tuple[str, str]], seq: str = "sq") -> str:
    """Mean position over the walks of several parameter sets."""
    rows = " UNION ALL ".join(r for _, r in machines)
    return "".join(m for m, _ in machines) + f" SELECT a.symbol, {ts('q.bar_ts')} AS ts, round(avg(pos), 6) AS pos FROM ({rows}) a JOIN {seq} q ON q.symbol = a.symbol AND q.rn = a.rn GROUP BY 1, 2"


def _gaps_sql(k: int, o: float, c: float, mode: str, reopen: bool, gap: float, end: str | None = None, quiet: str | None = None) -> tuple[str, str]:
    last = f"n.hm = '{end}'" if end else "false"
    still = f"n.hm >= '{quiet}' AND n.hm < '{end}'" if quiet else "false"
    return _machine(f"st{k}", {"side": "0", "parked": "0", "wide": "false", "pos": "NULL::DOUBLE"}, [
        f"n.s AS v, st.pos AS old, CASE WHEN st.wide AND st.parked <> 0 THEN st.parked ELSE st.side END AS side0, CASE WHEN st.wide THEN 0 ELSE st.parked END AS parked0, coalesce(n.ahead > {gap}, false) AS new_wide, coalesce(n.ahead > {gap}, false) OR {last} AS flat, {still} AS still",
        f"flat AND side0 <> 0 AND {str(mode in ('rest', 'restore')).lower()} AS cut, CASE WHEN flat THEN 0 ELSE side0 END AS base, CASE WHEN flat THEN {str(mode == 'block').lower()} ELSE still END AS shut",
        f"CASE WHEN base <> 0 AND base * v < {c} THEN 0 ELSE base END AS held, CASE WHEN v > {o} THEN 1 WHEN v < -{o} THEN -1 ELSE 0 END AS wish",
        f"CASE WHEN cut THEN 0 WHEN v IS NULL THEN base WHEN held = 0 AND NOT shut AND ({str(reopen).lower()} OR base = 0) THEN wish ELSE held END AS new_side, CASE WHEN cut AND {str(mode == 'restore').lower()} THEN side0 ELSE parked0 END AS new_parked",
        "CASE WHEN cut THEN 0.0::DOUBLE WHEN v IS NOT NULL OR old IS NOT NULL THEN new_side::DOUBLE END AS new_pos",
    ])


def _side(prev: str, o: float, c: float, reopen: bool) -> str:
    wish = f"CASE WHEN n.s > {o} THEN 1 WHEN n.s < -{o} THEN -1 ELSE 0 END"
    off = wish if reopen else "0"
    return f"CASE WHEN n.s IS NULL THEN {prev} WHEN {prev} = 1 THEN CASE WHEN n.s < {c} THEN {off} ELSE 1 END WHEN {prev} = -1 THEN CASE WHEN n.s > -({c}) THEN {off} ELSE -1 END ELSE {wish} END"


def _trigger_sql(o: float, c: float, reopen: bool) -> str:
    new, start = _side("st.side", o, c, reopen), _side("0", o, c, reopen)
    return _walk("side, pos", f"{start} AS side, CASE WHEN n.s IS NOT NULL THEN CAST({start} AS DOUBLE) END AS pos", f"{new} AS side, CASE WHEN n.s IS NOT NULL OR st.pos IS NOT NULL THEN CAST({new} AS DOUBLE) END AS pos").replace("st AS", "st(symbol, rn, side, pos) AS", 1)


#: Parameter sets of the registered queries by rule, for calls by name.
RULE_PARAMS: dict[str, list[dict]] = {}


def _rule_query(name: str, rule: str, params: list[dict], sql: str, head: str = _SEQ):
    if name == f"tr_{rule}":
        RULE_PARAMS[rule] = params

    @query(name, sql, head, recursive=True)
    def _(spark, sf):
        return _show(rules.run_rule(signal(spark, sf), rule, params), "pos")


GRID = [{"open_at": 0.8, "close_at": 0.0}, {"open_at": 0.6, "close_at": 0.2}, {"open_at": 0.5, "close_at": -0.2}]
_rule_query("tr_v0", "v0", GRID[:1], _trigger_sql(0.8, 0.0, False))


@query("tr_v0_1", _trigger_sql(0.6, 0.2, True), _SEQ, recursive=True)
def _(spark, sf):
    return _show(rules.reopening(signal(spark, sf), open_at=0.6, close_at=0.2), "pos")


_rule_query("tr_v0_1_wide", "v0_1", [{"open_at": 0.3, "close_at": 0.5}], _trigger_sql(0.3, 0.5, True))

_bin = "CASE WHEN n.s IS NULL THEN {p} WHEN {p} = 1 THEN CASE WHEN n.s < 0.0 THEN -1 ELSE 1 END WHEN n.s > 0.7 THEN 1 ELSE {p} END"
_rule_query("tr_binary", "binary", [{"direction": 1, "open_at": 0.7, "close_at": 0.0}], _walk(
    "", f"{_bin.format(p='(-1)')} AS side, CASE WHEN n.s IS NOT NULL THEN CAST({_bin.format(p='(-1)')} AS DOUBLE) END AS pos",
    f"{_bin.format(p='st.side')} AS side, CASE WHEN n.s IS NOT NULL OR st.pos IS NOT NULL THEN CAST({_bin.format(p='st.side')} AS DOUBLE) END AS pos").replace("st AS", "st(symbol, rn, side, pos) AS", 1))

_hit = "CASE WHEN st.side = 0 THEN coalesce(abs(n.s) > 0.4, false) WHEN st.side = 1 THEN coalesce(n.s < 0.1, false) ELSE coalesce(n.s > -0.1, false) END"
_full = f"({_hit}) AND st.streak + 1 >= 2"
_new1 = f"CASE WHEN {_full} THEN CASE WHEN st.side = 0 THEN CASE WHEN n.s > 0 THEN 1 ELSE -1 END ELSE 0 END ELSE st.side END"
_rule_query("tr_v1", "v1", [{"open_at": 0.4, "close_at": 0.1, "bars_needed": 2}], _walk(
    "", "0 AS side, CASE WHEN coalesce(abs(n.s) > 0.4, false) THEN 1 ELSE 0 END AS streak, CAST(0 AS DOUBLE) AS pos",
    f"{_new1} AS side, CASE WHEN {_full} OR NOT ({_hit}) THEN 0 ELSE st.streak + 1 END AS streak, CAST({_new1} AS DOUBLE) AS pos").replace("st AS", "st(symbol, rn, side, streak, pos) AS", 1))
_drop = lambda a: f"CASE WHEN len({a}) > 5 THEN {a}[2:] ELSE {a} END"
_rule_query("tr_v2", "v2", [{"open_at": 0.4, "close_at": 0.1, "window": 5, "needed": 3}], _mean_of([_machine("st0", {"side": "0", "flat": "[]::INTEGER[]", "held": "[]::INTEGER[]", "pos": "0.0::DOUBLE"}, [
    "n.s AS v, st.side AS side0, list_concat(st.flat, [coalesce(n.s > 0.4, false)::INTEGER, coalesce(n.s < -0.4, false)::INTEGER]) AS f0, list_append(st.held, coalesce(st.side * n.s < 0.1, false)::INTEGER) AS h0, st.flat AS f_old, st.held AS h_old",
    f"{_drop('f0')} AS f1, {_drop('h0')} AS h1",
    "side0 = 0 AND list_sum(f1) >= 3 AS opens, side0 <> 0 AND list_sum(h1) >= 3 AS closes",
    "CASE WHEN opens THEN CASE WHEN v > 0.4 THEN 1 ELSE -1 END WHEN closes THEN 0 ELSE side0 END AS new_side, CASE WHEN opens THEN [] WHEN side0 = 0 THEN f1 ELSE f_old END AS new_flat, CASE WHEN closes THEN [] WHEN side0 <> 0 THEN h1 ELSE h_old END AS new_held",
    "new_side::DOUBLE AS new_pos",
])]))


def _mean_sql() -> str:
    parts = []
    for k, g in enumerate(GRID):
        body = _trigger_sql(g["open_at"], g["close_at"], False)
        walk, _, out = body.partition("\nSELECT")
        parts.append((walk.replace("st(", f"st{k}(").replace("FROM st JOIN", f"FROM st{k} st JOIN"), f"SELECT symbol, rn, pos FROM st{k}"))
    return "".join(w for w, _ in parts) + f" SELECT a.symbol, {ts('sq.bar_ts')} AS ts, round(avg(pos), 6) AS pos FROM ({' UNION ALL '.join(p for _, p in parts)}) a JOIN sq ON sq.symbol = a.symbol AND sq.rn = a.rn GROUP BY 1, 2"


_rule_query("tr_v3", "v3", GRID, _mean_sql())
_GAPS = [g | {"gap": 90.0} for g in GRID]
for _n, _mode, _again in (("v3_1", "rest", False), ("v3_2", "restore", False), ("v3_3", "pass", True)):
    _rule_query(f"tr_{_n}", _n, _GAPS, _mean_of([_gaps_sql(k, g["open_at"], g["close_at"], _mode, _again, 90.0) for k, g in enumerate(GRID)]))
_shut = "(n.hm = '14:00' OR coalesce(n.ahead > 90, false))"


def _blocked(prev: str, o: float, c: float) -> str:
    base = f"(CASE WHEN {_shut} THEN 0 ELSE {prev} END)"
    wish = f"CASE WHEN {_shut} THEN 0 WHEN n.s > {o} THEN 1 WHEN n.s < -{o} THEN -1 ELSE 0 END"
    return f"CASE WHEN n.s IS NULL THEN {base} WHEN {base} = 1 AND NOT n.s < {c} THEN 1 WHEN {base} = -1 AND NOT n.s > -({c}) THEN -1 ELSE {wish} END"


_rule_query("tr_v3_4", "v3_4", [{"open_at": 0.6, "close_at": 0.2, "gap": 90.0, "end": "14:00"}], _walk(
    "", f"{_blocked('0', 0.6, 0.2)} AS side, CASE WHEN n.s IS NOT NULL THEN CAST({_blocked('0', 0.6, 0.2)} AS DOUBLE) END AS pos",
    f"{_blocked('st.side', 0.6, 0.2)} AS side, CASE WHEN n.s IS NOT NULL OR st.pos IS NOT NULL THEN CAST({_blocked('st.side', 0.6, 0.2)} AS DOUBLE) END AS pos").replace("st AS", "st(symbol, rn, side, pos) AS", 1))
_rule_query("tr_v3_5", "v3_5", [g | {"gap": 90.0, "end": "14:00", "quiet": "11:00"} for g in GRID], _mean_of([_gaps_sql(k, g["open_at"], g["close_at"], "block", True, 90.0, "14:00", "11:00") for k, g in enumerate(GRID)]))


def _next_day_sql(k: int, o: float, c: float) -> tuple[str, str]:
    return _machine(f"st{k}", {"side": "0", "due": "false", "day": "NULL::DATE", "pos": "NULL::DOUBLE"}, [
        "n.s AS v, st.side AS side0, st.due AS due0, st.pos AS old, st.day IS NOT NULL AND CAST(n.bar_ts AS DATE) <> st.day AS dawn, CAST(n.bar_ts AS DATE) AS new_day",
        f"CASE WHEN dawn AND due0 AND NOT coalesce(v > {o}, false) THEN 0 ELSE side0 END AS side1, CASE WHEN dawn THEN false ELSE due0 END AS due1",
        f"CASE WHEN side1 = 0 AND v > {o} THEN 1 ELSE side1 END AS new_side, CASE WHEN side1 = 0 AND v > {o} THEN false WHEN side1 <> 0 AND v < {c} THEN true ELSE due1 END AS new_due",
        "CASE WHEN v IS NOT NULL OR old IS NOT NULL THEN new_side::DOUBLE END AS new_pos",
    ])


_rule_query("tr_v3_4_t1", "v3_4_t1", GRID, _mean_of([_next_day_sql(k, g["open_at"], g["close_at"]) for k, g in enumerate(GRID)]))


def _stops_sql(o: float, c: float, loss: float, profit: float, trailing: bool, renew: bool) -> str:
    wish = f"CASE WHEN n.s > {o} THEN 1 WHEN n.s < -{o} THEN -1 ELSE 0 END"
    again = f"({wish}) = st.side" if renew else "false"
    entry = f"CASE WHEN st.side = 0 OR {again} THEN n.price ELSE st.entry END"
    best = f"CASE WHEN st.side = 0 OR {again} THEN n.price WHEN st.side = 1 THEN greatest(st.best, n.price) ELSE least(st.best, n.price) END"
    gain = f"st.side * n.price <= st.side * ({best}) * (1 - st.side * {profit})" if trailing else f"st.side * n.price >= st.side * ({entry}) * (1 + st.side * {profit})"
    out = f"st.side * n.price <= st.side * ({entry}) * (1 - st.side * {loss}) OR {gain} OR st.side * n.s < {c}"
    new = f"CASE WHEN n.s IS NULL THEN st.side WHEN st.side = 0 THEN {wish} WHEN {out} THEN 0 ELSE st.side END"
    first = "CASE WHEN n.s IS NULL THEN 0 ELSE {} END".format(wish)
    keep = lambda v, old: f"CASE WHEN n.s IS NULL THEN {old} ELSE {v} END"
    return _walk("", f"{first} AS side, n.price AS entry, n.price AS best, CASE WHEN n.s IS NOT NULL THEN CAST({first} AS DOUBLE) END AS pos",
                 f"{new} AS side, {keep(entry, 'st.entry')} AS entry, {keep(best, 'st.best')} AS best, CASE WHEN n.s IS NOT NULL OR st.pos IS NOT NULL THEN CAST({new} AS DOUBLE) END AS pos").replace("st AS", "st(symbol, rn, side, entry, best, pos) AS", 1)


_STOPS = {"open_at": 0.5, "close_at": -0.3, "loss": 0.05, "profit": 0.2}
_rule_query("tr_v4", "v4", [_STOPS], _stops_sql(0.5, -0.3, 0.05, 0.2, True, False))
_rule_query("tr_v5", "v5", [_STOPS], _stops_sql(0.5, -0.3, 0.05, 0.2, True, True))
_rule_query("tr_v6", "v6", [_STOPS], _stops_sql(0.5, -0.3, 0.05, 0.2, False, True))


_WISH = "CASE WHEN v > 0.6 THEN 1 WHEN v < -0.6 THEN -1 ELSE 0 END"


def _reversal_sql(restart: bool, extreme: bool) -> str:
    again, far = str(restart).lower(), str(extreme).lower()
    return _mean_of([_machine("st0", {"side": "0", "since": "0::BIGINT", "begun": "NULL::BIGINT", "mark": "0.0::DOUBLE", "mark_at": "0::BIGINT", "pos": "NULL::DOUBLE"}, [
        "n.s AS v, st.side AS side0, st.since AS since0, st.begun AS at0, st.mark AS mark0, st.mark_at AS far0, st.pos AS old",
        f"{_WISH} AS breach, side0 <> 0 AND rn - since0 >= 6 AND v IS NOT NULL AS done",
        "CASE WHEN done THEN 0 ELSE side0 END AS side1, CASE WHEN done THEN NULL ELSE at0 END AS at1",
        f"v IS NOT NULL AND side1 = 0 AND (at1 IS NULL OR ({again} AND breach <> 0)) AS fresh, v IS NOT NULL AND side1 = 0 AND NOT (at1 IS NULL OR ({again} AND breach <> 0)) AS watched, CASE WHEN mark0 > 0 THEN 1 ELSE -1 END AS sg",
        f"fresh AND breach <> 0 AS starts, watched AND {far} AND v * sg > abs(mark0) AS further",
        "CASE WHEN starts OR further THEN v ELSE mark0 END AS new_mark, CASE WHEN starts OR further THEN rn ELSE far0 END AS new_mark_at",
        f"rn - at1 AS past, rn - (CASE WHEN {far} THEN new_mark_at ELSE at1 END) AS base",
        f"watched AND past <= 8 AND past >= 3 AND (base >= 1 OR NOT {far}) AND sg * v < sg * (new_mark - base * 0.05::DOUBLE * sg) AS opens",
        "CASE WHEN opens THEN -sg ELSE side1 END AS new_side, CASE WHEN opens THEN rn ELSE since0 END AS new_since, CASE WHEN starts THEN rn WHEN opens OR (watched AND past > 8) THEN NULL ELSE at1 END AS new_begun",
        "CASE WHEN v IS NOT NULL OR old IS NOT NULL THEN new_side::DOUBLE END AS new_pos",
    ])])


#: Bars with their minute, and whether no bar of the two hours before was a breach.
_CLEAN = _SEQ + """,
cq AS (SELECT *, epoch(bar_ts) / 60.0::DOUBLE AS t, sum(CASE WHEN s > 0.6 OR s < -0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_ts RANGE BETWEEN INTERVAL 120 MINUTES PRECEDING AND CURRENT ROW)
  - CASE WHEN s > 0.6 OR s < -0.6 THEN 1 ELSE 0 END = 0 AS clean FROM sq)"""


def _timed_sql(stop: float | None, distance: float | None) -> str:
    missing = "v IS NULL" if stop is None else "(v IS NULL OR price IS NULL)"
    lost = "false" if stop is None else f"side0 <> 0 AND rn - since0 + 1 >= 15 AND CASE WHEN side0 > 0 THEN price / entry0 - 1 ELSE 1 - price / entry0 END < {stop}::DOUBLE"
    opens = "past >= 3 AND sg * v < sg * (trig0 - 0.05::DOUBLE * least(past, 5) * sg)" if distance is None else f"sg * (mark2 - v) >= {distance}::DOUBLE"
    return _mean_of([_machine("st0", {"side": "0", "since": "0::BIGINT", "entry": "0.0::DOUBLE", "begun": "NULL::BIGINT", "trig": "0.0::DOUBLE", "mark": "NULL::DOUBLE", "last": "NULL::DOUBLE", "cool": "NULL::DOUBLE", "pos": "NULL::DOUBLE"}, [
        "n.s AS v, n.price, n.t, n.clean, st.side AS side0, st.since AS since0, st.entry AS entry0, st.begun AS at0, st.trig AS trig0, st.mark AS mark0, st.last AS last0, st.cool AS cool0",
        f"{missing} AS none_, last0 IS NOT NULL AND t - last0 > 600 AS gap, {_WISH} AS breach",
        "CASE WHEN gap THEN NULL ELSE at0 END AS at1, CASE WHEN gap THEN NULL ELSE mark0 END AS mark1, CASE WHEN gap THEN t + 120 ELSE cool0 END AS cool1",
        f"coalesce(t < cool1, false) AS cooling, {lost} AS lost",
        "NOT none_ AND NOT cooling AND NOT lost AS live",
        "live AND side0 <> 0 AND (rn - since0 + 1 > 6 OR breach <> 0) AS done",
        "CASE WHEN done THEN 0 ELSE side0 END AS side1, CASE WHEN done THEN NULL ELSE at1 END AS at2, CASE WHEN done THEN NULL ELSE mark1 END AS mark_",
        "live AND side1 = 0 AND at2 IS NULL AND breach <> 0 AND clean AS starts, live AND side1 = 0 AND at2 IS NOT NULL AS watched, rn - at2 + 1 AS past, CASE WHEN trig0 > 0 THEN 1 ELSE -1 END AS sg",
        f"watched AND past > 8 AS over, CASE WHEN watched AND past <= 8 AND {str(distance is not None).lower()} AND sg * v > sg * mark_ THEN v ELSE mark_ END AS mark2",
        f"watched AND NOT over AND {opens} AS opens",
        "CASE WHEN none_ OR cooling THEN side0 WHEN lost THEN 0 WHEN opens THEN -sg ELSE side1 END AS new_side, CASE WHEN opens THEN rn ELSE since0 END AS new_since, CASE WHEN opens THEN price ELSE entry0 END AS new_entry,"
        " CASE WHEN none_ THEN at0 WHEN cooling THEN at1 WHEN lost OR opens OR over THEN NULL WHEN starts THEN rn ELSE at2 END AS new_begun, CASE WHEN starts THEN v ELSE trig0 END AS new_trig,"
        " CASE WHEN none_ THEN mark0 WHEN cooling OR lost THEN mark1 WHEN over THEN NULL WHEN starts THEN v ELSE mark2 END AS new_mark, CASE WHEN none_ THEN last0 ELSE t END AS new_last, CASE WHEN none_ THEN cool0 WHEN cooling THEN cool1 ELSE NULL END AS new_cool",
        "CASE WHEN none_ AND new_side = 0 THEN NULL ELSE new_side::DOUBLE END AS new_pos",
    ], "cq")], "cq")


_TIMED = {"gap": 600.0, "cooldown": 120.0, "lookback": 120.0}
for _n, _p, _sql in (("rev", {}, _reversal_sql(False, False)), ("rev1", {}, _reversal_sql(True, False)), ("rev2", {}, _reversal_sql(False, True)),
                     ("rev3", _TIMED, _timed_sql(None, None)), ("rev4", _TIMED, _timed_sql(-0.001, None)), ("rev5", _TIMED, _timed_sql(None, 0.2))):
    _rule_query(f"tr_{_n}", _n, [{"threshold": 0.6, "watch": 8, "hold": 6} | _p], _sql, _CLEAN if _p else _SEQ)


# --- profit and loss

_POS = SIGNAL + """,
ev AS (SELECT *, CASE WHEN s > 0.6 THEN 1 WHEN s < -0.6 THEN -1 END AS e FROM sig),
gr AS (SELECT *, count(e) OVER w AS g, last_value(e IGNORE NULLS) OVER w AS d, count(s) OVER w AS seen FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pos AS (SELECT symbol, bar_ts, price, s, CASE WHEN seen > 0 THEN CASE WHEN max(CASE WHEN (d = 1 AND s < 0.2) OR (d = -1 AND s > -0.2) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, g ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 0.0 ELSE coalesce(d, 0) END::DOUBLE END AS pos FROM gr),
gain AS (SELECT *, lead(price) OVER w / price - 1 AS rtn, pos * (lead(price) OVER w / price - 1) AS gp FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
allgp AS (SELECT symbol, bar_ts, gp FROM gain UNION ALL SELECT 'return', bar_ts, avg(gp) FROM gain GROUP BY bar_ts),
sums AS (SELECT symbol, CAST(bar_ts AS DATE) AS day, sum(g) AS gp FROM (SELECT *, lag(gp) OVER (PARTITION BY symbol ORDER BY bar_ts) AS g FROM allgp) GROUP BY 1, 2),
gpd AS (SELECT * FROM sums WHERE symbol <> 'return' UNION ALL SELECT 'return', day, avg(gp) FROM sums GROUP BY day),
turn AS (SELECT symbol, CAST(bar_ts AS DATE) AS day, sum(c) AS hsr FROM (SELECT *, abs(pos - lag(pos) OVER (PARTITION BY symbol ORDER BY bar_ts)) / 2 AS c FROM pos) GROUP BY 1, 2),
hsr AS (SELECT * FROM turn UNION ALL SELECT 'avg', day, avg(hsr) FROM turn GROUP BY day),
net AS (SELECT g.day, g.gp, h.hsr, round(coalesce(g.gp - 0.0004 * h.hsr, 0), 9) AS ret FROM gpd g LEFT JOIN hsr h ON h.day = g.day AND h.symbol = 'avg' WHERE g.symbol = 'return')"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return rules.reopening(signal(spark, sf), open_at=0.6, close_at=0.2)


def gained(spark: SparkSession, sf: str) -> DataFrame:
    return pnl.gains(pnl.forward_return(positions(spark, sf)))


def net_daily(spark: SparkSession, sf: str) -> DataFrame:
    g = gained(spark, sf)
    return pnl.net(pnl.daily_gains(g), pnl.turnover(g), FEE)


@query("pnl_fwd_rtn", f"SELECT symbol, {ts()} AS ts, round((lead(price, 3) OVER w / price - 1) / 3, 6) AS rtn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)", BARS)
def _(spark, sf):
    return _show(pnl.forward_return(panels.bars(spark, sf), 3), "rtn")


@query("pnl_fwd_rtn_model", f"SELECT symbol, {ts()} AS ts, round(lead(price, 3) OVER w / price - 1, 6) AS rtn FROM (SELECT * FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts < TIMESTAMP '2024-01-20') WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)", BARS)
def _(spark, sf):
    b = panels.bars(spark, sf).where("bar_ts >= timestamp_ntz'2024-01-05' and bar_ts < timestamp_ntz'2024-01-20'")
    return _show(pnl.forward_return(b, 3, per_bar=False), "rtn")


@query("pnl_gp_self", f"SELECT symbol, {ts()} AS ts, round(gp, 6) + 0 AS gp FROM allgp", _POS)
def _(spark, sf):
    g = gained(spark, sf)
    mean = g.groupBy("bar_ts").agg(F.avg("gp").alias("gp")).withColumn("symbol", F.lit("return"))
    return _show(g.select("symbol", "bar_ts", "gp").unionByName(mean.select("symbol", "bar_ts", "gp")), "gp")


@query("pnl_gp_cross", f"""SELECT a.symbol || ' To ' || b.symbol AS symbol, {ts('a.bar_ts')} AS ts, round(a.pos * b.rtn, 6) + 0 AS gp FROM gain a JOIN gain b USING (bar_ts)
  WHERE (a.symbol, b.symbol) IN (('click', 'view'), ('view', 'click'), ('error', 'purchase'))""", _POS)
def _(spark, sf):
    g = gained(spark, sf)
    pairs = spark.createDataFrame([("click", "view"), ("view", "click"), ("error", "purchase")], "s string, t string")
    left = g.select(F.col("symbol").alias("s"), "bar_ts", "pos").join(F.broadcast(pairs), "s")  # three rows
    right = g.select(F.col("symbol").alias("t"), "bar_ts", "rtn")
    return left.join(right, ["t", "bar_ts"]).select(F.concat("s", F.lit(" To "), "t").alias("symbol"), stamp("bar_ts").alias("ts"), F.round(F.col("pos") * F.col("rtn"), 6).alias("gp"))


@query("pnl_gpd", f"SELECT symbol, {dt()} AS day, round(gp, 6) AS gp FROM gpd", _POS)
def _(spark, sf):
    return pnl.daily_gains(gained(spark, sf)).select("symbol", day_text("day").alias("day"), F.round("gp", 6).alias("gp"))


@query("pnl_hsr", f"SELECT symbol, {dt()} AS day, round(hsr, 6) AS hsr FROM hsr", _POS)
def _(spark, sf):
    return pnl.turnover(positions(spark, sf)).select("symbol", day_text("day").alias("day"), F.round("hsr", 6).alias("hsr"))


@query("pnl_net", f"SELECT {dt()} AS day, round(ret, 6) AS net FROM net", _POS)
def _(spark, sf):
    return net_daily(spark, sf).select(day_text("day").alias("day"), F.round("net", 6).alias("net"))


@query("pnl_single", f"""SELECT symbol, {dt('CAST(bar_ts AS DATE)')} AS day, round(sum(coalesce(gp, 0)), 6) AS gp, round(sum(coalesce(c, 0)), 6) AS hsr
  FROM (SELECT *, abs(pos - lag(pos) OVER (PARTITION BY symbol ORDER BY bar_ts)) / 2 AS c FROM gain) GROUP BY 1, 2""", _POS)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    g = gained(spark, sf).withColumn("c", F.abs(F.col("pos") - F.lag("pos").over(w)) / 2)
    return g.groupBy("symbol", day_text("bar_ts").alias("day")).agg(F.round(F.sum(F.coalesce("gp", F.lit(0.0))), 6).alias("gp"), F.round(F.sum(F.coalesce("c", F.lit(0.0))), 6).alias("hsr"))


@query("pnl_direction", "SELECT symbol, CASE WHEN sum(gp) > 0 THEN 1 ELSE -1 END::BIGINT AS direction FROM gpd GROUP BY 1", _POS)
def _(spark, sf):
    d = pnl.daily_gains(gained(spark, sf))
    return d.groupBy("symbol").agg(F.when(F.sum("gp") > 0, 1).otherwise(-1).cast("long").alias("direction"))


@query("pnl_ppt", "SELECT round(sum(gp) / nullif(sum(hsr), 0) * 1000, 6) AS ppt FROM net", _POS)
def _(spark, sf):
    return net_daily(spark, sf).agg(F.round(ratio(F.sum("gp"), F.sum("hsr")) * 1000, 6).alias("ppt"))


@query("pnl_dwr", "SELECT round(count(*) FILTER (ret > 0) / nullif(count(*) FILTER (ret <> 0), 0)::DOUBLE, 6) AS dwr FROM net", _POS)
def _(spark, sf):
    n = net_daily(spark, sf).withColumn("net", F.round("net", 9))
    return n.agg(F.round(ratio(F.count_if(F.col("net") > 0), F.count_if(F.col("net") != 0)), 6).alias("dwr"))


@query("prj_clip", f"""SELECT symbol, {ts()} AS ts, d AS direction_choice, CASE WHEN s IS NOT NULL THEN CASE d WHEN 'pos' THEN greatest(s, 0) WHEN 'neg' THEN least(s, 0) ELSE s END END AS s
  FROM sig, (VALUES ('all'), ('pos'), ('neg')) t(d)""", SIGNAL)
def _(spark, sf):
    s = signal(spark, sf)
    sides = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), side_clip(F.col("s"), d).alias("v")) for d in ("all", "pos", "neg"))))
    return s.select("symbol", stamp("bar_ts").alias("ts"), sides.alias("x")).select("symbol", "ts", F.col("x.d").alias("direction_choice"), F.col("x.v").alias("s"))


@query("prj_clip_band", f"SELECT symbol, {ts()} AS ts, CASE WHEN s > -0.3 AND s < 1.3 THEN 0.5 ELSE s END AS s FROM sig", SIGNAL)
def _(spark, sf):
    return _show(signal(spark, sf).withColumn("s", band_to_middle(F.col("s"), -0.3)), "s")


# --- metrics

_DD = RETURNS + """,
run AS (SELECT *, sum(ret) OVER w AS cum, product(1 + ret) OVER w AS wealth FROM rets WINDOW w AS (PARTITION BY factor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dds AS (SELECT *, max(cum) OVER w - cum AS fall, wealth / max(wealth) OVER w - 1 AS dd FROM run WINDOW w AS (PARTITION BY factor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
eps AS (SELECT factor, g, count(*) AS length, min(dd) AS depth, min(day) AS first FROM (SELECT *, sum(CASE WHEN round(dd, 12) < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY factor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g,
  sum(CASE WHEN round(dd, 12) < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY factor) AS lastg FROM dds) WHERE round(dd, 12) < 0 AND g < lastg GROUP BY 1, 2),
agg AS (SELECT factor, sum(ret) AS ret, sum(ret) * 245 / count(*) AS ann, max(fall) AS max_dd, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245) AS sharpe,
  avg(ret) / nullif(sqrt(avg(ret * ret) FILTER (ret < 0)), 0) * sqrt(245) AS sortino, arg_max(wealth, day) AS w, count(*) AS n, avg(dd) FILTER (dd < 0) AS down, avg(dd * dd) FILTER (dd < 0) AS down2, sqrt(avg(dd * dd)) AS ulcer FROM dds GROUP BY 1)"""


@query("m_general", """SELECT a.factor, round(ret, 6) AS "return", round(ann, 6) AS return_annualized, round(max_dd, 6) AS max_dd, round(sharpe, 6) AS sharpe_ratio, round(CASE WHEN max_dd > 0 THEN ann / max_dd END, 6) AS calmar_ratio,
  round(sortino, 6) AS sortino_ratio, round((pow(w, 245.0 / n) - 1) / -down, 5) AS sterling_ratio, round((pow(w, 245.0 / n) - 1) / sqrt(down2), 5) AS burke_ratio, round(ulcer * 100, 5) AS ulcer_index, round(r.v, 3) AS avg_recovery
  FROM agg a LEFT JOIN (SELECT factor, avg(length / abs(depth)) AS v FROM eps GROUP BY 1) r USING (factor)""", _DD)
def _(spark, sf):
    m = metrics.summary(panels.returns(spark, sf))
    digits = {"sterling_ratio": 5, "burke_ratio": 5, "ulcer_index": 5, "avg_recovery": 3}
    return m.select("factor", *(F.round(c, digits.get(c, 6)).alias(c) for c in m.columns if c != "factor"))


def _metric(name: str, sql: str, **cols):
    @query(name, f"SELECT factor, {sql} FROM dds GROUP BY 1", _DD)
    def _(spark, sf):
        return metrics.drawdowns(panels.returns(spark, sf)).groupBy("factor").agg(*(F.round(c(), 6).alias(k) for k, c in cols.items()))


_metric("m_return", 'round(sum(ret), 6) AS total, round(sum(ret) * 245 / count(*), 6) AS annual', total=lambda: F.sum("ret"), annual=lambda: F.sum("ret") * 245 / F.count("ret"))
_metric("m_maxdd", "round(max(fall), 6) AS max_dd", max_dd=lambda: F.max("fall"))
_metric("m_sharpe", "round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245), 6) AS sharpe", sharpe=lambda: metrics.sharpe("ret"))
_metric("m_sharpe252", "round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) AS sharpe", sharpe=lambda: F.coalesce(metrics.sharpe("ret", 252, True), F.lit(0.0)))
_metric("m_sortino", "round(avg(ret) / nullif(sqrt(avg(ret * ret) FILTER (ret < 0)), 0) * sqrt(245), 6) AS sortino", sortino=lambda: metrics.sortino("ret"))
_metric("m_calmar", "round(CASE WHEN max(fall) > 0 THEN sum(ret) * 245 / count(*) / max(fall) END, 6) AS calmar", calmar=lambda: F.when(F.max("fall") > 0, ratio(F.sum("ret") * 245 / F.count("ret"), F.max("fall"))))
_metric("m_ulcer", "round(sqrt(avg(dd * dd)) * 100, 6) AS ulcer", ulcer=lambda: F.sqrt(F.avg(F.col("dd") * F.col("dd"))) * 100)
_metric("m_sterling", "round((pow(arg_max(wealth, day), 245.0 / count(*)) - 1) / -avg(dd) FILTER (dd < 0), 6) AS sterling", sterling=lambda: ratio(F.pow(F.max_by("wealth", "day"), 245.0 / F.count("ret")) - 1, -F.avg(F.when(F.col("dd") < 0, F.col("dd")))))
_metric("m_burke", "round((pow(arg_max(wealth, day), 245.0 / count(*)) - 1) / sqrt(avg(dd * dd) FILTER (dd < 0)), 6) AS burke", burke=lambda: ratio(F.pow(F.max_by("wealth", "day"), 245.0 / F.count("ret")) - 1, F.sqrt(F.avg(F.when(F.col("dd") < 0, F.col("dd") * F.col("dd"))))))


@query("m_dd_series", f"SELECT factor, {dt()} AS day, round(-fall, 6) + 0 AS fall FROM dds", _DD)
def _(spark, sf):
    return metrics.drawdowns(panels.returns(spark, sf)).select("factor", day_text("day").alias("day"), (F.round(-F.col("fall"), 6) + 0).alias("fall"))


@query("m_drawdowns", f"SELECT factor, {dt()} AS day, round(dd, 8) + 0 AS dd FROM dds", _DD)
def _(spark, sf):
    return metrics.drawdowns(panels.returns(spark, sf)).select("factor", day_text("day").alias("day"), (F.round("dd", 8) + 0).alias("dd"))


@query("ep_recovery", f"SELECT factor, {dt('first')} AS first_day, length, round(depth, 8) AS depth FROM eps", _DD)
def _(spark, sf):
    e = metrics.episodes(metrics.drawdowns(panels.returns(spark, sf)))
    return e.select("factor", day_text("first").alias("first_day"), "length", F.round("depth", 8).alias("depth"))


@query("m_recovery", "SELECT factor, round(avg(length / abs(depth)), 3) AS avg_recovery FROM eps GROUP BY 1", _DD)
def _(spark, sf):
    e = metrics.episodes(metrics.drawdowns(panels.returns(spark, sf)))
    return e.groupBy("factor").agg(F.round(F.avg(F.col("length") / F.abs("depth")), 3).alias("avg_recovery"))


@query("m_long_ratio", "SELECT symbol, round(sum(greatest(pos, 0)) / nullif(sum(greatest(pos, 0)) + sum(greatest(-pos, 0)), 0), 6) AS long_ratio FROM pos WHERE pos IS NOT NULL GROUP BY 1", _POS)
def _(spark, sf):
    p = positions(spark, sf).where("pos is not null")
    up, down = F.sum(F.greatest("pos", F.lit(0.0))), F.sum(F.greatest(-F.col("pos"), F.lit(0.0)))
    return p.groupBy("symbol").agg(F.round(ratio(up, up + down), 6).alias("long_ratio"))


@query("m_rolling_sharpe", f"""SELECT factor, {dt()} AS day, CASE WHEN count(ret) OVER w > 10 THEN round(avg(ret) OVER w / nullif(stddev_pop(ret) OVER w, 0) * sqrt(245), 5) END AS sharpe
  FROM rets WINDOW w AS (PARTITION BY factor ORDER BY day RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND CURRENT ROW)""", RETURNS)
def _(spark, sf):
    r = panels.returns(spark, sf).withColumn("n", F.unix_date("day"))
    w = Window.partitionBy("factor").orderBy("n").rangeBetween(-59, 0)
    s = ratio(F.avg("ret").over(w), F.stddev_pop("ret").over(w)) * F.sqrt(F.lit(245.0))
    return r.select("factor", day_text("day").alias("day"), F.when(F.count("ret").over(w) > 10, F.round(s, 5)).alias("sharpe"))


@query("m_all", """SELECT round(sum(ret) * 1000, 5) AS total, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245), 5) AS sharpe, round(avg(hsr), 6) AS hsr, count(*) AS days FROM net""", _POS)
def _(spark, sf):
    n = net_daily(spark, sf).withColumn("net", F.round("net", 9))
    return n.agg(F.round(F.sum("net") * 1000, 5).alias("total"), F.round(metrics.sharpe("net"), 5).alias("sharpe"), F.round(F.avg("hsr"), 6).alias("hsr"), F.count("*").alias("days"))


@query("flagship", """, rd AS (SELECT *, sum(ret) OVER w AS cum FROM net WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fl AS (SELECT *, max(cum) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS fall FROM rd)
SELECT 'click-purchase' AS model, round(sum(ret), 6) AS "return", round(sum(ret) * 245 / count(*), 6) AS return_annualized, round(max(fall), 6) AS max_dd,
  round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(245), 5) AS sharpe_ratio, round(avg(ret) / nullif(sqrt(avg(ret * ret) FILTER (ret < 0)), 0) * sqrt(245), 5) AS sortino_ratio FROM fl""", _POS)
def _(spark, sf):
    n = net_daily(spark, sf).select(F.lit("click-purchase").alias("model"), "day", F.round("net", 9).alias("ret"))
    m = metrics.summary(n, keys=["model"])
    return m.select("model", *(F.round(c, 5 if c in ("sharpe_ratio", "sortino_ratio") else 6).alias(c) for c in ("return", "return_annualized", "max_dd", "sharpe_ratio", "sortino_ratio")))
