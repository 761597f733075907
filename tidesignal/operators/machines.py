"""Trade rules as finite-state machines, run over stretches of a series in parallel.

A rule reads one code a bar (the comparisons of the signal with the thresholds, gaps, times of day) and moves between few states, so a
stretch of bars is a map from entry state to exit state, and the map of two stretches is their composition. ``run`` cuts every
series at multiples of ``SPAN_DAYS``, reduces each stretch to its maps (one for each parameter set), composes the maps of a series in
order of time to find where each stretch begins, and replays the stretches: one long series spreads over tasks, and the only thing
grouped by series is a row for each stretch. Rows are shuffled once, by series and stretch; both uses share that exchange.

Inside a stretch maps are composed the same way: bars in blocks of about the root of their number, all blocks and parameter sets at once.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Days in a stretch: it has at most so many days' bars, 92,160 of one minute.
SPAN_DAYS = 64
#: Parameter sets that go over a stretch together; more are dealt to further tasks.
SETS = 256
#: Sets that a task takes through a stretch at once: what is at hand stays small.
ABREAST = 8

NAN = float("nan")
# Bits of a code.
UP, DOWN, BELOW, ABOVE, MISSING, WIDE, LAST, QUIET = (1 << k for k in range(8))
_DOWN, _BELOW, _ABOVE = (np.uint8(b) for b in (DOWN, BELOW, ABOVE))


@dataclass(frozen=True)
class Machine:
    """``table[code, state]``: the next state; ``output[code, state]``: the position of a bar of that code, entered in that state.

    The last code of ``table`` changes nothing.
    """

    table: np.ndarray
    output: np.ndarray


def explore(step: Callable, start: tuple, codes: list[int]) -> Machine:
    """The machine of ``step(state, code) -> (state, position)`` over all states that can be reached; ``start`` has number 0."""
    number, table, output = {start: 0}, [], []
    todo = [start]
    for state in todo:
        row = [step(state, c) for c in codes]
        for nxt, _ in row:
            if nxt not in number:
                number[nxt] = len(todo)
                todo.append(nxt)
        table.append([number[nxt] for nxt, _ in row])
        output.append([out for _, out in row])
    size = max(codes) + 2
    t, o = np.tile(np.arange(len(todo), dtype=np.int32), (size, 1)), np.full((size, len(todo)), NAN)
    t[codes], o[codes] = np.array(table).T, np.array(output, float).T
    return Machine(t, o)


def _subsets(bits: list[int]) -> list[int]:
    return sorted(sum(c) for n in range(len(bits) + 1) for c in itertools.combinations(bits, n))


def _shown(side: int, seen: bool) -> float:
    return float(side) if seen else NAN


@functools.lru_cache(256)
def _trigger(reopen: bool, at_gap: str, longs: bool, shorts: bool, gaps: bool, end: bool, quiet: bool) -> Machine:
    def step(state, code):
        side, parked, seen, after_gap = state
        wide = bool(code & WIDE)
        nxt = wide and at_gap == "restore"
        if after_gap and parked:
            side, parked = parked, 0
        shut = False
        if wide or code & LAST:
            if side and (longs if side > 0 else shorts):
                if at_gap in ("rest", "restore"):
                    return (0, side if at_gap == "restore" else 0, seen, nxt), 0.0
                side = 0
            shut = at_gap == "block"
        elif code & QUIET:
            shut = True
        if code & MISSING:
            return (side, parked, seen, nxt), _shown(side, seen)
        held = side
        if code & (BELOW if side > 0 else ABOVE if side < 0 else 0):
            side = 0
        if not side and not shut and (reopen or not held):
            side = 1 if code & UP else -1 if code & DOWN else 0
        return (side, parked, True, nxt), float(side)

    more = [WIDE] * gaps + [LAST] * end + [QUIET] * quiet
    return explore(step, (0, 0, False, False), [a | b for a in (*_subsets([UP, DOWN, BELOW, ABOVE]), MISSING) for b in _subsets(more)])


@functools.lru_cache(8)
def _one_sided(direction: int) -> Machine:
    def step(state, code):
        side, seen = state
        if code & MISSING:
            return state, _shown(side, seen)
        if side == direction:
            side = -direction if code & BELOW else side
        elif code & UP:
            side = direction
        return (side, True), float(side)

    return explore(step, (-direction, False), [*_subsets([UP, BELOW]), MISSING])


@functools.lru_cache(64)
def _confirmed(needed: int) -> Machine:
    def step(state, code):
        side, streak = state
        wish = 1 if code & UP else -1 if code & DOWN else 0
        hit = wish if not side else code & (BELOW if side > 0 else ABOVE)
        streak = streak + 1 if hit else 0
        if streak >= needed:
            side, streak = (wish if not side else 0), 0
        return (side, streak), float(side)

    return explore(step, (0, 0), _subsets([UP, DOWN, BELOW, ABOVE]))


@functools.lru_cache(1)
def _next_day() -> Machine:
    def step(state, code):
        side, due, seen = state
        if code & LAST:  # the first bar of a day
            side, due = (0 if due and not code & UP else side), False
        if code & MISSING:
            return (side, due, seen), _shown(side, seen)
        if side and code & BELOW:
            due = True
        if not side and code & UP:
            side, due = 1, False
        return (side, due, True), float(side)

    return explore(step, (0, False, False), [a | b for a in (*_subsets([UP, BELOW]), MISSING) for b in (0, LAST)])


def _crossings(x: np.ndarray, open_at: float, close_at: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (x > open_at) | (x < -open_at) * _DOWN | (x < close_at) * _BELOW | (-x < close_at) * _ABOVE


class Bars:
    """The bars of one stretch in order of time, and when the next stretch begins (None: it is the last)."""

    def __init__(self, x: np.ndarray, when: np.ndarray, following: np.datetime64 | None):
        self.x, self.missing, self.when = x, MISSING * np.isnan(x), when
        then = np.append(when[1:], when[-1:] if following is None else following)
        self.ahead = (then - when).astype("timedelta64[us]").astype(float) / 60e6

    @functools.cached_property
    def clock(self) -> np.ndarray:
        return (self.when.astype("datetime64[m]").astype("int64")) % 1440

    @functools.cached_property
    def dawn(self) -> np.ndarray:
        day = self.when.astype("datetime64[D]")
        return np.append(True, day[1:] != day[:-1])  # stretches begin with a day


def _minute(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:5])


def trigger(b: Bars, open_at: float, close_at: float, reopen: bool = False, gap: float | None = None, at_gap: str = "none", end: str | None = None, quiet: str | None = None, longs: bool = True, shorts: bool = True) -> tuple[Machine, np.ndarray]:
    """Open beyond +-open_at, close when the signal falls back through close_at on its side.

    ``gap`` (minutes to the next bar) and ``end`` (HH:MM) may flatten: ``rest`` gives 0 and ends the bar, ``restore`` does so and takes
    the same side again after the gap, ``pass`` flattens and goes on, ``block`` flattens and forbids opening. From ``quiet`` to ``end``
    nothing is opened.
    """
    code = np.where(b.missing, b.missing, _crossings(b.x, open_at, close_at))
    if gap is not None:
        code += WIDE * (b.ahead > gap)
    if end is not None:
        code += LAST * (b.clock == _minute(end))
        if quiet is not None:
            code += QUIET * ((b.clock >= _minute(quiet)) & (b.clock < _minute(end)))
    return _trigger(reopen, at_gap, longs, shorts, gap is not None, end is not None, end is not None and quiet is not None), code


def one_sided(b: Bars, direction: int, open_at: float, close_at: float) -> tuple[Machine, np.ndarray]:
    """Always in the market: ``direction`` from its opening to its closing signal, the other side else."""
    with np.errstate(invalid="ignore"):
        code = UP * (direction * b.x > open_at) + BELOW * (direction * b.x < close_at)
    return _one_sided(direction), np.where(b.missing, b.missing, code)


def confirmed(b: Bars, open_at: float, close_at: float, bars_needed: int = 3) -> tuple[Machine, np.ndarray]:
    """As many bars in a row are needed to open or to close; both sides share one count, and a missing bar ends it."""
    return _confirmed(bars_needed), _crossings(b.x, open_at, close_at)


def next_day(b: Bars, open_at: float, close_at: float) -> tuple[Machine, np.ndarray]:
    """Long only; a closing signal acts at the next day's first bar, unless that bar opens anew."""
    with np.errstate(invalid="ignore"):
        code = UP * (b.x > open_at) + BELOW * (b.x < close_at)
    return _next_day(), np.where(b.missing, b.missing, code) + LAST * b.dawn


#: Rules by name: a stretch and parameters give the machine and the codes of its bars.
MACHINES: dict[str, Callable[..., tuple[Machine, np.ndarray]]] = {
    "v0": trigger,
    "v0_1": functools.partial(trigger, reopen=True),
    "binary": one_sided,
    "v1": confirmed,
    "v3": trigger,
    "v3_1": functools.partial(trigger, at_gap="rest"),
    "v3_2": functools.partial(trigger, at_gap="restore"),
    "v3_3": functools.partial(trigger, at_gap="pass", reopen=True),
    "v3_4": functools.partial(trigger, at_gap="block", reopen=True),
    "v3_5": functools.partial(trigger, at_gap="block", reopen=True),
    "v3_4_t1": next_day,
}


def _blocks(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as (bar of a block, set, block), filled up with the code that changes nothing, and the map of each block (set, block, state)."""
    sets, n = codes.shape
    length = max(1, int(n**0.5))
    count = -(-n // length)
    states = table.shape[1]
    c = np.full((sets, count * length), len(table) - 1, np.int32)
    c[:, :n] = codes
    c = np.ascontiguousarray(c.reshape(sets, count, length).transpose(2, 0, 1)) * np.int32(states)
    flat, m = table.ravel(), np.broadcast_to(np.arange(states, dtype=np.int32), (sets, count, states))
    for k in range(length):
        m = flat.take(c[k, :, :, None] + m)
    return c, m


def exits(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Exit state of each set of codes (a row each) for every entry state."""
    _, m = _blocks(table, codes)
    out = np.broadcast_to(np.arange(table.shape[1]), (len(codes), table.shape[1]))
    for k in range(m.shape[1]):
        out = np.take_along_axis(m[:, k], out, 1)
    return out


def replay(machine: Machine, codes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the positions of all sets at each bar, and number of sets with one, from each set's entry state."""
    c, m = _blocks(machine.table, codes)
    at, starts, rows = entry, [], np.arange(len(codes))
    for k in range(m.shape[1]):
        starts.append(at)
        at = m[rows, k, at]
    s = np.array(starts, np.int32).T
    flat, shown, known = machine.table.ravel(), np.nan_to_num(machine.output).ravel(), (~np.isnan(machine.output)).ravel()
    total, count = np.empty((len(c), c.shape[2])), np.empty((len(c), c.shape[2]), np.int64)
    for k in range(len(c)):
        at = c[k] + s
        total[k], count[k] = shown.take(at).sum(0), known.take(at).sum(0)
        s = flat.take(at)
    return total.T.ravel()[: codes.shape[1]], count.T.ravel()[: codes.shape[1]]


def _together(rule: str, b: Bars, params: list[dict]) -> Iterator[tuple[Machine, list[int], np.ndarray]]:
    """Machines of the parameter sets, each with up to ``ABREAST`` of the sets that share it and their codes."""
    shared: dict[int, tuple] = {}
    for k, p in enumerate(params):
        m, code = MACHINES[rule](b, **p)
        of = shared.setdefault(id(m), (m, [], []))
        of[1].append(k)
        of[2].append(code.astype(np.uint8))
        if len(of[1]) == ABREAST:
            yield m, of[1], np.array(of[2])
            del shared[id(m)]
    for m, sets, codes in shared.values():
        yield m, sets, np.array(codes)


def _bars(pdf: pd.DataFrame, following=None) -> tuple[pd.DataFrame, Bars]:
    pdf = pdf.sort_values("bar_ts", ignore_index=True)
    return pdf, Bars(pdf["s"].to_numpy(float), pdf["bar_ts"].to_numpy("datetime64[us]"), following)


def run(df: DataFrame, rule: str, params: list[dict], keys: list[str], span_days: int | None = None) -> DataFrame:
    """``keys, bar_ts, _sum, _sets``: sum of the positions of all sets at each bar, and number of sets with one; ``df`` has
    ``keys, bar_ts, s``, with a date or time stamp as ``bar_ts``."""
    batches = -(-len(params) // SETS)
    stretch = F.floor(F.unix_date(F.col("bar_ts").cast("date")) / (span_days or SPAN_DAYS)).cast("int")
    batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))) if batches > 1 else F.lit(0)
    base = df.select(*keys, "bar_ts", "s", stretch.alias("_stretch"), batch.alias("_batch"))
    group, ids = [*keys, "_stretch", "_batch"], [base.schema[k] for k in keys]
    of = lambda pdf: params[int(pdf["_batch"].iloc[0]) :: batches]
    long_gap = lambda p, first, last: "gap" in p and p["gap"] is not None and (first - last) / np.timedelta64(1, "m") > p["gap"]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        """A stretch as maps: over all bars but the last, then over the last, without and with a wide gap after it."""
        pdf, b = _bars(pdf)
        mine = of(pdf)
        maps: list = [None] * len(mine)
        for m, sets, codes in _together(rule, b, mine):
            before, states = exits(m.table, codes[:, :-1]), m.table.shape[1]
            for k, code, x in zip(sets, codes[:, -1].tolist(), before):
                both = np.concatenate([m.table[c, x] if c < len(m.table) - 1 else x for c in (code, code | WIDE)])
                maps[k] = np.append(states, both)
        head = pdf.loc[[0], group]
        head["first"], head["last"], head["maps"] = pdf["bar_ts"].iloc[0], pdf["bar_ts"].iloc[-1], [np.concatenate(maps).astype("<u2").tobytes()]
        return head

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state of each set at the beginning of each stretch of a series."""
        pdf = pdf.sort_values("_stretch", ignore_index=True)
        mine = of(pdf)
        at, out = [0] * len(mine), []
        first = pdf["first"].to_numpy("datetime64[us]")
        for k, (last, raw) in enumerate(zip(pdf["last"].to_numpy("datetime64[us]"), pdf["maps"])):
            out.append(np.array(at, "<u2").tobytes())
            maps, place = np.frombuffer(raw, "<u2"), 0
            for j, p in enumerate(mine):
                states = int(maps[place])
                wide = k + 1 < len(pdf) and long_gap(p, first[k + 1], last)
                at[j] = int(maps[place + 1 + states * wide + at[j]])
                place += 1 + 2 * states
        pdf["following"], pdf["states"] = pdf["first"].shift(-1), out
        return pdf[[*group, "following", "states"]]

    def show(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        after = entry["following"].to_numpy("datetime64[us]")[0]
        pdf, b = _bars(pdf, None if np.isnat(after) else after)
        states = np.frombuffer(entry["states"].iloc[0], "<u2").astype(np.int64)
        total, known = np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
        for m, sets, codes in _together(rule, b, of(pdf)):
            for out, part in zip((total, known), replay(m, codes, states[sets])):
                out += part
        pdf["_sum"], pdf["_sets"] = total, known
        return pdf[[*keys, "bar_ts", "_sum", "_sets"]]

    where = [*ids, T.StructField("_stretch", T.IntegerType()), T.StructField("_batch", T.IntegerType())]
    time = base.schema["bar_ts"].dataType
    maps = base.groupBy(*group).applyInPandas(reduce, T.StructType([*where, T.StructField("first", time), T.StructField("last", time), T.StructField("maps", T.BinaryType())]))
    entries = maps.groupBy(*keys, "_batch").applyInPandas(scan, T.StructType([*where, T.StructField("following", time), T.StructField("states", T.BinaryType())]))
    done = base.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(show, T.StructType([*ids, base.schema["bar_ts"], T.StructField("_sum", T.DoubleType()), T.StructField("_sets", T.LongType())]))
    return done if batches == 1 else done.groupBy(*keys, "bar_ts").agg(F.sum("_sum").alias("_sum"), F.sum("_sets").alias("_sets"))
