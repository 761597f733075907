"""The reopening trade rule over unbounded input, one typed state a series, taken over from a batch run.

A series' state is its side, whether a value was seen, the time of its last bar and the number of bars that came late. Bars that come
within ``delay`` of the series' newest bar are held back in a list state, so bars out of order by less than that are taken in order; a
timer releases what is held once a series has been idle. A bar not after the last one taken is late: it changes no position, and is
returned as a row of its own with ``late`` set, never dropped. Without a delay nothing is held, and only bars of one micro-batch are put
in order. A series without a state starts flat. Null times are late bars.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, bar_ts timestamp, pos double, late boolean, n_late long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reopening(StatefulProcessor):
    """Sides of one series, bar by bar."""

    def __init__(self, open_at: float, close_at: float, delay: pd.Timedelta, idle_ms: int):
        self.open_at, self.close_at, self.delay, self.idle_ms = open_at, close_at, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "side int, seen boolean, last timestamp, n_late long")
        self.held = handle.getListState("held", "bar_ts timestamp, s double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A row of ``closing_state`` of the batch run."""
        row = initialState.iloc[0]
        self.now.update((int(row["side"]), bool(row["seen"]), row["last"].to_pydatetime(), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        side, seen, last, n_late = self.now.get() if self.now.exists() else (0, False, None, 0)
        came = pd.concat(list(rows))[["bar_ts", "s"]]
        late = came["bar_ts"].isna()
        if last is not None:
            late |= came["bar_ts"] <= pd.Timestamp(last)
        bars = came[~late].sort_values("bar_ts", kind="stable")
        if self.delay:
            before = pd.DataFrame(list(self.held.get()), columns=["bar_ts", "s"]).astype({"bar_ts": bars["bar_ts"].dtype, "s": float})
            bars = pd.concat([before, bars]).sort_values("bar_ts", kind="stable")
        again = bars["bar_ts"].duplicated()
        missed = pd.concat([came[late], bars[again]])
        bars = bars[~again]
        if self.delay:
            wait = bars["bar_ts"] > bars["bar_ts"].max() - self.delay
            self._hold(bars[wait], timerValues)
            bars = bars[~wait]
        yield from self._take(key, bars, missed, (side, seen, last, n_late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle series takes what it holds."""
        bars = pd.DataFrame(list(self.held.get()), columns=["bar_ts", "s"])
        self.held.clear()
        if len(bars):
            yield from self._take(key, bars.sort_values("bar_ts"), bars[:0], self.now.get())

    def _hold(self, bars: pd.DataFrame, timerValues) -> None:
        self.held.put([(t.to_pydatetime(), None if pd.isna(v) else float(v)) for t, v in zip(bars["bar_ts"], bars["s"])]) if len(bars) else self.held.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(bars):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _take(self, key, bars: pd.DataFrame, missed: pd.DataFrame, state: tuple) -> Iterator[pd.DataFrame]:
        side, seen, last, n_late = state
        out = []
        for v in bars["s"]:
            if pd.notna(v):
                seen = True
                if side and side * v < self.close_at:
                    side = 0
                if not side:
                    side = 1 if v > self.open_at else -1 if v < -self.open_at else 0
            out.append(float(side) if seen else None)
        if len(bars):
            last = bars["bar_ts"].iloc[-1].to_pydatetime()
        n_late += len(missed)
        self.now.update((int(side), bool(seen), last, int(n_late)))
        times = [*bars["bar_ts"], *missed["bar_ts"]]
        if times:
            yield pd.DataFrame({"symbol": key[0], "bar_ts": pd.Series(times, dtype="datetime64[us]"), "pos": pd.Series([*out, *[None] * len(missed)], dtype=float), "late": [False] * len(out) + [True] * len(missed), "n_late": n_late})

    def close(self) -> None:
        pass


def closing_state(positions: DataFrame) -> DataFrame:
    """``symbol, side, seen, last`` after the last bar of a batch run of the rule: its position is its side."""
    end = positions.groupBy("symbol").agg(F.max(F.struct("bar_ts", "pos")).alias("x"))
    return end.select("symbol", F.coalesce("x.pos", F.lit(0.0)).cast("int").alias("side"), F.col("x.pos").isNotNull().alias("seen"), F.col("x.bar_ts").cast("timestamp").alias("last"))


def follow(bars: DataFrame, open_at: float, close_at: float, delay: str | None = None, idle: str = "10 minutes", start: DataFrame | None = None) -> DataFrame:
    """``symbol, bar_ts, pos, late, n_late`` for a stream of (symbol, bar_ts timestamp, s); ``start`` has the rows of ``closing_state``.

    The state needs the RocksDB store: start the query inside ``rocks``.
    """
    step = Reopening(open_at, close_at, pd.Timedelta(delay or 0), int(pd.Timedelta(idle).total_seconds() * 1000))
    mode = "processingTime" if delay else "none"
    return bars.groupBy("symbol").transformWithStateInPandas(step, OUT, "append", mode, start.groupBy("symbol") if start is not None else None)


@contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting stands again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def replay(spark, path: str, schema: str, open_at: float, close_at: float, checkpoint: str, out: str, delay: str | None = None, start: DataFrame | None = None, per_batch: int = 1) -> DataFrame:
    """Runs the stream over the files in ``path`` to its end, writing to ``out`` in a shared folder, and returns its rows."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path).select("symbol", "bar_ts", "s")
    with rocks(spark):
        followed = follow(source, open_at, close_at, delay, start=start)
        query = followed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(out)


def write_weeks(bars: DataFrame, path: str) -> None:
    """One file a calendar week, written by one job; the files' times follow the weeks, since a stream reads files by their times."""
    spark = bars.sparkSession
    bars.withColumn("week", F.date_format(F.date_trunc("week", "bar_ts"), "yyyy-MM-dd")).repartition("week").write.partitionBy("week").parquet(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    weeks = sorted((s for s in fs.listStatus(root) if s.isDirectory()), key=lambda s: s.getPath().getName())
    for k, week in enumerate(weeks):
        for f in fs.listStatus(week.getPath()):
            fs.setTimes(f.getPath(), f.getModificationTime() - 2000 * (len(weeks) - k), -1)
