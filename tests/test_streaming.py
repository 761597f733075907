"""The trade rule over a stream."""

import time

import pytest
from pyspark.sql import functions as F

from tidesignal.operators import rules
from tidesignal.streaming import rule

SCHEMA = "symbol string, bar_ts timestamp, s double"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.sql("""SELECT if(id % 3 = 0, 'a', 'b') AS symbol, timestamp'2023-12-18 00:00:00' + make_interval(0, 0, 0, 0, 12 * id) AS bar_ts, if(id % 11 = 0, null, sin(id * 1.7)) AS s FROM range(0, 400)""").coalesce(1)


@pytest.fixture(scope="module")
def batch(bars):
    return rules.reopening(bars, open_at=0.6, close_at=0.2).select("symbol", "bar_ts", "pos")


def key(rows):
    return sorted((r[0], r[1], r[2] is None, r[2] or 0.0) for r in rows)


def put(spark, rows, path):
    """One file."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # file times tell the order


def test_weeks_over_a_year_end_keep_every_bar(spark, tmp_path):
    bars = spark.sql("""SELECT 'a' AS symbol, timestamp'2023-12-18 00:00:00' + make_interval(0, 0, 0, 0, 12 * id) AS bar_ts, sin(id * 1.7) AS s FROM range(0, 800)""").coalesce(1)
    rule.write_weeks(bars, f"{tmp_path}/in")
    got = rule.replay(spark, f"{tmp_path}/in", "symbol string, bar_ts timestamp, s double", 0.6, 0.2, f"{tmp_path}/state", f"{tmp_path}/out", per_batch=8)
    want = rules.reopening(bars, open_at=0.6, close_at=0.2).select("symbol", "bar_ts", "pos")
    assert sorted(got.select("symbol", "bar_ts", "pos").collect()) == sorted(want.collect()) and got.count() == 800
    assert not got.where("late").count()


def test_a_stream_takes_over_from_a_batch_run(spark, tmp_path, bars, batch):
    cut = "bar_ts < timestamp'2024-03-01 06:00:00'"
    known = rules.reopening(bars.where(cut), open_at=0.6, close_at=0.2).select("symbol", "bar_ts", "pos")
    rule.write_weeks(bars.where(f"not ({cut})"), f"{tmp_path}/in")
    got = rule.replay(spark, f"{tmp_path}/in", SCHEMA, 0.6, 0.2, f"{tmp_path}/state", f"{tmp_path}/out", start=rule.closing_state(known), per_batch=4)
    want = batch.where(f"not ({cut})").collect()
    assert key(got.select("symbol", "bar_ts", "pos").collect()) == key(want) and len(want) > 50
    assert rule.PROVIDER not in dict(spark.sparkContext.getConf().getAll()) and "RocksDB" not in spark.conf.get(rule.PROVIDER)


def test_late_and_repeated_bars_are_counted_and_change_nothing(spark, tmp_path, bars, batch):
    rows = [tuple(r) for r in bars.where("symbol = 'a'").orderBy("bar_ts").collect()]
    put(spark, rows[:60] + rows[10:11], f"{tmp_path}/in")  # one bar twice in a batch
    put(spark, rows[60:] + [("a", rows[5][1], 9.0), ("a", None, 1.0)], f"{tmp_path}/in")  # one bar again, too late, and one without a time
    got = rule.replay(spark, f"{tmp_path}/in", SCHEMA, 0.6, 0.2, f"{tmp_path}/state", f"{tmp_path}/out")
    assert key(got.where("not late").select("symbol", "bar_ts", "pos").collect()) == key(batch.where("symbol = 'a'").collect())
    late = got.where("late").collect()
    assert sorted(str(r.bar_ts) for r in late) == sorted(str(t) for t in (rows[10][1], rows[5][1], None)) and all(r.pos is None for r in late)
    assert got.agg(F.max("n_late")).first()[0] == 3


def test_bars_out_of_order_within_the_delay_are_taken_in_order_and_an_idle_series_is_released(spark, tmp_path, bars, batch):
    rows = [tuple(r) for r in bars.where("symbol = 'b'").orderBy("bar_ts").collect()][:80]
    mixed = [rows[k ^ 1] for k in range(80)]  # neighbours change places
    for a in range(0, 80, 27):  # borders fall between such neighbours
        put(spark, mixed[a : a + 27], f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with rule.rocks(spark):
        followed = rule.follow(source, 0.6, 0.2, delay="2 days", idle="2 seconds")
        query = followed.writeStream.format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("followed").count() < 80:
            time.sleep(1)
        got = spark.table("followed").collect()
    finally:
        query.stop()
    times = {r[1] for r in rows}
    want = [r for r in batch.where("symbol = 'b'").collect() if r[1] in times]
    assert key([r[:3] for r in got]) == key(want) and not any(r.late for r in got)
