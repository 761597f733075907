"""As-of joins by spans of time against a plain search."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from tidesignal.operators import align

START = datetime.datetime(2024, 1, 1)
SCHEMA = "symbol string, at timestamp_ntz, v double"


def plain(at, series, ahead, strict):
    if at is None:
        return None
    able = [(t, v) for t, v in series if t is not None and v is not None and ((t > at) if ahead else (t < at)) | ((t == at) and not strict)]
    if not able:
        return None
    return min(able)[1] if ahead else max(able)[1]


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("span", ["day", "month"])
def test_asof_equals_a_plain_search(spark, ahead, strict, span):
    r = random.Random(f"{ahead}{strict}{span}")
    when = lambda: None if r.random() < 0.03 else START + datetime.timedelta(hours=r.randrange(0, 2400, 6))
    name = lambda: r.choice(["a", "a", "a", "b", None])
    left = [(k, name(), when()) for k in range(300)]
    right = [(name(), when(), None if r.random() < 0.2 else float(r.randrange(9))) for _ in range(120)]
    got = align.asof(spark.createDataFrame(left, "k long, symbol string, at timestamp_ntz"), spark.createDataFrame(right, SCHEMA), ["symbol"], "at", "v", span=span, ahead=ahead, strict=strict)
    assert got.columns == ["k", "symbol", "at", "v"]
    want = [(k, s, t, plain(t, [(u, v) for x, u, v in right if x == s], ahead, strict)) for k, s, t in left]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == want


def test_one_series_is_many_tasks(spark):
    bars = spark.range(20_000).select(F.lit("a").alias("symbol"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id)").alias("at"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = align.asof(bars.drop("v"), bars.where("v % 1000 = 0"), ["symbol"], "at", "v").withColumn("task", F.spark_partition_id())
        most, tasks = got.groupBy("task").count().agg(F.max("count"), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 4 and most < 10_000
    assert got.where("v != floor(datediff(at, timestamp_ntz'2024-01-01') * 24 + hour(at)) - (datediff(at, timestamp_ntz'2024-01-01') * 24 + hour(at)) % 1000").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("a", START, 1.0)], SCHEMA)
    assert align.asof(some.drop("v"), none, ["symbol"], "at", "v").collect() == [("a", START, None)]
    assert align.asof(none.drop("v"), some, ["symbol"], "at", "v").count() == 0
