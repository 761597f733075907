"""Status tables in a shared folder, and what the sinks use without a named database."""

import pytest

import oracle
from tidesignal import plans, registry  # noqa: F401
from tidesignal.sources import files, jdbc, tables


@pytest.mark.parametrize("query", ["snk_jdbc", "snk_stream_upsert"])
@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1024]"])
def test_sinks_of_a_cluster_without_a_database(spark, small, monkeypatch, query, master):
    monkeypatch.setattr(spark.sparkContext, "master", master)
    for name in ("create", "upsert", "mark", "upsert_stream"):  # a database in the driver is out of the executors' reach
        monkeypatch.setattr(jdbc, name, None)
    oracle.assert_same(registry.queries()[query](spark, small).toPandas(), oracle.connect(small).execute(registry.oracle_sql()[query]).df())


def test_tables_in_a_folder(spark, tmp_path):
    at, df = str(tmp_path), lambda rows: spark.createDataFrame(rows, "id long, level string, alerted int")
    rows = lambda: sorted(map(tuple, tables.read(spark, at, "messages").collect()), key=str)
    with pytest.raises(FileNotFoundError):
        tables.mark(df([(1, "", 0)]), at, "messages", "alerted")
    tables.create(df([(7, "info", 0)]), at, "messages")
    assert rows() == []
    tables.upsert(df([(1, "info", 0), (2, "warn", 0)]), at, "messages", ["id"])
    again = df([(2, "error", 0), (3, "info", None)])
    tables.upsert(again.unionByName(again), at, "messages", ["id"])
    tables.mark(df([(1, "", 0), (1, "", 0), (9, "", 0)]), at, "messages", "alerted")
    want = [(1, "info", 1), (2, "error", 0), (3, "info", None)]
    assert rows() == want
    df([(5, "half", 0)]).write.parquet(f"{at}/messages/5/rows")  # a writer that ended before its mark
    files.write_text(spark, f"{at}/messages/5/done.part", "")
    assert rows() == want
    tables.upsert(df([(4, "late", 0)]), at, "messages", ["id"])
    assert rows() == [*want, (4, "late", 0)] and sorted(p.name for p in (tmp_path / "messages").iterdir()) == ["4", "5"]


def test_staging_tables_are_indexed(spark, monkeypatch):
    url, seen, execute = "jdbc:derby:memory:tests;create=true", [], jdbc.execute
    monkeypatch.setattr(jdbc, "execute", lambda spark, url, statements, driver=None: seen.extend(statements) or execute(spark, url, statements, driver))
    rows = spark.range(30_000).selectExpr("id", "0 AS v")
    jdbc.create(rows, url, "many", keys=["id"])
    for _ in range(2):
        assert jdbc.upsert(rows, url, "many", ["id"]) == 30_000
    assert jdbc.mark(rows, url, "many", "v") == 30_000
    made = [s for s in seen if s.startswith("CREATE INDEX")]
    assert len(made) == 4 and all(s.endswith('("id")') for s in made) and sum("_stage_" in s for s in made) == 3


def test_a_batch_run_again_leaves_a_folder_table_as_it_is(spark, tmp_path):
    at, df = str(tmp_path), lambda rows: spark.createDataFrame(rows, "id long, t long, v string")
    rows = lambda: sorted(map(tuple, tables.read(spark, at, "latest").collect()), key=str)
    put = lambda new, n, stream="a": tables.upsert_batch(df(new), n, at, "latest", ["id"], "t", stream)
    tables.create(df([(1, 1, "")]), at, "latest")
    assert put([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (None, 3, "x")], 0)
    assert put([(1, 6, "late"), (2, 2, "d"), (3, 1, "e"), (None, 4, "y")], 1)
    want = [(1, 7, "b"), (2, 2, "d"), (3, 1, "e"), (None, 4, "y")]
    assert rows() == want
    assert not put([(4, 9, "again")], 1) and not put([(4, 9, "again")], 0) and rows() == want
    assert put([(4, 1, "f")], 0, "another") and put([], 2) and rows() == [*want[:3], (4, 1, "f"), want[3]]
    df([(5, 1, "half")]).write.parquet(f"{at}/latest/6/rows")  # the batch's rows are there and its mark isn't
    assert put([(5, 1, "g")], 3) and (5, 1, "g") in rows()


def test_the_stream_has_four_batches_however_many_files(spark, small, monkeypatch):
    seen, put = [], tables.upsert_batch
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,1024]")
    monkeypatch.setattr(tables, "upsert_batch", lambda batch, number, *rest: seen.append((number, done := put(batch, number, *rest))) or done)
    spark.conf.set("spark.sql.shuffle.partitions", "22")
    try:
        registry.queries()["snk_stream_upsert"](spark, small)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen == [(n, True) for n in range(4)] + [(n, False) for n in range(4)]
