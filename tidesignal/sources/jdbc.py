"""Status tables in a database: reads with pushed filters, upserts and marks.

Executors write rows to a staging table in parallel; one transaction on the driver's connection then changes the target in standard SQL, so
a lost executor or a repeated task never leaves a half-changed target. Names are quoted
as ANSI identifiers, which some databases must be told to accept in the URL. Staging tables are indexed by their keys, as tables are that
``create`` gets ``keys`` for, so no statement meets all pairs of rows; keys that are strings need a length (``createTableColumnTypes``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(c: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in c.split("."))


def read(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    """A table; filters and columns go to the database. ``options`` may give partitionColumn, bounds and numPartitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=_name(table), **(options or {})).load()


def _write(rows: DataFrame, url: str, table: str, options: dict[str, str]) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=_name(table), isolationLevel="READ_COMMITTED", **options).mode("overwrite").save()


def execute(spark: SparkSession, url: str, statements: list[str], driver: str | None = None) -> list[int]:
    """Runs the statements in one transaction; gives the rows that each changed."""
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    con = jvm.java.sql.DriverManager.getConnection(url)
    try:
        con.setAutoCommit(False)
        st = con.createStatement()
        changed = [st.executeUpdate(s) for s in statements]
        con.commit()
        return changed
    except Exception:
        con.rollback()
        raise
    finally:
        con.close()


def _index(spark: SparkSession, url: str, table: str, keys: list[str], options: dict[str, str]) -> None:
    execute(spark, url, [f"CREATE INDEX {_name(f'k_{uuid.uuid4().hex[:12]}')} ON {_name(table)} ({', '.join(map(_name, keys))})"], options.get("driver"))


def _staged(rows: DataFrame, url: str, table: str, keys: list[str], options: dict[str, str], statements) -> int:
    """Writes ``rows`` to a staging table, runs the statements and drops it; after a failure it is left to look at."""
    stage = f"{table}_stage_{uuid.uuid4().hex[:12]}"
    _write(rows, url, stage, options)
    _index(rows.sparkSession, url, stage, keys, options)
    return execute(rows.sparkSession, url, [*statements(_name(table), _name(stage)), f"DROP TABLE {_name(stage)}"], options.get("driver"))[-2]


def create(rows: DataFrame, url: str, table: str, options: dict[str, str] | None = None, keys: list[str] | None = None) -> None:
    """An empty table with the columns of ``rows``, or the table emptied; with ``keys``, indexed by them."""
    _write(rows.limit(0), url, table, options or {})
    if keys:
        _index(rows.sparkSession, url, table, keys, options or {})


def upsert(rows: DataFrame, url: str, table: str, keys: list[str], options: dict[str, str] | None = None) -> int:
    """Rows replace those of the same keys, the others are added; gives the rows written.

    ``rows`` must have one row a key without null keys (``files.last_write`` sees to the first); equal rows written twice count once.
    """
    cols = ", ".join(map(_name, rows.columns))
    match = " AND ".join(f"s.{_name(k)} = {_name(table)}.{_name(k)}" for k in keys)
    return _staged(rows, url, table, keys, options or {}, lambda t, s: [f"DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {s} s WHERE {match})", f"INSERT INTO {t} ({cols}) SELECT DISTINCT {cols} FROM {s}"])


def mark(ids: DataFrame, url: str, table: str, column: str, value: int = 1, key: str = "id", options: dict[str, str] | None = None) -> int:
    """Sets ``column`` where the key is among ``ids``; gives the rows that were set."""
    return _staged(ids.select(key), url, table, [key], options or {}, lambda t, s: [f"UPDATE {t} SET {_name(column)} = {int(value)} WHERE {_name(key)} IN (SELECT {_name(key)} FROM {s})"])


def _count(spark: SparkSession, url: str, sql: str, options: dict[str, str]) -> int:
    return spark.read.format("jdbc").options(url=url, query=sql, **{k: v for k, v in options.items() if k == "driver"}).load().first()[0]


def create_ledger(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> None:
    """The table ``<table>_batches`` of batches that a stream has written to ``table``; its key keeps a batch from being entered twice."""
    execute(spark, url, [f'CREATE TABLE {_name(table + "_batches")} ("stream" VARCHAR(128) NOT NULL, "batch" BIGINT NOT NULL, PRIMARY KEY ("stream", "batch"))'], (options or {}).get("driver"))


def upsert_batch(batch: DataFrame, number: int, url: str, table: str, keys: list[str], order: str, stream: str, options: dict[str, str] | None = None) -> bool:
    """One batch of a stream into ``table``: of the rows of a key the last by ``order``, where the table has no later one.

    The batch's number goes into the ledger in the same transaction as its rows, so a batch that is run again, after a failure
    between that transaction and the stream's own commit, changes nothing. Gives False for such a batch. ``order`` is never null.
    """
    options, spark, ledger = options or {}, batch.sparkSession, f"{table}_batches"
    who = stream.replace("'", "''")
    if _count(spark, url, f"""SELECT count(*) AS n FROM {_name(ledger)} WHERE "stream" = '{who}' AND "batch" = {int(number)}""", options):
        return False
    rest = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*(F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in batch.columns))
    cols = ", ".join(map(_name, batch.columns))
    same = lambda t, s: " AND ".join(f"{s}.{_name(k)} = {t}.{_name(k)}" for k in keys)
    _staged(last, url, table, keys, options, lambda t, s: [
        f"DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {s} s WHERE {same(t, 's')} AND s.{_name(order)} >= {t}.{_name(order)})",
        f"INSERT INTO {_name(ledger)} VALUES ('{who}', {int(number)})",
        f"INSERT INTO {t} ({cols}) SELECT {cols} FROM {s} s WHERE NOT EXISTS (SELECT 1 FROM {t} t WHERE {same('t', 's')})",
    ])
    return True


def upsert_stream(rows: DataFrame, url: str, table: str, keys: list[str], order: str, stream: str, checkpoint: str, options: dict[str, str] | None = None):
    """A running query that writes every batch of the streaming ``rows`` by ``upsert_batch``; ``create`` and ``create_ledger`` come first."""
    write = lambda batch, number: upsert_batch(batch, number, url, table, keys, order, stream, options)
    return rows.writeStream.foreachBatch(lambda b, n: write(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
