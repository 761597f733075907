"""Status tables in a folder that driver and executors share, with the calls of ``jdbc`` where a cluster names no database.

A version of a table is written whole from the one before, by Spark, and counts once its mark is there. The mark is put last, by a rename,
so a lost executor, a repeated task or a job that ends midway never leaves a half-changed table. It also names the last batch
of each stream. A table has one writer at a time; the version before the last stays for those who read it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def _fs(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _last(spark: SparkSession, at: str, table: str) -> tuple[int, dict[str, int]]:
    """The number of the last version that counts, 0 if there is none, and the last batch of each stream in it."""
    fs, path = _fs(spark, f"{at}/{table}")
    there = sorted((int(s.getPath().getName()) for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
    n = next((n for n in there if fs.exists(_fs(spark, f"{at}/{table}/{n}/done.json")[1])), 0)
    return n, files.load_config(spark, f"{at}/{table}/{n}/done.json") if n else {}


def _put(rows: DataFrame, at: str, table: str, number: int, batches: dict[str, int]) -> None:
    """``rows`` as version ``number``; what a job that ended midway has left under that number is written over."""
    spark, to = rows.sparkSession, f"{at}/{table}/{number}"
    rows.write.mode("overwrite").parquet(f"{to}/rows")
    files.write_text(spark, f"{to}/done.part", json.dumps(batches))
    fs, part = _fs(spark, f"{to}/done.part")
    if not fs.rename(part, _fs(spark, f"{to}/done.json")[1]):
        raise OSError(f"version {number} of {at}/{table} could not be marked")
    fs.delete(_fs(spark, f"{at}/{table}/{number - 2}")[1], True)


def _read(spark: SparkSession, at: str, table: str, number: int) -> DataFrame:
    if not number:
        raise FileNotFoundError(f"no table {at}/{table}")
    return spark.read.parquet(f"{at}/{table}/{number}/rows")


def read(spark: SparkSession, at: str, table: str) -> DataFrame:
    """A table as it is now; filters and columns go to its files."""
    return _read(spark, at, table, _last(spark, at, table)[0])


def create(rows: DataFrame, at: str, table: str, options: dict[str, str] | None = None, keys: list[str] | None = None) -> None:
    """An empty table with the columns of ``rows``, or the table emptied. ``options``, also below, and ``keys`` are for ``jdbc``, without effect."""
    n, batches = _last(rows.sparkSession, at, table)
    _put(rows.limit(0), at, table, n + 1, batches)


def _newest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The greatest row of each key, by ``order``; aggregated before the shuffle, so a key with many rows is no load."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*(F.col(c) if c in keys else F.col("_top")[c].alias(c) for c in columns))


def upsert(rows: DataFrame, at: str, table: str, keys: list[str], options: dict[str, str] | None = None) -> None:
    """Rows replace those of the same keys, the others are added; ``rows`` has one row a key, equal rows count once."""
    n, batches = _last(rows.sparkSession, at, table)
    old = _read(rows.sparkSession, at, table, n)
    both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    _put(_newest(both, keys, ["_new"], old.columns), at, table, n + 1, batches)


def mark(ids: DataFrame, at: str, table: str, column: str, value: int = 1, key: str = "id", options: dict[str, str] | None = None) -> None:
    """Sets ``column`` where the key is among ``ids``."""
    n, batches = _last(ids.sparkSession, at, table)
    old = _read(ids.sparkSession, at, table, n)
    found = old.join(ids.select(key).distinct().withColumn("_found", F.lit(True)), key, "left")
    new = F.when(F.col("_found"), F.lit(value).cast(old.schema[column].dataType)).otherwise(F.col(column)).alias(column)
    _put(found.select(*(new if c == column else c for c in old.columns)), at, table, n + 1, batches)


def create_ledger(spark: SparkSession, at: str, table: str, options: dict[str, str] | None = None) -> None:
    """Nothing: the marks of a table hold its batches."""


def upsert_batch(batch: DataFrame, number: int, at: str, table: str, keys: list[str], order: str, stream: str, options: dict[str, str] | None = None) -> bool:
    """One batch of a stream into ``table``: of the rows of a key, there and in the batch, the last by ``order`` (of equal ones the greatest).

    The mark that makes the rows count has the batch's number, so a batch that is run again changes nothing. Gives False for such a batch.
    Numbers of a stream rise, as Spark gives them.
    """
    spark = batch.sparkSession
    n, batches = _last(spark, at, table)
    if number <= batches.get(stream, -1):
        return False
    old = _read(spark, at, table, n)
    _put(_newest(old.unionByName(batch), keys, [order], old.columns), at, table, n + 1, batches | {stream: number})
    return True


def upsert_stream(rows: DataFrame, at: str, table: str, keys: list[str], order: str, stream: str, checkpoint: str, options: dict[str, str] | None = None):
    """A running query that writes every batch of the streaming ``rows`` by ``upsert_batch``; ``create`` comes first."""
    write = lambda batch, number: upsert_batch(batch, number, at, table, keys, order, stream)
    return rows.writeStream.foreachBatch(lambda b, n: write(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
