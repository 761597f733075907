"""Readers and writers of panels, tables and configurations."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_wide(spark: SparkSession, path: str, index: str, value: str = "value") -> DataFrame:
    """A wide Parquet panel (one column a symbol) as tidy rows; NaN becomes NULL, the file's name the factor."""
    wide = spark.read.parquet(path)
    names = [c for c in wide.columns if c != index]
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1)
    tidy = wide.select(name.alias("factor_id"), index, *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot(["factor_id", index], names, "symbol", value)
    return tidy.withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema."""
    return spark.read.csv(path, schema=schema, header=True)


def read_stat(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Headerless status lines ``Date, Symbol, text, text``: trailing numbers, latest row of each symbol.

    ``source`` names the column of folders ``source=..`` under ``path``: then the latest row of each symbol in each of them.
    """
    part = [source] if source else []
    raw = spark.read.csv(path, schema="day string, symbol string, rate string, missing string" + "".join(f", {c} string" for c in part))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '(-?[0-9]+(?:[.][0-9]+)?) *$', 1) as double)")
    rows = raw.select(*part, F.expr("try_cast(trim(day) as date)").alias("day"), F.trim("symbol").alias("symbol"), number("rate").alias("complete_rate"), number("missing").alias("missing"))
    w = Window.partitionBy(*part, "symbol").orderBy(F.desc("day"), F.desc("missing"), F.desc("complete_rate"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def stat_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Completeness of the latest status lines by ``keys``: how many rates are below 1, their least and mean; how many lines miss something, the most and mean."""
    low, gap = F.col("complete_rate") < 1, F.col("missing") > 0
    rate, missing = F.when(low, F.col("complete_rate")), F.when(gap, F.col("missing"))
    return rows.groupBy(*keys).agg(
        F.count_if(low).alias("trade_incomplete_count"), F.min(rate).alias("trade_min"), F.avg(rate).alias("trade_mean"),
        F.count_if(gap).alias("inc_missing_count"), F.max(missing).alias("inc_max"), F.avg(missing).alias("inc_mean"),
    )


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists of [root_dir, process, factor], one list a line, as distinct rows; lines that are no such list give none."""
    x = F.explode(F.from_json("value", "array<array<string>>")).alias("x")
    rows = spark.read.text(path).select(x).where("size(x) = 3")
    return rows.select(*(F.col("x")[k].alias(c) for k, c in enumerate(("root_dir", "process_name", "factor")))).distinct()


def parse_config(text: str, kind: str) -> dict:
    """TOML, YAML or JSON, told by the file's suffix."""
    if kind == ".toml":
        return tomllib.loads(text)
    if kind in (".yml", ".yaml"):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def read_config(path: str) -> dict:
    """A configuration on the driver's disk."""
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read(), PurePath(path).suffix)


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration in any store that Spark reads."""
    return parse_config(spark.read.text(path, wholetext=True).first()[0], PurePath(path).suffix)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark writes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def flatten(config: dict, name: str = "") -> dict[str, str]:
    """Dotted names of a nested configuration's values, as JSON."""
    out: dict[str, str] = {}
    for k, v in config.items():
        out |= flatten(v, f"{name}{k}.") if isinstance(v, dict) else {f"{name}{k}": json.dumps(v)}
    return out


def list_factors(spark: SparkSession, folder: str, pattern: str = r"(.+)\.parquet") -> list[str]:
    """Names captured by ``pattern`` among the entries of a folder in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(m[1] for n in names if (m := re.fullmatch(pattern, n)))


def leaf_folders(spark: SparkSession, roots: dict[str, dict]) -> list[tuple[str, str | None, str]]:
    """(root, tag, leaf) of each root's folders without folders in them, in any store that Spark reads.

    A root's ``target_leaf`` replaces the listing, ``exclude`` takes leaves out of either; hidden folders (``_``, ``.``) are passed over.
    """
    jvm = spark.sparkContext._jvm

    def leaves(fs, path, at: str) -> list[str]:
        inner = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        inner = [n for n in inner if n[0] not in "_."]
        if not inner:
            return [at or "."]
        return [x for n in inner for x in leaves(fs, jvm.org.apache.hadoop.fs.Path(path, n), f"{at}/{n}" if at else n)]

    out = []
    for root, info in roots.items():
        path = jvm.org.apache.hadoop.fs.Path(root)
        found = info.get("target_leaf") or leaves(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, "")
        out += [(root, info.get("tag_name"), x) for x in found if x not in info.get("exclude", [])]
    return out


def filter_pairs(names: list[str], positive: str = "pos_", negative: str = "neg_") -> list[tuple[str, str, str]]:
    """(suffix, positive name, negative name) of filters that come in pairs."""
    up, down = ({n.removeprefix(p): n for n in names if n.startswith(p)} for p in (positive, negative))
    return [(s, up[s], down[s]) for s in sorted(up.keys() & down.keys())]


def paired_filters(spark: SparkSession, path: str, positive: str = "pos_", negative: str = "neg_", keys: list[str] = ["symbol", "bar_ts"]) -> DataFrame:
    """``suffix, keys, up, down``: filter panels ``filter=<name>/`` under ``path`` whose names come in pairs, side by side.

    The names are told from the folders alone, and only folders of pairs are read (a filter of partitions in the plan). A bar that one
    of the two lacks has a missing value there.
    """
    pairs = filter_pairs(list_factors(spark, path, r"filter=(.+)"), positive, negative)
    rows = spark.read.parquet(path).where(F.col("filter").isin([n for _, up, down in pairs for n in (up, down)]))
    is_up = F.col("filter").startswith(positive)
    suffix = F.when(is_up, F.substr("filter", F.lit(len(positive) + 1))).otherwise(F.substr("filter", F.lit(len(negative) + 1)))
    return rows.groupBy(suffix.alias("suffix"), *keys).agg(F.max(F.when(is_up, F.col("v"))).alias("up"), F.max(F.when(~is_up, F.col("v"))).alias("down"))


def write_panel(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_per_symbol(df: DataFrame, path: str, key: str = "symbol") -> None:
    """One folder of CSV a symbol."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).csv(path, header=True)


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A status table after all its upserts: the latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *(F.desc(c) for c in rows.columns if c not in (*keys, at)))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def mark_alerted(messages: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``alerted`` set for the given ids."""
    done = ids.select(key).distinct().withColumn("_done", F.lit(1))
    return messages.join(done, key, "left").withColumn("alerted", F.coalesce("_done", "alerted")).drop("_done")
