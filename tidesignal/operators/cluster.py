"""Correlation of factors by blocks, greedy dedup, hierarchical clustering, for any number of factors.

Daily values become dense blocks of factors by days, over a calendar on which missing days count as 0, each factor centred by its
mean. Two blocks meet in one task as a matrix product, so neither a join on the day nor a row for a pair that nobody asked for
is made: a limit, or a part that both factors must belong to, is applied inside the product. Single linkage and the greedy pass run as
rounds of joins over the pairs within the limit. Average linkage merges reciprocal nearest neighbours: all pairs of clusters that are each
other's nearest at once, round by round. Since a merged cluster is never nearer to a third one than the nearer of its halves was,
that gives the merges of the sequential algorithm up to the limit, and only pairs inside a component of near pairs can ever matter.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Factors in a block at most, days in a piece of it, and bytes of a block over all days.
BLOCK, DAYS, BLOCK_BYTES = 512, 1024, 32 << 20


def calendar(df: DataFrame, on: str = "day") -> tuple:
    """First day and number of days up to the last one, both included."""
    first, last = df.agg(F.min(on), F.max(on)).first()
    return (first, (last - first).days + 1) if first else (None, 1)


def _numbered(names: DataFrame, key: str) -> DataFrame:
    """``k, part, at``: the names in order from 0. One row a factor."""
    part = F.col("part") if "part" in names.columns else F.lit(None).cast("long")
    return names.select(F.col(key).alias("k"), part.alias("part")).withColumn("at", F.row_number().over(Window.orderBy("k")) - 1)


def correlations(df: DataFrame, names: DataFrame, days: tuple, key: str = "factor", on: str = "day", value: str = "v", keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``a, b, corr`` of the pairs a < b of ``names`` over the calendar ``days``, where a missing day counts as 0.

    ``keep``: which correlations to return, as a mask of an array (no correlation counts as 0 there). A column ``part`` of ``names``:
    only pairs of one part, none for null. Series without spread have no correlation. Rows of one day add up.
    """
    first, length = days
    size = max(16, min(BLOCK, BLOCK_BYTES // (8 * length)))
    pieces = -(-length // DAYS)
    parts = "part" in names.columns
    cells = df.where(F.col(on).isNotNull()).select(F.col(key).alias("k"), F.datediff(F.col(on), F.lit(first)).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    cells = cells.where(F.col("t").between(0, length - 1))
    known = _numbered(names, key).join(cells.groupBy("k").agg((F.sum("v") / length).alias("m")), "k", "left").na.fill(0.0, ["m"])
    block, row, piece = (F.col("at") / size).cast("int").alias("block"), (F.col("at") % size).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    frame = known.select(block, piece, row, F.lit(-1).alias("col"), F.col("m").alias("v"), "k", "part")  # one row a factor and piece
    null = lambda c: F.lit(None).cast(known.schema[c].dataType).alias(c)
    filled = cells.join(known.select("k", "at"), "k").select(block, (F.col("t") / DAYS).cast("int").alias("piece"), row, (F.col("t") % DAYS).cast("int").alias("col"), "v", null("k"), null("part"))
    kinds = [known.schema["k"].dataType, known.schema["part"].dataType]
    dense = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("ks", T.ArrayType(kinds[0])), T.StructField("parts", T.ArrayType(kinds[1]))])

    def fill(t: pa.Table) -> pa.Table:
        r, c, v = (t[n].to_numpy() for n in ("row", "col", "v"))
        piece, edge = t["piece"][0].as_py(), c < 0
        n = int(edge.sum())
        m = np.zeros(n)
        m[r[edge]] = v[edge]
        x = np.repeat(-m[:, None], min(DAYS, length - piece * DAYS), axis=1)
        np.add.at(x, (r[~edge], c[~edge]), v[~edge])
        by = t.filter(pa.array(edge)).sort_by("row")
        lists = [pa.array([by[n].to_pylist() if piece == 0 else None], f.type) for n, f in (("v", t.schema.field("v")), ("k", t.schema.field("k")), ("part", t.schema.field("part"))) for f in [pa.field("l", pa.list_(f.type))]]
        return pa.table([t["block"].slice(0, 1), t["piece"].slice(0, 1), pa.array([x.tobytes()], pa.binary()), *lists], names=dense.names)

    blocks = frame.unionByName(filled).groupBy("block", "piece").applyInArrow(fill, dense)
    count = F.broadcast(known.agg(F.floor((F.count("*") - 1) / size).cast("int").alias("last")))  # one row
    left = blocks.crossJoin(count).select(F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), "piece", "x", "m", "ks", "parts")
    right = blocks.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), "piece", "x", "m", "ks", "parts")
    right = right.toDF(*(f"{c}_" for c in right.columns))  # columns of its own, for the cogroup of one table with itself
    schema = T.StructType([T.StructField("a", kinds[0]), T.StructField("b", kinds[0]), T.StructField("corr", T.DoubleType())])

    def product(one: pa.Table, two: pa.Table) -> pa.Table:
        sides = []
        for t in (one, two.rename_columns(one.column_names)):
            t = t.sort_by("piece")
            m = np.array(t["m"][0].as_py())
            sides.append(([np.frombuffer(b.as_buffer(), np.float64).reshape(len(m), -1) for b in t["x"]], m, t["ks"][0].values, t["parts"][0].as_py()))
        (x, mx, kx, px), (y, my, ky, py) = sides
        c = sum(u @ w.T for u, w in zip(x, y))
        vx, vy = (sum((u * u).sum(1) for u in z) for z in (x, y))
        fine = [v > 1e-12 * (v + length * m * m) for v, m in ((vx, mx), (vy, my))]
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.where(fine[0][:, None] & fine[1][None, :], c / np.sqrt(vx[:, None] * vy[None, :]), np.nan)
        wanted = np.ones(c.shape, bool) if keep is None else keep(np.nan_to_num(c))
        if one["i"][0] == one["j"][0]:
            wanted = np.triu(wanted, 1)
        if parts:
            number = {p: n for n, p in enumerate({*px, *py} - {None})}
            u, w = (np.array([number.get(p, lone) for p in q]) for q, lone in ((px, -1), (py, -2)))
            wanted &= u[:, None] == w[None, :]
        i, j = np.nonzero(wanted)
        return pa.table([kx.take(pa.array(i)), ky.take(pa.array(j)), pa.array(c[i, j], from_pandas=True)], names=schema.names)

    return left.groupBy("i", "j").cogroup(right.groupBy("i_", "j_")).applyInArrow(product, schema)


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one takes a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the shared folder; computed once, where ``checkpoint()`` computes its input twice."""
    path = f"{_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy_dedup(pairs: DataFrame, ranked: DataFrame, limit: float) -> DataFrame:
    """Rows of ``ranked`` (``factor, rank``; ranks are unique) that are kept: in order of rank, unless a kept one correlates beyond ``limit``.

    Done in rounds over the pairs beyond the limit: a factor all of whose better-ranked rivals are out is kept, and its rivals go out. Each
    round decides at least the best undecided factor; the rounds are as many as the longest chain of such decisions, not as the factors.
    """
    far = pairs.where(F.abs("corr") > limit).select("a", "b")
    ranked = written(ranked.select("factor", "rank"))
    ra, rb = (ranked.select(F.col("factor").alias(c), F.col("rank").alias(f"r{c}")) for c in "ab")
    both = far.join(ra, "a").join(rb, "b")
    first = F.col("ra") < F.col("rb")
    edges = written(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")))
    open_, kept = ranked, ranked.limit(0)
    while True:
        live = edges.join(open_.select(F.col("factor").alias("better")), "better", "left_semi").join(open_.select(F.col("factor").alias("worse")), "worse", "left_semi")
        chosen = open_.join(live.select(F.col("worse").alias("factor")), "factor", "left_anti")
        beaten = edges.join(chosen.select(F.col("factor").alias("better")), "better", "left_semi").select(F.col("worse").alias("factor"))
        step = written(open_.join(chosen.select("factor", F.lit(True).alias("_in")), "factor", "left").join(beaten.distinct().withColumn("_out", F.lit(True)), "factor", "left"))
        kept = kept.unionByName(step.where("_in").select("factor", "rank"))
        open_ = step.where("_in is null and _out is null").select("factor", "rank")
        if open_.isEmpty():
            return kept


def single_linkage(pairs: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """``factor, group``: single linkage of 1 - |corr| cut at ``limit``, for any number of factors; a group is named by its first factor.

    Groups are the components of the pairs within the limit: each factor takes the least label among its neighbours, then the label of
    its label, until none changes; the second step lets labels leap along chains.
    """
    near = pairs.where(1 - F.abs(F.coalesce("corr", F.lit(0.0))) <= limit).select("a", "b")
    edges = written(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = names.select("factor", F.col("factor").alias("group"))
    while True:
        least = edges.join(labels.select(F.col("factor").alias("b"), "group"), "b").groupBy(F.col("a").alias("factor")).agg(F.min("group").alias("_g"))
        taken = labels.join(least, "factor", "left").select("factor", "group", F.least("group", F.coalesce("_g", "group")).alias("_new"))
        above = taken.select(F.col("factor").alias("_new"), F.col("_new").alias("_top"))
        step = written(taken.join(above, "_new").select("factor", F.col("group").alias("_old"), F.least("_new", "_top").alias("group")))
        labels = step.select("factor", "group")
        if step.where(F.col("_old") != F.col("group")).isEmpty():
            return labels


def average_linkage(pairs: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """``factor, group``: average linkage of 1 - |corr| cut at ``limit``; groups are numbered from 1 by their first factor.

    ``pairs`` has every pair inside a component of near pairs; pairs without a correlation are at distance 1. A round finds each
    cluster's nearest other one (of equally near ones the first), merges all that chose each other within the limit, adds up the distances
    between merged clusters and drops clusters with nothing left within the limit, which no merge can bring back. Rounds are as many as
    the longest chain of dependent merges.
    """
    labels = names.select("factor", F.col("factor").alias("label"))
    links = written(pairs.select("a", "b", (1 - F.abs(F.coalesce("corr", F.lit(0.0)))).alias("s"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    while not links.isEmpty():
        apart = links.withColumn("d", F.col("s") / (F.col("na") * F.col("nb")))
        ends = F.explode(F.array(*(F.struct(F.col(x).alias("c"), F.col(f"n{x}").alias("n"), F.struct("d", F.col(y).alias("to")).alias("near")) for x, y in ("ab", "ba")))).alias("e")
        near = apart.select(ends).groupBy("e.c").agg(F.min("e.near").alias("near"), F.first("e.n").alias("n")).select("c", "n", "near.d", "near.to").where(F.col("d") <= limit)
        back = near.select(F.col("c").alias("to"), F.col("to").alias("choice"), F.col("n").alias("other"))
        mutual = F.col("choice") == F.col("c")
        state = written(near.join(back, "to", "left").select("c", F.when(mutual, F.least("c", "to")).otherwise(F.col("c")).alias("new"), (F.col("n") + F.when(mutual, F.col("other")).otherwise(0)).alias("size")))
        labels = labels.join(state.select(F.col("c").alias("label"), "new"), "label", "left").select("factor", F.coalesce("new", "label").alias("label"))
        one, two = (state.select(F.col("c").alias(x), F.col("new").alias(f"to_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
        turned = F.col("to_a") > F.col("to_b")
        pick = lambda p, x, y: F.when(turned, F.col(f"{p}_{y}")).otherwise(F.col(f"{p}_{x}"))
        moved = links.join(one, "a").join(two, "b").where("to_a <> to_b").select(pick("to", "a", "b").alias("a"), pick("to", "b", "a").alias("b"), "s", pick("size", "a", "b").alias("na"), pick("size", "b", "a").alias("nb"))
        links = written(moved.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    number = labels.select("label").distinct().select("label", F.row_number().over(Window.orderBy("label")).alias("group"))  # one row a group
    return labels.join(number, "label").select("factor", "group")


def groups(df: DataFrame, names: DataFrame | None, limit: float, key: str = "factor", value: str = "v") -> DataFrame:
    """``factor, group`` by average linkage of 1 - |corr| of the daily values, cut at ``limit``; of all factors, unless ``names`` has them."""
    df = written(df.select(key, "day", value))  # read several times
    names = df.select(key).distinct() if names is None else written(names.select(key))
    days = calendar(df)
    near = correlations(df, names, days, key, value=value, keep=lambda c: 1 - np.abs(c) <= limit)
    own = names.select(F.col(key).alias("factor"))
    parts = single_linkage(near, own, limit)
    inside = correlations(df, parts.select(F.col("factor").alias(key), F.col("group").alias("part")), days, key, value=value)
    return average_linkage(inside, own, limit)
