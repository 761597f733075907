"""Hard negatives of anchors, by exact search in the inverted lists of a k-means clustering.

Vectors become whole numbers, so that inner products are exact. Centroids are trained on ``SAMPLE`` vectors (taken by hash, the only
sample); every vector goes to the list of its nearest centroid, and the largest distance in a list is stored as its radius. By
Cauchy-Schwarz no member of a list scores above a.c + |a| r, or below a.c - |a| r, with the anchor a.

A search takes queries (an anchor, a label to meet or to avoid, a window of scores, k) to the lists. A task holds the lists of one bin
(``BIN_BYTES``; a list beyond that is split over bins by hash) and a block of up to ``ANCHORS`` anchors; anchors near the same centroid
are searched together. They visit lists by descending upper bound; a list whose bounds lie outside a query's window is skipped, and a
query is done once the bound falls strictly below its k-th score, or its window. Equal scores can still win by a smaller id, so an
equal bound is visited. First come the positives, from the anchor's own bins and then, with the k-th score so far as their window,
from all others that can still hold one; each positive's score opens the window of its negatives.

What is broadcast: at most ``LISTS`` centroids, their radii and bins. Work grows as anchors times vectors at worst, in blocks; no pair is
ever a row.

Edge cases: rows with a null id, label or vector or any null or non-finite component take no part; vectors of different lengths meet on
their common part; an empty vector scores 0 with all; rows that repeat an id are rows of their own, but never meet their own id; equal
anchor rows are searched once; an anchor without positives, or a positive without negatives, has no rows; extra columns are ignored;
an empty table gives no rows. Components are exact while inner products stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE, LISTS, ROUNDS = 8192, 4096, 8
#: Bytes of vectors in a bin, and anchors in a block.
BIN_BYTES, ANCHORS = 16 << 20, 16384
#: Anchors that walk the lists together.
GROUP = 64
NONE = np.iinfo(np.int64).max


def whole_vectors(df: DataFrame, key: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """``id, label, v``: components as floor(scale * x); rows with anything null or not finite are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where("label is not null")


def dense(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an array column as a matrix; short rows end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(lists.value_lengths()).astype(np.int64)
    width = int(ends.max(initial=0)) if width is None else width
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out, at = np.zeros((len(ends), width)), np.concatenate(([0], np.cumsum(ends)))
    for k, n in enumerate(ends.tolist()):
        out[k, : min(n, width)] = flat[at[k] : at[k] + min(n, width)]
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the distance to it."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    half = (c * c).sum(1) / 2
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024]
        near[a : a + 1024] = (part @ c.T - half).argmax(1)
        far[a : a + 1024] = np.sqrt(((part - c[near[a : a + 1024]]) ** 2).sum(1))
    return near, far


def kmeans(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from rows spread over the sample; an empty list keeps its centroid."""
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(0).permutation(len(x))]
    c = x[:lists].copy()
    for _ in range(rounds):
        near, _ = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Lists:
    """Centroids with their radii; list j lies in bins first[j] to first[j] + parts[j] - 1."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray, anchor_blocks: int):
        self.centroids, self.radius, self.first, self.parts, self.anchor_blocks = centroids, radius, first, parts, anchor_blocks
        self.bins = int((first + parts).max(initial=0))

    def bounds(self, anchors: np.ndarray, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bound of the scores of each anchor with the members of each list; wide enough for rounding."""
        middle = anchors @ self.centroids[which].T
        reach = np.sqrt((anchors * anchors).sum(1))[:, None] * self.radius[which][None, :]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle + reach + slack, middle - reach - slack


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, label, v, list, far``: each vector's list and its distance to the centroid. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = _nearest(dense(b.column(2), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["id", "label", "v", "list", "far"])

    return vectors.mapInArrow(run, "id long, label long, v array<double>, list int, far double")


def build(vectors: DataFrame, scratch: Scratch, anchor_blocks: int) -> tuple[Lists, DataFrame]:
    """Inverted lists of all vectors, in the shared folder."""
    size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    n, width = size[0], max(size[1] or 0, 1)
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow()  # at most SAMPLE rows
    x = dense(sample.column("v"), width)
    centroids = kmeans(x, max(1, min(LISTS, round(n**0.5)))) if len(x) else np.zeros((1, width))
    placed = scratch.write("lists", assign(vectors, centroids))
    count, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():  # at most LISTS rows
        count[r["list"]], radius[r["list"]] = r["n"], r["r"]
    room = max(1, BIN_BYTES // (8 * width))
    first, parts, at, used = np.zeros(len(count), np.int32), np.ones(len(count), np.int32), 0, 0
    for j, k in enumerate(count.tolist()):
        if used and used + k > room:
            at, used = at + 1, 0
        first[j], parts[j] = at, max(1, -(-k // room))
        at, used = (at + int(parts[j]) - 1, used + k) if parts[j] == 1 else (at + int(parts[j]), 0)
    return Lists(centroids, radius, first, parts, anchor_blocks), placed


class _Best:
    """The k best of each query so far: scores descending, equal ones by ascending id."""

    def __init__(self, queries: int, k: int):
        self.score, self.id, self.k = np.full((queries, k), -np.inf), np.full((queries, k), NONE), k

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, a query, a score and an id each."""
        hit = np.unique(q)
        q = np.concatenate((q, np.repeat(hit, self.k)))
        score, ids = np.concatenate((score, self.score[hit].ravel())), np.concatenate((ids, self.id[hit].ravel()))
        by = np.lexsort((ids, -score, q))
        q, score, ids = q[by], score[by], ids[by]
        start = np.searchsorted(q, hit)
        at = start[:, None] + np.arange(self.k)
        self.score[hit], self.id[hit] = score[at], ids[at]


def walk(lists: Lists, members: dict[int, tuple], anchors: np.ndarray, own: np.ndarray, of: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, visits: list | None = None) -> _Best:
    """The k best rows of each query among ``members`` (list -> vectors, ids, labels) with scores from ``low`` to ``high``.

    Query i belongs to anchor ``of[i]`` and wants rows of the anchor's ``label`` (``same``; never its ``own`` id) or of any other.
    """
    best, names = _Best(len(of), k), np.array(sorted(members), np.int64)
    up, down = lists.bounds(anchors, names)
    order = np.argsort(-up.max(0), kind="stable")
    up, down, names = up[:, order], down[:, order], names[order]
    rest = np.maximum.accumulate(up[:, ::-1], 1)[:, ::-1]  # highest bound of the lists from here on
    for j, name in enumerate(names.tolist()):
        least = np.maximum(low, best.score[:, -1])
        if not (rest[of, j] >= least).any():
            break
        live = np.flatnonzero((up[of, j] >= least) & (down[of, j] <= high))
        if not len(live):
            continue
        if visits is not None:
            visits.append((name, len(live)))
        x, ids, labels = members[name]
        rows, at = np.unique(of[live], return_inverse=True)
        floor, ceiling = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
        np.minimum.at(floor, at, least[live])
        np.maximum.at(ceiling, at, high[live])
        s = anchors[rows] @ x.T
        fits = (s >= floor[:, None]) & (s <= ceiling[:, None]) & ((labels == label[rows, None]) == same)
        if same:
            fits &= ids != own[rows, None]
        i, m = np.nonzero(fits)
        if not len(i):
            continue
        got, start = s[i, m], np.searchsorted(i, np.arange(len(rows) + 1))
        n = start[at + 1] - start[at]  # candidates of each live query
        take = np.repeat(start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        q = np.repeat(live, n)
        right = (got[take] >= least[q]) & (got[take] <= high[q])
        if right.any():
            take, q = take[right], q[right]
            best.add(q, got[take], ids[m[take]])
    return best


def _route(lists: Lists, queries: DataFrame, home: bool) -> DataFrame:
    """``queries`` (anchor, block, id, label, v, lows, highs), once for each bin whose lists may hold a result: those of the list with
    the anchor's highest bound (``home``), or all others. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                up, down = lists.bounds(dense(b.column(4), lists.centroids.shape[1]))
                of = np.repeat(np.arange(b.num_rows), np.asarray(b.column(5).value_lengths()))
                low, high = (b.column(c).flatten().to_numpy(zero_copy_only=False)[:, None] for c in (5, 6))
                first = np.arange(up.shape[1]) == up.argmax(1)[:, None]
                reached = [np.zeros((b.num_rows, lists.bins), bool) for _ in range(2)]
                for hit, (i, j) in zip(reached, (np.nonzero(first), np.nonzero((up[of] >= low) & (down[of] <= high)))):
                    i = i if hit is reached[0] else of[i]
                    for p in range(int(lists.parts[j].max(initial=0))):
                        has = lists.parts[j] > p
                        hit[i[has], lists.first[j[has]] + p] = True
                i, bins = np.nonzero(reached[0] if home else reached[1] & ~reached[0])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in b.columns), pa.array(bins.astype(np.int32))], [*b.schema.names, "bin"])

    return queries.mapInArrow(run, f"{_QUERY}, bin int")


_QUERY = "anchor long, block int, id long, label long, v array<double>, lows array<double>, highs array<double>"


def search(lists: Lists, placed: DataFrame, queries: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
    """``anchor, slot, id, score``: up to k rows of each bin for each query; ``slot`` is the window's place in ``lows`` and ``highs``."""
    spark = placed.sparkSession
    bins = spark.createDataFrame([(j, int(f), int(p)) for j, (f, p) in enumerate(zip(lists.first, lists.parts))], "list int, first int, parts int")  # at most LISTS rows
    spread = placed.join(F.broadcast(bins), "list").select(
        (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(lists.anchor_blocks - 1))).alias("block"), "id", "label", "v", "list"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            width = lists.centroids.shape[1]
            left = left.sort_by([("list", "ascending"), ("id", "ascending")])
            x, ids, labels, of = dense(left["v"], width), *(left[c].to_numpy() for c in ("id", "label", "list"))
            cuts = np.flatnonzero(np.diff(of, prepend=of[0] - 1)).tolist() + [len(of)]
            members = {int(of[a]): (x[a:b], ids[a:b], labels[a:b]) for a, b in zip(cuts, cuts[1:])}
            anchors = dense(right["v"], width)
            near = np.argsort(_nearest(anchors, lists.centroids)[0], kind="stable")
            numbers, own, label = (right[c].to_numpy() for c in ("anchor", "id", "label"))
            lows, highs = right["lows"].combine_chunks(), right["highs"].combine_chunks()
            size = np.asarray(lows.value_lengths()).astype(np.int64)
            start, lows, highs = np.concatenate(([0], np.cumsum(size))), lows.flatten().to_numpy(), highs.flatten().to_numpy()
            for a in range(0, len(near), GROUP):
                g = near[a : a + GROUP]
                q = np.concatenate([np.arange(start[r], start[r + 1]) for r in g])
                who = np.repeat(np.arange(len(g)), size[g])
                best = walk(lists, members, anchors[g], own[g], who, label[g], same, lows[q], highs[q], k)
                i, j = np.nonzero(best.id != NONE)
                for part, col in zip(out, (numbers[g[who[i]]], q[i] - start[g[who[i]]], best.id[i, j], best.score[i, j].astype(np.int64))):
                    part.append(col)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])], ["anchor", "slot", "id", "score"])

    routed = _route(lists, queries, home)
    return spread.groupBy("bin", "block").cogroup(routed.groupBy("bin", "block")).applyInArrow(run, "anchor long, slot int, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")).cast("int")
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(df: DataFrame, label: Column, anchor: Column, key: str = "vec_id", vector: str = "embedding", k_positives: int = 5, k: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows where ``anchor`` (over ``id``) holds. For each of an anchor's first ``k_positives`` rows of its label, the first
    ``k`` rows of other labels that score at most like the positive and at least ``least / of`` of it.
    """
    scratch = Scratch(df.sparkSession, "negatives")
    vectors = whole_vectors(df, key, vector, label)
    anchors = scratch.write("anchors", vectors.where(anchor).dropDuplicates(["id", "label", "v"]).withColumn("anchor", F.monotonically_increasing_id()))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    lists, placed = build(vectors, scratch, blocks)
    base = anchors.select("anchor", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "v")
    window = lambda low, high: (F.array(low).alias("lows"), F.array(high).alias("highs"))
    inf = F.lit(float("inf"))
    near = scratch.write("near", search(lists, placed, base.select("*", *window(-inf, inf)), True, True, k_positives))
    kth = _top(near, k_positives).where(F.col("rank") == k_positives).select("anchor", F.col("score").cast("double").alias("kth"))
    far = search(lists, placed, base.join(kth, "anchor", "left").select(*base.columns, *window(F.coalesce("kth", -inf), inf)), False, True, k_positives)
    positives = scratch.write("positives", _top(near.unionByName(far), k_positives).where(F.col("score") >= 0))  # no window opens below 0
    mine_ = positives.withColumn("slot", F.col("rank") - 1).select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    low = lambda s: F.ceil(F.lit(least) * s / F.lit(of) - 1e-6).cast("double")  # noqa: E731  checked again below, in whole numbers
    windows = mine_.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))  # at most k_positives an anchor
    queries = base.join(windows, "anchor").select(*base.columns, F.transform("p", lambda e: low(e["positive_score"])).alias("lows"), F.transform("p", lambda e: e["positive_score"].cast("double")).alias("highs"))
    found = scratch.write("home", search(lists, placed, queries, True, False, k)).unionByName(search(lists, placed, queries, False, False, k))
    fits = found.join(mine_, ["anchor", "slot"]).where(F.lit(least) * F.col("positive_score") <= F.lit(of) * F.col("score"))
    return _top(fits, k).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
