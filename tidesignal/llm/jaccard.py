"""Exact n-gram Jaccard self join: classes of documents linked by a shingle-set similarity of num/den or more.

Size-banded tiles. A document's band is the logarithm of its set size to the base den/num, so linked documents lie in the same or
in adjacent bands. A tile holds the documents of two adjacent bands that share one shingle of their prefixes: with all shingles in
one global order, two linked sets must share a member among the first ``n - ceil(n*num/den) + 1`` of each, and at the first one they
share enough must be left behind it in both. The order puts frequent shingles last, so common lines and passages stay out of prefixes.

Within a tile every document is first compared with ``LEADERS`` leaders only, those with the fewest shingles of their own. Components of
these links are contracted, and then just the pairs that still lie in different components are compared, so a tile of copies of one
text costs a few comparisons a member. Every pair passes the size and position tests, then a hashed bitmap signature (a bit is the parity of the members that hash to it): the count
of differing bits bounds the overlap from above. Survivors are settled by exact intersection of the sorted shingle arrays. No link
between different sets is lost: a pair is skipped only where a bound excludes it or where both ends are already in one component.

Equal sets are collapsed to one beforehand, by a digest of 128 bits. Vertices are numbers of sets, not doc_ids, so a doc_id with two
texts is two vertices. Texts are shuffled only for sets with a pair that passes its signatures.

Edge cases: null and empty texts have the empty set and link with nothing; repeated rows are returned as often as they come and
share a class; rows of one doc_id with different texts are different documents, each with the class of its own text; rows with a
null doc_id are returned with a null component_id and take no part in links; very long texts are read in windows, whole; extra
columns are ignored; an empty table gives an empty result. Ties can't occur: classes don't depend on the order of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, text_batches
from .components import connected_components
from .shingles import shingle_sets

#: Sets of a tile that all its sets are compared with first.
LEADERS = 4
#: Shingles in the list of frequent ones (1 MB), and how many are counted together to find them.
FREQUENT, COUNTED = 1 << 17, 1 << 20
#: Bits for each id of the filter that keeps texts outside all pairs from being shuffled, and its largest size (16 MB). Beyond that
#: more and more texts pass it; they are dropped at the join.
FILTER_LOAD, FILTER_BITS = 16, (16, 27)
#: 64-bit words of a signature for sets of up to so many shingles.
SIGNATURE_WORDS = ((1_000, 8), (8_000, 64), (math.inf, 512))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def frequent_shingles(docs: DataFrame, text: str, n: int, tables: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """About the ``FREQUENT`` most frequent of the shingles met twice or more among some ``COUNTED``, sorted, with their counts.

    Every document is counted. Each task hands on a bounded list. Counts fall into at most 1,024 classes; from their sizes follows the
    class at which the list is full, of which a share chosen by hash is taken, so the driver gets the list once, however many tasks there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, size = [], 0

        def add() -> None:
            nonlocal keys, totals, held, size
            x = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            times = np.diff(np.append(at, len(x)))
            more = times > 1
            both = np.concatenate([keys, x[at][more]])
            keys, where = np.unique(both, return_inverse=True)
            totals = np.bincount(where, np.concatenate([totals, times[more]]), len(keys)).astype(np.int64)
            if len(keys) > 2 * FREQUENT:
                top = np.sort(np.argpartition(-totals, FREQUENT)[:FREQUENT])
                keys, totals = keys[top], totals[top]
            held, size = [], 0

        for b in batches:
            for s in shingle_sets(b.column(0), n):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    add()
        if size:
            add()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(totals)], ["h", "n"])

    found = docs.select(F.col(text).alias("_t")).mapInArrow(count, "h long, n long")
    counts = tables.write("counts", found.groupBy("h").agg(F.sum("n").alias("n")))
    rank = F.floor(16 * F.log2("n"))
    room, full, share = FREQUENT, -1, 0
    for r in sorted(counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("size")).collect(), reverse=True):
        if r["size"] > room:
            full, share = r["rank"], 1024 * room // r["size"]
            break
        room -= r["size"]
    some = (rank == full) & (F.pmod(F.xxhash64("h"), F.lit(1024)) < share)
    top = counts.where((rank > full) | some).toPandas()
    tables.drop("counts")
    keys, totals = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], totals[order]


def _in_order(s: np.ndarray, k: int, keys: np.ndarray, totals: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The first k of a sorted set in the global order: shingles outside the list by hash, then those of the list by rising count."""
    maybe = np.flatnonzero(some[(s & np.uint64(len(some) - 1)).astype(np.int64)])
    if not len(maybe):
        return s[:k]
    at = np.searchsorted(keys, s[maybe])
    listed = keys[np.minimum(at, len(keys) - 1)] == s[maybe]
    maybe, at = maybe[listed], at[listed]
    rare = np.delete(s, maybe)
    if len(rare) >= k:
        return rare[:k]
    return np.concatenate([rare, s[maybe[np.lexsort((s[maybe], totals[at]))]][: k - len(rare)]])


def _signature(s: np.ndarray) -> np.ndarray:
    bits = 64 * next(w for most, w in SIGNATURE_WORDS if len(s) <= most)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _pairs_array(found: list[tuple[int, int]]) -> list[pa.Array]:
    two = np.array(found, np.int64).reshape(-1, 2)
    return [pa.array(two[:, 0]), pa.array(two[:, 1])]


def describe(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, a 128-bit digest of the set, its prefix and its signature, for every row."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals = held.value
        some = np.zeros(1 << 20, bool)
        some[(keys & np.uint64(len(some) - 1)).astype(np.int64)] = True
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                size, digests, prefix, maps = [], [], [], []
                for s in shingle_sets(b.column(1), n):
                    size.append(len(s))
                    digests.append(_digest(s))
                    prefix.append(_in_order(s, prefix_size(len(s), num, den), keys, totals, some).view(np.int64) if len(s) else np.zeros(0, np.int64))
                    maps.append(_signature(s) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), *_pairs_array(digests), _lists(prefix), _lists(maps)], [key, "n_shingles", "d1", "d2", "prefix", "signature"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_t")).mapInArrow(run, f"{key} long, n_shingles long, d1 long, d2 long, prefix array<long>, signature array<long>")


def _overlap_possible(num: int, den: int) -> Column:
    """Whether the signatures allow a link. Bits that differ are members of one set only; a wider map is folded to the other's width."""
    a, b = F.col("signature_a"), F.col("signature_b")
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    small = SIGNATURE_WORDS[0][1]
    at = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(0))
    short = sum((F.bit_count(at(a, k).bitwiseXOR(at(b, k))) for k in range(small)), F.lit(0))  # the usual width, without lambdas

    def fold(c: Column, width: Column) -> Column:
        parts = F.sequence(F.lit(0), (F.size(c) / width).cast("int") - 1)
        return F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), width), lambda t, k: F.zip_with(t, F.slice(c, k * width + 1, width), lambda x, y: x.bitwiseXOR(y)))

    both = (F.size(a) == small) & (F.size(b) == small)
    bits = F.when(both, short).when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) > F.size(b), differ(fold(a, F.size(b)), b)).otherwise(differ(a, fold(b, F.size(a))))
    total = F.col("n_a") + F.col("n_b")
    return (total - bits) * (num + den) >= 2 * num * total


def _bounds(n_a: Column, at_a: Column, n_b: Column, at_b: Column, num: int, den: int) -> Column:
    """Sizes, and what is left behind the first shared shingle, allow a link."""
    return (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num) & (F.least(n_a - at_a, n_b - at_b) * (num + den) >= num * (n_a + n_b))


def _links(docs: DataFrame, pairs: DataFrame, reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked, by exact intersection."""
    needed = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct().join(reps, "v")
    some = _filter(needed.select("id"))
    held = docs.sparkSession.sparkContext.broadcast(some)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = held.value
        for whole in batches:
            few = whole.filter(pa.array(_marked(on, whole.column(0).to_numpy(zero_copy_only=False))))
            for a in range(0, few.num_rows, 1000):
                b = few.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([*_pairs_array([_digest(s) for s in shingle_sets(b.column(1), n)]), b.column(1)], ["d1", "d2", "text"])

    found = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(pick, "d1 long, d2 long, text string")
    texts = found.dropDuplicates(["d1", "d2"]).join(needed.select("v", "d1", "d2"), ["d1", "d2"]).select("v", "text")
    end = lambda x: texts.select(F.col("v").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                same = []
                for x, y in zip(shingle_sets(batch.column(2), n), shingle_sets(batch.column(3), n)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(den * common >= num * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _slot(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each id among so many bits."""
    at = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _marked(on: np.ndarray, ids: np.ndarray) -> np.ndarray:
    byte, bit = _slot(ids, 8 * len(on))
    return on[byte] & bit > 0


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits at the slots of all ``ids``, eight a byte from end to end: few other ids share one while there are room and bits for them."""
    count = ids.count()
    size = 1 << min(max((FILTER_LOAD * count).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size // 8, np.uint8)
        for b in batches:
            byte, bit = _slot(b.column(0).to_numpy(zero_copy_only=False), size)
            np.bitwise_or.at(on, byte, bit)
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array([on.tobytes()], pa.binary())], ["bits"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size // 8, np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                on |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([on.tobytes()], pa.binary())], ["bits"])

    parts = ids.mapInArrow(mark, "bits binary")
    got = parts.repartition(16).mapInArrow(union, "bits binary").coalesce(1).mapInArrow(union, "bits binary").collect()
    return np.frombuffer(got[0]["bits"], np.uint8) if got else np.zeros(size // 8, np.uint8)


def similarity_classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) of every row of ``docs``."""
    rows = _classes(docs, n, num, den, key, text)
    return rows.select(F.col("doc_id").alias(key), "n_shingles", "component_id")


def _classes(docs: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, component_id`` and ``first`` (the row's set stands for its class) of every row."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    text_batches(docs.sparkSession)
    tables = Scratch(docs.sparkSession, "jaccard")
    sets = tables.write("sets", describe(docs, frequent_shingles(docs, "text", n, tables), n, num, den).withColumn("v", F.monotonically_increasing_id()))
    rows = tables.write("rows", sets.select("doc_id", "n_shingles", "d1", "d2", "v"))
    first = rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "v")).alias("r"))
    reps = tables.write("reps", first.select("d1", "d2", F.col("r.doc_id").alias("id"), F.col("r.v").alias("v")))
    heads = tables.write("heads", sets.join(reps.select("v").hint("shuffle_hash"), "v", "left_semi").select("v", F.col("n_shingles").alias("n"), "prefix", "signature"))
    tables.drop("sets")

    # shingles of prefixes that at least two different sets have
    shared = heads.select(F.explode("prefix").alias("h")).groupBy("h").count().where("count > 1").select("h")
    base = math.log(den / num)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(base) + F.lit(1e-9)).cast("int")
    cells = tables.write("cells", heads.select("v", "n", F.posexplode("prefix").alias("at", "h")).join(shared, "h").withColumn("band", band))
    maps = tables.write("maps", heads.select("v", "n", "signature").join(cells.select("v").distinct(), "v", "left_semi"))
    tables.drop("heads")

    # each member of a tile (two adjacent bands) against a few leaders of its upper band: in each of LEADERS parts of it the set with
    # the fewest shingles rarer than the shared one, that is, with the least of its own
    tiles = cells.select("h", "v", "n", "at", "band", F.explode(F.array("band", F.col("band") + 1)).alias("tile"))
    part = F.pmod(F.xxhash64("v"), F.lit(LEADERS))
    lead = [F.min(F.when(part == k, F.struct("at", "v", "n"))) for k in range(LEADERS)]
    upper = tiles.where("band = tile").groupBy("h", "tile").agg(F.array_compact(F.array(*lead)).alias("leaders"), F.count("*").alias("k"))
    stars = tiles.join(upper, ["h", "tile"]).select("v", "n", "at", F.explode("leaders").alias("lead"))
    stars = stars.where((F.col("v") != F.col("lead.v")) & _bounds(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), num, den))
    tried = stars.select(F.least("v", "lead.v").alias("a"), F.greatest("v", "lead.v").alias("b")).distinct()
    end = lambda x: maps.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}"))
    near = tables.write("near", tried.join(end("a"), "a").join(end("b"), "b").where(_overlap_possible(num, den)).select("a", "b"))
    links = tables.write("links", _links(docs, near, reps, n, num, den))
    component = connected_components(links)

    # pairs of a tile that are still in different components: all but the largest component's members against the others; where all
    # sets of the upper band are leaders, every pair has been compared
    placed = tiles.join(upper.where(F.col("k") > F.size("leaders")).select("h", "tile"), ["h", "tile"]).join(component.withColumnRenamed("id", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    parts = placed.groupBy("h", "tile", "component").count().groupBy("h", "tile").agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("k")).where("k > 1").select("h", "tile", F.col("top.component").alias("top"))
    still = tables.write("open", placed.join(parts, ["h", "tile"]).join(maps.select("v", "signature"), "v"))
    tables.drop("cells")
    fields = ("v", "n", "at", "band", "component", "signature")
    rest = still.where("component != top").select("h", "tile", "top", *(F.col(c).alias(f"{c}_a") for c in fields))
    others = still.select("h", "tile", *(F.col(c).alias(f"{c}_b") for c in fields))
    once = (F.greatest("band_a", "band_b") == F.col("tile")) & ((F.col("component_b") == F.col("top")) | (F.col("v_a") < F.col("v_b")))
    apart = (F.col("component_a") != F.col("component_b")) & once & _bounds(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), num, den) & _overlap_possible(num, den)
    met = rest.join(others, ["h", "tile"]).where(apart)
    close = tables.write("close", met.select(F.least("v_a", "v_b").alias("a"), F.greatest("v_a", "v_b").alias("b")).distinct())
    tables.drop("open", "maps")
    final = component
    if not close.isEmpty():
        more = tables.write("more", _links(docs, close, reps, n, num, den))
        final = connected_components(component.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))

    placed = reps.join(final.withColumnRenamed("id", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    smallest = placed.groupBy("component").agg(F.min(F.struct("id", "v")).alias("low"))
    labels = tables.write("labels", placed.join(smallest, "component").select("d1", "d2", F.col("low.id").alias("component_id"), (F.col("v") == F.col("low.v")).alias("first")))
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.join(labels, ["d1", "d2"], "left").select("doc_id", "n_shingles", "d1", "d2", alone.alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those of the smallest doc_id and the set of its text. Rows that repeat it stay.

    Rows without words and rows with a null doc_id are in no class and stay too.
    """
    stand = _classes(docs, n, num, den, "doc_id", "text").where(F.col("first") & F.col("doc_id").isNotNull() & ((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))))
    marks = [free_name(docs, f"_{c}") for c in ("id", "d1", "d2")]
    keys = stand.select(F.col("doc_id").alias(marks[0]), F.col("d1").alias(marks[1]), F.col("d2").alias(marks[2])).distinct()
    at = docs.columns.index("text")
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns, *_pairs_array([_digest(s) for s in shingle_sets(b.column(at), n)])], [*(f.name for f in fields), *marks[1:]])

    schema = T.StructType([*fields, *(T.StructField(m, T.LongType()) for m in marks[1:])])
    same = [F.col("doc_id").cast("long").alias(marks[0]), *marks[1:]]
    known = docs.where("doc_id is not null").mapInArrow(run, schema).select(*docs.columns, *same).join(keys, marks, "left_semi").select(*docs.columns)
    return known.unionByName(docs.where("doc_id is null"))
