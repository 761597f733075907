"""Ranked lexical search: an index of compressed posting blocks, searched by Block-Max WAND.

``build`` reads whole texts once and writes an index in the shared folder, one row a shard: a shard holds some thousand documents of one
input partition, their ids and lengths, and for each term the blocks of up to ``BLOCK`` postings. A block stores its first and last
document, its documents as gaps and its counts in the least number of bytes, and the pairs (count, length) that no other posting of the
block beats: from these the block's highest impact follows exactly, whatever the corpus' statistics are. N, L and the document
frequencies are then sums over the index, over all documents.

``search`` passes over the shards once. Pointers are lower bounds of a list's next document; the pivot is the first document at which the
lists' highest impacts reach the score of the k-th best. A shallow move finds the blocks around the pivot from their ends alone; if the
sum of their highest impacts stays below, the lists leap past the nearest end and nothing is decompressed. Else blocks are
decompressed one by one, the most valuable list first, until the document is refuted or has its score. A bound equal to the k-th
score is not skipped, since the smaller id wins a tie, unless all ids to come are larger. The k best of an item are kept from shard to shard of a task, and ranked over all
tasks in the end.

Items go in batches of at most ``ITEMS`` items or ``ITEM_BYTES`` of text, the only thing broadcast; the index of a batch holds the batch's
terms (a semi-join pushed into the build), and every document.

Edge cases: null and empty texts have no terms, are never found, and do not count in N; items without terms have no rows; a null
``doc_id`` comes last among equal scores; rows that repeat a ``doc_id`` or an ``item_id`` are documents or items of their own; very long
texts are read in windows; extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import attrgetter, le

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, slices, text_batches

BLOCK = 128
#: A shard ends after so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
#: Items searched in one pass, and their bytes of text (a longer item goes alone).
ITEMS, ITEM_BYTES = 4096, 16 << 20
WINDOW = 1 << 20
END = 1 << 62

_BREAKS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(32 if b in _BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))

_INDEX = "shard long, ids array<long>, lens array<long>, terms array<binary>, dfs array<int>, ends array<int>, firsts array<int>, lasts array<int>, cap_ends array<int>, caps array<long>, blocks array<binary>"


def _windows(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, a window of about ``WINDOW`` bytes at a time."""
    raw = (text or "").encode("utf-8", "replace").translate(_FOLD)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + WINDOW)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and everything beyond ASCII; only A-Z is lower-cased."""
    return [w for part in _windows(text) for w in part]


def pack(docs: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: gaps between documents and counts, each in the least width of 1, 2, 4 or 8 bytes."""
    out = [b"", b""]
    widths = bytearray()
    for k, x in enumerate((np.diff(docs, prepend=0), counts)):
        width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max()) < 1 << (8 * w))
        widths.append(width)
        out[k] = x.astype(f"<u{width}").tobytes()
    return bytes(widths) + b"".join(out)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = block[0], block[1]
    n = (len(block) - 2) // (a + b)
    gaps = np.frombuffer(block, f"<u{a}", n, 2).astype(np.int64)
    return np.cumsum(gaps), np.frombuffer(block, f"<u{b}", n, 2 + a * n).astype(np.int64)


def unbeaten(counts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Pairs (count, length), flat, of the postings for which no other has as high a count in as short a document."""
    by = np.lexsort((-counts, lens))
    c = counts[by]
    best = np.maximum.accumulate(c)
    keep = np.r_[True, c[1:] > best[:-1]]
    return np.column_stack((c[keep], lens[by][keep])).ravel()


class _Shard:
    """Postings of the documents read since the last row."""

    def __init__(self) -> None:
        self.ids, self.lens, self.lists, self.postings = [], [], {}, 0

    def add(self, doc_id, n: int, counts: Counter) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lens.append(n)
        self.postings += len(counts)
        for w, c in counts.items():
            got = self.lists.get(w)
            if got is None:
                self.lists[w] = [[at], [c]]
            else:
                got[0].append(at)
                got[1].append(c)

    def row(self, shard: int) -> dict:
        lens = np.array(self.lens, np.int64)
        out = {"shard": shard, "ids": self.ids, "lens": self.lens, **{k: [] for k in ("terms", "dfs", "ends", "firsts", "lasts", "cap_ends", "caps", "blocks")}}
        for w, (docs, counts) in self.lists.items():
            d, c = np.array(docs, np.int64), np.array(counts, np.int64)
            for a in range(0, len(d), BLOCK):
                x, y = d[a : a + BLOCK], c[a : a + BLOCK]
                out["firsts"].append(docs[a])
                out["lasts"].append(int(x[-1]))
                out["caps"] += unbeaten(y, lens[x]).tolist()
                out["cap_ends"].append(len(out["caps"]))
                out["blocks"].append(pack(x, y))
            out["terms"].append(w)
            out["dfs"].append(len(docs))
            out["ends"].append(len(out["blocks"]))
        return out


def build(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """The index of all documents, a row a shard; of the terms of ``vocabulary`` only, where one is given. Narrow: no shuffle."""
    spark = docs.sparkSession
    text_batches(spark)
    known = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType.fromDDL(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, kind = known.value, to_arrow_schema(schema)
        number, shard = TaskContext.get().partitionId() << 24, _Shard()
        for b in slices(batches, 100):
            for key, text in zip(column(b, "doc_id"), column(b, "text")):
                n, counts = 0, Counter()
                for part in _windows(text):
                    n += len(part)
                    counts.update(part if wanted is None else filter(wanted.__contains__, part))
                shard.add(key, n, counts)
                if len(shard.ids) >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield pa.RecordBatch.from_pylist([shard.row(number)], kind)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row(number)], kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class _List:
    """Blocks of one term in one shard, decompressed when first needed."""

    __slots__ = ("firsts", "lasts", "tops", "top", "blocks", "weight", "size", "open")

    def __init__(self, firsts, lasts, tops, blocks, weight, size):
        self.firsts, self.lasts, self.tops, self.top, self.blocks, self.weight, self.size = firsts, lasts, tops, max(tops), blocks, weight, size
        self.open = {}

    def block(self, b: int) -> tuple[list[int], list[int]]:
        got = self.open.get(b)
        if got is None:
            docs, counts = unpack(self.blocks[b])
            got = self.open[b] = docs.tolist(), (self.weight * ((1_000_000_000 * counts) // (1000 * counts + self.size[docs]))).tolist()
        return got


class _Pointer:
    """Place in a list: ``doc`` is a lower bound of the next document; ``exact`` where it is that document itself."""

    __slots__ = ("list", "top", "lasts", "firsts", "doc", "at", "exact", "pos")

    def __init__(self, of: _List):
        self.list, self.top, self.lasts, self.firsts = of, of.top, of.lasts, of.firsts
        self.doc, self.at, self.exact, self.pos = of.firsts[0], 0, False, 0

    def leap(self, doc: int) -> None:
        """Shallow move: to the block that may hold ``doc`` or what follows, by the ends of blocks alone."""
        if self.lasts[self.at] < doc:
            self.at = bisect_left(self.lasts, doc, self.at + 1)
            self.pos = 0
            if self.at == len(self.lasts):
                self.doc, self.exact, self.at = END, True, self.at - 1
                return
        first = self.firsts[self.at]
        self.doc, self.exact = (doc, False) if first < doc else (first, False)

    def seek(self, doc: int) -> int:
        """Deep move: the impact of ``doc`` where the list holds it, else 0; the pointer stands on ``doc`` or beyond."""
        self.leap(doc)
        if self.doc > doc:
            return 0
        docs, values = self.list.block(self.at)
        self.pos = bisect_left(docs, doc, self.pos)
        self.doc, self.exact = docs[self.pos], True
        return values[self.pos] if self.doc == doc else 0


_DOC, _TOP = attrgetter("doc"), attrgetter("top")


def wand(lists: list[_List], heap: list[tuple], k: int, ids: list, ascending: bool, seen: list[int] | None = None) -> None:
    """Add the best documents of a shard to ``heap``: (score, minus id, ...) of the k best so far, the worst first.

    ``ascending``: no id is null, and none is less than the one before it.
    """
    pointers = [_Pointer(x) for x in lists]
    def needed(at: int) -> int:
        """Least score that still gets in, from place ``at`` of the shard on: where later ids are larger, ties have lost."""
        if len(heap) < k:
            return 1
        worst = heap[0][3]
        return heap[0][0] + (ascending and worst is not None and worst <= ids[at])

    least = needed(0)
    while True:
        pointers.sort(key=_DOC)
        total, pivot = 0, -1
        for p, c in enumerate(pointers):
            total += c.top
            if total >= least:
                pivot = p
                break
        if pivot < 0 or (doc := pointers[pivot].doc) == END:
            return
        n = pivot + 1
        while n < len(pointers) and pointers[n].doc == doc:
            n += 1
        bound, edge = 0, pointers[n].doc - 1 if n < len(pointers) else END - 1
        for c in pointers[:n]:
            if c.doc < doc:
                c.leap(doc)
            if c.doc > doc:
                edge = min(edge, c.doc - 1)
            else:
                bound += c.list.tops[c.at]
                edge = min(edge, c.lasts[c.at])
        if bound < least:  # no document up to the nearest end can do
            for c in pointers[:n]:
                if c.doc <= edge:
                    c.leap(edge + 1)
            continue
        score = 0
        for c in sorted(pointers[:n], key=_TOP, reverse=True):
            if c.doc > doc:
                continue
            if bound >= least:
                cap = c.list.tops[c.at]
                got = c.seek(doc)
                score += got
                bound += got - cap
            if c.doc <= doc:
                c.leap(doc + 1)
        if seen is not None:
            seen.append(doc)
        if bound >= least and score >= least:
            key = ids[doc]
            entry = (score, key is not None, -key if key is not None else 0, key)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
        least = needed(doc)


def search(index: DataFrame, items: list[tuple[object, frozenset[bytes]]], k: int = 10) -> DataFrame:
    """``item, doc_id, score`` of the k best documents of each task for each item (its number in the list), scores above 0."""
    spark = index.sparkSession
    n_docs, n_terms = index.select(F.explode("lens").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    found = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).groupBy("e.terms").agg(F.sum("e.dfs").alias("df")).collect() if n_docs else []  # at most the batch's terms
    weights = {bytes(r["terms"]): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
    shared = spark.sparkContext.broadcast((weights, [t for _, t in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, wanted = shared.value
        heaps = [[] for _ in wanted]
        for b in slices(batches, 1):
            row = {name: b.column(j)[0].as_py() for j, name in enumerate(b.schema.names)}
            size = 8 * (10 + (90 * np.array(row["lens"], np.int64) * n_docs) // n_terms)
            ids = row["ids"]
            ascending = None not in ids and all(map(le, ids, ids[1:]))
            lists, block, cap = {}, 0, 0
            for w, end in zip(row["terms"], row["ends"]):
                tops = []
                for e in row["cap_ends"][block:end]:
                    c = np.array(row["caps"][cap:e], np.int64).reshape(-1, 2)
                    tops.append(weights[w] * int((1_000_000_000 * c[:, 0] // (1000 * c[:, 0] + 8 * (10 + (90 * c[:, 1] * n_docs) // n_terms))).max()))
                    cap = e
                lists[w] = _List(row["firsts"][block:end], row["lasts"][block:end], tops, row["blocks"][block:end], weights[w], size)
                block = end
            for heap, want in zip(heaps, wanted):
                if here := [lists[w] for w in want if w in lists]:
                    wand(here, heap, k, ids, ascending)
        rows = [(j, e[3], e[0]) for j, heap in enumerate(heaps) for e in heap]
        cols = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long") if n_docs else spark.createDataFrame([], "item int, doc_id long, score long")


def _batches(items: DataFrame) -> Iterator[list[tuple[object, frozenset[bytes]]]]:
    held, size = [], 0
    for key, text in items.select("item_id", "text").toLocalIterator():
        if held and (len(held) >= ITEMS or size + len(text or "") > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((key, frozenset(terms(text))))
        size += len(text or "")
    if held:
        yield held


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item, equal scores by ascending ``doc_id``."""
    spark: SparkSession = docs.sparkSession
    scratch, kind = Scratch(spark, "lexical"), items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for n, batch in enumerate(_batches(items)):
        index = scratch.write(f"index{n}", build(docs, frozenset().union(*(t for _, t in batch))))
        best = scratch.write(f"best{n}", search(index, batch, k))
        keys = spark.createDataFrame([(j, key) for j, (key, _) in enumerate(batch)], f"item int, item_id {kind}")  # at most ITEMS rows
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int")
        ranked = best.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(keys), "item")
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
        scratch.drop(f"index{n}")
    return out
