"""Substring dedup by content-defined chunks.

A gear rolling hash of the last 32 bytes marks chunk ends where its low bits are zero, so an insertion moves the chunk borders near
it and no others. Chunks are deduplicated by digest: the copy in the smallest doc_id stays, and within a document the first one.
A run of neighbouring duplicate chunks of ``MIN_RUN`` bytes or more is cut out; shorter chance matches stay.

Digests have 128 bits and are written once. Only (digest, doc_id) pairs are shuffled, one for each distinct digest of a document;
frequent digests are pre-aggregated, and only digests with two or more documents are joined back, by a sorted join whose hot keys may
be split. Texts are shuffled once, by doc_id, to meet their duplicates.

Edge cases: null texts stay null and empty ones empty; of two equal texts the one with the smaller doc_id stays whole and the
other becomes empty; rows that repeat a doc_id count as one document and are cut alike; rows with a null doc_id are left as they
are. Cuts fall on character borders. Ties can't occur: the first of two copies in one document is the earlier one. Very long texts
are chunked whole; an empty table gives an empty result. Whole chunks are cut, so at either end of a repeated passage up to a chunk (48
bytes on average, ``MAX_CHUNK`` at most) stays in every copy.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, free_name, slices, text_batches

#: Smallest and largest chunk, the mask of the bits that end one (mean about MIN_CHUNK + MASK + 1), and the shortest run cut.
MIN_CHUNK, MAX_CHUNK, MASK, MIN_RUN = 16, 256, 31, 64
#: A weaker mask: where no chunk ends within MAX_CHUNK bytes, the last place that meets it ends one, so that cuts depend on content.
SPARE_MASK = 7
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(raw: bytes) -> list[int]:
    """End offsets of the chunks of a text."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for k in range(5):  # the sum of gear[b] << age over the last 32 bytes, by doubling
        w = 1 << k
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    h >>= np.uint32(27)  # high bits depend on the whole window
    marks = np.flatnonzero(h & np.uint32(MASK) == 0) + 1
    spare: list[int] | None = None
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MAX_CHUNK:
            if spare is None:
                spare = (np.flatnonzero(h & np.uint32(SPARE_MASK) == 0) + 1).tolist()
            k = bisect_right(spare, last + MAX_CHUNK) - 1
            last = spare[k] if k >= 0 and spare[k] >= last + MIN_CHUNK else last + MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK or m == n > last:
            last = m
            ends.append(m)
    return ends


def _digests(raw: bytes, ends: list[int]) -> list[bytes]:
    out, a, digest = [], 0, xxhash.xxh3_128_digest
    for b in ends:
        out.append(digest(raw[a:b]))
        a = b
    return out


def digests_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the distinct chunk ``digests`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for t in column(b, "_t"):
                raw = (t or "").encode("utf-8", "surrogatepass")
                found.append(set(_digests(raw, chunk_ends(raw))))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array([d for x in found for d in x], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "digests"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_t")).mapInArrow(run, f"{key} long, digests array<binary>")


def _cut(raw: bytes, known: set[bytes]) -> tuple[bytes, list[tuple[int, int]], int, int]:
    """The text without runs of duplicates; the spans cut; chunks; chunks in the spans."""
    ends = chunk_ends(raw)
    n = len(raw)
    seen: set[bytes] = set()
    runs: list[list[int]] = []  # start, end, chunks
    a, open_run = 0, False
    for b, d in zip(ends, _digests(raw, ends)):
        copy = d in known or d in seen
        seen.add(d)
        if copy and open_run:
            runs[-1][1:] = b, runs[-1][2] + 1
        elif copy:
            runs.append([a, b, 1])
        open_run = copy
        a = b
    runs = [r for r in runs if r[1] - r[0] >= MIN_RUN or (r[0] == 0 and r[1] == n)]
    inner = lambda k: 0 < k < n and raw[k] & 0xC0 == 0x80  # noqa: E731  inside a character
    out, kept, at = [], [], 0
    for a, b, _ in runs:
        while inner(a):
            a += 1
        while inner(b):
            b -= 1
        out.append((a, b))
        kept.append(raw[at:a])
        at = b
    return b"".join(kept) + raw[at:], out, len(ends), sum(r[2] for r in runs)


REPORT = "n_chunks long, n_dup_chunks long, dup_bytes long, dup_spans array<struct<start: long, end: long>>"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut; with ``report`` also ``n_chunks, n_dup_chunks, dup_bytes`` and ``dup_spans``.

    ``n_dup_chunks`` counts chunks that are cut; a chance match too short to be cut is no duplicate. Columns of ``docs`` that have a
    name of the report give way to it.
    """
    added = T._parse_datatype_string(REPORT).fields if report else []
    docs = docs.drop(*(f.name for f in added))
    text_batches(docs.sparkSession)
    tables = Scratch(docs.sparkSession, "chunks")
    digests = tables.write("digests", digests_of(docs.where(F.col(key).isNotNull()), key, text))
    rows = digests.select(F.col(key).alias("_doc"), F.explode("digests").alias("_d"))
    common = rows.groupBy("_d").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).where("_first < _last").select("_d", "_first")
    later = tables.write("later", rows.join(common, "_d").where("_doc > _first").groupBy("_doc").agg(F.collect_set("_d").alias("_known")))
    tables.drop("digests")
    fields = list(docs.schema.fields)
    at, id_at = docs.columns.index(text), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new, sizes, copies, gone, where = [], [], [], [], []
            for t, known, id_ in zip(b.column(at).to_pylist(), b.column(len(fields)).to_pylist(), b.column(id_at).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                left, spans, n, k = (raw, [], 0, 0) if id_ is None else _cut(raw, set(known or ()))
                new.append(None if t is None else left.decode("utf-8", "surrogatepass"))
                sizes.append(n)
                copies.append(k)
                gone.append(sum(y - x for x, y in spans))
                where.append([{"start": x, "end": y} for x, y in spans])
            cols = [b.column(k) for k in range(len(fields))]
            cols[at] = pa.array(new, pa.string())
            if report:
                cols += [pa.array(sizes, pa.int64()), pa.array(copies, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in [*fields, *added]])

    joined = docs.join(later, docs[key] == later["_doc"], "left").select(*(docs[c] for c in docs.columns), later["_known"].alias(free_name(docs, "_known")))
    return joined.mapInArrow(run, T.StructType([*fields, *added]))
