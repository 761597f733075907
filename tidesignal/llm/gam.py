"""Document quality as a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins and has a lookup table; boosting visits the features in turn and adds a small step of a
shallow tree (up to three leaves) fitted to the gradient of the logistic loss. Then the feature pairs whose four-leaf tables
lower the loss most get tables of their own, boosted the same way. A score is the sum of table entries, by vectorised indexing.

Training uses at most ``TRAIN_ROWS`` labelled rows, taken by hash of the document id; features are computed on the executors,
and only that bounded feature matrix reaches the driver. Scoring is one narrow pass over all whole texts.

Edge cases: null and empty texts have all-zero features and get a score; repeated labels of a document count once (the smallest);
with no labels at all every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, crc_mod, slices, text_batches

#: At most so many labelled rows train the model.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 240, 120, 0.1
THRESHOLD = 0.3

FEATURES = ("words", "word_length", "upper", "symbols", "exclaim", "digits", "echo", "distinct", "line_copies", "lines", "top_word", "stops", "wordless", "trigram_copies", "non_ascii")
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_STOPS = b".,"
_HIGH = bytes(range(128, 256))
_NO_WORD = bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123)))


def features(text: str | None) -> tuple[float, ...]:
    """The numbers of ``FEATURES`` for one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    w = raw.split()
    n, size = len(w), len(raw)
    if not n:
        return (0.0,) * len(FEATURES)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    counts = Counter(w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = len(set(zip(w, w[1:], w[2:])))
    return (
        np.log1p(n), sum(map(len, w)) / n, share(_UPPER), share(_SYMBOLS), share(b"!"), share(_DIGITS),
        sum(map(eq, w, w[1:])) / n, len(counts) / n**0.9, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)) - np.log1p(n),
        max(counts.values()) / n, share(_STOPS), sum(1 for x in counts if not x.translate(None, _NO_WORD)) / len(counts),
        1 - grams / (n - 2) if n > 2 else 0.0, share(_HIGH),
    )


class Gam:
    """Additive lookup tables over binned features."""

    def __init__(self, edges, tables, pairs, pair_edges, pair_tables, base):
        self.edges, self.tables, self.pairs, self.pair_edges, self.pair_tables, self.base = edges, tables, pairs, pair_edges, pair_tables, base

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {k for p in self.pairs for k in p}}
        for (a, b), t in zip(self.pairs, self.pair_tables):
            z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g, h):
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: greedy splits of the ordered bins."""
    cuts = [(0, len(g))]
    gain = lambda a, b: (s := g[a:b].sum()) * s / (h[a:b].sum() + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for a, b in cuts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            tg, th = g[a:b].sum(), h[a:b].sum()
            got = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - gain(a, b)
            got = np.where((ch < 1.0) | (th - ch < 1.0), -1.0, got)
            k = int(got.argmax())
            if got[k] > best[0]:
                best = (got[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        a, b = best[1]
        cuts.remove((a, b))
        cuts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in cuts:
        step[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four-leaf table of a pair: its gain and the step of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = lambda c, t: [a := c[:-1, :-1], (r := c[:-1, -1:]) - a, (d := c[-1:, :-1]) - a, t - r - d + a]
    got = sum(x**2 / (y + 1) for x, y in zip(parts(cg, tg), parts(ch, th)))
    i, j = np.unravel_index(int(got.argmax()), got.shape)
    step = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(got.max() - tg * tg / (th + 1)), step


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the tables of all features, then of the most useful pairs."""
    width = len(FEATURES)
    if len(y) == 0:
        return Gam([np.zeros(0)] * width, [np.zeros(1)] * width, [], {}, [], 0.0)
    quantiles = lambda k, n: np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1]))
    edges = [quantiles(k, BINS) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    rate0 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate0 / (1 - rate0)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k in range(width):
            p = 1 / (1 + np.exp(-z))
            n = len(tables[k])
            step = RATE * _tree(np.bincount(bins[k], y - p, n), np.bincount(bins[k], p * (1 - p), n))
            tables[k] += step
            z += step[bins[k]]
    pair_edges = {k: quantiles(k, PAIR_BINS) for k in range(width)}
    coarse = {k: np.searchsorted(e, x[:, k], "right") for k, e in pair_edges.items()}
    shape = lambda a, b: (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)

    def moments(a, b):
        p = 1 / (1 + np.exp(-z))
        s = shape(a, b)
        cell = coarse[a] * s[1] + coarse[b]
        return [np.bincount(cell, v, s[0] * s[1]).reshape(s) for v in (y - p, p * (1 - p))], cell

    able = [(a, b) for a in range(width) for b in range(a) if min(shape(a, b)) > 1]
    pairs = sorted(able, key=lambda ab: -_quadrants(*moments(*ab)[0])[0])[:PAIRS]
    pair_tables = [np.zeros(shape(*ab)) for ab in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, ab in zip(pair_tables, pairs):
            m, cell = moments(*ab)
            step = RATE * _quadrants(*m)[1]
            t += step
            z += step.ravel()[cell]
    return Gam(edges, tables, pairs, pair_edges, pair_tables, base)


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _with_features(df: DataFrame, key: str, text: str, extra: list[str]) -> DataFrame:
    text_batches(df.sparkSession)
    kept = [df.schema[c] for c in (key, *extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = _matrix(column(b, "_t"))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(kept))] + [lists], [*(f.name for f in kept), "x"])

    return df.select(*(F.col(f.name) for f in kept), F.col(text).alias("_t")).mapInArrow(run, T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out_mod: int = 5, rows: int = TRAIN_ROWS) -> Gam:
    """A model of ``label``, learnt from rows whose crc32(doc_id) mod ``held_out_mod`` is not 0."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", held_out_mod) != 0))
        .groupBy("doc_id").agg(F.min(label).cast("double").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # at most ``rows`` pairs of numbers; one text each
    got = _with_features(texts, "doc_id", "text", ["_y"]).select("x", "_y").toPandas()
    order = got["_y"].to_numpy(np.float64)
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    by = np.lexsort([*x.T, order])  # the same model whatever the order of arrival
    return train(x[by], order[by])


def score(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` in 0 to 1. Narrow: no shuffle."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(column(b, "_t"))))], [key, "score"])

    return docs.select(F.col(key), F.col(text).alias("_t")).mapInArrow(run, T.StructType([kind, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, model: Gam, held_out_mod: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    got = score(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", held_out_mod) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Gam, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns unchanged, whatever their names."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.score(_matrix(column(b, text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
