"""Language identification by a small byte convolutional network.

A window of 256 bytes is embedded, passed through filters of widths 2, 3 and 4, max-pooled over its positions and classified by a
softmax layer. The network is trained in numpy on the windows of at most ``TRAIN_DOCS`` documents. A whole text is covered by
windows side by side, each window's probabilities count by its bytes, and the language with the highest mean wins.

Training windows are cut on the executors, from whole texts; only they reach the driver: the texts of at most ``TRAIN_DOCS`` documents,
chosen by a hash of their keys. Prediction is one narrow pass in batches of windows.

Edge cases: a text that is null or has no letters is ``und`` with score 0; with no training rows every text is ``und``; a window at
the end of a text is padded with zeros. Very long texts are covered whole. Of languages with equal probabilities the first by name
wins. Repeated rows are predicted alike; in training a repeated key counts once, with its smallest language and text. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, text_batches

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 6
#: Bounds of the training sample, and its passes.
TRAIN_DOCS, EPOCHS, BATCH, RATE = 1500, 2, 64, 0.01
CHUNK = 256
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class ByteCnn:
    """Weights, and the forward and backward pass."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        w = rng.normal(0, 0.3, (wide, EMBED, n)).astype(np.float32)
        #: Narrower filters see only the first positions of the widest one.
        self.mask = np.concatenate([np.repeat((np.arange(wide) < k)[:, None], FILTERS, 1) for k in WIDTHS], 1).astype(np.float32)[:, None, :]
        self.filters = w * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _conv(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (m x 256 bytes) to columns (m x positions x inputs) and activations before pooling."""
        e = self.embed[x].reshape(len(x), -1)
        wide = max(WIDTHS)
        cols = np.lib.stride_tricks.sliding_window_view(e, wide * EMBED, axis=1)[:, ::EMBED]
        flat = np.ascontiguousarray(cols).reshape(-1, wide * EMBED)
        return cols, (flat @ self.filters.reshape(wide * EMBED, -1)).reshape(len(x), cols.shape[1], -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for k in range(0, len(x), CHUNK):
            pooled = np.maximum(self._conv(x[k : k + CHUNK])[1].max(1) + self.bias, 0)
            z = pooled @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy; only the pooled positions pass any back."""
        cols, act = self._conv(x)
        at = act.argmax(1)
        top = np.take_along_axis(act, at[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (top > 0)
        m, n = back.shape
        seen = cols[np.arange(m)[:, None], at]  # m x filters x inputs
        g_filters = np.einsum("mf,mfi->if", back, seen).reshape(self.filters.shape) * self.mask
        g_embed = np.zeros_like(self.embed)
        flow = np.einsum("mf,kef->mfke", back, self.filters)
        for k in range(max(WIDTHS)):
            np.add.at(g_embed, x[np.arange(m)[:, None], at + k], flow[:, :, k])
        g_embed[0] = 0
        return {"out": pooled.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": g_filters, "embed": g_embed}


def train(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 0) -> ByteCnn:
    net, rng = ByteCnn(langs, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(getattr(net, k)) for k in ("out", "out_bias", "bias", "filters", "embed")}
    second = {k: v.copy() for k, v in first.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            t += 1
            for name, g in net.step(x[some], y[some]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                getattr(net, name).__isub__(RATE * 0.5**epoch * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8))
    return net


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, side by side."""
    n = -(-len(raw) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x.reshape(n, WINDOW)


def fit(docs: DataFrame, allowed: Column, lang: str = "lang", text: str = "text", key: str = "doc_id", n_docs: int = TRAIN_DOCS) -> ByteCnn | None:
    """A network learnt from rows where ``allowed`` holds and the language is known; None if there are none."""
    known = docs.where(allowed & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(lang).cast("string").alias("_l"), F.col(text).cast("binary").alias("_t"))
    chosen = known.select("_k").distinct().orderBy(F.xxhash64("_k"), "_k").limit(n_docs)
    texts = known.join(F.broadcast(chosen), "_k").groupBy("_k").agg(F.min(F.struct("_l", "_t")).alias("r")).select("r.*")  # at most n_docs keys, one row each

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, cuts = [], []
            for t, lang_ in zip(column(b, "_t"), column(b, "_l")):
                x = windows(t or b"")
                langs += [lang_] * len(x)
                cuts += [w.tobytes() for w in x]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cuts, pa.binary())], ["lang", "w"])

    got = texts.select("_l", "_t").mapInArrow(cut, "lang string, w binary").toPandas().sort_values(["lang", "w"])
    if got.empty:
        return None
    langs = sorted(set(got["lang"]))
    x = np.stack([np.frombuffer(w, np.uint8) for w in got["w"]])
    return train(x, got["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(np.int64), langs)


def predict(docs: DataFrame, net: ByteCnn | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                texts = column(part, "_t")
                cut = [windows(t.encode("utf-8", "surrogatepass")) if net and t and has_letter(t) else np.zeros((0, WINDOW), np.uint8) for t in texts]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                sizes = np.array([len(c) for c in cut])
                if net and sizes.any():
                    x = np.concatenate(cut)
                    weight = (x != 0).sum(1).astype(np.float64)
                    p = net.probabilities(x) * weight[:, None]
                    have = np.flatnonzero(sizes)
                    starts = np.concatenate([[0], np.cumsum(sizes[have])[:-1]])
                    total = np.add.reduceat(p, starts, axis=0)
                    total /= total.sum(1, keepdims=True)
                    best = total.argmax(1)
                    scores[have] = total[np.arange(len(have)), best].clip(0, 1)
                    for k, m in zip(have.tolist(), best.tolist()):
                        langs[k] = net.langs[m]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], [key, "lang_pred", "score"])

    schema = T.StructType([kind, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(key), F.col(text).alias("_t")).mapInArrow(run, schema)
