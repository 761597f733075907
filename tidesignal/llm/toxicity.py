"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding: compatibility forms and case, then look-alike letters of other scripts as Latin ones, marks and invisible characters
dropped, digits and signs that stand for letters read as letters where a letter is next to them, and ``l`` read as ``i`` (``1``, ``|`` and ``!``
stand for both). Lexicon and text are folded alike. What isn't a letter ends a word; an entry matches at the start of a word, so
one entry covers the inflected forms of a stem.

Learning: the beginnings of words (``MIN_STEM`` to ``MAX_STEM`` letters) of the labelled rows are counted by document and label, on Spark.
An entry is a beginning that tells toxic rows apart better than any shorter and any longer one on its path, by the likelihood ratio, and
is at least ``RATIO`` times as frequent in toxic rows; its weight is the logarithm of that ratio. An exception is a phrase of the word
that holds an entry, alone or with its left neighbour, which at least ``MIN_CLEAN`` clean rows and no toxic row have; phrases can be given
too. A hit inside an exception does not count. The score is a logistic function of the hits' weight for 1,000 words and of its total.

Training uses at most ``TRAIN_ROWS`` labelled rows, taken by hash of the document id; the lexicon has at most ``ENTRIES`` entries and as
many exceptions. Scoring is one narrow pass over whole texts, in windows that end between words.

Edge cases: null, empty and wordless texts have no hits and get the score of a text without hits; repeated labels of a document
count once (the largest), its repeated rows are scored each; about equally good beginnings: the longest; without labels of both kinds every
score is 0.5 and nothing matches; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, slices, text_batches

#: At most so many labelled rows train the model.
TRAIN_ROWS = 20_000
ENTRIES = 5_000
MIN_STEM, MAX_STEM = 3, 14
MIN_TOXIC, MIN_CLEAN, RATIO = 4, 3, 5.0
CANDIDATES = 50_000
EQUAL = 1.05  # evidence that differs by less counts as equal
THRESHOLD = 0.3
WINDOW = 1 << 20

# Letters of other scripts that look like Latin ones, and what may stand for a letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "i", "ʟ": "i", "ł": "i", "ø": "o",
    "l": "i",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "!": "i"}

_INVISIBLE = re.compile("[­͏​-‏⁠-⁤﻿̀-ͯ]")
_TABLE = str.maketrans(LOOKALIKES)
_PLAIN = {ord(k): v for k, v in STAND_INS.items()}
_SIGNS = re.compile(r"[0-9@$|!]+")
_BREAK = re.compile(r"[\W\d_]+")
_ASCII_BREAKS = {k: " " for k in range(128) if not chr(k).isalpha()}
_SPACE = re.compile(r"\s")


def _as_letters(m: re.Match) -> str:
    """Signs with letters on both sides stand for letters; at one end of a word only digits, ``@`` and ``$`` do."""
    t, got = m.string, m[0]
    left, right = m.start() > 0 and t[m.start() - 1].isalpha(), m.end() < len(t) and t[m.end()].isalpha()
    return got.translate(_PLAIN) if left and right or (left or right) and "!" not in got and "|" not in got else got


def fold(text: str | None) -> str:
    """Folded words, each with one space before it and after the last."""
    t = text or ""
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    t = _SIGNS.sub(_as_letters, t.lower().translate(_TABLE))
    words = (t.translate(_ASCII_BREAKS) if t.isascii() else _BREAK.sub(" ", t)).split()
    return f" {' '.join(words)} " if words else " "


def _pieces(text: str | None) -> Iterator[tuple[str, int]]:
    """The folded text and its number of words; a long text in windows that end at white space (a longer word goes whole)."""
    t, at = text or "", 0
    while at < len(t):
        m = _SPACE.search(t, at + WINDOW) if len(t) - at > WINDOW else None
        to = m.end() if m else len(t)
        got = fold(t[at:to])
        yield got, got.count(" ") - 1
        at = to


class Lexicon:
    """Entries with weights, exceptions, and what turns hits into a score."""

    def __init__(self, entries: dict[str, float], exceptions: list[str], slope: tuple[float, float, float], empty: float):
        self.entries, self.exceptions, self.slope, self.empty = entries, exceptions, slope, empty
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            m = ahocorasick.Automaton()
            for w, v in self.entries.items():
                m.add_word(f" {w}", (len(w) + 1, v))
            for p in self.exceptions:
                m.add_word(f" {p} ", (len(p) + 2, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the entries found outside exceptions; of those that begin at one place the longest."""
        found, safe = {}, []
        if not self.entries:
            return []
        for end, (n, weight) in self.machine.iter(folded):
            start = end + 1 - n
            if weight is None:
                safe.append((start, end))
            else:
                found[start] = (start, end, weight)  # ends ascend, so the longest comes last
        if not safe:
            return list(found.values())
        return [h for h in found.values() if not any(a <= h[0] and h[1] <= b for a, b in safe)]

    def measure(self, text: str | None) -> tuple[float, int]:
        """Weight of all hits, and number of words."""
        total, words = 0.0, 0
        for folded, n in _pieces(text):
            total += sum(h[2] for h in self.hits(folded))
            words += n
        return total, words

    def score(self, total: float, words: int) -> float:
        if total <= 0:
            return self.empty
        a, b, c = self.slope
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(1000 * total / max(words, 1)) + c * np.log1p(total), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients by Newton's steps; the ridge keeps separable data finite."""
    x, w = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    keep = ridge * np.diag([0.01, *np.ones(x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Likelihood ratio statistic of a beginning in ``a`` toxic and ``b`` clean rows."""
    part = lambda k, n, p: k * np.log(np.maximum(k, 1e-9) / (n * p)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / (n * (1 - p)))
    p = np.clip((a + b) / (toxic + clean), 1e-9, 1 - 1e-9)
    return 2 * (part(a, toxic, p) + part(b, clean, p))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Weighted entries from (beginning, toxic rows, clean rows): the best of each path, of about equally good ones the longest.

    Its evidence must exceed what the best of ``tried`` beginnings would show by chance."""
    if not counts:
        return {}
    a, b = (np.array([c[k] for c in counts], np.float64) for k in (1, 2))
    ratio = (a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))
    value = np.where((a >= MIN_TOXIC) & (ratio >= RATIO), _evidence(a, b, toxic, clean), 0.0)
    of = {c[0]: k for k, c in enumerate(counts)}
    longer: dict[str, list[str]] = {}
    for w in of:
        for n in range(MIN_STEM, len(w)):
            longer.setdefault(w[:n], []).append(w)
    out, done = {}, set()
    for w in sorted(of, key=lambda w: (-value[of[w]], w)):
        if value[of[w]] <= 2 * np.log(max(tried, 100)) or len(out) == ENTRIES:
            break
        if w not in done:
            near = [x for x in longer.get(w, []) if x not in done and value[of[x]] * EQUAL >= value[of[w]]]
            pick = max([w, *near], key=lambda x: (len(x), value[of[x]], x))
            out[pick] = float(np.log(ratio[of[pick]]))
            done |= {w, *longer.get(w, ()), *(w[:n] for n in range(MIN_STEM, len(w)))}
    return out


def _counted(rows: DataFrame, phrases) -> DataFrame:
    """``phrase, toxic, clean``: labelled rows with a phrase, of the phrases that a text has; the phrase '' counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def table() -> pa.RecordBatch:
            names = sorted(seen[0].keys() | seen[1].keys())
            got = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (seen[1], seen[0]))], ["phrase", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()
            return got

        for b in batches:
            for part in slices(iter([b]), 50):
                for text, y in zip(column(part, "text"), column(part, "_y")):
                    seen[int(y > 0)].update(phrases(text) | {""})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield table()
        yield table()

    return rows.select("text", "_y").mapInArrow(run, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _stems(text: str | None) -> set[str]:
    words = {w for folded, _ in _pieces(text) for w in folded.split()}
    return {w[:n] for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}


def _contexts(stems: set[str], text: str | None) -> set[str]:
    """The given beginnings that a text has, each with the word it begins and that word's neighbours, as ``stem/digest``."""
    out = set()
    for folded, _ in _pieces(text):
        words = ["", *folded.split(), ""]
        for k, w in enumerate(words):
            for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1):
                if w[:n] in stems:
                    out.add(f"{w[:n]}/{zlib.crc32(' '.join(words[k - 1 : k + 2]).encode('utf-8', 'replace'))}")
    return out


def _around(model: Lexicon, text: str | None) -> set[str]:
    """The words with a hit, alone and with their left neighbour."""
    out = set()
    for folded, _ in _pieces(text):
        for start, _, _ in model.hits(folded):
            end, left = folded.index(" ", start + 1), folded.rfind(" ", 0, start)
            out.add(folded[start + 1 : end])
            if left >= 0:
                out.add(folded[left + 1 : end])
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from the labelled rows where ``learn`` (over ``doc_id``) holds; ``exceptions`` are phrases that never count."""
    spark, none = docs.sparkSession, Lexicon({}, [], (0.0, 0.0, 0.0), 0.5)
    text_batches(spark)
    given = [fold(p).strip() for p in exceptions]
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # at most ``rows`` pairs of numbers
    scratch = Scratch(spark, "toxicity")
    train = scratch.write("train", texts.repartition(max(1, spark.sparkContext.defaultParallelism)))
    counts = scratch.write("counts", _counted(train, _stems))
    all_rows = counts.where("phrase = ''").first()
    toxic, clean = (all_rows["toxic"], all_rows["clean"]) if all_rows else (0, 0)
    if not toxic or not clean:
        return none
    often = counts.where((F.col("phrase") != "") & (F.col("toxic") >= MIN_TOXIC) & ((F.col("toxic") + 0.5) * (clean + 1) >= RATIO * (toxic + 1) * (F.col("clean") + 0.5)))
    stems = {r["phrase"]: r for r in often.orderBy(F.desc("toxic"), "clean", "phrase").limit(CANDIDATES).collect()}
    names = set(stems)
    places = _counted(train, lambda t: _contexts(names, t)).where("phrase <> ''").groupBy(F.substring_index("phrase", "/", 1).alias("stem"))
    places = places.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("clean") > 0).alias("clean")).collect()  # at most CANDIDATES rows
    independent = [(r["stem"], *(min(stems[r["stem"]][k], r[k]) for k in ("toxic", "clean"))) for r in places]
    model = Lexicon(choose(sorted(independent), toxic, clean, counts.count()), [], (0.0, 0.0, 0.0), 0.5)
    spared = _counted(train, lambda t: _around(model, t)).where((F.col("phrase") != "") & (F.col("clean") >= MIN_CLEAN) & (F.col("toxic") == 0))
    model.exceptions = sorted({*given, *(r["phrase"] for r in spared.orderBy(F.desc("clean"), "phrase").limit(ENTRIES).collect())} - {""})
    x = np.array([list(r) for r in _measured(train, model, "_y").select("total", "words", "_y").collect()], np.float64)  # at most ``rows`` rows of numbers
    x = x[np.lexsort(x.T)]
    hit = x[:, 0] > 0
    empty = (x[~hit, 2].sum() + 0.5) / ((~hit).sum() + 1)
    slope = _logistic(np.column_stack((np.log1p(1000 * x[:, 0] / np.maximum(x[:, 1], 1)), np.log1p(x[:, 0])))[hit], (x[hit, 2] > 0).astype(float)) if hit.any() else np.zeros(3)
    scratch.drop("train", "counts")
    return Lexicon(model.entries, model.exceptions, tuple(slope.tolist()), float(empty))


def _measured(docs: DataFrame, model: Lexicon, *extra: str) -> DataFrame:
    """``extra`` columns, and each text's ``total`` weight, ``words`` and ``score``. Narrow: no shuffle."""
    text_batches(docs.sparkSession)
    kept = [docs.schema[c] for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [model.measure(t) for t in column(b, "_t")]
            cols = [pa.array([g[k] for g in got], t) for k, t in ((0, pa.float64()), (1, pa.int64()))]
            scores = pa.array([model.score(*g) for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), *cols, scores], [*extra, "total", "words", "score"])

    schema = T.StructType([*kept, T.StructField("total", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(F.col(c) for c in extra), F.col("text").alias("_t")).mapInArrow(run, schema)


def classify(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    return _measured(docs, model, "doc_id").select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
