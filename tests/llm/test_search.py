"""Hard negatives, toxicity and ranked search: against brute force or held-out labels, and their edge cases."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesignal.llm import lexical, negatives, toxicity
from tidesignal.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


# --- hard negatives


def _mined(rows, k=5):
    """Brute force over (id, label, whole vector)."""
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, lab, v in rows:
        if i % 100:
            continue
        got = sorted((-score(v, w), j) for j, other, w in rows if other == lab and j != i)[:k]
        for minus, p in got:
            near = sorted((-score(v, w), j) for j, other, w in rows if other != lab and 80 * -minus <= 100 * score(v, w) <= 100 * -minus)
            out |= {(i, p, r, j, -minus, -s) for r, (s, j) in enumerate(near[:k], 1)}
    return out


def _whole(rows):
    fine = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in fine]


def _query(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, EMBEDDINGS)
    for c in extra:
        df = df.withColumn(c, F.lit("own"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()}


def test_hard_negatives_with_ties_nulls_and_copies(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], r.randrange(3)) for i in range(0, 900, 3)]
    rows += [(901 + i, [1.0, 0.5, 0.5, 0.0, 0.0, 0.25], i % 2) for i in range(150)]  # one hot vector
    rows += [(100, None, 1), (200, [float("nan")] * 6, 1), (2001, [None] + [0.5] * 5, 1), (2002, [0.5] * 6, None), (2003, [float("inf")] * 6, 0), (None, [0.5] * 6, 0), (2100, [], 1), (2101, [1.0, 1.0], 0)]
    assert _query(spark, tmp_path, rows, extra=("score", "list", "slot", "id")) == _mined(_whole(rows))


def test_hard_negatives_of_empty_and_single_rows(spark, tmp_path):
    assert _query(spark, tmp_path, []) == set()
    assert _query(spark, tmp_path, [(100, [1.0], 1)]) == set()
    assert _query(spark, tmp_path, [(100, [1.0], 1), (100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == {(100, 1, 1, 2, 65536, 230 * 256)}


def test_hard_negatives_over_many_bins_and_anchor_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "BIN_BYTES", 64 * 6 * 8)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    r = np.random.default_rng(3)
    middle = r.normal(size=(9, 6))
    rows = [(i, [float(x) for x in middle[i % 9] + 0.1 * r.normal(size=6)], int(i % 4)) for i in range(0, 1400, 2)]
    assert _query(spark, tmp_path, rows) == _mined(_whole(rows))


def test_walk_skips_lists_and_stops():
    r = np.random.default_rng(5)
    middle = 400 * r.normal(size=(40, 8))
    x = np.floor(np.repeat(middle, 50, 0) + r.normal(size=(2000, 8)))
    centroids = np.array([x[a : a + 50].mean(0) for a in range(0, 2000, 50)])
    radius = np.array([np.sqrt(((x[50 * j : 50 * j + 50] - c) ** 2).sum(1)).max() for j, c in enumerate(centroids)])
    lists = negatives.Lists(centroids, radius, np.zeros(40, np.int32), np.ones(40, np.int32), 1)
    members = {j: (x[50 * j : 50 * j + 50], np.arange(50 * j, 50 * j + 50), np.zeros(50, np.int64)) for j in range(40)}
    visits = []
    best = negatives.walk(lists, members, x[:1], np.array([0]), np.array([0]), np.array([0]), True, np.array([-np.inf]), np.array([np.inf]), 5, visits)
    s = x @ x[0]
    assert best.id[0].tolist() == sorted(range(1, 2000), key=lambda i: (-s[i], i))[:5] and len(visits) < 5


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    got = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score is null or score < 0 or score > 1").count() == 0
    rows = got.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) >= 0.75 and hit / sum(r["predicted"] for r in rows) >= 0.85


def test_folding():
    assert toxicity.fold("ＩＤＩＯＴ 1d10t ıdıоt i​diot !") == " idiot idiot idiot idiot "
    assert toxicity.fold("a 108.51.216 $cum l0ser! 2024") == " a scum ioser "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" \n1 ") == " "


def _plain(model, text):
    """Total weight by looking at every word and exception, without an automaton."""
    folded = toxicity.fold(text)
    words, at, spans = folded.split(), 0, []
    safe = [(m.start(), m.start() + len(p) + 2) for p in model.exceptions for m in re.finditer(f"(?= {re.escape(p)} )", folded)]
    total = 0.0
    for w in words:
        best = max((e for e in model.entries if w.startswith(e)), key=len, default=None)
        if best and not any(a <= at and at + 1 + len(best) <= b for a, b in safe):
            total += model.entries[best]
        spans.append(at)
        at += len(w) + 1
    return total, len(words)


def test_matches_equal_a_plain_search():
    r = random.Random(2)
    model = toxicity.Lexicon({"ab": 1.0, "abc": 2.5, "ca": 0.5, "bb": 3.0}, ["abcc", "a bb", "ca b ab"], (0.0, 1.0, 0.0), 0.1)
    for _ in range(500):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 12)))
        assert model.measure(text) == pytest.approx(_plain(model, text))


def test_windows_of_long_texts(monkeypatch):
    model = toxicity.Lexicon({"bad": 1.0}, [], (0.0, 1.0, 0.0), 0.1)
    text = "good bad " * 500 + "x" * 3000 + " bad"
    whole = model.measure(text)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    assert model.measure(text) == whole == (501.0, 1002)


def test_toxicity_learns_stems_and_exceptions(spark, make_docs):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(5))
    rows, labels = [], []
    for k in range(300):
        words, bad = [word() for _ in range(60)], k % 3 == 0
        if bad:
            for j in range(4):
                words[r.randrange(60)] = "vlarg" + word()
        elif k % 30 == 1:
            words[r.randrange(60)] = "vlargol"
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(bad)))
    docs = make_docs(rows + [(1000, None, "s"), (1001, "", None), (1002, "quiet words", "s"), (1003, "a Vlàrgh vl4rgz", "s"), (1003, "vlargol", "s")]).withColumn("score", F.lit("own"))
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (7, None), (0, 0)], "doc_id long, toxic int"), F.lit(True))
    assert "viarg" in model.entries and "viargoi" in model.exceptions
    got = toxicity.classify(docs, model).collect()
    assert len(got) == 305 and sum(g["predicted"] for g in got if g["doc_id"] < 300) == 100
    assert [g["predicted"] for g in got if g["doc_id"] >= 1000] == [0, 0, 0, 1, 0]
    given = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), exceptions=("Vlargh",))
    assert "viargh" in given.exceptions


def test_toxicity_without_labels_or_rows(spark, make_docs):
    docs, none = make_docs(["a", None]), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, F.lit(True))
    assert [r["score"] for r in toxicity.classify(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.classify(docs.limit(0), model).count() == 0
    only = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, only, F.lit(True)).entries == {}


# --- ranked search


def _ranked(docs, items, k=10):
    """Brute force; docs and items are (id, text)."""
    split = lambda t: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(w for _, b in bags for w in set(b))
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            tf, m = Counter(b), 10 + (90 * len(b) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(split(text)) if tf[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _searched(spark, docs, items, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("item_id", F.lit(1)).repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("own")).withColumn("rank", F.lit(0))
    got = lexical.rank(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 70)
    monkeypatch.setattr(lexical, "WINDOW", 40)
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Über", "ñu", "x9"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choices(vocab, weights, k=n)).title()
    docs = [(k, text(r.choice([1, 3, 20, 200]))) for k in range(400)]
    docs += [(500 + k, docs[k % 7][1]) for k in range(60)] + [(3, docs[3][1]), (None, docs[1][1]), (600, None), (601, ""), (602, " .,-\t")]
    items = [(k, text(r.choice([1, 2, 8, 30]))) for k in range(25)] + [(90, None), (91, "..."), (92, "unseen words"), (1, "w0 W0 w1")]
    assert _searched(spark, docs, items) == _ranked(docs, items)


def test_search_of_empty_tables(spark):
    assert _searched(spark, [], [(1, "a")], 1) == [] and _searched(spark, [(1, "a")], []) == [] and _searched(spark, [(1, None)], [(1, "a")]) == []


def test_items_in_batches(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 2)
    docs, items = [(k, f"a{k % 5} b c{k}") for k in range(30)], [(k, f"a{k} c{k}") for k in range(5)]
    assert _searched(spark, docs, items) == _ranked(docs, items)


def test_blocks_round_trip_and_stay_closed():
    docs, counts = np.array([3, 4, 70000, 70001]), np.array([1, 300, 1, 2])
    assert [x.tolist() for x in lexical.unpack(lexical.pack(docs, counts))] == [docs.tolist(), counts.tolist()]
    assert lexical.unbeaten(np.array([1, 5, 5, 2]), np.array([9, 9, 8, 3])).tolist() == [2, 3, 5, 8]
    size = np.full(4096, 80)
    make = lambda docs, w: (b := [docs[a : a + 8] for a in range(0, len(docs), 8)]) and lexical._List([x[0] for x in b], [x[-1] for x in b], [w * (10**9 // 1080)] * len(b), [lexical.pack(np.array(x), np.ones(len(x), np.int64)) for x in b], w, size)
    common, rare = make(list(range(4096)), 10), make([5, 1000, 3000], 9000)
    heap, seen = [], []
    lexical.wand([common, rare], heap, 2, list(range(4096)), True, seen)
    assert sorted(e[3] for e in heap) == [5, 1000] and len(common.open) <= 4 and len(seen) <= 6


def test_all_pairs_of_scores_tie_by_id(spark):
    docs = [(k, "same words here") for k in itertools.chain(range(40, 20, -1), range(20))]
    assert [r[2] for r in sorted(_searched(spark, docs, [(1, "words")], 4), key=lambda r: r[1])] == list(range(10))
