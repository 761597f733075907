"""Every stage's rows against a plain version of it, on all rows that its predecessor kept."""

import re
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_chunks import brute

import corpus_pipeline
from tidesignal.llm import common, gam, queries


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def one_of_each_class(rows):
    """Ids that stay: those without words, and the smallest id of each component of links at 4 of 5 shingles."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k for k in ids if not sets[k] or top(k) == k}


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, small):
    """name -> (documents before, rows after)"""
    docs, out = common.table(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, docs, small), f"test-{name}")
        out[name] = (docs, after)
        if name != "tokens":
            assert after.columns == docs.columns
        docs = after
    return out


def test_quality_keeps_what_the_classifier_accepts(spark, small, stages):
    before, after = stages["quality"]
    score = {r["doc_id"]: r["score"] for r in gam.classify(before, gam.fit(before, common.table(spark, small, "labels"))).collect()}
    rows, kept = by_id(before), by_id(after)
    assert len(rows) == before.count() and kept == {k: r for k, r in rows.items() if score[k] >= gam.THRESHOLD}
    assert 0 < len(kept) < len(rows)


def test_near_duplicates_keep_one_of_each_class(stages):
    before, after = stages["near_duplicates"]
    rows = by_id(before)
    want = one_of_each_class([(k, r["text"]) for k, r in rows.items()])
    assert len(want) < len(rows) and by_id(after) == {k: rows[k] for k in want}


def test_passages_are_cut_as_one_table_of_chunks_says(stages):
    before, after = stages["passages"]
    rows = by_id(before)
    cut = brute(sorted((k, r["text"]) for k, r in rows.items()))
    want = {k: r | {"text": cut[k], "n_chars": None if cut[k] is None else len(cut[k])} for k, r in rows.items()}
    assert by_id(after) == want


def test_mixture_is_what_its_sql_gives(stages):
    before, after = stages["mixture"]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    want = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op10_temperature_mix'].strip().rstrip(';')})").fetchall())
    rows = by_id(before)
    got = after.collect()
    assert Counter(r["doc_id"] for r in got) == want and all(r.asDict() == rows[r["doc_id"]] for r in got)
    assert set(want) == set(rows)


def test_tokens_are_those_of_the_library(stages):
    before, after = stages["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    want = Counter((r["doc_id"], None if r["text"] is None else tuple(library.encode(r["text"]))) for r in before.collect())
    got = after.collect()
    assert Counter((r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"] or []) for r in got)


def test_odd_documents_go_through_every_stage(spark, small, make_docs):
    long = " ".join(f"word{k % 997}x{k}" for k in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, long, None), (4, "the same short text of nine words in all", "b"), (4, "the same short text of nine words in all", "b"), (None, "a text without a key of its own", "b"), (5, long, "a")]
    docs = make_docs(rows).withColumn("n_shingles", F.lit(7)).withColumn("tokens", F.lit("x")).withColumn("_d", F.lit(None).cast("string")).withColumn("score", F.lit(0.5))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality":  # what it rejects is the model's affair
            assert set(stage(spark, docs, small).columns) == set(docs.columns)
            continue
        after = common.materialize(stage(spark, docs, small), f"test-odd-{name}")
        assert name == "tokens" or after.columns == docs.columns
        seen[name] = Counter(r["doc_id"] for r in after.collect())
        docs = after
    assert seen["near_duplicates"] == seen["passages"] == Counter([1, 2, 3, 4, 4, None])  # 5 equals 3; a repeated row stays; null texts and keys too
    assert set(seen["mixture"]) == set(seen["tokens"]) == {1, 2, 3, 4, None} and seen["mixture"] == seen["tokens"]
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got[1]["ids"] is None and got[2]["ids"] == [] and got[3]["n_tokens"] > 60_000


def test_empty_documents(spark, small):
    docs = common.table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
