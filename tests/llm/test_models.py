"""Held-out accuracy of the trained operators, and their edge cases."""

from pyspark.sql import functions as F

from tidesignal.llm import gam, langid
from tidesignal.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op8_quality_gam"](spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality is not null")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert len(rows) > 30
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert right >= 0.75 and auc >= 0.8, (right, auc)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_edges(spark, make_docs):
    docs = make_docs([None, "", "word", "w " * 100_000])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    rows = gam.classify(docs, gam.fit(docs, empty)).collect()
    assert [r["score"] for r in rows] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = gam.fit(docs, labels)
    assert gam.classify(docs, model).count() == 4 and gam.classify(make_docs([]), model).count() == 0
    kept = gam.reject(docs.withColumn("score", F.lit("own")).withColumn("x", F.lit(1)), model, 0.0)
    assert kept.count() == 4 and kept.columns == [*docs.columns, "score", "x"] and {r["score"] for r in kept.collect()} == {"own"}


def test_language_on_held_out_rows(spark):
    got = QUERIES["op4_byte_cnn"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null")
    share = got.where("held_out and lang_pred != 'und'").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.95, share


def test_language_edges(spark, make_docs):
    docs = make_docs([None, "", "123 !?", "des mots", "\n"])
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    net = langid.fit(docs, F.lit(True))
    assert [r["lang_pred"] for r in langid.predict(docs, net).orderBy("doc_id").collect()] == ["und", "und", "und", "x", "und"]
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None


def test_language_with_letterlike_numbers_ties_and_hot_keys(spark, make_docs):
    docs = make_docs(["² ½ ①", "² a"]).union(make_docs([(7, "mots de la", "s")] * 500)).withColumn("score", F.lit("own"))
    net = langid.fit(docs, F.lit(True))
    got = langid.predict(docs, net).collect()
    assert [r["lang_pred"] for r in got[:2]] == ["und", "x"] and len(got) == 502
    assert langid.predict(docs.limit(0), net).count() == 0 and langid.fit(docs.limit(0), F.lit(True)) is None


def test_training_keeps_every_language_and_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda x, y, langs: seen.update(x=x, y=y, langs=langs))
    rows = [(k, "word " * (10 + 400 * (k == 3)), "abcdefghij"[k % 10]) for k in range(200)] + [(5, "again " * 5, "z")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs, F.lit(True), n_docs=100)
    assert len(set(seen["y"].tolist())) == 10 and len(seen["langs"]) == 10
    langid.fit(docs, F.col("doc_id") == 3)
    assert len(seen["x"]) == 9  # 2,050 bytes in windows of 256, all of them
