import zlib

import pandas as pd
from pyspark.sql import functions as F

from civicframe.llm import language_id as L

EN = "the and that with from have this will your which their about would there"
FR = "le la les des une est dans pour que avec sur pas plus être très élève"


def samples(n=60):
    rows = []
    for i in range(n):
        rows.append((i, " ".join(EN.split()[i % 9 :] + EN.split()[: i % 5]), "en"))
        rows.append((1000 + i, " ".join(FR.split()[i % 9 :] + FR.split()[: i % 5]), "fr"))
    return rows


def test_learns_and_rejects(spark):
    docs = spark.createDataFrame([(*r, 9) for r in samples()] + [(5000, None, "en", 9), (5001, "123 !", None, 9), (5002, "", "fr", 9)], "doc_id long, text string, lang string, language int")
    model = L.learn(docs)
    assert model["names"] == ["en", "fr"] and 0 < model["threshold"] <= 1
    got = L.identify(docs, model, out="found").select("doc_id", "lang", "language", "found.*").toPandas().set_index("doc_id")
    assert (got.lang_pred[got.index < 5000] == got.lang[got.index < 5000]).all() and got.score.between(0, 1).all()
    assert (got.lang_pred[got.index >= 5000] == "und").all() and not got.accepted[got.index >= 5000].any()
    assert L.learn(docs)["temperature"] == model["temperature"]


def test_held_out_accuracy(spark):
    """The query on the given tables: rows that it has not learnt from."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = L.op2_language_id(spark, folder).alias("g").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got)
    known = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(known) > 100 and sum(r.lang == r.lang_pred for r in known) >= 0.98 * len(known)


def test_odd_tables(spark):
    docs = spark.createDataFrame([*samples(20), (3, "the and that", "en"), (3, "le la les", "fr")], "doc_id long, text string, lang string")
    model = L.learn(docs.union(docs))
    again = L.learn(docs.repartition(5).union(docs))
    assert (model["logits"] == again["logits"]).all()  # of repeated identifiers the same one, whatever the order
    assert L.learn(docs.limit(0)) is None and L.identify(docs.limit(0), model).count() == 0
    out = L.identify(docs.union(docs).withColumn("language", F.lit("own")), model)
    assert out.columns == ["doc_id", "text", "lang", "language", "language_"] and out.count() == 2 * docs.count()
    long = spark.createDataFrame([(i, EN * 2000 if i % 2 else FR * 2000, "en" if i % 2 else "fr") for i in range(12)], "doc_id long, text string, lang string")
    assert L.learn(long, sample=10)["names"] == ["en", "fr"]


def test_no_labels_and_blocks(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert L.learn(docs) is None
    assert L.predict(None, ["text", None]).lang_pred.tolist() == ["und", "und"]
    model = L.train([r[1] for r in samples()], [r[2] for r in samples()])
    one = pd.concat([L.predict(model, [t]) for t in (EN * 400, FR, "É")], ignore_index=True)
    assert one.equals(L.predict(model, [EN * 400, FR, "É"])) and one.lang_pred[0] == "en"
