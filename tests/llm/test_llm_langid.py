import base64
import random

import pytest
from cases import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from notelattice.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    assert len(set(model.labels)) == 4 and len(model.labels) > 8
    got = langid.identify(docs, model, keep=("doc_id", "held_out", "lang")).where("held_out")
    n, right, out = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right / n > 0.99 and out == 0


def test_odd_documents(spark):
    docs = odd_documents(spark)
    model = langid.fit(docs, max_sample=100)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs, model).collect()}
    for i, text, *_ in TEXTS:
        if i in (3, 4, 6, 10):  # null, empty, no letter
            assert (i, "und", True) in got
        elif i in (1, 2, 5):
            assert (i, "en", False) in got
    scores = [r.score for r in langid.identify(docs, model, batch_bytes=10).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert sorted(scores) == sorted(r.score for r in langid.identify(docs, model).collect())


def test_other_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    other = spark.createDataFrame([(1, "Это совсем другой язык, и его никто не учил. " * 3)], "doc_id long, text string")
    assert langid.identify(other, model).first().rejected
    assert langid.identify(docs, model).where("rejected").count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.fit(no_documents(spark))
    assert {r.lang_pred for r in langid.identify(odd_documents(spark), model).collect()} == {"und"}
    assert langid.identify(no_documents(spark), model).count() == 0


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(200).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


UNLEARNED = [
    "A magyar nyelv szavai hosszúak, és az emberek minden reggel kávét isznak a városban, mielőtt dolgozni mennek. ",
    "Suomen kieli on kaunis ja ihmiset kävelevät metsässä joka päivä, koska he rakastavat luontoa ja hiljaisuutta. ",
    "Język polski jest trudny, ale ludzie w Warszawie mówią nim codziennie i czytają książki przed snem. ",
    "Türkçe konuşan insanlar her sabah çay içer ve gazete okur, sonra işe gitmek için otobüse binerler. ",
]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_unlearned_languages_and_noise_are_rejected(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = langid.fit(docs)
    draw = random.Random(3)
    texts = [t * 15 for t in UNLEARNED]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (300, 900, 1440)]
    texts += [base64.b64encode(draw.randbytes(n)).decode() for n in (300, 600, 1000)]
    texts += [t[:n] for t in texts[:4] for n in (250, 500, 900)]
    _, scores, out = model.predict(texts)
    assert all(out), (model.limits, scores, out)
    assert langid.identify(docs.where("lang is not null"), model).where("rejected").count() == 0
