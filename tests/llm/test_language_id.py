"""Language identification against plain naive Bayes on the same n-grams, and held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

from torquelog.llm import language_id as lid


def test_query_on_held_out_documents(spark, directory):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    rows = lid.query(spark, directory).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    right = sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held)
    assert right / len(held) > 0.95


def test_scores_are_those_of_naive_bayes(spark):
    train = [("aa ab", "x"), ("abab", "x"), ("zz zy", "y"), ("zyx", "y"), ("zz", "y")]
    docs = spark.createDataFrame(train, "text string, lang string")
    model = lid.train(docs)
    assert model.languages == ["x", "y"]
    counts = np.zeros((2, lid.BUCKETS))
    for text, lang in train:
        for row in lid.grams([text])[0]:
            np.add.at(counts[model.languages.index(lang)], row[row < lid.BUCKETS], 1)
    table = np.log((counts + lid.ALPHA) / (counts + lid.ALPHA).sum(axis=1, keepdims=True))
    assert np.allclose(table, model.log_probability)
    best, share, has = lid.posterior(model, ["abz", "zy", "a", ""])
    for i, text in enumerate(["abz", "zy", "a"]):
        score = [sum(t[b] for row in lid.grams([text])[0] for b in row if b < lid.BUCKETS) + math.log(n) for t, n in zip(table, (2, 3))]
        odds = np.exp(np.array(score) - max(score))
        assert best[i] == int(np.argmax(score)) and share[i] == pytest.approx(max(odds / odds.sum()))
    assert has.tolist() == [True, True, True, False]


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_texts_do_not_reach_into_each_other(monkeypatch, size):
    monkeypatch.setattr(lid, "CHARS", size)
    texts = ["abc", "", "Éa", "zzz zzz", "1 2"]
    alone = [lid.grams([t])[0].tolist() for t in texts]
    buckets, first, letters = lid.grams(texts)
    edges = [*first, buckets.shape[1]]
    assert [buckets[:, a:b].tolist() for a, b in zip(edges, edges[1:])] == alone
    assert letters.tolist() == [True, False, True, True, False]


def test_odd_rows(odd):
    model = lid.train(odd.where(~lid.fold()))
    assert model.languages == ["a", "b", "c", "en"]
    from pyspark.sql import functions as F

    rows = lid.predict(odd, model, F.col("doc_id"), lid.fold()).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for key in (1, 2, 3):  # null, empty, blank
        assert by[key]["lang_pred"] == "und" and by[key]["score"] == 0
    assert by[8]["lang_pred"] != "und"
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_no_language_to_learn(odd, no_docs):
    from pyspark.sql import functions as F

    model = lid.train(no_docs)
    assert model.languages == []
    rows = lid.predict(odd, model, F.col("doc_id"), lid.fold()).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert lid.predict(no_docs, model, F.col("doc_id"), lid.fold()).count() == 0
