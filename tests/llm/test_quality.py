"""Ordinal regression: gradients by way of recovered thresholds, held-out quality, odd rows."""

import numpy as np
import pytest

from torquelog.llm import quality as q


def test_query_on_held_out_documents(spark, directory):
    directory = directory.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in q.query(spark, directory).collect()}
    assert len(rows) == spark.read.parquet(f"{directory}/documents.parquet").count()
    for r in rows.values():
        assert 0 <= r["tail_2"] <= r["tail_1"] <= 1
        assert r["expected_grade"] == pytest.approx(r["tail_1"] + r["tail_2"])
        assert r["keep"] == (r["tail_2"] >= q.TAIL)
    labels = q.graded(spark.read.parquet(f"{directory}/labels.parquet")).collect()
    held = [(x["grade"], rows[x["doc_id"]]["keep"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    clean = [keep for grade, keep in held if grade == 2]
    assert sum(clean) / len(clean) > 0.95
    junk = [keep for grade, keep in held if grade == 0]
    assert sum(junk) <= 0.2 * len(junk)


def test_fit_recovers_thresholds_and_shared_weights():
    rng = np.random.default_rng(1)
    n, true_w, cuts = 6000, np.array([1.5, -2.0, 0.7]), np.array([-1.0, 0.5, 2.0])
    has = rng.random((n, 3)) < 0.5
    score = has @ true_w
    u = rng.random(n)
    tails = 1 / (1 + np.exp(cuts - score[:, None]))
    grade = (u[:, None] < tails).sum(axis=1)
    first = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    model = q.fit(np.nonzero(has)[1] + 10, first, grade, 4, steps=600)
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.allclose(model.weights[10:13], true_w, atol=0.25)
    assert np.allclose(model.thresholds, cuts, atol=0.25)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Good words here", "", "bad!! bad!! BAD", "bad!! bad!! BAD", "é ü"]
    alone = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        alone.append(q.features(raw, np.array([0, len(raw)]))[0].tolist())
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    buckets, first = q.features(raw, at)
    assert [buckets[a:b].tolist() for a, b in zip(first, first[1:])] == alone
    assert alone[2] == alone[3]


def test_odd_rows_and_selection(spark, odd, no_docs):
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(100, 140)] + [(None, 1, 0), (4, None, 1), (100, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    grades = q.graded(labels)
    assert {r["doc_id"]: r["grade"] for r in grades.collect()}[102] == 0
    assert 4 not in {r["doc_id"] for r in grades.collect()}
    model = q.train(odd, grades)
    rows = q.score(odd, model).collect()
    assert len(rows) == odd.count()
    same = {r["expected_grade"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1  # a null text is an empty one
    kept = q.select(odd, model)
    assert kept.columns == odd.columns
    want = sum(r["tail_2"] >= q.TAIL for r in rows)
    assert kept.count() == want
    assert q.select(no_docs, model).count() == 0


def test_without_labels_every_document_stays(spark, odd):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = q.train(odd, none)
    assert q.select(odd, model).count() == odd.count()


def test_training_rows_are_bounded(spark, odd):
    grades = spark.createDataFrame([(i, i % 3) for i in range(100, 140)], "doc_id long, grade int")
    first = q.train(odd, grades, max_rows=10)
    again = q.train(odd, grades, max_rows=10)
    assert np.array_equal(first.weights, again.weights)


