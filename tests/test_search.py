"""Hashed vector search against the exact one."""

import numpy as np
import pytest

from torquelog.operators import search, similarity

SCHEMA = "id bigint, v array<double>"


def clusters(rows=3000, size=24, seed=3):
    """Vectors around 60 centres, none of them near the origin."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, size)) + 0.5
    points = centres[rng.integers(0, 60, rows)] + 0.25 * rng.standard_normal((rows, size))
    return [(i, p.tolist()) for i, p in enumerate(points)]


def test_recall_of_the_index(spark):
    rows = clusters()
    df = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([r for r in rows if r[0] % 50 == 0], "query bigint, vector array<double>")
    index = search.hyperplane_index(df, "id", "v")
    found = search.search(index, queries, 10).cache()
    exact = similarity.nearest_vectors(df, "id", "v", queries, 10).withColumnRenamed("id", "key")
    assert search.recall(found, exact) >= 0.9
    assert search.recall(exact, exact) == 1.0
    # a query meets a part of the rows only
    asked = search._units(queries, "query", "vector").withColumnRenamed("key", "query")
    places = search._places(asked, "query", "query bigint", index.mean, index.tables, index.bits, index.seed, 3)
    met = places.join(index.buckets, ["table", "bucket"]).select("query", "id").distinct().count()
    assert met < 0.7 * queries.count() * len(rows)
    # what is found is scored exactly and ranked
    by_row = {(r["query"], r["key"]): r["score"] for r in exact.collect()}
    for row in found.collect():
        assert row["score"] == by_row.get((row["query"], row["key"]), row["score"])
        assert 1 <= row["rank"] <= 10


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(50, [2.0, 0.0]), (60, [0.0, 1.0])]
    rows += [(70, None), (71, [0.0, 0.0]), (72, [1.0, None]), (73, [float("nan"), 1.0]), (74, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [(1, [3.0, 0.0]), (2, [0.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])]
    queries = spark.createDataFrame(asked, "query bigint, vector array<double>")
    index = search.hyperplane_index(df, "id", "v")
    assert index.vectors.count() == 2 and index.copies.count() == 42
    got = {}
    for r in search.search(index, queries, 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"], r["score"]))
    assert sorted(got) == [1, 2]
    assert sorted(got[1]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert sorted(got[2])[0] == (1, 60, 1.0)


@pytest.mark.parametrize("empty", ["rows", "queries"])
def test_empty_tables(spark, empty):
    some = [(1, [1.0, 2.0])]
    df = spark.createDataFrame([] if empty == "rows" else some, SCHEMA)
    queries = spark.createDataFrame([] if empty == "queries" else some, "query bigint, vector array<double>")
    found = search.search(search.hyperplane_index(df, "id", "v"), queries, 3)
    assert found.columns == ["query", "key", "score", "rank"] and found.collect() == []


@pytest.mark.parametrize("part", [4096, 7])
def test_a_bucket_hands_on_its_best_only(spark, monkeypatch, part):
    monkeypatch.setattr(search, "PART", part)
    rows = [(i, [1.0, i / 100]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(7, [1.0, 0.5])], "query bigint, vector array<double>")
    index = search.hyperplane_index(df, "id", "v", tables=2, per_bucket=200)
    asked = search._units(queries, "query", "vector").withColumnRenamed("key", "query")
    places = search._places(asked, "query", "query bigint", index.mean, 2, index.bits, index.seed, 3)
    assert search._met(places, asked, index, 2, "query bigint").count() < 150
    found = search.search(index, queries, 2).collect()
    exact = similarity.nearest_vectors(df, "id", "v", queries, 2).collect()
    assert sorted((r["key"], r["score"], r["rank"]) for r in found) == sorted((r["id"], r["score"], r["rank"]) for r in exact)
