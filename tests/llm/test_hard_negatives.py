"""Hard negatives against a plain search, the bounds, and odd vectors."""

import math
import random

import duckdb
import numpy as np
import pytest

import check
from torquelog.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, id int, name string, p int, s string, score int"


def brute(rows, anchors, positives=5, negatives=10, least=30, most=90):
    taken = {
        (k, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for k, v, label in rows
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for key, label, v in taken:
        if key is None or not anchors(key):
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w)), k is None, k or 0, k, other)
            for k, other, w in taken
            if len(v) == len(w) and (k is None or k != key)
        ]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:positives]:
            kept = [s for s in scored if s[4] != label and least * -p[0] <= 100 * -s[0] <= most * -p[0]]
            out += [(key, p[3], i + 1, s[3], -p[0], -s[0]) for i, s in enumerate(kept[:negatives])]
    return sorted(out, key=repr)


def found(df):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def odd_vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.4 * (i % 3), 0.5) for _ in range(20)], i % 4) for i in range(220)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (None, rows[5][1], 2), (None, None, None)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 20, 1), (303, [float("inf")] * 20, 2)]
    rows += [(304, rows[1][1], None), (305, [], 1), (306, [], 2), (307, [], 1), (308, [0.0] * 20, 1)]
    rows += [(400 + i, rows[7][1], i % 2) for i in range(60)]  # copies tie by key
    rows += [(500 + i, [0.5, -0.25 * i, 0.125], i % 2) for i in range(9)] + [(10, rows[8][1], 3)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(*r, 1, "x", 1, "x", 1) for r in odd_vectors()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_odd_vectors(vectors):
    from pyspark.sql import functions as F

    got = found(h.mine(vectors, F.col("id") % 5 == 0))
    want = brute(odd_vectors(), lambda k: k % 5 == 0)
    assert len(want) > 500 and got == want


def test_many_blocks_give_the_same(vectors, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(h, "BLOCK", 40)
    monkeypatch.setattr(h, "ANCHORS", 9)
    got = found(h.mine(vectors, F.col("id") % 10 == 0, positives=3, negatives=4, least=10, most=95))
    assert got == brute(odd_vectors(), lambda k: k % 10 == 0, 3, 4, 10, 95)


def test_bounds_hold_and_get_closer():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(50, 37)))
    a = np.floor(256 * rng.normal(size=37))
    s, ours = h.summaries(x), h.summaries(a[None])[0]
    exact, last = x @ a, np.inf
    for cut in h._edges(37, h.CUTS):
        middle = s[:, cut][:, 0::2] @ ours[cut][0::2]
        reach = s[:, cut][:, 1::2] @ ours[cut][1::2]
        assert (np.abs(exact - middle) <= reach + 1e-6).all()
        assert reach.mean() < last
        last = reach.mean()


def test_filter_rules_vectors_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 4
    x = np.floor(256 * np.repeat(np.repeat(centres, 4, axis=1), 30, axis=0))  # flat segments
    norms, s = np.sqrt((x**2).sum(axis=1)), h.summaries(x)
    may = h.survivors(x[0], s[0], norms[0], s, norms, h._edges(64, h.CUTS), np.arange(600), 5, -np.inf, np.inf)
    scores = x @ x[0]
    best = np.sort(scores)[-5]
    assert set(np.flatnonzero(scores >= best)) <= set(may) and len(may) <= 60


def test_large_scores_are_exact():
    a = np.array([2.0**31 + 1, 3.0])
    assert h.exact(a, np.array([[2.0**30 + 1, 5.0]]), 2.0**32, 2.0**31)[0] == (2**31 + 1) * (2**30 + 1) + 15


def test_empty_table(spark):
    assert h.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, directory):
    got = h.query(spark, directory).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{directory}/embeddings.parquet'")
    assert check.rows_of(got) == check.rows_of(con.execute(h.SQL).fetchdf()) and len(got)
