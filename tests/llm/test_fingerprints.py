"""Fingerprints: the edit, equality, and likeness against generalised Jaccard similarity."""

import hashlib
from collections import Counter, defaultdict

import pytest

from torquelog.llm import fingerprints as fp


def jaccard(a, b):
    blank = str.maketrans(fp.SPACES, " " * len(fp.SPACES))
    a, b = (Counter(w for w in t.lower().translate(blank).split(" ") if w) for t in (a, b))
    greater = sum((a | b).values())
    return sum((a & b).values()) / greater if greater else 1.0


def edits(docs):
    """[(doc_id, text, edited, next text)] for documents whose keys differ."""
    rows = sorted(((k, t or "") for k, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        out.append((key, text, text[: len(text) - k] + following[:k], following))
    return out


def check(rows, docs):
    by = {r["doc_id"]: r for r in rows}
    errors = defaultdict(list)
    for key, text, edited, following in edits(docs):
        r = by[key]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (edited == text) <= (r["near_edited"] == 1.0)
        errors["edited"].append(r["near_edited"] - jaccard(text, edited))
        errors["next"].append(r["near_next"] - jaccard(text, following))
        if jaccard(text, following) == 0:
            assert r["near_next"] == 0
    return {k: (sum(v) / len(v), (sum(x * x for x in v) / len(v)) ** 0.5) for k, v in errors.items()}


def test_query(spark, directory):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{directory}/documents.parquet").collect()]
    rows = fp.query(spark, directory).collect()
    assert len(rows) == len(docs)
    for mean, deviation in check(rows, docs).values():
        assert abs(mean) < 0.025 and deviation < 0.12
    prints = defaultdict(set)
    texts = dict(docs)
    for r in rows:
        prints[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_samples_agree_with_the_chance_of_the_similarity(spark):
    a = [("x", 5, 3), ("y", 1, 2), ("z", 2, 0), ("v", 0, 4), ("u", 7, 7)]
    want = sum(min(p, q) for _, p, q in a) / sum(max(p, q) for _, p, q in a)
    rows = spark.createDataFrame([(0, *r) for r in a], "g int, word string, w long, v long")
    got = fp.signatures(rows.selectExpr("g", "xxhash64(word) AS term", "w", "v"), ["g"], ["w", "v"], 4000).first()
    agree = sum(p == q for p, q in zip(got["w"], got["v"])) / 4000
    assert agree == pytest.approx(want, abs=0.035)


def test_odd_rows(spark, odd, no_docs):
    single = odd.where("doc_id is not null and doc_id <> 13")
    rows = fp.compare_with_edits(single).collect()
    assert len(rows) == single.count()
    check(rows, [tuple(r) for r in single.select("doc_id", "text").collect()])
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == ""
    assert by[4]["fingerprint"] == by[5]["fingerprint"] != ""
    assert by[2]["near_next"] == 1.0  # the next one has no words either
    assert fp.compare_with_edits(no_docs).count() == 0


def test_repeated_rows_and_null_keys(odd):
    rows = fp.compare_with_edits(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    twice = [r for r in rows if r["doc_id"] == 13]
    assert twice[0] == twice[1]


def test_fingerprints_alone(odd):
    rows = fp.fingerprint(odd).collect()
    assert len(rows) == odd.count()
    both = {r["doc_id"]: r["fingerprint"] for r in fp.compare_with_edits(odd).collect()}
    assert all(both[r["doc_id"]] == r["fingerprint"] for r in rows if r["doc_id"] is not None)
