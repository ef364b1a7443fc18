"""Decontamination against a search for every window in every text."""

import hashlib
import random
import re

import numpy as np
import pytest

from torquelog.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))


def brute(docs, items, window=10):
    windows, longest = {}, []
    for item, text in items:
        w = words_of(text)
        longest.append((item or "", w))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item or "")
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def digest(rows):
    return sorted((tuple(r)[:6] for r in rows), key=repr)


def test_query(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet").collect()
    items = spark.read.parquet(f"{directory}/benchmark.parquet").collect()
    want = brute([(d["doc_id"], d["text"]) for d in docs], [(str(i["item_id"]), i["text"]) for i in items])
    assert digest(dec.query(spark, directory).collect()) == sorted(want, key=repr)
    assert any(r[5] for r in want)


ITEMS = [
    ("1", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"),
    ("2", "One"),
    ("3", "漢字 text"),
    ("4", None),
    ("5", "... !"),
    (None, "a b c"),
    ("7", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"),
    ("1", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"),
]


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_odd_rows(spark, odd, block):
    tests = spark.createDataFrame(ITEMS, "item_id string, text string")
    more = spark.createDataFrame(
        [(900, "x W1 w2,w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 one"), (901, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w3 w4")],
        "doc_id long, text string",
    )
    docs = odd.select("doc_id", "text").union(more)
    found = dec.find_matches(docs, tests, block_bytes=block).collect()
    want = brute([(d["doc_id"], d["text"]) for d in docs.collect()], ITEMS)
    got = [
        (
            r["doc_id"],
            r["_n"],
            sum(x["end"] - x["start"] for x in r["_runs"]),
            len(r["_items"]),
            hashlib.sha256(",".join(sorted(r["_items"])).encode()).hexdigest(),
            bool(r["_runs"]),
        )
        for r in found
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    best = {r["doc_id"]: r["_longest"] for r in found}
    assert (best[900]["words"], best[900]["place"]) == (12, 1)
    assert (best[901]["words"], best[901]["place"]) == (10, 0)


def test_affected_documents_go_and_the_rest_keep_their_columns(spark, odd):
    tests = spark.createDataFrame(ITEMS, "item_id string, text string")
    left = dec.decontaminate(odd, tests)
    assert left.columns == odd.columns
    keys = {r["doc_id"] for r in left.collect()}
    assert not {9, 10, 11} & keys and {1, 2, 3, 4, 5, 7, 8, None} <= keys


def test_empty_tables(spark, odd, no_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert not any(r["contaminated"] for r in dec.report(odd, none).collect())
    assert dec.decontaminate(odd, none).count() == odd.count()
    assert dec.report(no_docs, none).count() == 0


def test_suffix_array_is_sorted_and_search_finds_all_places():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(6)]
    text = " ".join(rng.choice(vocabulary) for _ in range(400))
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6)))) for i in range(20)]
    index = dec.index_items(items, window=3)
    h = dec.words.hash_of(text)
    numbers = np.searchsorted(index.vocabulary, h) + 1
    places, columns = dec.suffix_array(numbers, np.full(len(numbers), len(numbers)), index)
    assert columns.tolist() == sorted(columns.tolist())
    low, high = dec.search(columns, index)
    for r in range(len(index.table)):
        need = index.needs[r]
        window = index.table[r, :need].tolist()
        want = [p for p in range(len(numbers) - need + 1) if numbers[p : p + need].tolist() == window]
        assert sorted(places[low[r] : high[r]].tolist()) == want


def longest_match(text, items, window):
    """(words, place, item) by all places of all items; only whole items may be below a window."""
    w, best = words_of(text), []
    for item, t in items:
        v = words_of(t)
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n and (n >= window or n == len(v)):
                    best.append((-n, i, item or ""))
    return (-min(best)[0], *min(best)[1:]) if best else None


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_longest_match_along_every_place_of_a_window(spark, block):
    head = " ".join(f"h{i}" for i in range(4))
    items = [("a", f"{head} x"), ("b", f"{head} y z {head} q r s"), ("c", f"{head} y z {head} q t"), ("d", "h0 h1")]
    rng = random.Random(3)
    items += [(f"r{i}", " ".join(rng.choice("uvw") for _ in range(rng.randrange(2, 15)))) for i in range(12)]
    docs = [(0, f"{head} y z {head} q r k"), (1, f"k {head} q t t"), (2, f"{head} q r s h0 h1"), (3, "h0 h1 h2")]
    docs += [(10 + i, " ".join(rng.choice("uvw") for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    tests = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["_longest"] for r in dec.find_matches(frame, tests, window=4, block_bytes=block).collect()}
    for key, text in docs:
        want = longest_match(text, items, 4)
        assert (tuple(got[key]) if got[key] else None) == want
