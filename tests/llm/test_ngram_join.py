"""The similarity join against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from torquelog.llm import ngram_join as nj


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def brute(docs, n=4, percent=85):
    """{doc_id: (n_shingles, component_id)} for documents whose keys differ."""
    sets = {}
    for key, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
        sets[key] = runs
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def check(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = nj.similar_groups(frame, **options).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(docs)
    assert got == brute(docs, **options)
    return got


def family(rng, size, words, edits):
    """Copies of one text, each with some words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed, edits", [(1, 2), (2, 6), (3, 12)])
def test_families_at_the_threshold(spark, seed, edits):
    rng = random.Random(seed)
    texts = family(rng, 60, 120, edits) + family(rng, 25, 60, edits) + family(rng, 10, 9, 1)
    shared = " ".join(f"s{i}" for i in range(12))
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))) for _ in range(80)]
    rng.shuffle(texts)
    got = check(spark, list(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len(texts)


def test_chain_is_one_component(spark):
    words = [f"c{i}" for i in range(140)]
    docs = [(100 - i, " ".join(words[i : i + 100])) for i in range(0, 40, 4)]
    got = check(spark, docs)
    assert len({c for _, c in got.values()}) == 1


def test_very_common_shingles(spark):
    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(9))
    docs = [(i, f"{line} " + " ".join(f"q{rng.randrange(300)}" for _ in range(rng.randrange(0, 4)))) for i in range(150)]
    check(spark, docs)


@pytest.mark.parametrize("n, percent", [(5, 80), (1, 50), (2, 100)])
def test_other_parameters(spark, n, percent):
    rng = random.Random(n)
    docs = list(enumerate(family(rng, 25, 40, 6) + ["a", "a b", "A B", "a b c"]))
    check(spark, docs, n=n, percent=percent)


@pytest.mark.parametrize("rounds", [0, 1])
def test_rounds_of_pivots_do_not_change_the_result(spark, monkeypatch, rounds):
    monkeypatch.setattr(nj.link, "__defaults__", (rounds,))
    rng = random.Random(4)
    check(spark, list(enumerate(family(rng, 40, 80, 5) + family(rng, 20, 30, 3))))


def test_texts_are_cut_into_words_once(spark):
    docs = list(enumerate(family(random.Random(5), 30, 60, 4)))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = nj.similar_groups(frame.mapInArrow(counted, frame.schema)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs)
    assert read.value == len(docs)


def test_few_pairs_of_a_large_loose_group_are_left_to_the_last_round(spark, monkeypatch):
    left, of = [], nj.pairs_across
    monkeypatch.setattr(nj, "pairs_across", lambda *args: left.append(of(*args).count()) or of(*args))
    check(spark, list(enumerate(family(random.Random(6), 250, 130, 3))))
    assert sum(left) < 250 * 249 / 2 / 8


def test_odd_rows(spark, odd, no_docs):
    rows = nj.similar_groups(odd).collect()
    assert len(rows) == odd.count()
    single = [tuple(r) for r in odd.select("doc_id", "text").collect() if r["doc_id"] not in (None, 13)]
    want = brute(single)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert {k: got[k] for k in want} == want
    assert got[5][1] == 4 and got[6][1] == 4 and got[10][1] == 9
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert nj.similar_groups(no_docs).count() == 0


def test_query(spark, directory):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{directory}/documents.parquet").collect()]
    rows = nj.query(spark, directory).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs)


def test_one_of_each_group_stays(odd):
    left = nj.first_of_each(odd)
    assert left.columns == odd.columns
    keys = [r["doc_id"] for r in left.collect()]
    assert 4 in keys and 5 not in keys and 6 not in keys and 9 in keys and 10 not in keys
    assert keys.count(13) == 2 and keys.count(None) == 2


def test_components_of_any_graph(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(64)] + [(-5000, 1000 + i) for i in (3, 40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = nj.components(spark.createDataFrame(edges, "x long, y long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["d"]: r["label"] for r in got} == {x: find(x) for x in linked}
    assert len(got) == len(linked)


def test_bit_filter_lets_all_members_through(spark):
    values = spark.range(-500, 500).selectExpr("xxhash64(id) AS v")
    bits = nj.bit_filter(values, "v")
    import numpy as np

    inside = np.array([r["v"] for r in values.collect()], np.int64)
    assert nj._in_filter(bits, inside).all()
    other = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 10000)
    assert nj._in_filter(bits, other).mean() < 0.01


def test_a_copy_takes_no_other_text_of_its_key_along(spark):
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, "a text of its own"), (None, base + " y"), (None, "no key"), (None, None)]
    left = nj.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)


def test_a_pair_is_made_once_however_many_shingles_it_shares(spark, monkeypatch):
    rows = [(s, d, 1 if d <= 30 else d, 10, 10 - s) for s in range(10) for d in range(1, 41)]
    frame = spark.createDataFrame(rows, "shingle long, d long, label long, n long, rest long")
    monkeypatch.setattr(type(frame), "distinct", lambda self: self)
    got = [tuple(r) for r in nj.pairs_across(frame, 85).collect()]
    want = {(x, y) for y in range(31, 41) for x in range(1, y)}
    assert set(got) == want and len(got) == len(want)


def test_filters_and_tables_of_little_data_are_small(spark):
    from torquelog.llm import words

    few = spark.range(1000).selectExpr("xxhash64(id) AS v")
    assert nj.bit_filter(few, "v").nbytes <= 1 << 18
    words._powers.clear()
    assert words._power_tables(1000)[0].size <= (1 << 16) + 1
    before = [t.copy() for t in words._power_tables(1000)]
    words._power_tables(words.CHUNK)
    assert all((a == b[: len(a)]).all() for a, b in zip(before, words._power_tables(1000)))


def test_tasks_get_few_sets_at_a_time(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, of = spark.conf.get(name), nj.verify
    monkeypatch.setattr(nj, "verify", lambda *args: seen.append(spark.conf.get(name)) or of(*args))
    check(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c")], percent=50)
    assert seen and max(map(int, seen)) <= nj.BATCH and spark.conf.get(name) == before


def test_sets_are_stored_in_less_than_their_hashes():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 490, 500, 3000]
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in sizes]
    sets[1] = np.array([0, (1 << 64) - 1], np.uint64)
    h, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    with_empty = np.insert(first, 2, first[2])  # an empty set takes no place
    high, low = nj.packed(h, with_empty)
    assert np.array_equal(nj.unpacked(high, low, first), h)
    for a, b in zip(first[:-1], first[1:]):  # each alone, as a pair is compared
        assert np.array_equal(nj.unpacked(high[a:b], low[a:b], np.array([0, b - a])), h[a:b])
    size = sum(len(pa.compress(x.tobytes(), "zstd", asbytes=True)) for x in (high, low))
    assert size < 0.93 * h.nbytes < len(pa.compress(h.tobytes(), "zstd", asbytes=True))
