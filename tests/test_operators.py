import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from torquelog import runtime
from torquelog.functions import text
from torquelog.operators import (
    association,
    classes,
    joins,
    keywords,
    metrics,
    ranking,
    records,
    rules,
    similarity,
    vocabulary,
)
from torquelog.plans import reports
from torquelog.runtime import fits, hot_keys, lookup_join, salted_join


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------------------------------ records


def test_asset_head(spark):
    df = spark.createDataFrame(
        [
            (1, "1234567890123", "0000000000001: Other :broken: door", None),
            (2, "bad", "1111111111111:Door:x", 4.0),
            (3, "2222222222222", "no colon", 1.0),
        ],
        "id int, asset_name string, work_description string, quantity double",
    )
    got = records.asset_head(df, ["quantity"], ["asset_name", "work_description"])
    assert rows(got, "id", "asset_name", "serial", "category", "description", "quantity") == [
        (1, "1234567890123", "0000000000001", "Other", "broken: door", 0),
        (2, "1111111111111", "1111111111111", "Door", "x", 4),
        (3, "2222222222222", "2222222222222", None, None, 1),
    ]


def test_claims_head(spark):
    base = ("Brand", "Parts", "M7a", "P1", "board", "1234567890123", "the door of the oven")
    variants = [
        base,
        ("BRAND", *base[1:]),
        ("other", *base[1:]),
        (*base[:2], None, *base[3:]),
        (*base[:3], None, *base[4:]),
        (*base[:3], "No part used", *base[4:]),
        (*base[:5], "12", base[6]),
        (*base[:6], "la porte du four"),
    ]
    names = "brand service_line_type model part_number part_description serial_number summary"
    df = spark.createDataFrame(
        [(i, *v) for i, v in enumerate(variants)],
        "i int, " + ", ".join(f"{n} string" for n in names.split()),
    )
    assert rows(records.claims_head(df, "brand", "Parts", "M7"), "i") == [(0,), (1,), (4,)]


def test_part_label(spark):
    df = spark.createDataFrame([("1", "door"), (" ", None), ("2", "")], "n string, d string")
    got = [r[0] for r in df.select(records.part_label("n", "d")).collect()]
    assert got == ["1 - door", "No part needed / no update", "2"]


# -------------------------------------------------------------------------------------------- joins


def test_unknown_part_leaves_other(spark):
    recs = spark.createDataFrame(
        [(1, "p", "Other"), (2, "q", "Other"), (3, "p", "Door"), (4, None, "Other")],
        "id int, part string, category string",
    )
    parts = spark.createDataFrame(
        [("p", "old", 1), ("p", "new", 2)], "part string, system string, pos int"
    )
    got = joins.category_from_part(recs, parts, "part", "category", "system", "pos")
    assert rows(got, "id", "category") == [(1, "new"), (2, "Other"), (3, "Door"), (4, "Other")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_takes_map_columns(spark, how):
    left = spark.createDataFrame([(i % 3, {"a": i}) for i in range(30)], "k int, m map<string,int>")
    right = spark.createDataFrame([(1,), (2,)], "k int")
    assert salted_join(left, right, ["k"], how).count() == left.join(right, ["k"], how).count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    want = left.join(right, ["k"], how)
    assert rows(salted_join(left, right, ["k"], how), *want.columns) == rows(want, *want.columns)
    for hot in ([], ['{"k":"hot"}'], ['{"k":"nowhere"}']):
        got = salted_join(left, right, ["k"], how, hot)
        assert rows(got, *want.columns) == rows(want, *want.columns)
    for everything in (False, True):
        got = lookup_join(left, right, ["k"], how, max_rows=1, salt_all=everything)
        assert rows(got, *want.columns) == rows(want, *want.columns)


def test_hot_keys(spark):
    df = spark.createDataFrame([(i if i % 3 else 0,) for i in range(3000)], "k int")
    assert hot_keys(df, ["k"], sample=1.0) == ['{"k":0}']


def test_lookup_join_refuses_other_kinds(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        lookup_join(df, df, ["id"], "right")


def test_fits(spark):
    assert fits(spark.range(10), 10)
    assert not fits(spark.range(11), 10)
    assert not fits(spark.range(100), 1000, max_bytes=50)
    assert fits(spark.range(0))


def test_parts_with_solutions(spark):
    parts = spark.createDataFrame([("1", "a"), (" 2", "b"), ("3", "c"), (None, "d")], "part string, name string")
    solutions = spark.createDataFrame([("1 ", "x"), ("1", "y"), ("2", "z"), ("9", "w"), (None, "v")], "sp string, s string")
    got = joins.parts_with_solutions(parts, solutions, "part", "sp")
    assert rows(got, "name", "s") == [("a", "x"), ("a", "y"), ("b", "z"), ("c", None), ("d", None)]


def test_anti_and_semi_make_all(spark):
    left = spark.createDataFrame([(i, i % 5) for i in range(40)], "i int, k int")
    right = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    a, b = joins.without(left, right, ["k"]), joins.only(left, right, ["k"])
    assert rows(a.unionByName(b), "i") == rows(left, "i")
    assert {r["k"] for r in b.collect()} == {1, 3}


def test_write_back(spark):
    df = spark.createDataFrame([(1, "Other"), (2, "Door")], "id int, c string")
    found = spark.createDataFrame([(1, "Fan")], "id int, c string")
    assert rows(joins.write_back(df, found, "id", "c"), "id", "c") == [(1, "Fan"), (2, "Door")]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_word_tables_of_any_size(spark, threshold):
    """Broadcast or shuffled, null and repeated keys, null lists and map columns: one answer."""
    data = [
        (1, ["a", "b", "a", "x"], {"k": 1}), (2, ["x"], None), (3, [], {}), (None, ["a", "x"], {}),
        (None, ["x", "b"], {}), (1, ["x", "a"], {}), (4, None, {}),
    ]
    df = spark.createDataFrame(data, "id int, t array<string>, m map<string,int>")
    vocab = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "word string")
    table = spark.createDataFrame([("a", "alpha one"), ("", "no")], "word string, expansion string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        kept = joins.keep_words(df, "id", "t", vocab)
        done = joins.expand_words(df, "id", "t", table)
        got = rows(kept, "id", "t"), rows(done, "id", "t")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def want(change):
        return sorted(((i, None if t is None else change(t)) for i, t, _ in data), key=repr)

    assert got[0] == want(lambda t: [w for w in t if w in "ab"])
    assert got[1] == want(lambda t: ["alpha one" if w == "a" else w for w in t])


# --------------------------------------------------------------------------------------- vocabulary


def test_own_vocabulary_equals_join(spark):
    rng = random.Random(1)
    pool = ["ab", "cd", "e9", "door", "oven", "the", "x", "if", "zz"]
    data = [(i, [rng.choice(pool) for _ in range(rng.randrange(6))]) for i in range(30)]
    data.append((99, ["qq", "yy", "rare"]))
    df = spark.createDataFrame(data, "id int, t array<string>")
    counts = Counter(w for _, t in data for w in t)
    vocab = {w for w, c in counts.items() if len(w) >= 3 or c >= 5} - {"the", "if"}
    got = vocabulary.keep_own_vocabulary(df, "id", "t")
    assert rows(got, "id", "t") == sorted(
        ((i, [w for w in t if w in vocab]) for i, t in data), key=repr
    )


def test_error_codes(spark):
    a = spark.createDataFrame([("E89",), (None,), (" e90 ",)], "code string")
    b = spark.createDataFrame([("e89",), ("W1",), ("",)], "code string")
    codes = vocabulary.error_codes([a, b], "code")
    assert rows(codes, "code") == [("e89",), ("e90",), ("w1",)]
    assert rows(vocabulary.bare_error_codes(codes), "word") == [("89",), ("90",)]


def test_codes_get_their_prefix_back(spark):
    df = spark.createDataFrame([(1, ["error", "89", "noise"])], "id int, t array<string>")
    words = spark.createDataFrame([("error",), ("89",)], "word string")
    bare = spark.createDataFrame([("89",)], "word string")
    got = vocabulary.correct_codes(df, "id", "t", words, bare)
    assert rows(got, "t") == [(["error", "E89"],)]


def _distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


@pytest.mark.parametrize("cutoff", [0.6, 0.8, 0.99])
def test_similar_words_against_brute_force(spark, cutoff):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
    asked, known = {make() for _ in range(40)}, {make() for _ in range(200)}
    known |= {w for w in list(asked)[:5]}
    want = []
    for a in asked:
        scored = [
            (round(1 - _distance(a, v) / max(len(a), len(v)), 6), v) for v in known
        ]
        best = sorted(((-s, v) for s, v in scored if s >= cutoff))[:3]
        want += [(a, v, -s) for s, v in best]
    got = vocabulary.similar_words(
        spark.createDataFrame([(w,) for w in asked], "word string"),
        spark.createDataFrame([(w,) for w in known], "word string"),
        cutoff, 3,
    )
    assert rows(got, "word", "match", "score") == sorted(want, key=repr)


# ------------------------------------------------------------------------------------------ ranking


def test_row_numbers_and_stratified_split(spark):
    data = [(i, "hot" if i % 3 else "rare") for i in range(600)] + [(1000, "one")]
    df = spark.createDataFrame(data, "id int, label string")
    numbered = ranking.row_numbers(df, "label", ranking.hash_share("id", 42), "id", pieces=16)
    for label, count in Counter(l for _, l in data).items():
        got = sorted(r["row_number"] for r in numbered.where(F.col("label") == label).collect())
        assert got == list(range(1, count + 1))
    split = ranking.stratified_split(df, "id", "label")
    tests = Counter(r["label"] for r in split.where("split = 'test'").collect())
    assert tests == {"hot": 80, "rare": 40}
    assert split.count() == len(data)


def test_random_split_is_disjoint_and_whole(spark):
    df = spark.range(1000)
    split = ranking.random_split(df, "id")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1000 and 150 < sizes["test"] < 250


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert rows(ranking.first_per_key(df, ["k"], "o"), "k", "o", "v") == [("a", 1, "y"), ("b", 3, "z")]


def test_top_labels(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3, 0.5],)], "p array<double>")
    got = df.select(ranking.top_labels(F.col("p"), ["a", "d", "c", "b"], 3).alias("t")).first()["t"]
    assert [(x["label"], x["prob"]) for x in got] == [("b", 0.5), ("d", 0.5), ("c", 0.3)]


# ----------------------------------------------------------------------------------------- keywords


def _corpus(spark, seed, groups=2, many=200):
    rng = random.Random(seed)
    pool = ["aa", "bb", "cc", "dd"]
    data = [
        (i, f"g{rng.randrange(groups)}", [rng.choice(pool) for _ in range(rng.randrange(6))])
        for i in range(many)
    ]
    return data, spark.createDataFrame(data, "id int, g string, t array<string>")


@pytest.mark.parametrize("span", [False, True])
def test_group_keywords(spark, span):
    data, df = _corpus(spark, 3)
    want = defaultdict(Counter)
    for g in ("g0", "g1"):
        texts = [t for _, name, t in sorted(data) if name == g]
        texts = [[w for t in texts for w in t]] if span else texts
        for n in (1, 2, 3):
            for t in texts:
                want[g, n].update(" ".join(t[i : i + n]) for i in range(len(t) - n + 1))
    expected = [
        (g, n, gram, c)
        for (g, n), counts in want.items()
        for gram, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
    ]
    got = keywords.group_keywords(df, "g", "id", "t", k=10, span_rows=span)
    assert rows(got, "g", "n", "gram", "cnt") == sorted(expected, key=repr)


def test_spanning_over_short_rows(spark):
    data = [(i, "g", t) for i, t in enumerate([["aa"], [], ["bb"], ["cc"], [], ["dd", "ee"]])]
    df = spark.createDataFrame(data, "id int, g string, t array<string>")
    got = keywords.group_keywords(df, "g", "id", "t", sizes=(3,), span_rows=True)
    assert rows(got, "gram", "cnt") == [("aa bb cc", 1), ("bb cc dd", 1), ("cc dd ee", 1)]


def test_record_keywords(spark):
    data, df = _corpus(spark, 4)
    got = {(r["id"], r["n"]): r["keywords"] for r in keywords.record_keyword_lists(df, "id", "t", k=3).collect()}
    assert len(got) == 3 * len(data)
    for i, _, t in data:
        for n in (1, 2, 3):
            counts = Counter(" ".join(t[j : j + n]) for j in range(len(t) - n + 1))
            best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
            assert [(k["word"], k["freq"]) for k in got[i, n]] == best


def test_published_counts(spark):
    note = "Download the error log, Log in to USB and log out 6/09/21. The USB error"
    df = spark.createDataFrame([(1, note)], "id int, x string")
    got = {r["n"]: r["keywords"] for r in keywords.published_lists(df, "id", "x").collect()}
    assert [tuple(k) for k in got[1]] == [
        ("error", 2), ("log", 2), ("09", 0), ("21", 0), ("download", 0), ("usb", 0),
    ]
    low = keywords.published_lists(df, "id", "x", sizes=(1,), lower=True).first()["keywords"]
    assert [tuple(k) for k in low][:4] == [("log", 3), ("error", 2), ("usb", 2), ("download", 1)]
    assert {k["freq"] for k in got[2]} == {0}
    assert [k["word"] for k in got[2]] == sorted(k["word"] for k in got[2])


def test_asset_report(spark):
    recs = spark.createDataFrame(
        [
            ("w1", "0000000000001", "0000000000001:Other:latch hinge bent", "p1", 1.0),
            ("w2", "x", "1: Fan :blade noise motor", None, None),
            ("w3", "x", "1:Other:the blade makes noise", "unknown", 2.0),
            ("w4", "x", "1:Other:nothing alike", None, 2.0),
        ],
        "wo string, asset_name string, work_description string, part_name string, quantity double",
    )
    parts = spark.createDataFrame([("p1", "Door", 1)], "part_name string, system string, pos int")
    vocab = spark.createDataFrame([(w,) for w in "latch hinge bent blade noise motor".split()], "word string")
    for words in (None, vocab):
        got = reports.asset_report(
            recs, "wo", parts, "pos", ["quantity"], ["asset_name", "work_description"], words
        )
        assert rows(got, "wo", "category", "quantity") == [
            ("w1", "Door", 1), ("w2", "Fan", 0), ("w3", "Fan", 2), ("w4", "Unknown", 2),
        ]


def test_asset_report_leaves_no_record_without_a_category(spark):
    serial = "1234567890123"
    recs = spark.createDataFrame(
        [
            ("w1", serial, f"{serial}:Door:door hinge broken", None, 1),
            ("w2", serial, "fan noise without colons", None, 1),
            ("w3", serial, f"{serial}:Other:hinge of the door", "nowhere", 1),
            ("w4", serial, f"{serial}:Other:zzz", "P", 1),
            ("w5", serial, None, None, 1),
        ],
        "wo string, asset_name string, work_description string, part_name string, quantity int",
    )
    parts = spark.createDataFrame([("P", "Fan", 1)], "part_name string, system string, pos int")
    words = spark.createDataFrame([("door",), ("hinge",), ("12",)], "word string")
    bare = spark.createDataFrame([("12",)], "word string")
    done = reports.asset_report(
        recs, "wo", parts, "pos", ["quantity"], ["asset_name", "work_description"], words, bare
    )
    got = {r["wo"]: r["category"] for r in done.collect()}
    assert len(got) == done.count() and None not in got.values()
    assert (got["w1"], got["w3"], got["w4"]) == ("Door", "Door", "Fan")
    if "w2" in got:
        assert got["w2"] == "Unknown"


@pytest.mark.parametrize("block", [1, 500])
def test_nearest_vectors_for_a_table_of_queries(spark, block):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(99, [0.0] * 4), (98, None)]
    asked = [(f"q{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(7)] + [("none", None)]
    df = spark.createDataFrame(data, "id int, v array<double>")
    table = spark.createDataFrame(asked, "query string, vector array<double>")
    got = similarity.nearest_vectors(df, "id", "v", table, 3, block=block).collect()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * 4) / math.dist(b, [0] * 4)

    want = set()
    for name, q in asked[:-1]:
        best = sorted(((-round(cosine(q, v), 6), i) for i, v in data[:40]))[:3]
        want |= {(name, i, rank + 1) for rank, (_, i) in enumerate(best)}
    assert {(r["query"], r["id"], r["rank"]) for r in got} == want and len(got) == 21


def test_class_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "l string, v array<double>")
    got = similarity.class_means(df, "l", "v").collect()
    assert {r["l"]: r["mean"] for r in got} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}


def test_incident_report(spark):
    df = spark.createDataFrame(
        [(1, "P1", "Replaced the door, door hinge on 10/10/23 ab"), (2, None, None)],
        "id int, part string, summary string",
    )
    got = {r["id"]: r for r in reports.incident_report(df, "id", "summary", ["part"]).collect()}
    one = got[1]
    assert one["cleaned"] == "replace door door hinge"  # "ab" is short and rare
    assert one["actions"] == ["replace"]
    assert one["observations"] == ["door", "door", "hinge", "ab"]
    assert one["keywords_2"] == "door door, door hinge, replace door"
    assert [x["word"] for x in one["significant"]][:2] == ["10 10", "10 23"]
    assert got[2]["keywords_1"] in (None, "")


def test_actions_of_an_incident(spark):
    df = spark.createDataFrame(
        [(1, "P", "Replaced the magnetron and closed the door")], "id int, part string, summary string"
    )
    got = reports.incident_report(df, "id", "summary", ["part"]).first()
    assert got["actions"] == ["replace", "close"]
    assert got["observations"] == ["magnetron", "door"]


def test_null_text_keeps_its_row(spark):
    df = spark.createDataFrame([(1, None), (2, "oven door")], "id int, x string")
    tokens = df.select("id", text.words(F.col("x")).alias("t"))
    got = keywords.record_keyword_lists(tokens, "id", "t", sizes=(1,))
    assert [(r["id"], len(r["keywords"])) for r in got.orderBy("id").collect()] == [(1, 0), (2, 2)]


def test_set_keywords(spark):
    data, df = _corpus(spark, 5, many=40)
    docs = [Counter(t) for _, _, t in data]
    df_of = Counter(w for d in docs for w in d)
    total = Counter()
    for d in docs:
        w = {t: c * (math.log((1 + len(docs)) / (1 + df_of[t])) + 1) for t, c in d.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            total[t] += x / size
    got = {r["gram"]: r["score"] for r in keywords.set_keywords(df, "id", "t").collect()}
    assert got == pytest.approx(total, abs=2e-6)


@pytest.mark.parametrize("held", [0, 3, 1000])
def test_corpus_weights_of_held_and_other_words(spark, monkeypatch, held):
    monkeypatch.setattr(keywords, "HELD", held)
    data = [(1, ["a", "a", "b"]), (1, ["a", "c"]), (2, ["a", "b", "d"]), (None, ["a", "e"]), (None, ["b"]), (3, [])]
    df_of = Counter(w for _, t in data for w in set(t))
    idf = {w: math.log((1 + 4) / (1 + n)) + 1 for w, n in df_of.items()}
    sizes, want = Counter(), []
    for k, t in data:
        for w, c in Counter(t).items():
            sizes[k] += (c * idf[w]) ** 2
    for k, t in data:
        want += [(k, w, round(c * idf[w] / math.sqrt(sizes[k]), 6)) for w, c in Counter(t).items()]
    df = spark.createDataFrame(data, "id int, t array<string>").repartition(3)
    got = keywords.corpus_weights(df, "id", "t").withColumn("weight", F.round("weight", 6))
    assert rows(got, "id", "gram", "weight") == sorted(want, key=repr)


# --------------------------------------------------------------------------------------- categories


def test_closest_category(spark):
    recs = spark.createDataFrame(
        [
            (1, "door", "hinge latch hinge gasket"),
            (2, "fan", "blade motor noise"),
            (3, "Other", "hinge gasket broken"),
            (4, "Other", "motor noise noise"),
            (5, "Other", "completely different"),
            (6, "Other", None),
        ],
        "id int, category string, description string",
    )
    got = reports.assigned_categories(recs, "id", "category", "description")
    first = {r["id"]: r["assigned"] for r in got.where("n = 1").collect()}
    assert first == {3: "door", 4: "fan", 5: "Unknown", 6: "Unknown"}
    done = reports.relabel(recs, got, "id", "category")
    assert rows(done, "id", "category")[0] == (1, "door")
    assert (4, "fan") in rows(done, "id", "category")
    matrix = reports.keyword_matrix(got, "id")
    assert matrix.columns == ["id", "keywords_1", "keywords_2", "keywords_3", "assigned_category"]
    assert matrix.count() == 4


def test_category_vectors_have_unit_length(spark):
    data, df = _corpus(spark, 6, groups=3)
    found = keywords.group_keywords(df, "g", "id", "t")
    vectors = similarity.category_vectors(found, "g", "g0")
    sizes = vectors.groupBy("g", "n").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r["g"] for r in sizes} == {"g1", "g2"}
    assert all(abs(r["s"] - 1) < 1e-9 for r in sizes)


def test_phone_cases_and_notes_without_part(spark):
    recs = spark.createDataFrame(
        [
            ("w1", None, "Resolved by phone."),
            ("w2", " ", "swapped board"),
            ("w3", "P1", "swapped board"),
            ("w1", None, "second visit"),
            ("w4", None, "Phone follow-up with customer"),
        ],
        "wo string, part string, note string",
    )
    cases = reports.phone_cases(recs, "note", ["by phone", "phone", "phone follow-up"])
    assert rows(cases, "wo", "matched") == [
        ("w1", ["by phone", "phone"]),
        ("w4", ["phone", "phone followup"]),
    ]
    assert rows(reports.notes_without_part(recs, cases, "part", "wo"), "wo") == [("w2",)]
    late = reports.phone_cases(recs, "note", ["by phone"], reference_mode=True)
    assert late.count() == 0


def test_group_text_pieces_join_to_the_whole(spark):
    data = [(i, "A" if i % 3 else "b", f"t{i}") for i in range(50)] + [(60, "b", " "), (61, None, "x")]
    df = spark.createDataFrame(data, "id int, g string, t string")
    pieces = reports.group_text(df, "g", "id", "t", span=7).orderBy("g", "piece").collect()
    for g in ("a", "b"):
        whole = " ".join(r["text"] for r in pieces if r["g"] == g)
        assert whole == " ".join(t for _, name, t in data if name and name.lower() == g and t.strip())


# ------------------------------------------------------------------------------------------ classes


def test_weights_and_rare_classes(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else "c") for i in range(10)], "id int, l string")
    weights = {r["l"]: r["weight"] for r in classes.class_weights(df, "l").collect()}
    assert weights == {"a": 0.555556, "b": 1.111111, "c": 3.333333}
    merged = Counter(r["l"] for r in classes.merge_rare(df, "l").collect())
    assert merged == {"a": 6, "b": 3, "Other": 1}


def test_label_index(spark):
    df = spark.createDataFrame([(3, "door"), (1, "tool"), (2, "door"), (4, None)], "id int, l string")
    assert rows(classes.label_index(df, "l"), "l", "index") == [("door", 0), ("tool", 1)]
    assert rows(classes.label_index(df, "l", "id"), "l", "index") == [("door", 1), ("tool", 0)]
    numbers = spark.createDataFrame([(10, 1), (2, None), (1, 5), (2, None), (None, 0)], "l int, id int")
    assert rows(classes.label_index(numbers, "l"), "l", "index") == [(1, 0), (10, 2), (2, 1)]
    assert rows(classes.label_index(numbers, "l", "id"), "l", "index") == [(1, 1), (10, 0), (2, 2)]


def test_upsample(spark):
    df = spark.createDataFrame([(i, "big" if i < 30 else "small") for i in range(35)], "id int, l string")
    got = classes.upsample(df, "id", "l", 20).collect()
    assert Counter(r["l"] for r in got) == {"big": 30, "small": 20}
    assert {r["id"] for r in got if r["l"] == "small"} <= set(range(30, 35))
    again = classes.upsample(df, "id", "l", 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def _points(spark, seed=7):
    rng = random.Random(seed)
    data = [
        (i, "a" if i < 40 else "b" if i < 52 else "c" if i < 55 else "d", [rng.random() for _ in range(4)])
        for i in range(56)
    ]
    return data, spark.createDataFrame(data, "id long, l string, v array<double>")


@pytest.mark.parametrize("block", [5, 1000])
def test_neighbours_against_brute_force(spark, block):
    data, df = _points(spark)
    want = []
    for i, l, v in data:
        near = sorted((round(math.dist(v, w), 9), j) for j, m, w in data if m == l and j != i)[:3]
        want += [(i, j, rank) for rank, (_, j) in enumerate(near, 1)]
    got = classes.neighbour_pairs(df, "id", "l", "v", 3, block_rows=block)
    assert rows(got, "id", "neighbour", "rank") == sorted(want, key=repr)


def test_neighbours_over_blocks_that_travel(spark, monkeypatch):
    _, df = _points(spark)
    whole = rows(classes.neighbour_pairs(df, "id", "l", "v", 3), "id", "neighbour", "rank")
    monkeypatch.setattr(classes, "TRAVEL", 7)
    monkeypatch.setattr(classes, "CELLS", 20)
    assert rows(classes.neighbour_pairs(df, "id", "l", "v", 3, block_rows=4), "id", "neighbour", "rank") == whole


@pytest.mark.parametrize("k", [None, 1, 5, 50])
def test_smote_balances_between_neighbours(spark, k):
    data, df = _points(spark)
    points = {i: v for i, _, v in data}
    made = classes.smote(df, "id", "l", "v", k=k).collect()
    assert Counter(r["l"] for r in made) == {"b": 28, "c": 37}
    assert sorted(r["draw"] for r in made if r["l"] == "b") == list(range(1, 29))
    for r in made:
        assert r["id"] != r["neighbour"]
        a, b = points[r["id"]], points[r["neighbour"]]
        assert all(min(x, y) - 1e-9 <= m <= max(x, y) + 1e-9 for x, y, m in zip(a, b, r["v"]))
        assert data[r["id"]][1] == data[r["neighbour"]][1] == r["l"]


def test_smote_without_need(spark):
    _, df = _points(spark)
    assert classes.smote(df.where("l = 'd'"), "id", "l", "v").count() == 0
    assert classes.smote(df.where("l = 'a'"), "id", "l", "v").count() == 0


# ------------------------------------------------------------------------------------------ metrics


def test_metrics(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] + [("b", None)]
    df = spark.createDataFrame(pairs, "l string, p string")
    labels = spark.createDataFrame([("a",), ("z",)], "l string")
    got = {r["label"]: r for r in metrics.class_report(df, "l", "p", labels).collect()}
    assert set(got) == {"a", "b", "c", "z"}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (0.833333, 0.714286, 7)
    assert (got["b"]["precision"], got["b"]["recall"]) == (0.6, 0.75)
    assert (got["z"]["f1"], got["z"]["support"]) == (0, 0)
    one = metrics.summary(df, "l", "p").first()
    assert one["accuracy"] == round(8 / 12, 6)
    assert one["recall"] == one["accuracy"]


# -------------------------------------------------------------------------------------- association


def test_rules_chain(spark):
    df = spark.createDataFrame([(1, ["hot", "door"]), (2, ["cold"])], "id int, t array<string>")
    got = association.forward_chain(df, "id", "t", {"hot door": "heat"}, {"heat": "fan", "fan": "heat"})
    assert rows(got, "id", "facts") == [(1, ["fan", "heat"])]


def test_code_pairs(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "c"), (3, None)],
        "g int, code string",
    )
    got = association.code_cooccurrence(df, "g", "code")
    assert rows(got, "code_a", "code_b", "groups", "lift") == [
        ("a", "b", 2, 1.5), ("a", "c", 1, 0.75), ("b", "c", 1, 0.75),
    ]


def test_one_hot_and_trend(spark):
    df = spark.createDataFrame([(1, "x"), (2, "q"), (3, None)], "id int, c string")
    assert rows(association.one_hot(df, "id", "c", ["x", "y"]), "id", "c_x", "c_y") == [
        (1, 1, 0), (2, 0, 0), (3, 0, 0),
    ]
    times = spark.sql(
        "select timestamp '2024-01-05' ts, 'a' c union all select timestamp '2024-02-05', 'a' "
        "union all select timestamp '2024-02-06', 'a'"
    )
    assert rows(association.trend(times, "ts", "c"), "period", "records", "change") == [
        ("2024-01-01", 1, 1), ("2024-02-01", 2, 1),
    ]


def closed(facts, rule_rows):
    """All facts that follow, round by round."""
    out = {(k, f): 0 for k, f in facts if k is not None and f is not None}
    turn = 0
    while True:
        turn += 1
        new = {
            (k, conclusion)
            for k in {k for k, _ in out}
            for _, premises, conclusion in rule_rows
            if all((k, p) in out for p in premises) and (k, conclusion) not in out
        }
        if not new:
            return out
        out |= {pair: turn for pair in new}


RULE_SETS = {
    "chain": [(f"r{i}", [f"f{i}"], f"f{i + 1}") for i in range(5)],
    "cycle": [("a", ["x"], "y"), ("b", ["y"], "z"), ("c", ["z"], "x")],
    "premises": [("a", ["x", "y"], "z"), ("b", ["z", "w"], "v"), ("c", ["x"], "w"), ("d", ["v", "x", "y"], "u")],
    "none": [],
}


@pytest.mark.parametrize("name", RULE_SETS)
def test_rules_follow_to_the_end(spark, name):
    facts = [(1, "f0"), (1, "x"), (2, "x"), (2, "y"), (2, "y"), (3, "y"), (4, "f3"), (None, "x"), (5, None), (6, "other")]
    table = rules.rule_table(spark, RULE_SETS[name])
    got = rules.derive(spark.createDataFrame(facts, "key int, fact string"), table).collect()
    want = closed(facts, RULE_SETS[name])
    assert {(r["key"], r["fact"]): r["round"] for r in got} == want and len(got) == len(want)


def test_rules_on_no_facts(spark):
    table = rules.rule_table(spark, RULE_SETS["cycle"])
    assert rules.derive(spark.createDataFrame([], "key int, fact string"), table).count() == 0


def test_a_round_joins_the_new_facts_only(spark, monkeypatch):
    """The rows that meet the rules are the facts, each once, however many rounds there are."""
    seen = []
    plain = rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df: (out := plain(df), seen.append(out))[0])
    table = rules.rule_table(spark, RULE_SETS["chain"])
    facts = spark.createDataFrame([(k, "f0") for k in range(20)], "key int, fact string")
    assert rules.derive(facts, table).count() == 120
    assert sum(df.count() for df in seen if "met" in df.columns) == 100  # f5 is no premise


@pytest.mark.parametrize("common", [3, 2048])
def test_group_keywords_among_the_common_words(spark, monkeypatch, common):
    """The n-grams of few words suffice or not: groups that are not settled by them are counted whole."""
    monkeypatch.setattr(keywords, "COMMON", common)
    rng = random.Random(5)
    data = [(i, "ab"[i % 2], [rng.choice("pqrstuvw") for _ in range(30)]) for i in range(20)]
    data += [(50, "odd", ["x y", "z"]), (51, "odd", ["x", "y z"]), (52, "none", None), (53, None, ["p", "p"])]
    df = spark.createDataFrame(data, "id int, g string, t array<string>")
    counts = Counter()
    for _, g, t in data:
        for n in (1, 2, 3):
            counts.update((g, n, " ".join(t[i : i + n])) for i in range(len(t or []) - n + 1))
    want = defaultdict(list)
    for (g, n, gram), cnt in counts.items():
        want[g, n].append((-cnt, gram))
    want = [(g, n, x, -c, i + 1) for (g, n), v in want.items() for i, (c, x) in enumerate(sorted(v)[:3])]
    got = keywords.group_keywords(df, "g", "id", "t", k=3)
    assert rows(got, "g", "n", "gram", "cnt", "rank") == sorted(want, key=repr)


def test_record_counts_cut_and_counted_elsewhere(spark):
    df = spark.createDataFrame(
        [(1, ["b", "a", "b"], ["a", "a", "B"]), (2, None, None), (3, [], ["a"])],
        "id int, t array<string>, raw array<string>",
    )
    got = {(r["id"], r["n"]): [tuple(x) for x in r["counts"]] for r in keywords.record_counts(df, ["id"], "t", (1, 2)).collect()}
    assert got[1, 1] == [(-2, "b"), (-1, "a")] and got[1, 2] == [(-1, "a b"), (-1, "b a")]
    assert got[2, 1] == got[3, 2] == []
    cut = keywords.record_counts(df, ["id"], "t", (1,), 2, among="raw")
    assert [tuple(x) for x in cut.where("id = 1").first()["counts"]] == [(-2, "a"), (0, "b")]


def test_own_vocabulary_makes_the_tokens_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(value):
        seen.add(1)
        return value

    df = spark.createDataFrame([(i, "ab door ab cd") for i in range(12)] + [(20, "xy door"), (21, None)], "id int, x string")
    df = df.select("id", text.split_space(F.udf(read, "string")("x")).alias("t"))
    codes = spark.createDataFrame([("cd",)], "word string")
    got = {r["id"]: r["t"] for r in vocabulary.keep_own_vocabulary(df, "id", "t", bare_codes=codes).collect()}
    assert got[0] == ["ab", "door", "ab", "Ecd"] and got[20] == ["door"] and got[21] is None
    assert seen.value == 14


def test_incident_records_stay_where_they_are(spark):
    """The report shuffles and joins no record while the tasks can hold the short words and the codes."""
    df = spark.createDataFrame([(1, "P", "ab door 12 hinge 77")] * 5 + [(None, None, None)], "id int, part string, summary string")
    codes = spark.createDataFrame([("77",), ("77",), (None,)], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = reports.incident_report(df, "id", "summary", ["part"], bare_codes=codes)
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        got = report.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r["cleaned"] for r in got if r["id"]] == ["ab door 12 hinge E77"] * 5 and len(got) == 6


@pytest.mark.parametrize(("bound", "listed"), [(1_000_000, 2048), (1_000_000, 0), (-1, 0)])
def test_own_vocabulary_held_or_joined(spark, monkeypatch, bound, listed):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(joins, "LISTED", listed)
    data = [
        (1, ["ab", "the", "7", "door", None, "éa"]), (None, ["ab", "ab", "x9", "200"]), (1, ["ab", "ab"]), (2, None),
        (3, []), (4, ["x9", "yy", "7"]), (4, ["x9", "yy", "7"]),
    ]
    df = spark.createDataFrame(data, "id int, t array<string>")
    codes = spark.createDataFrame([("7",), ("200",), ("none",), ("7",), (None,)], "word string")
    got = vocabulary.keep_own_vocabulary(df, "id", "t", bare_codes=codes)
    want = [
        (1, ["ab", "E7", "door"]), (None, ["ab", "ab", "E200"]), (1, ["ab", "ab"]), (2, None), (3, []),
        (4, ["E7"]), (4, ["E7"]),
    ]
    assert rows(got, "id", "t") == sorted(want, key=repr)


def test_word_with_two_expansions_is_not_held(spark, monkeypatch):
    table = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", None)], "word string, expansion string")
    assert joins.held_words(table)[1] is None
    df = spark.createDataFrame([(1, ["d", "e", None]), (2, ["d"])], "id int, t array<string>")
    assert rows(joins.expand_words(df, "id", "t", table), "t") == [(["d", "e", None],), (["d"],)]
    for listed in (0, 2048):
        monkeypatch.setattr(joins, "LISTED", listed)
        held = joins.expand_words(df, "id", "t", table.where("word = 'd'"))
        assert rows(held, "t") == [(["d", "e", None],), (["d"],)]
        empty = joins.keep_words(df, "id", "t", spark.createDataFrame([(None,)], "word string"))
        assert rows(empty, "id", "t") == [(1, []), (2, [])]


@pytest.mark.parametrize("held", [True, False])
def test_long_part_list_is_cut_to_the_parts_asked_for(spark, monkeypatch, held):
    recs = spark.createDataFrame(
        [(1, "p", "Other"), (None, "q", "Other"), (3, "r", "Door"), (3, "p", "Other"), (4, None, "Other"), (5, "p", None)],
        "id int, part string, category string",
    )
    parts = spark.createDataFrame(
        [("p", "old", 1), ("p", "new", 2), ("r", "Fan", 1), ("s", "Fan", 1), ("t", "Fan", 1), (None, "Fan", 9), ("q", None, 1)],
        "part string, system string, pos int",
    )
    seen = []
    real = joins.last_per_key
    monkeypatch.setattr(joins, "last_per_key", lambda df, *a: (seen.append(df.count()), real(df, *a))[1])
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 6 if held else -1)
    got = joins.category_from_part(recs, parts, "part", "category", "system", "pos")
    assert rows(got, "id", "category") == sorted(
        [(1, "new"), (None, "Other"), (3, "Door"), (3, "new"), (4, "Other"), (5, None)], key=repr
    )
    assert seen == [3]  # the rows of p and q


def test_lists_are_read_once_for_words_and_codes(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(value):
        seen.add(1)
        return value

    df = spark.createDataFrame([(1, "oven door"), (2, "E7 7")], "id int, x string")
    errors = spark.createDataFrame([("E7", 3), ("E7", 3), (" e8 ", None), (None, 4)], "code string, n int")
    errors = errors.repartition(1).select(F.udf(read, "string")("code").alias("code"), "n")
    parts = spark.createDataFrame([("fan belt",)], "p string")
    got = vocabulary.asset_vocabulary(df, text.words(F.col("x")), parts, "p", [errors], "code", min_count=1)
    assert {r["word"] for r in got.collect()} == {"oven", "door", "e7", "fan", "belt", "e8", "7", "8", "3", "4"}
    assert seen.value == 4


@pytest.mark.parametrize(("bound", "listed"), [(1_000_000, 2048), (1_000_000, 0), (-1, 0)])
def test_asset_vocabulary_and_codes_held_or_joined(spark, monkeypatch, bound, listed):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(joins, "LISTED", listed)
    data = [(1, ["error", "89", "noise"]), (None, ["noise", None]), (1, ["89", "89"]), (2, None)]
    df = spark.createDataFrame(data, "id int, t array<string>")
    words = spark.createDataFrame([("error",), ("89",), (None,)], "word string")
    bare = spark.createDataFrame([("89",), ("89",), (None,)], "word string")
    got = vocabulary.correct_codes(df, "id", "t", words, bare)
    assert rows(got, "id", "t") == sorted([(1, ["error", "E89"]), (None, []), (1, ["E89", "E89"]), (2, None)], key=repr)
    if bound > 0:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
