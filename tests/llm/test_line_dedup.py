"""Line dedup against a scan of all windows in order, and the guarantee of winnowing."""

import hashlib
import re

import duckdb
import pytest

import check
from torquelog.llm import line_dedup as ld


def brute(docs, window):
    """{(doc_id, text): kept text}"""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    keys = {(d, t or "") for d, t in docs}
    ordered = sorted(keys, key=lambda k: (k[0] is None, k[0] or 0, md5(k[1])))
    first, out = {}, {}
    runs = {}
    for k in ordered:
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(k[1].split("\n")) if x.strip(" \t\r")]
        runs[k] = full
        for p in range(len(full) - window + 1):
            first.setdefault(tuple(x for _, x in full[p : p + window]), (k, p))
    for k in ordered:
        gone = set()
        for p in range(len(runs[k]) - window + 1):
            d, q = first[tuple(x for _, x in runs[k][p : p + window])]
            if d != k or p >= q + window:
                gone |= {i for i, _ in runs[k][p : p + window]}
        out[k] = "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone)
    return out


MORE = [
    (500, "h1\nh2\nh3\nown a\nf1\nf2\nf3"),
    (501, "h1\n\n  h2 \nh3\r\nown b\nf1\nf2"),
    (502, "x\nx\nx\nx\nx\nx\nx\nx"),
    (503, "own c\nh2\nh3\nown a\nf1"),
    (500, "h1\nh2\nh3\nown a\nf1\nf2\nf3"),
    (499, "f1\nf2\nf3\nf1\nf2\nf3"),
]


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_odd_rows(spark, odd, window):
    more = spark.createDataFrame(MORE, "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    want = brute([tuple(r) for r in docs.collect()], window)
    got = ld.dedup_lines(docs.selectExpr("doc_id", "text", "text AS before"), window).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["before"] is None:
            assert r["text"] is None
        else:
            assert r["text"] == want[r["doc_id"], r["before"]]
    assert any(r["_gone"] for r in got)


def test_columns_stay_and_lengths_follow(odd):
    out = ld.dedup_lines(odd)
    assert out.columns == [*odd.columns, "_lines", "_gone"]
    for r in out.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_empty_table(no_docs):
    assert ld.dedup_lines(no_docs).count() == 0


def test_every_shared_run_of_a_window_shares_a_fingerprint(odd):
    rows = ld.windows(odd, 3).collect()
    marks = {}
    for r in rows:
        assert marks.setdefault(r["same"], r["mark"]) == r["mark"]
        assert r["first"] <= r["at"] < r["first"] + 3


def test_query_equals_sql(spark, directory):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{directory}/documents.parquet'")
    got, want = ld.query(spark, directory).toPandas(), con.execute(ld.SQL).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows_of(got) == check.rows_of(want)
    assert got["n_removed"].sum() > 0


def runs_with_words(full, window, words):
    """(place, lines) of the windows that are long enough by lines or by words."""
    for n in range(1, window + 1):
        for p in range(len(full) - n + 1):
            run = [x for _, x in full[p : p + n]]
            if n == window or sum(len(re.split("[ \t\r]+", x)) for x in run) > words:
                yield p, tuple(run)


def brute_words(docs, window, words):
    """{(doc_id, text): kept text}, also for windows of fewer lines with over ``words`` words."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    keys = sorted({(d, t or "") for d, t in docs}, key=lambda k: (k[0] is None, k[0] or 0, md5(k[1])))
    full = {
        k: [(i, x.strip(" \t\r")) for i, x in enumerate(k[1].split("\n")) if x.strip(" \t\r")] for k in keys
    }
    first, out = {}, {}
    for k in keys:
        for p, run in runs_with_words(full[k], window, words):
            first.setdefault(run, (k, p))
    for k in keys:
        gone = set()
        for p, run in runs_with_words(full[k], window, words):
            d, q = first[run]
            if d != k or p >= q + len(run):
                gone |= {i for i, _ in full[k][p : p + len(run)]}
        out[k] = "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone)
    return out


PASSAGE, HALF, OTHER_HALF = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 51), ("q", 26), ("r", 25)))
LONG_LINES = [
    (600, PASSAGE),
    (601, f"own\n {PASSAGE}\r\nmore"),
    (602, f"{HALF}\n{OTHER_HALF}"),
    (603, f"own d\n{HALF}\n\n{OTHER_HALF}"),
    (604, f"{HALF}\nown e\n{OTHER_HALF}"),
    (605, " ".join(PASSAGE.split()[:50])),
    (606, "again\n" + " ".join(PASSAGE.split()[:50])),
    (607, "\n".join([PASSAGE + " x"] * 4)),
    (608, f"{PASSAGE}\nshort\n{HALF}\n{OTHER_HALF}"),
    (609, f"{PASSAGE}\nshort\n{HALF}\n{OTHER_HALF}\nshort\n{HALF}"),
    (610, "\n".join([HALF] * 5)),
]


@pytest.mark.parametrize("words", [20, 50])
@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_long_runs_of_few_lines_go(spark, odd, window, words):
    more = spark.createDataFrame(MORE + LONG_LINES, "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    want = brute_words([tuple(r) for r in docs.collect()], window, words)
    got = ld.dedup_lines(docs.selectExpr("doc_id", "text", "text AS before"), window, words=words)
    for r in got.where("before IS NOT NULL").collect():
        assert r["text"] == want[r["doc_id"], r["before"]]


def test_passages_of_over_50_words_stay_once(spark):
    docs = spark.createDataFrame(LONG_LINES, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs, words=50).collect()}
    assert kept[601] == "own\nmore" and kept[603] == "own d\n"
    assert kept[604] == LONG_LINES[4][1] and kept[606] == LONG_LINES[6][1]
