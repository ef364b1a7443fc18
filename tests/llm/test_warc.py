"""Archives: revisits against a plain grouping, records of any content, existing archives."""

import gzip
import hashlib
from pathlib import Path

import duckdb
import pytest

import check
from torquelog.llm import warc

SCHEMA = "page_id long, url string, html string, key int, type string, digest string, original int, bytes int"
COPY = "<p>same</p>" * 20
TRICKY = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5 + "\r\n\r\n"


def odd_pages():
    rows = [(i, f"http://x/{i}", COPY) for i in (9, 4, 30, 31)]
    rows += [(40 + i, "http://short", "short") for i in range(5)] + [(50, None, None), (51, "", "")]
    rows += [(60, "http://a\r\nContent-Length: 1", TRICKY), (61, "http://b", TRICKY), (62, "u", "\n" + "é漢😀" * 40 + "\r\n")]
    rows += [(None, "no key", COPY), (None, "no key", "only here " * 20), (4, "again", COPY), (-2, "u", "é" * 50)]
    rows += [(70, "u", "é" * 50), (71, "u", "x" * 99), (72, "u", "x" * 99), (73, "u", "y" * 100), (74, "u", "y" * 100)]
    return rows + [(80, "long", "line of a long page\n" * 200_000), (81, "long", "line of a long page\n" * 200_000)]


def brute(rows):
    first = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(key, first.get(data, key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        original = first.get(data)
        if original == key:
            original = None
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if original is not None else "response", original))
    return sorted(out, key=repr)


def number(text):
    return None if text is None else int(text)


def found(df):
    return sorted(
        ((number(r["key"]), r["bytes"], r["digest"], r["type"], number(r["refers_to"])) for r in df.collect()), key=repr
    )


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, 1, "x", "x", 1, 1) for r in odd_pages()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def archives(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    return path, found(warc.deduplicate(pages, path))


def test_odd_pages(archives):
    assert archives[1] == brute(odd_pages())


def test_hot_payloads_are_split(spark, pages, tmp_path, monkeypatch):
    from torquelog.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 1)
    assert found(warc.deduplicate(pages, str(tmp_path / "out"))) == brute(odd_pages())


def test_files_are_plain_archives(archives):
    """Read with gzip and the lengths alone, as any reader would."""
    seen = {}
    for path in Path(archives[0]).glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            block, end, data = data[:size], data[size : size + 4], data[size + 4 :]
            assert end == b"\r\n\r\n"
            payload = block.partition(b"\r\n\r\n")[2]
            digest = "sha256:" + hashlib.sha256(payload).hexdigest()
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == digest
            else:
                assert payload == b"" and fields["WARC-Profile"] == warc.PROFILE and "WARC-Refers-To" in fields
            seen[fields["WARC-Type"]] = seen.get(fields["WARC-Type"], 0) + 1
    want = brute(odd_pages())
    assert seen == {t: sum(r[3] == t for r in want) for t in ("response", "revisit")}


def test_payloads_come_back(spark, archives):
    back = warc.read_archives(spark, archives[0], with_payload=True).where("type = 'response'").collect()
    texts = {html or "" for _, _, html in odd_pages()}
    assert {r["payload"] for r in back} == texts


def test_rewriting_archives(spark, pages, archives, tmp_path):
    """All records as responses first, then rewritten; rewriting again changes nothing."""
    from pyspark.sql import functions as F

    raw = warc.records(pages).withColumn("type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("string"))
    warc.written(raw, str(tmp_path / "raw"))
    warc.rewrite(spark, str(tmp_path / "raw"), str(tmp_path / "once"))
    warc.rewrite(spark, str(tmp_path / "once"), str(tmp_path / "twice"))
    once = found(warc.located(warc.read_archives(spark, str(tmp_path / "once"))))
    assert [r[:3] for r in once] == [r[:3] for r in brute(odd_pages())]
    payloads = [r for r in once if r[1] >= 100]
    assert sum(r[3] == "response" for r in payloads) >= len({r[2] for r in payloads})
    assert all(r[3] == "response" for r in once if r[1] < 100)
    assert found(warc.located(warc.read_archives(spark, str(tmp_path / "twice")))) == once


def test_a_revisit_of_another_archive_stays(spark, tmp_path):
    kind = "key long, uri string, payload string, bytes long, digest string, type string, refers_to string"
    row = (7, "u", "", 500, "d" * 64, "revisit", "<urn:uuid:elsewhere>")
    warc.written(spark.createDataFrame([row], kind), str(tmp_path / "in"))
    warc.rewrite(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).first()
    assert (got["type"], got["refers_to"], got["declared"]) == ("revisit", "<urn:uuid:elsewhere>", "d" * 64)


def test_cut_archive():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    whole, rest = warc.parse(record + record[:-7], last=False)
    assert [b for _, b in whole] == [b"abcde"] and rest.lstrip() == record[:-7]
    assert warc.parse(record[:-7], last=True) == ([], b"")
    assert warc.parse(b"no archive", last=True) == ([], b"")


def test_empty_table(spark, tmp_path):
    assert warc.deduplicate(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0


def test_query(spark, directory):
    got = warc.query(spark, directory).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{directory}/pages.parquet'")
    assert check.rows_of(got) == check.rows_of(con.execute(warc.SQL).fetchdf()) and len(got)
