import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from torquelog.sources import files
from torquelog.streaming import counts


def test_error_list_with_mark_and_line_breaks(spark, tmp_path):
    path = tmp_path / "errors.csv"
    path.write_text(
        '﻿Type,Error Code, e3\ncritical,E89,"first\nsecond, ""quoted"""\nCritical,E90,x\n',
        encoding="utf-8",
    )
    got = files.read_error_list(spark, str(path))
    assert got.columns == ["Type", "Error Code", "e3"]
    assert [tuple(r) for r in got.collect()] == [
        ("critical", "E89", 'first\nsecond, "quoted"'),
        ("Critical", "E90", "x"),
    ]


def test_dictionary_drops_the_empty_key(spark, tmp_path):
    path = tmp_path / "short.json"
    path.write_text('{"asap": "as soon\\nas", "": "", "btw": "by the way"}')
    got = {r["key"]: r["expansion"] for r in files.read_dictionary(spark, str(path)).collect()}
    assert got == {"asap": "as soon\nas", "btw": "by the way"}


def test_missing_file(spark, tmp_path):
    path = str(tmp_path / "none.csv")
    with pytest.raises(AnalysisException):
        files.read_or_empty(spark, path, "a string, b int")
    empty = files.read_or_empty(spark, path, "a string, b int", missing_ok=True)
    assert empty.columns == ["a", "b"] and empty.isEmpty()


def test_csv_round_trip_with_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"c'], "x,y")], "id int, t array<string>, s string")
    path = str(tmp_path / "out")
    files.write_csv(df, path, quote_all=True)
    got = files.read_csv(spark, path).first()
    assert (got["id"], got["t"], got["s"]) == ("1", '["a","b\\"c"]', "x,y")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "groups.json"
    path.write_text('{"k": ["a b", "c d"], "part": "1 - door"}\n{"k": [], "part": "2"}\n')
    got = files.read_json_lines(spark, str(path)).orderBy("part").collect()
    assert [(r["part"], r["k"]) for r in got] == [("1 - door", ["a b", "c d"]), ("2", [])]


def test_nothing_is_written_for_no_rows(spark, tmp_path):
    path = tmp_path / "report"
    assert not files.write_if_any(spark.range(0), str(path))
    assert not path.exists()
    assert files.write_if_any(spark.range(2), str(path))
    assert files.read_csv(spark, str(path)).count() == 2


def test_ingest_adds_up_over_runs(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    df.write.parquet(source)
    keys = {"c": F.col("c")}
    for _ in range(2):  # the second run finds only what is new
        stream = counts.read_stream(spark, source, df.schema)
        counts.ingest_counts(stream, keys, table, checkpoint).awaitTermination()
        df.limit(1).write.mode("append").parquet(source)
    got = {r["c"]: r["records"] for r in counts.running_counts(spark, table, ["c"]).collect()}
    assert got == {"a": 3, "b": 1}


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.sql(
        "select timestamp '2024-01-01 00:10:00' ts, 'a' c union all "
        "select timestamp '2024-01-01 00:50:00', 'a' union all select timestamp '2024-01-01 05:00:00', 'a'"
    ).coalesce(1).write.parquet(source)
    stream = counts.read_stream(spark, source, "ts timestamp, c string")
    query = (
        counts.windowed_counts(stream, "ts", "c")
        .writeStream.format("memory").queryName("windows").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = spark.table("windows").collect()
    assert [(str(r["window_start"]), r["records"]) for r in closed] == [("2024-01-01 00:00:00", 2)]
