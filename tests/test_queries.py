"""Every registered query against its SQL on the smallest tables, and the shape of the main plans."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as entry
import check
from torquelog import catalog, runtime

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    return con


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


PYTHON_TASKS = {"class_neighbours", "smote_balanced"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, DIRECTORY)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_TASKS:
        assert "EvalPython" not in text and "InPandas" not in text
    got = df.toPandas()
    if name in ORACLES:
        want = database.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert check.rows_of(got) == check.rows_of(want)
    else:
        assert len(got)


BEYOND = """assign_categories set_keywords keyword_part_lift enrich_with_pages entities_in_documents
notes_without_part orders_without_returns stratified_split merge_rare_classes category_from_part
parts_with_solutions dictionary_file_expansion group_keywords_spanning_rows upsample_minority
class_neighbours smote_balanced error_code_pairs similar_words records_of_large_classes""".split()


@pytest.mark.parametrize("name", BEYOND)
def test_query_beyond_the_broadcast_bound(spark, database, monkeypatch, name):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, DIRECTORY)
        assert "BroadcastHashJoin" not in plan(df)
        got = df.toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = database.execute(ORACLES[name]).fetchdf()
    assert check.rows_of(got) == check.rows_of(want)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_relabelling_moves_open_records_only(spark):
    text = plan(QUERIES["relabel_records"](spark, DIRECTORY))
    assert ") Union" in text  # the known records pass beside the join


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["record_keywords", "record_ngrams_sorted", "record_top_bigrams", "phone_cases", "clean_asset_records"]
)
def test_record_work_needs_no_shuffle(spark, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    # the only exchange is the one that spreads a small file over the cores
    assert text.count(") Exchange") <= 1


def test_group_keywords_cut_before_the_shuffle(spark):
    text = plan(QUERIES["group_keywords"](spark, DIRECTORY))
    assert text.count(") WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["orders_without_returns"](spark, DIRECTORY))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text
    claims = plan(QUERIES["claims_head"](spark, DIRECTORY))
    assert "EqualTo(l_returnflag,N)" in claims and "StringStartsWith(p_type,S)" in claims


def test_claims_of_short_serials_and_other_languages_go(spark):
    kept = {(r["l_orderkey"], r["l_linenumber"]) for r in QUERIES["claims_head"](spark, DIRECTORY).collect()}
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs}
    assert kept and all(line > 2 for _, line in kept)
    assert all(lang[order % 200] == "en" for order, _ in kept)


def test_streamed_windows_end_with_the_watermark(spark):
    rows = QUERIES["streamed_event_windows"](spark, DIRECTORY).collect()
    events = spark.read.parquet(f"{DIRECTORY}/events.parquet")
    last = events.selectExpr("date_format(max(ts) - INTERVAL 2 HOURS, 'yyyy-MM-dd HH:mm:ss')").first()[0]
    assert rows and all(r["window_start"] <= last for r in rows)
    assert sum(r["records"] for r in rows) < events.count()
