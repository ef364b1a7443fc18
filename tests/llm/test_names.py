"""Columns of any name pass through: those the operators use themselves, and keys of any type."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from torquelog.llm import common, fingerprints, line_dedup, ngram_join, packing, quality, sharding
from torquelog.llm import decontaminate as dec

NAMES = """_md5 _id _digest _places _kept _lines _gone _hash _n _runs _items _longest _key _grade key graded
_place _piece _before _within _hot _salts _salt _shard _doc_id hash of_label label a.b tick`mark _MD5_ x""".split()


@pytest.fixture(scope="module")
def clashing(odd):
    columns = [F.lit(i).alias(n) for i, n in enumerate(NAMES) if n.lower() not in {c.lower() for c in odd.columns}]
    return odd.select("*", *columns)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*[common.named(c) for c in columns]).collect()), key=str)


def same(got, want, clashing, *counts):
    """All columns of the table and the rows of the run without them."""
    assert [c for c in got.columns if c in clashing.columns] == clashing.columns
    extra = [c for c in clashing.columns if c not in want.columns or c in counts]
    for r in got.select(*[common.named(c) for c in extra]).distinct().collect():
        assert list(r) == [NAMES.index(c) for c in extra]
    columns = [c for c in want.columns if c not in counts]
    assert rows(got, *columns) == rows(want, *columns)


def test_line_dedup(odd, clashing):
    got, want = line_dedup.dedup_lines(clashing, words=50), line_dedup.dedup_lines(odd, words=50)
    assert got.columns == [*clashing.columns, "_lines_", "_gone_"]
    same(got, want, clashing, "_lines", "_gone")
    assert rows(got, "text", "_lines_", "_gone_") == rows(want, "text", "_lines", "_gone")


def test_ngram_join(odd, clashing):
    same(ngram_join.first_of_each(clashing, n=5, percent=80), ngram_join.first_of_each(odd, n=5, percent=80), clashing)


@pytest.mark.parametrize("held", [1, 8])
def test_decontaminate(spark, monkeypatch, odd, clashing, held):
    monkeypatch.setattr(dec, "HELD", held)
    texts = [r["text"] for r in odd.where("text is not null").collect()]
    items = [(f"i{i}", " ".join(t.split()[:12])) for i, t in enumerate(texts) if i % 2]
    tests = spark.createDataFrame(items, "item_id string, text string")
    same(dec.decontaminate(clashing, tests), dec.decontaminate(odd, tests), clashing)
    whole = dec.find_matches(odd, tests)
    blocks = dec.find_matches(clashing, tests, block_bytes=100)
    assert blocks.columns == [*clashing.columns, "_n_", "_runs_", "_items_", "_longest_"]
    got = rows(blocks, "text", "_n_", "_runs_", "_items_", "_longest_")
    assert got == rows(whole, "text", "_n", "_runs", "_items", "_longest")


def test_quality(spark, odd, clashing):
    graded = [(r["doc_id"], i % 3) for i, r in enumerate(odd.where("doc_id >= 100").orderBy("doc_id").collect())]
    grades = spark.createDataFrame(graded, "doc_id long, grade int")
    model = quality.train(clashing, grades)
    same(quality.select(clashing, model), quality.select(odd, model), clashing)


def test_copies_of_a_key_count_once(spark, odd):
    keys = odd.where("doc_id >= 100").select("doc_id", "text")
    grades = keys.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    one, many = quality.train(keys, grades), quality.train(keys.union(keys).union(keys), grades)
    tails = [
        {r["doc_id"]: r["tail_1"] for r in quality.score(keys, model).collect()} for model in (one, many)
    ]
    assert tails[0] == pytest.approx(tails[1])


def test_packing(odd, clashing):
    columns = ["doc_id", "piece", "start", "length"]
    assert rows(packing.pack_documents(clashing), *columns) == rows(packing.pack_documents(odd), *columns)


def test_written_shards(spark, clashing, tmp_path):
    sharding.write_shards(clashing, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*clashing.columns, "shard_"] and back.count() == clashing.count()


@pytest.mark.parametrize("kind", ["string", "date", "int"])
def test_keys_of_any_type(odd, kind):
    docs = odd.select("text", "doc_id").where("doc_id is null or doc_id > 0")
    key = F.lpad(F.col("doc_id").cast("string"), 5, "0")
    keys = {"string": key, "date": F.date_add(F.lit("1980-01-01"), F.col("doc_id").cast("int"))}
    named = docs.select("text", keys.get(kind, F.col("doc_id").cast("int")).alias("doc_id"))
    columns = ["n_chars", "edited_sha256", "near_edited", "near_next"]
    got = fingerprints.compare_with_edits(named)
    assert dict(got.dtypes)["doc_id"] == kind
    assert rows(got, *columns) == rows(fingerprints.compare_with_edits(docs), *columns)


def test_stages(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, directory)
        assert got.columns == wide.columns, name
        assert rows(got, "doc_id", "text") == rows(stage(spark, docs, directory), "doc_id", "text"), name
