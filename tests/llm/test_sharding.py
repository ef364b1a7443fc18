"""Rendezvous sharding: the law of keys, sizes, slots and weights."""

import zlib
from collections import Counter

import pytest

from torquelog.llm import sharding


def check(rows, docs):
    assert len(rows) == len(docs)
    for shard in range(sharding.SHARDS):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], sharding.SHARDS) for r in rows)
    content = Counter((d["doc_id"], d["text"] or "") for d in docs)
    want = Counter()
    for (key, text), n in content.items():
        want[key, len(text.encode()) + 1, zlib.crc32(text.encode())] += n
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_odd_rows(odd):
    docs = odd.select("doc_id", "text").collect()
    rows = sharding.assign(odd).collect()
    check(rows, docs)
    shards = {}
    for r in rows:  # the key alone decides
        assert shards.setdefault(r["doc_id"], r["shard"]) == r["shard"]


def test_query(spark, directory):
    rows = sharding.query(spark, directory).collect()
    check(rows, spark.read.parquet(f"{directory}/documents.parquet").collect())
    assert {r["law"] for r in rows} == {"key"}


def test_empty_table(no_docs):
    assert sharding.assign(no_docs).count() == 0


def test_weights_set_the_shares(spark):
    keys = spark.range(20000).selectExpr("id as doc_id", "'t' as text")
    counts = Counter(r["shard"] for r in sharding.assign(keys, (1.0, 2.0, 0.0, 5.0)).collect())
    assert 2 not in counts
    for shard, weight in ((0, 1), (1, 2), (3, 5)):
        assert counts[shard] == pytest.approx(20000 * weight / 8, rel=0.06)


def test_a_removed_shard_gives_up_only_its_own(spark):
    keys = spark.range(5000).selectExpr("id as doc_id", "'t' as text")
    before = {r["doc_id"]: r["shard"] for r in sharding.assign(keys, (1.0,) * 4).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.assign(keys, (1.0, 1.0, 0.0, 1.0)).collect()}
    assert all(after[k] == s for k, s in before.items() if s != 2)


def test_bad_weights(odd):
    with pytest.raises(ValueError):
        sharding.assign(odd, (0.0, 0.0))


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and "shard" in back.columns
