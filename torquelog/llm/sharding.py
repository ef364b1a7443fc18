"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog.llm import common

SHARDS = 8


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: each shard draws an exponential at its weight's rate, the least wins.

    The draw of a (key, shard) pair depends on nothing else, so a new shard takes keys only into
    itself, a removed shard gives up only its own, and a changed weight moves keys only into or out
    of that shard. A shard gets keys in proportion to its weight. Null keys share one shard.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative and not all 0")
    draws = [
        F.struct(
            (-F.log(common.unsigned_unit(F.xxhash64(key, F.lit(s)))) / F.lit(float(w))).alias("draw"),
            F.lit(s).alias("shard"),
        )
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*draws))["shard"]


def assign(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row of ``docs``.

    ``size`` is the UTF-8 length plus 1, ``slot`` the gapless place in the shard. A null text has
    size 1 and CRC 0, like an empty one. Repeated rows go to one shard and get a slot each. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    weights = tuple(weights)
    grown = tuple(grown_weights) if grown_weights is not None else (*weights, 1.0)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), grown).cast("int").alias("grown_shard"),
    )
    out = common.numbered(rows, ["shard"], "slot", "shards")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(
    docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id"
) -> None:
    """Write the rows as Parquet in one folder per shard; no shuffle, as a shard has many files."""
    (column,) = common.unused(docs, "shard")
    docs.withColumn(column, rendezvous(common.named(key), weights)).write.partitionBy(column).parquet(path)


def query(spark: SparkSession, directory: str) -> DataFrame:
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    return assign(docs).select("*", F.lit("key").alias("law"))
