"""Vector search by random-hyperplane hashing with several probes, checked by exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelog.operators.ranking import top_k
from torquelog.operators.similarity import unit
from torquelog.runtime import lookup_join, materialize

MOST_BITS = 40
PART = 4096  # vectors of a bucket that one task compares at a time
ROUNDED = 2e-6  # scores this near may be equal when rounded
ID = "id struct<a:bigint,b:bigint>"


@dataclass(frozen=True)
class Index:
    """The stored tables of an index and what makes the hash of a vector.

    ``vectors`` (id, unit, low) has each different vector once, with its least key; ``copies``
    (id, key) the rows it stands for; ``buckets`` (id, table, bucket) its place in every table.
    """

    vectors: DataFrame
    copies: DataFrame
    buckets: DataFrame
    mean: list[float]
    tables: int
    bits: int
    seed: int


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit) of the rows that have a direction: no null or NaN in the vector, and a length above 0."""
    units = df.select(F.col(key).alias("key"), unit(F.col(vector).cast("array<double>")).alias("unit"))
    return units.where(F.col("unit").isNotNull() & ~F.exists("unit", F.isnan))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _mean(vectors: DataFrame, size: int) -> list[float]:
    """The mean of all vectors: a sum per task, then a sum per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size), 0
        for batch in batches:
            total += _matrix(batch.column(0)).sum(axis=0) if batch.num_rows else 0.0
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([rows])], ["total", "rows"])

    sums = vectors.select("unit").mapInArrow(run, "total array<double>, rows bigint")
    cells = sums.select("rows", F.posexplode("total").alias("pos", "value"))
    means = cells.groupBy("pos").agg((F.sum("value") / F.greatest(F.sum("rows"), F.lit(1))).alias("mean"))
    return [row["mean"] for row in means.orderBy("pos").collect()]


def _places(df: DataFrame, name: str, kind: str, mean: list[float], tables: int, bits: int, seed: int, flips: int) -> DataFrame:
    """(name, table, bucket) of (name, unit): one bit per hyperplane through the mean.

    Also the buckets on the other side of any of the ``flips`` hyperplanes of a table that are nearest.
    """
    flips = min(flips, bits)
    subsets = (np.arange(1 << flips)[:, None] >> np.arange(flips)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((tables * bits, len(mean)))
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            margins = ((_matrix(batch.column(1)) - mean) @ planes.T).reshape(rows, tables, bits)
            own = ((margins > 0).astype(np.int64) << np.arange(bits)).sum(axis=2)
            nearest = np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, :flips]
            masks = (np.int64(1) << nearest) @ subsets.T
            buckets = own[:, :, None] ^ masks
            many = 1 << flips
            of = pa.array(np.repeat(np.arange(rows), tables * many))
            table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), many), rows)
            columns = [batch.column(0).take(of), pa.array(table), pa.array(buckets.ravel())]
            yield pa.RecordBatch.from_arrays(columns, [name, "table", "bucket"])

    return df.select(name, "unit").mapInArrow(run, f"{kind}, table int, bucket bigint")


def hyperplane_index(
    df: DataFrame, key: str, vector: str, tables: int = 8, per_bucket: int = 64, seed: int = 7
) -> Index:
    """Hash every row of ``df`` into ``tables`` tables of buckets of about ``per_bucket`` different vectors.

    The number of hyperplanes grows with the logarithm of the number of different vectors, so a query
    meets about as many candidates at any size. The hyperplanes go through the mean of all vectors.
    Equal vectors are hashed and compared once, whatever their number. Left out are null vectors, those
    with a null or NaN, of length 0, or with another number of components than most.
    """
    units = _units(df, key, vector)
    units = units.withColumn("id", F.struct(F.xxhash64("unit").alias("a"), F.xxhash64(F.lit(seed), "unit").alias("b")))
    size = units.agg(F.mode(F.size("unit"), deterministic=True)).first()[0] or 1
    units = materialize(units.where(F.size("unit") == size))
    vectors = materialize(units.groupBy("id").agg(F.first("unit").alias("unit"), F.min("key").alias("low")))
    bits = int(np.clip(np.ceil(np.log2(max(1, vectors.count()) / per_bucket)), 1, MOST_BITS))
    mean = _mean(vectors, size)
    buckets = materialize(_places(vectors, "id", ID, mean, tables, bits, seed, 0))
    return Index(vectors, units.select("id", "key"), buckets, mean, tables, bits, seed)


def _met(places: DataFrame, asked: DataFrame, index: Index, k: int, kind: str) -> DataFrame:
    """(query, id, low, score) of what the queries meet in their buckets, cut to about ``k`` a bucket.

    A bucket of more than ``PART`` vectors is split, and its queries visit every part.
    """
    sizes = index.buckets.groupBy("table", "bucket").agg(
        F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")
    )
    split = materialize(sizes.where("parts > 1"))
    where = ["table", "bucket"]
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    held = lookup_join(index.buckets, split, where, "left", ready=True).select("id", *where, part)
    wanted = lookup_join(places, split, where, "left", ready=True).select("query", *where, each)
    held = held.join(index.vectors, "id").select(*where, "part", "id", "low", "unit")
    wanted = wanted.join(asked.withColumnRenamed("unit", "wanted"), "query").select(*where, "part", "query", "wanted")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        of, at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            units = _table_matrix(right, "unit")
            for start in range(0, left.num_rows, 1024):
                products = _table_matrix(left.slice(start, 1024), "wanted") @ units.T
                last = np.full((len(products), 1), -np.inf)
                if products.shape[1] > k:
                    last = -np.partition(-products, k - 1, axis=1)[:, k - 1 : k] - ROUNDED
                near = np.nonzero(~(products < last))
                of, at, scores = [*of, near[0] + start], [*at, near[1]], [*scores, products[near]]
        of, at = pa.array(np.concatenate(of)), pa.array(np.concatenate(at))
        columns = [left["query"].take(of), right["id"].take(at), right["low"].take(at), pa.array(np.concatenate(scores))]
        return pa.table(columns, names=["query", "id", "low", "score"])

    low = index.vectors.schema["low"].dataType.simpleString()
    groups = [*where, "part"]
    met = wanted.groupBy(*groups).cogroup(held.groupBy(*groups)).applyInArrow(best, f"{kind}, {ID}, low {low}, score double")
    return met.groupBy("query", "id").agg(F.first("low").alias("low"), F.round(F.max("score"), 6).alias("score"))


def _table_matrix(table: pa.Table, column: str) -> np.ndarray:
    return _matrix(table[column].combine_chunks())


def search(index: Index, queries: DataFrame, k: int, flips: int = 3) -> DataFrame:
    """Top ``k`` rows per query vector by cosine among those found: (query, key, score, rank).

    ``queries`` is a table (query, vector) of any size, one row per query. In every table a query looks
    into its own bucket and those across its ``flips`` nearest hyperplanes, 2 ** ``flips`` in all. What
    is found is scored exactly where it lies, and of a bucket only what may be among the ``k`` best goes
    on; ties go to the smaller key. Rows and queries meet by bucket only. A
    query with fewer than ``k`` rows in its buckets gets those. Queries without a direction, or with
    another number of components than the index, get none.
    """
    asked = _units(queries, "query", "vector").withColumnRenamed("key", "query")
    asked = materialize(asked.where(F.size("unit") == len(index.mean)))
    kind = f"query {asked.schema['query'].dataType.simpleString()}"
    places = _places(asked, "query", kind, index.mean, index.tables, index.bits, index.seed, flips)
    scored = _met(places, asked, index, k, kind)
    # the k best vectors hold the k best rows, and of each the k least keys are enough
    best = materialize(top_k(scored, ["query"], [F.desc("score"), F.col("low")], k).drop("rank"))
    rows = index.copies.join(best.select("id").distinct(), "id", "left_semi")
    rows = top_k(rows, ["id"], [F.col("key")], k).drop("rank")
    return top_k(best.join(rows, "id").select("query", "key", "score"), ["query"], [F.desc("score"), F.col("key")], k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query, key, ...) of ``exact`` that are in ``found``; 1 if there are none."""
    hit = exact.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or (0.0 if exact.take(1) else 1.0)
