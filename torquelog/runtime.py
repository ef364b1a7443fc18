"""Session helpers: table loading, durable intermediate results, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def load(spark: SparkSession, directory: str, table: str, key: str | None = None) -> DataFrame:
    """Read a Parquet table; ``key`` spreads a table with few file splits over all cores."""
    df = spark.read.parquet(f"{directory}/{table}.parquet")
    return spread(df, key) if key else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows by ``key`` when the scan has fewer splits than the cluster has cores.

    A large input already has more splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and lambdas read but never recompute.

    The optimizer copies the definition of a projected column into the filters and lambdas that use
    it; the output of a generator it leaves alone. The generator here yields exactly one row.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def scratch(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one only for local masters."""
    context = spark.sparkContext
    configured = context.getCheckpointDir()
    if configured:
        return configured
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="torquelog-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the checkpoint folder and cut the lineage; survives lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder; later passes read the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Of what runs meanwhile, tasks hand ``rows`` rows at most to Python at a time; each may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits(df: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven small enough to broadcast. Counts first, sizes only if few."""
    if df.count() > (BROADCAST_ROWS if max_rows is None else max_rows):
        return False
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0]
    return (size or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    ready: bool = False,
    max_rows: int | None = None,
    salt_all: bool = False,
) -> DataFrame:
    """Equi-join a large ``left`` to a side that is usually small.

    The right side is materialised, so that checking its size and joining it compute it once; say
    ``ready`` when it is a stored table. It is broadcast when its size is within the bound. Beyond
    the bound the join shuffles and salts the left rows: those of hot keys, or with ``salt_all``
    those of every key, for a left side so much larger (words of a corpus against a vocabulary) that
    repeating the right side costs less than another look at the left one. Only the left side is
    split, so every left-preserving join type stays exact.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the left side whole, not for how={how!r}")
    if not ready:
        right = materialize(right)
    if fits(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how, None if salt_all else hot_keys(left, on))


def hot_keys(df: DataFrame, on: list[str], share: float = 0.005, sample: float = 0.01) -> list:
    """Keys that hold about ``share`` of the rows or more, by a sample; at most ``2 / share``.

    A missed key costs time, never rows: the salted join is exact for any choice of hot keys.
    """
    keys = F.to_json(F.struct(*on))
    counted = df.sample(sample, seed=42).groupBy(keys.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(10, int(total * share))
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n")).limit(int(2 / share))
    return [row["k"] for row in top.collect()]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot: list | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Shuffle join with the rows of the ``hot`` keys (None: of all keys) spread over partitions.

    The salt is the row's place, so columns of any type will do and equal rows part too; the right
    side has every salt, so any choice gives the same rows.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        if not hot:
            return left.join(right, on, how)
        is_hot = F.to_json(F.struct(*on)).isin(hot)
        salt = F.when(is_hot, salt).otherwise(F.lit(0))
        every = F.when(is_hot, every).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_salt", salt)
    repeated = right.withColumn("_salt", F.explode(every))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def key_ranges(df: DataFrame, key: str, buckets: int | None = None) -> Column:
    """Monotone bucket number of a numeric key, about equally many rows per bucket.

    The edges are fixed as literals, so a retried task sees the same buckets. Used to split ordered
    windows of hot groups: no (group, bucket) holds more rows than one bucket.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(max(parts, 8), 1024)
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return F.lit(0)
    edges = df.agg(F.percentile_approx(key, shares, 10_000).alias("e")).first()["e"]
    if not edges:
        return F.lit(0)
    steps = F.array(*[F.lit(e) for e in sorted(set(edges))])
    return F.size(F.filter(steps, lambda e: e < F.col(key)))
