"""Class sizes, labels, weights and balancing for classifier training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torquelog.operators.joins import only
from torquelog.operators.ranking import hash_share, row_numbers
from torquelog.runtime import lookup_join, materialize

TRAVEL = 4096  # rows of a block that are compared to another block in one task
CELLS = 1 << 20  # of a matrix product


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``rows / (classes * rows of the class)`` per class, by label name."""
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    total, classes = counts.agg(F.sum("rows"), F.count(F.lit(1))).first()
    weight = F.lit(total or 0) / (F.lit(classes) * F.col("rows"))
    return counts.withColumn("weight", F.round(weight, 6))


def merge_rare(df: DataFrame, label: str, least: int = 3, other: str = "Other") -> DataFrame:
    """Classes of fewer than ``least`` rows become ``other``."""
    rare = class_counts(df, label).where(F.col("rows") < least).select(
        label, F.lit(True).alias("_rare")
    )
    joined = lookup_join(df, rare, [label], "left")
    return joined.withColumn(
        label, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(label))
    ).drop("_rare")


def label_index(df: DataFrame, label: str, first_seen_by: str | None = None) -> DataFrame:
    """(label, index): in the order of the label's own type, or by first appearance.

    Numbers are in numeric order, strings in that of their bytes. A class whose order column is
    always null comes last. Numbers a table of one row per class, in ranges, so no class passes
    through the driver and the number of classes is not limited.
    """
    rows = df.where(F.col(label).isNotNull())
    seen = F.min(first_seen_by) if first_seen_by else F.lit(0)
    classes = materialize(rows.groupBy(label).agg(seen.alias("_first")))
    order = [F.col("_first").asc_nulls_last(), F.col(label)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = classes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_place")) - 1
    return placed.withColumn("_within", within).join(starts, "_range").select(
        label, (F.col("_start") + F.col("_within")).cast("long").alias("index")
    )


def upsample(
    df: DataFrame, key: str, label: str, least: int = 500, seed: int = 42
) -> DataFrame:
    """Raise every class below ``least`` rows to ``least`` by drawing rows with replacement.

    Larger classes pass unchanged. Draw ``i`` of a class takes its row number
    ``hash(label, i, seed) mod rows``, so the result is the same on every run. Only classes below
    ``least`` rows are numbered, so no window holds more rows than that.
    """
    sizes = materialize(class_counts(df, label))
    small = sizes.where(F.col("rows") < least)
    large = sizes.where(F.col("rows") >= least)
    majority = only(df, large, [label])
    minority = only(df, small, [label]).withColumn(
        "_pos", F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1
    )
    draws = small.select(
        label, "rows", F.explode(F.sequence(F.lit(1), F.lit(least))).alias("draw")
    )
    picked = draws.withColumn(
        "_pick", F.concat_ws("-", F.col(label).cast("string"), F.col("draw").cast("string"))
    ).select(label, "draw", (hash_share("_pick", seed) % F.col("rows")).cast("int").alias("_pos"))
    drawn = picked.join(minority, [label, "_pos"]).drop("_pos")
    return majority.withColumn("draw", F.lit(0)).unionByName(drawn)


def neighbour_pairs(
    df: DataFrame, key: str, label: str, vector: str, k: int, block_rows: int = 1024
) -> DataFrame:
    """The ``k`` nearest rows of the same class for every row: (key, neighbour, distance, rank).

    Exact for any class size. Rows are hashed into blocks of about ``TRAVEL`` (``block_rows``, if more)
    per class and travel once per block of their class; each task compares one pair of blocks with
    matrix products of at most ``CELLS`` cells and keeps ``k`` per row, and the partial lists merge per
    row. No pair of rows is ever written out beyond those lists.
    """
    sizes = class_counts(df, label).select(label, "rows").withColumn(
        "blocks", F.ceil(F.col("rows") / max(block_rows, TRAVEL)).cast("int")
    )
    rows = lookup_join(df.select(key, label, vector), sizes, [label]).withColumn(
        "block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.withColumn("other", each).select(label, "block", "other", key, vector)
    right = rows.withColumn("mine", each).select(
        *[F.col(c).alias(f"_{c}") for c in (label, "mine", "block", key, vector)]
    )
    key_type = df.schema[key].dataType.simpleString()

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "neighbour", "distance"]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        b = b.sort_values(f"_{key}")  # ties go to the smaller key
        x = np.vstack(a[vector].to_numpy()).astype("float64")
        y = np.vstack(b[f"_{vector}"].to_numpy()).astype("float64")
        ids, others = a[key].to_numpy(), b[f"_{key}"].to_numpy()
        take, step = min(k, len(y)), max(1, CELLS // len(y))
        lengths, found = (y * y).sum(1)[None, :], []
        for start in range(0, len(x), step):
            part, mine = x[start : start + step], ids[start : start + step]
            squared = (part * part).sum(1)[:, None] + lengths - 2 * part @ y.T
            squared[mine[:, None] == others[None, :]] = np.inf
            best = np.argsort(squared, axis=1, kind="stable")[:, :take]
            found.append((best.ravel(), np.take_along_axis(squared, best, 1).ravel()))
        best, squared = (np.concatenate(column) for column in zip(*found))
        out = pd.DataFrame({"key": np.repeat(ids, take), "neighbour": others[best], "distance": squared})
        out = out[np.isfinite(out["distance"])]
        return out.assign(distance=np.sqrt(out["distance"].clip(lower=0)))

    partial = (
        left.groupBy(label, "block", "other")
        .cogroup(right.groupBy(f"_{label}", "_mine", "_block"))
        .applyInPandas(compare, f"key {key_type}, neighbour {key_type}, distance double")
    )
    ranked = Window.partitionBy("key").orderBy(F.round("distance", 9), "neighbour")
    return (
        partial.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .withColumnRenamed("key", key)
    )


def smote(
    df: DataFrame, key: str, label: str, vector: str, seed: int = 42, k: int | None = None
) -> DataFrame:
    """Synthetic rows that raise every class to the size of the largest.

    (label, draw, key, neighbour, vector): each draw takes a row of the class, one of its ``k``
    nearest rows of the class, and a point between them; ``k`` defaults to the smallest class size
    less one. Draws are hashes, not random numbers. Classes of one row have no neighbour and are left
    as they are. The largest class, the hot one, needs no draws, so its rows are never compared, and
    neither are those of a class where ``k`` takes in every other row: there any other row will do.
    """
    sizes = materialize(class_counts(df.where(F.col(label).isNotNull()), label))
    sizes = sizes.where(F.col("rows") > 1)
    limits = sizes.agg(F.max("rows"), F.min("rows")).first()
    largest, least = limits[0] or 0, limits[1] or 0
    k = k or max(1, least - 1)
    needed = sizes.withColumn("missing", F.lit(largest) - F.col("rows")).where("missing > 0")
    members = lookup_join(df.select(key, label, vector), needed, [label])
    members = materialize(row_numbers(members, label, hash_share(key, seed), key))
    to = F.col(vector).alias("_to")
    draws = _draws(members, key)
    compared = F.col("rows") > k + 1

    pairs = neighbour_pairs(members.where(compared), key, label, vector, k)
    nearest = pairs.join(members.select(F.col(key).alias("neighbour"), to), "neighbour")
    nearest = nearest.select(key, "rank", "neighbour", "_to")
    rank = (F.pmod(hash_share("_d", seed), F.lit(k)) + 1).cast("int")
    near = lookup_join(draws.where(compared).withColumn("rank", rank), nearest, [key, "rank"])

    anyone = members.select(
        label, F.col("row_number").alias("_other"), F.col(key).alias("neighbour"), to
    )
    steps = F.col("row_number") + F.pmod(hash_share("_d", seed), F.col("rows") - 1)  # never itself
    others = draws.where(~compared).withColumn("_other", steps % F.col("rows") + 1)
    free = lookup_join(others, anyone, [label, "_other"], ready=True)

    both = near.drop("rank").unionByName(free.drop("_other"))
    share = hash_share("_d", seed + 1) / F.lit(float(2**32))
    between = F.zip_with(vector, "_to", lambda a, b: a + (b - a) * F.col("_share"))
    return both.withColumn("_share", share).select(
        label, "draw", key, "neighbour", between.alias(vector)
    )


def _draws(members: DataFrame, key: str, chunk: int = 10_000) -> DataFrame:
    """One row per synthetic row wanted: the rows of a class take turns, in hash order.

    A row of a tiny class may be drawn very often, so its turns are made in chunks that spread over
    the partitions.
    """
    rows, missing = F.col("rows"), F.col("missing")
    extra = F.when(F.col("row_number") <= missing % rows, 1).otherwise(0)
    wanted = members.withColumn("_n", F.floor(missing / rows) + extra).where("_n > 0")
    chunks = wanted.withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk)))
    ).repartition(key, "_c")
    first, last = F.col("_c") * chunk + 1, F.least((F.col("_c") + 1) * chunk, F.col("_n"))
    turns = chunks.withColumn("turn", F.explode(F.sequence(first, last)))
    name = F.concat_ws("-", F.col(key).cast("string"), F.col("turn").cast("string"))
    return turns.withColumns(
        {"draw": F.col("row_number") + (F.col("turn") - 1) * rows, "_d": name}
    ).drop("_n", "_c", "turn", "missing", "group_rows")
