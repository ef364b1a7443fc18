"""Top-k, arg-max, row numbers and ordered neighbours that hold up for hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from torquelog.runtime import key_ranges, lookup_join, materialize, once


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark cuts each map partition to ``k`` rows per key before the
    shuffle, so a hot key sends at most ``k`` rows per partition."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` per key, by a map-side combined minimum."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [order, *rest]])


def top_labels(probabilities: Column, labels: list[str], n: int) -> Column:
    """The ``n`` most probable labels of an array of probabilities, ties alphabetical."""
    names = F.array(*[F.lit(x) for x in labels])
    pairs = F.zip_with(
        probabilities, names, lambda p, l: F.struct((-p).alias("neg"), l.alias("label"))
    )
    return F.transform(
        F.slice(F.array_sort(pairs), 1, n),
        lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("prob")),
    )


def hash_share(key: str, seed: int) -> Column:
    """The same number in [0, 2^32) for the same key on every run, as long."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def random_split(df: DataFrame, key: str, parts: int = 5, seed: int = 42) -> DataFrame:
    """Column ``split``: 'test' for one hash bucket of ``parts``, else 'train'. No shuffle."""
    test = F.pmod(hash_share(key, seed), F.lit(parts)) == 0
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def row_numbers(df: DataFrame, group: str, order: Column, tie: str, pieces: int = 4096) -> DataFrame:
    """``row_number`` per group by a hash in [0, 2^32), without one task per group.

    The hash range is cut into ``pieces``; rows are numbered inside (group, piece) and shifted by the
    rows of the pieces before. A hot group therefore spreads over all pieces.
    """
    cut = df.withColumn("_h", order).withColumn(
        "_p", F.floor(F.col("_h") / (2**32 // pieces)).cast("int")
    )
    sizes = cut.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group,
        "_p",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"),
        F.sum("_c").over(Window.partitionBy(group)).alias("group_rows"),
    )
    inside = Window.partitionBy(group, "_p").orderBy("_h", tie)
    numbered = cut.withColumn("_r", F.row_number().over(inside))
    joined = lookup_join(numbered, offsets, [group, "_p"])
    return joined.withColumn("row_number", F.col("_r") + F.col("_o")).drop("_h", "_p", "_r", "_o")


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42,
    pieces: int = 4096,
) -> DataFrame:
    """Column ``split`` with exactly ``round(share * rows)`` test rows in every class.

    The test rows of a class are those with the smallest key hashes. A histogram of the hashes tells
    in which piece of the hash range a class's last test row lies; only the rows of that piece are
    ordered, to find that row. The split itself compares each row with it and shuffles nothing.
    """
    rows = df.where(F.col(label).isNotNull())
    hashed = rows.select(F.col(label), F.col(key), hash_share(key, seed).alias("_h")).withColumn(
        "_p", F.floor(F.col("_h") / (2**32 // pieces)).cast("int")
    )
    sizes = hashed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(label).orderBy("_p")
    wanted = F.floor(F.sum("_c").over(Window.partitionBy(label)) * test_share + 0.5)
    placed = sizes.select(
        label, "_p", (F.sum("_c").over(up_to) - F.col("_c")).alias("_before"), "_c",
        wanted.alias("_wanted"),
    )
    last = placed.where("_before < _wanted and _wanted <= _before + _c").select(
        label, "_p", (F.col("_wanted") - F.col("_before")).alias("_need")
    )
    inside = Window.partitionBy(label, "_p").orderBy("_h", key)
    edge = lookup_join(hashed, last, [label, "_p"]).withColumn("_r", F.row_number().over(inside))
    cuts = edge.where("_r = _need").select(
        label, F.struct(F.col("_h"), F.col(key).alias("_k")).alias("_cut")
    )
    mine = F.struct(hash_share(key, seed).alias("_h"), F.col(key).alias("_k"))
    split = F.when(mine <= F.col("_cut"), "test").otherwise("train")
    return lookup_join(rows, cuts, [label], "left").withColumn("split", split).drop("_cut")


def following_heads(df: DataFrame, group: str, key: str, tokens: str, count: int) -> DataFrame:
    """Column ``_tail``: the first ``count`` tokens after the row, in its group, by key order.

    Rows without tokens are dropped. The ordered windows run per (group, key range); the range
    boundaries are bridged through one small row per (group, range), found from the heads alone.
    """
    empty = F.array().cast("array<string>")
    ranged = once(df.withColumn("_b", key_ranges(df, key)), tokens, F.col(tokens))
    rows = ranged.where(F.size(tokens) > 0).withColumn("_head", F.slice(tokens, 1, count))
    inside = Window.partitionBy(group, "_b").orderBy(key)

    def ahead(column: str, window: WindowSpec) -> Column:
        later = [F.coalesce(F.lead(column, i).over(window), empty) for i in range(1, count + 1)]
        return F.slice(F.concat(*later), 1, count)

    firsts = top_k(rows.select(group, "_b", key, "_head"), [group, "_b"], [F.col(key)], count)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "_head")))
    starts = firsts.groupBy(group, "_b").agg(
        F.slice(F.flatten(F.transform(in_order, lambda x: x["_head"])), 1, count).alias("_start")
    )
    ranges = Window.partitionBy(group).orderBy("_b")
    bridge = starts.select(group, "_b", ahead("_start", ranges).alias("_next"))
    rows = rows.withColumn("_near", ahead("_head", inside))
    joined = lookup_join(rows, bridge, [group, "_b"], "left")
    tail = F.slice(F.concat("_near", F.coalesce("_next", empty)), 1, count)
    return joined.withColumn("_tail", tail).drop("_b", "_head", "_near", "_next")
