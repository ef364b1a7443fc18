"""Category vectors and nearest-category search through an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torquelog.functions import text
from torquelog.operators.ranking import top_k
from torquelog.runtime import lookup_join, materialize


def category_vectors(keywords: DataFrame, group: str, other: str | None = "Other") -> DataFrame:
    """Unit TF-IDF vectors of the keyword documents: (group, n, word, idf, weight).

    One document per (group, n). The result is small, at most groups x sizes x top-k words, and is
    materialised because its document count enters every weight.
    """
    lists = keywords if other is None else keywords.where(F.col(group) != other)
    words = lists.select(group, "n", F.explode(text.words(F.col("gram"))).alias("word"))
    counts = materialize(words.groupBy(group, "n", "word").agg(F.count(F.lit(1)).alias("tf")))
    documents = counts.select(group, "n").distinct().count()
    idf = counts.groupBy("word").agg(
        (F.log(F.lit(1 + documents) / (1 + F.count(F.lit(1)))) + 1).alias("idf")
    )
    raw = counts.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(group, "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, [group, "n"]).select(
        group, "n", "word", "idf", (F.col("w") / F.col("norm")).alias("weight")
    )


def closest_category(
    keywords: DataFrame, vectors: DataFrame, key: str, group: str, unknown: str = "Unknown"
) -> DataFrame:
    """Best category of each keyword list by cosine: (key, n, group, score).

    ``keywords`` has one row (key, n, keywords) per list, empty lists included. Each query word meets
    only the categories that hold it. Ties go to the alphabetically first category, lists without any
    shared word to ``unknown`` with score 0.
    """
    vectors = materialize(vectors)
    asked = F.flatten(F.transform("keywords", lambda x: text.words(x["word"])))
    query = keywords.select(key, "n", F.explode(asked).alias("word"))
    query = query.groupBy(key, "n", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = vectors.select("word", "idf").distinct()
    hits = lookup_join(query, idf, ["word"], ready=True, salt_all=True)
    hits = hits.withColumn("q", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy(key, "n")))
    hits = hits.select(key, "n", "word", (F.col("q") / length).alias("q"))
    held = vectors.select("word", group, F.col("n").alias("m"), "weight")
    dots = (
        lookup_join(hits, held, ["word"], ready=True, salt_all=True)
        .groupBy(key, "n", group, "m")
        .agg(F.round(F.sum(F.col("q") * F.col("weight")), 9).alias("score"))
    )
    best = dots.groupBy(key, "n").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col(group))).alias("b")
    )
    return keywords.join(best, [key, "n"], "left").select(
        key,
        "n",
        F.coalesce(F.col(f"b.{group}"), F.lit(unknown)).alias(group),
        F.round(F.coalesce(-F.col("b.neg"), F.lit(0.0)), 6).alias("score"),
        "keywords",
    )


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, mean): the mean vector of each class, for any number of classes."""
    cells = df.select(label, F.posexplode(vector).alias("pos", "value"))
    means = cells.groupBy(label, "pos").agg(F.avg("value").alias("mean"))
    lists = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("v"))
    return lists.select(label, F.transform("v", lambda cell: cell["mean"]).alias("mean"))


def unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length))


def nearest_vectors(
    df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 500
) -> DataFrame:
    """Top ``k`` rows per query vector by cosine: (query, key, score, rank).

    ``queries`` is a stated set (query, vector) of any size. It is worked through in blocks of about
    ``block`` queries, each of which travels to the rows as one small array; a block is cut to ``k``
    rows per query before the next one is added. Null vectors and those of length 0 have no cosine
    and are left out on both sides.
    """
    units = queries.select("query", unit(F.col("vector")).alias("unit")).where("unit is not null")
    units = materialize(units)
    rows = df.select(key, unit(F.col(vector)).alias("_unit")).where("_unit is not null")
    blocks = max(1, -(-units.count() // block))
    found = None
    for b in range(blocks):
        part = units.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks))).where(F.col("_block") == b)
        listed = part.groupBy("_block").agg(F.collect_list(F.struct("query", "unit")).alias("_queries"))

        def score(q: Column) -> Column:
            products = F.zip_with("_unit", q["unit"], lambda a, b: a * b)
            return F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 6)

        scores = F.transform("_queries", lambda q: F.struct(q["query"].alias("query"), score(q).alias("score")))
        # the number of the block, but not as a constant, which would turn the join into a nested loop
        mine = (F.size("_unit") * 0 + b).cast("long")
        met = rows.withColumn("_block", mine).join(F.broadcast(listed), "_block")
        pairs = met.select(key, F.inline(scores))
        best = top_k(pairs, ["query"], [F.desc("score"), F.col(key)], k)
        found = best if found is None else found.unionByName(best)
    return found
