"""N-gram keywords per record and per group, and scores over a whole set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelog import runtime
from torquelog.functions import ngrams, text
from torquelog.operators.ranking import following_heads, top_k
from torquelog.runtime import materialize, once, salted_join, staged

SIZES = (1, 2, 3)
FEATURES = 50
COMMON = 2048  # most frequent words of a group whose n-grams are counted first
HELD = 1 << 18  # most common n-grams of a corpus that the tasks hold with their weights
HELD_BYTES = 256  # of such an n-gram at most
LARGE = 1 / 512  # least share of all words of a group counted so; there are at most 512


def gram_rows(df: DataFrame, keep: list[str], tokens: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row (keep..., n, gram) per n-gram occurrence."""
    sized = df.select(*keep, F.inline(ngrams.all_ngrams(F.col(tokens), sizes)))
    return sized.select(*keep, "n", F.explode("grams").alias("gram"))


def group_keywords(
    df: DataFrame,
    group: str,
    key: str,
    tokens: str,
    sizes: tuple[int, ...] = SIZES,
    k: int = FEATURES,
    span_rows: bool = False,
) -> DataFrame:
    """Top ``k`` n-grams per group and n: (group, n, gram, cnt, rank), by count, then gram.

    An n-gram is counted no more often than any of its words. So the n-grams of a large group are
    counted among its ``COMMON`` most frequent words first; if the last of the ``k`` best is more
    frequent than the last of those words, no other n-gram can be among them. The other groups are
    counted in full. No group text is ever built. With ``span_rows`` the rows of a group are read as
    one text in key order, so n-grams also cross from a row into the next ones; only the few words at
    the ends of the rows are put in order for that.
    """
    kept = [group, key] if span_rows and key != group else [group]
    rows = staged(df.select(*kept, F.col(tokens).alias("_tokens")), "group_tokens")
    mine = F.xxhash64(group)
    most = max(COMMON, k)
    words = rows.select(group, F.explode("_tokens").alias("gram"))
    words = words.groupBy(group, "gram").agg(F.count(F.lit(1)).alias("cnt"))
    top = materialize(top_k(words, [group], [F.desc("cnt"), F.col("gram")], most))
    single = top.select(group, F.lit(1).alias("n"), "gram", "cnt", "rank").where(F.col("rank") <= k)
    longer = tuple(n for n in sizes if n > 1)
    if not longer:
        return single
    crossing = None
    if span_rows:
        crossing = staged(_crossing_grams(rows, group, key, "_tokens", longer), "crossing_grams")

    def best_of(counts: DataFrame, within: Column) -> DataFrame:
        if crossing is not None:
            counts = counts.unionByName(crossing.where(within).withColumn("cnt", F.lit(1).cast("long")))
        counts = counts.groupBy(group, "n", "gram").agg(F.sum("cnt").alias("cnt"))
        return top_k(counts, [group, "n"], [F.desc("cnt"), F.col("gram")], k)

    large, groups = _large_groups(rows, group)
    common = top.where(mine.isin(large)).select(mine.alias("g"), "gram").toArrow()
    among = rows.where(mine.isin(large)).select(mine.alias("_g"), group, "_tokens")
    schema = T.StructType(
        [rows.schema[group], T.StructField("n", T.IntegerType()), T.StructField("gram", T.StringType()),
         T.StructField("cnt", T.LongType())]
    )
    pairs = df.sparkSession.sparkContext.broadcast(common)
    found = materialize(best_of(among.mapInArrow(_grams_among(pairs, longer), schema), mine.isin(large)))
    last = top.where(F.col("rank") == most).where(mine.isin(large)).select(mine.alias("g"), "cnt")
    last = {row["g"]: row["cnt"] for row in last.collect()}
    floors = found.where(F.col("rank") == k).select(mine.alias("g"), "n", "cnt")
    floors = {(row["g"], row["n"]): row["cnt"] for row in floors.collect()}
    settled = [g for g in large if g not in last or all(floors.get((g, n), 0) > last[g] for n in longer)]
    done = found.where(mine.isin(settled))
    if len(settled) < groups:
        rest = gram_rows(rows.where(~mine.isin(settled)), [group], "_tokens", longer)
        rest = rest.withColumn("cnt", F.lit(1).cast("long"))
        done = done.unionByName(best_of(rest, ~mine.isin(settled)))
    return single.unionByName(done) if 1 in sizes else done


def _large_groups(rows: DataFrame, group: str) -> tuple[list[int], int]:
    """Hashes of the groups with at least ``LARGE`` of all words, and the number of all groups.

    Groups with a token that is null or holds a blank are left out: there an n-gram may be spelled by
    different words.
    """
    odd = F.exists("_tokens", lambda t: t.isNull() | F.contains(t, F.lit(" ")))
    sizes = rows.groupBy(group).agg(F.sum(F.size("_tokens")).alias("words"), F.max(odd).alias("odd"))
    sizes = materialize(sizes)
    total, groups = sizes.agg(F.sum("words"), F.count(F.lit(1))).first()
    large = sizes.where(~F.col("odd") & (F.col("words") >= (total or 0) * LARGE) & (F.col("words") > 0))
    return [row["g"] for row in large.select(F.xxhash64(group).alias("g")).collect()], groups


def _grams_among(common, sizes: tuple[int, ...]):
    """(group, n, gram, cnt) over Arrow batches (hash, group, tokens): the n-grams of common words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value.combine_chunks()
        words = pc.unique(table["gram"])
        hashes, place = np.unique(table["g"].to_numpy(), return_inverse=True)
        of = pc.index_in(table["gram"], value_set=words).to_numpy()
        known = np.sort(place.astype(np.int64) * len(words) + of)
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            if not len(known) or not len(row):
                continue
            word = pc.index_in(batch.column(2).flatten(), value_set=words).fill_null(-1).to_numpy()
            key = np.searchsorted(hashes, batch.column(0).to_numpy())[row] * len(words) + word
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = (word >= 0) & (known[at] == key)
            # a number for each different n-gram of a group, from that of its first n - 1 words
            number, first, text = at, np.arange(len(row)), words.take(pa.array(np.where(hit, word, 0)))
            for n in range(2, max(sizes) + 1):
                end = first + n - 1
                fits = end < len(row)
                first, number, end = first[fits], number[fits], end[fits]
                fits = hit[first] & hit[end] & (row[first] == row[end])
                first, number, end = first[fits], number[fits], end[fits]
                _, one, number, cnt = np.unique(
                    number * len(known) + at[end], return_index=True, return_inverse=True, return_counts=True
                )
                if n in sizes and len(one):
                    start = first[one]
                    parts = [text.take(pa.array(start + i)) for i in range(n)]
                    columns = [
                        batch.column(1).take(pa.array(row[start])), pa.array(np.full(len(one), n, np.int32)),
                        pc.binary_join_element_wise(*parts, " "), pa.array(cnt.astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[1], "n", "gram", "cnt"])

    return run


def _crossing_grams(
    df: DataFrame, group: str, key: str, tokens: str, sizes: tuple[int, ...]
) -> DataFrame:
    """(group, n, gram) of the n-grams that start in a row and end in a later one of its group.

    They hold at most n - 1 words of the row's end and as many of what follows, so no other n-gram
    is in those two parts together.
    """
    most = max(sizes) - 1
    inner = F.concat(F.slice(tokens, 1, most), F.slice(tokens, -most, most))
    ends = df.select(
        group, key, F.when(F.size(tokens) <= 2 * most, F.col(tokens)).otherwise(inner).alias("_ends")
    )
    rows = following_heads(ends, group, key, "_ends", most)

    def made(n: int) -> Column:
        last = F.slice("_ends", F.greatest(F.size("_ends") - n + 2, F.lit(1)), n - 1)
        both = F.concat(last, F.slice("_tail", 1, n - 1))
        return F.struct(F.lit(n).alias("n"), text.let(both, lambda t: ngrams.ngrams(t, n)).alias("grams"))

    sized = rows.select(group, F.inline(F.array(*[made(n) for n in sizes if n > 1])))
    return sized.select(group, "n", F.explode("grams").alias("gram"))


def record_counts(
    df: DataFrame, keep: list[str], tokens: str, sizes: tuple[int, ...] = SIZES, k: int | None = None,
    among: str | None = None,
) -> DataFrame:
    """(keep..., n, counts) with the record's n-grams as an array of structs (neg, gram).

    ``neg`` is the negated count; the order is by it, then by gram. With ``k`` only the first are kept.
    With ``among`` those are found first; then ``neg`` counts the words equal to the gram in that
    column of string lists (n = 1; 0 for longer ones). The record is one row, so nothing is shuffled.
    """
    listed = [F.col(tokens).alias("_tokens")] + ([F.col(among).alias("_among")] if among else [])
    kept = df.select(*keep).schema
    counts = T.ArrayType(
        T.StructType([T.StructField("neg", T.LongType()), T.StructField("gram", T.StringType())])
    )
    schema = T.StructType([*kept.fields, T.StructField("n", T.IntegerType()), T.StructField("counts", counts)])
    return df.select(*keep, *listed).mapInArrow(_record_counts(len(keep), sizes, k, bool(among)), schema)


def _slices(batch: pa.RecordBatch, lists: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` list elements, at least one row each."""
    lengths = batch.column(lists).value_lengths().fill_null(0).to_numpy()
    run = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def _record_counts(kept: int, sizes: tuple[int, ...], k: int | None, exact: bool):
    """The rows of ``record_counts`` over Arrow batches (kept..., tokens, words to count among)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, kept)):
            rows = batch.num_rows
            lists = batch.column(kept)
            row = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            for n in sizes:
                first = np.arange(max(0, len(row) - n + 1))
                first = first[row[first] == row[first + n - 1]]
                parts = [flat.take(pa.array(first + i)) for i in range(n)]
                grams = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                coded = grams.dictionary_encode()
                order = pc.array_sort_indices(coded.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                many = max(1, len(order))
                key = row[first] * many + rank[coded.indices.to_numpy()]
                key, cnt = np.unique(key, return_counts=True)
                owner, rank = key // many, key % many
                best = np.lexsort((rank, -cnt, owner))
                owner, rank, cnt = owner[best], rank[best], cnt[best]
                if k is not None:
                    top = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
                    owner, rank, cnt = owner[top], rank[top], cnt[top]
                if exact:
                    cnt = _held(batch.column(kept + 1), owner, order[rank], coded.dictionary, n)
                    best = np.lexsort((rank, -cnt, owner))
                    owner, rank, cnt = owner[best], rank[best], cnt[best]
                pairs = pa.StructArray.from_arrays(
                    [pa.array(-cnt.astype(np.int64)), coded.dictionary.take(pa.array(order[rank]))], ["neg", "gram"]
                )
                offsets = pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(kept)), pa.array(np.full(rows, n, np.int32)),
                     pa.ListArray.from_arrays(offsets, pairs)],
                    [*batch.schema.names[:kept], "n", "counts"],
                )

    return run


def _held(lists: pa.ListArray, owner: np.ndarray, gram: np.ndarray, grams: pa.Array, n: int) -> np.ndarray:
    """How often the list of row ``owner`` holds the word ``gram`` of ``grams``, for each pair of these."""
    if n > 1 or not len(owner):
        return np.zeros(len(owner), np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    word = pc.index_in(lists.flatten(), value_set=grams).fill_null(-1).to_numpy()
    key, cnt = np.unique((row * len(grams) + word)[word >= 0], return_counts=True)
    if not len(key):
        return np.zeros(len(owner), np.int64)
    wanted = owner * len(grams) + gram
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return np.where(key[at] == wanted, cnt[at], 0)


def record_keyword_lists(
    df: DataFrame, key: str, tokens: str, sizes: tuple[int, ...] = SIZES, k: int = FEATURES
) -> DataFrame:
    """Top ``k`` n-grams per record and n: (key, n, keywords) as structs (word, freq). Map-only."""
    counts = record_counts(df, [key], tokens, sizes, k)
    return counts.select(key, "n", _named("counts").alias("keywords"))


def record_keywords(
    df: DataFrame, key: str, tokens: str, sizes: tuple[int, ...] = SIZES, k: int = FEATURES
) -> DataFrame:
    """Top ``k`` n-grams per record and n as rows (key, n, gram, cnt, rank). Map-only."""
    lists = record_keyword_lists(df, key, tokens, sizes, k)
    rows = lists.select(key, "n", F.posexplode("keywords").alias("pos", "kw"))
    return rows.select(
        key, "n", F.col("kw.word").alias("gram"), F.col("kw.freq").alias("cnt"),
        (F.col("pos") + 1).alias("rank"),
    )


def words_only(keywords: str) -> Column:
    """The words of a keyword array, without their counts."""
    return F.transform(keywords, lambda x: x["word"])


def published_lists(
    df: DataFrame, key: str, value: str, sizes: tuple[int, ...] = SIZES, k: int = FEATURES,
    lower: bool = False,
) -> DataFrame:
    """Keyword lists with the counts of the published outputs: (key, n, keywords).

    The n-grams are the top ``k`` of the lower-cased text as ever. Their count is how often the text
    (``lower``: the lower-cased text) holds them as whole words in exactly that form, inner marks
    included. So a word written with a capital, a part of ``6/09/21`` and every longer n-gram count
    0. The order is by that count, then by n-gram.
    """
    source = F.lower(F.col(value)) if lower else F.col(value)
    rows = df.select(
        key, text.running_words(source).alias("raw"), ngrams.keyword_tokens(F.col(value)).alias("tokens")
    )
    counts = record_counts(rows, [key], "tokens", sizes, k, among="raw")
    return counts.select(key, "n", _named("counts").alias("keywords"))


def _named(counts: str) -> Column:
    return F.transform(
        counts, lambda x: F.struct(x["gram"].alias("word"), (-x["neg"]).alias("freq"))
    )


def top_gram_lists(
    df: DataFrame, keep: list[str], tokens: str, n: int = 2, k: int = 10
) -> DataFrame:
    """Top n-grams of each record with their weight in the record's unit-length vector.

    A record is its own corpus here, so every n-gram has the same inverse frequency and the weight
    is ``count / sqrt(sum of squared counts)``. (keep..., top) with structs (word, weight). Map-only.
    """
    counts = record_counts(df, keep, tokens, (n,))
    squares = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x["neg"] * x["neg"])
    sized = once(counts, "norm", F.sqrt(squares))
    weighted = F.transform(
        F.slice("counts", 1, k),
        lambda x: F.struct(
            x["gram"].alias("word"), F.round(-x["neg"] / F.col("norm"), 6).alias("weight")
        ),
    )
    return sized.select(*keep, weighted.alias("top"))


def record_top_grams(df: DataFrame, key: str, tokens: str, n: int = 2, k: int = 10) -> DataFrame:
    """``top_gram_lists`` as rows (key, gram, weight, rank)."""
    rows = top_gram_lists(df, [key], tokens, n, k).select(key, F.posexplode("top").alias("pos", "t"))
    return rows.select(
        key, F.col("t.word").alias("gram"), F.col("t.weight").alias("weight"),
        (F.col("pos") + 1).alias("rank"),
    )


def corpus_weights(df: DataFrame, key: str, tokens: str, n: int = 1) -> DataFrame:
    """(key, gram, weight): smooth-idf TF-IDF with unit length per record.

    The n-grams of the records are counted and stored once. The most common ``HELD`` n-grams are
    weighted where the records are; only rows of the others, of which each is in few records, are
    joined to their frequencies. The records travel once, as lists, to the lengths of their vectors;
    rows of one key are one vector, those without a key, too.
    """
    counts = record_counts(df, [key], tokens, (n,)).select(F.col(key).alias("_k"), "counts")
    counts = staged(counts, "gram_counts")
    records = counts.where(F.col("_k").isNotNull()).count()
    rows = counts.select("_k", F.inline("counts"))
    idf = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("in")).select(
        "gram", "in", (F.log(F.lit(1 + records) / (1 + F.col("in"))) + 1).alias("idf")
    )
    idf = staged(idf, "gram_frequencies")
    held = max(0, min(HELD, runtime.BROADCAST_ROWS))
    short = F.octet_length("gram") <= HELD_BYTES
    weight = (-F.col("neg") * F.col("idf")).alias("w")
    if held:
        top = idf.where(short).orderBy(F.desc("in"), "gram").limit(held)
        top = staged(top.select("gram", "idf"), "common_grams")
        common = lambda rows: rows.join(F.broadcast(top), "gram")
        rare = rows.join(F.broadcast(top.select("gram")), "gram", "left_anti")
        rare = rare.join(idf.join(F.broadcast(top.select("gram")), "gram", "left_anti"), "gram")
    else:
        common = None
        rare = salted_join(rows, idf, ["gram"])
    rare = staged(rare.select("_k", "gram", weight), "rare_weights")
    found = rare.select("_k", "w")
    if common:
        found = found.unionByName(common(rows).select("_k", weight))
    lengths = found.groupBy("_k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    lengths = staged(lengths.withColumnRenamed("_k", "_of"), "vector_lengths")

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(lengths.hint("merge"), F.col("_k").eqNullSafe(F.col("_of")))

    out = sized(rare)
    if common:
        listed = sized(counts).select("_k", "length", F.inline("counts"))
        out = out.select("_k", "length", "gram", "w").unionByName(
            common(listed).select("_k", "length", "gram", weight)
        )
    return out.select(F.col("_k").alias(key), "gram", (F.col("w") / F.col("length")).alias("weight"))


def set_keywords(df: DataFrame, key: str, tokens: str, n: int = 1, k: int = 10) -> DataFrame:
    """Top ``k`` n-grams of a whole set by summed TF-IDF."""
    sums = corpus_weights(df, key, tokens, n).groupBy("gram").agg(
        F.round(F.sum("weight"), 6).alias("score")
    )
    return sums.orderBy(F.desc("score"), "gram").limit(k)


def phrase_matches(df: DataFrame, tokens: str, phrases: list[str]) -> DataFrame:
    """Rows holding at least one phrase, with the sorted list of those found. No shuffle."""
    found = once(df, "matched", ngrams.matched_phrases(F.col(tokens), phrases))
    return found.where(F.size("matched") > 0)
