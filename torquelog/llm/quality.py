"""Ordinal regression of text quality: one hashed weight vector, ordered thresholds.

The chance that a text's grade is at least k is a logistic function of its score minus threshold k.
The score is the sum of the weights of the distinct hashed features of the text, so all grades share
the weights and only the thresholds differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog.llm import common, words
from torquelog.llm.language_id import fold

BUCKETS = 1 << 18
MAX_ROWS = 20_000  # labelled rows to fit on, at most
FEATURES = 1024  # buckets that have a weight, at most
MIN_TEXTS = 5  # a feature of fewer fitted texts has no weight
STEPS = 300
RATE = 0.1
DECAY = 1e-4
TAIL = 0.5
PREFIXES = (4, 5, 6, 7, 8, 10)  # bytes

_SYMBOL = ~words.ALNUM & words.NOT_SPACE
_SYMBOL[128:] = False


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return words.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature buckets, first one of each text and the end) of the texts in ``data``.

    Features are the lower-cased words and their first bytes, once more if they come twice and if
    they come four times; the runs of symbols; and tenths of: words that repeat the one before,
    distinct words among all, symbols and upper-case letters among the bytes.
    """
    low = words.LOWER[data]
    texts = len(at) - 1
    start, end, first = words.spans(low, at, words.ALNUM)
    long = [np.flatnonzero(end - start > n) for n in PREFIXES]
    h = words.hashes(low, start, end, *[np.minimum(start + n, end) for n in PREFIXES])
    owner = np.repeat(np.arange(texts), np.diff(first))
    s_start, s_end, s_first = words.spans(low, at, _SYMBOL)
    symbols = words.hashes(low, s_start, s_end)
    s_owner = np.repeat(np.arange(texts), np.diff(s_first))
    whole = h[0]
    again = np.zeros(len(whole), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])

    def keys(of: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        return (of.astype(np.int64) << 18) | (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)

    of_words, times = np.unique(keys(owner, whole), return_counts=True)
    counted = [keys(owner[w], _salted(h[i + 1][w], 1 + i)) for i, w in enumerate(long)]
    parts, many = np.unique(np.concatenate(counted), return_counts=True)
    found = [of_words, parts, keys(s_owner, _salted(symbols, 20))]
    for least, salt in ((2, 21), (4, 22)):
        for key, n in ((of_words, times), (parts, many)):
            key = key[n >= least]
            found.append(keys(key >> 18, _salted(key.astype(np.uint64) & np.uint64(BUCKETS - 1), salt)))

    by = lambda of, weight=None: np.bincount(of, weight, minlength=texts)
    count, size = np.maximum(np.diff(first), 1), np.maximum(np.diff(at), 1)
    upper = np.add.reduceat(np.append((data > 64) & (data < 91), False).astype(np.int64), at[:-1])
    shapes = [
        by(owner, again) / count,
        by(of_words >> 18) / count,
        by(s_owner, (s_end - s_start).astype(float)) / size,
        np.where(np.diff(at) > 0, upper, 0) / size,
    ]
    for k, value in enumerate(shapes):
        found.append(keys(np.arange(texts), _salted(np.floor(value * 10).astype(np.uint64), 30 + k)))
    key = np.unique(np.concatenate(found))
    return key & (BUCKETS - 1), np.searchsorted(key >> 18, np.arange(texts + 1))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """For each text and each grade above the lowest, the chance of that grade or a higher one."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds - score[:, None]))


def informative(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Marks the buckets whose share of texts differs most between grades, by chi-square.

    ``seen`` has the number of texts of each grade that have the bucket, ``texts`` that of all. A
    bucket of fewer than ``MIN_TEXTS`` texts is never marked.
    """
    total = seen.sum(axis=0)
    expected = np.outer(texts / max(texts.sum(), 1), total)
    chi = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0)
    chi[total < MIN_TEXTS] = -1
    marked = np.zeros(BUCKETS, bool)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    marked[best[chi[best] > 0]] = True
    return marked


def fit(
    buckets: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS
) -> Model:
    """Maximum likelihood with weight decay by Adam over all given rows at each step.

    Threshold gaps are exponentials of free parameters, which keeps the thresholds in order. Without
    rows every text has the highest grade.
    """
    texts = len(grade)
    if not texts:
        return Model(np.zeros(BUCKETS), np.arange(grades - 1) - 40.0)
    owner = np.repeat(np.arange(texts), np.diff(first))
    used, column = np.unique(buckets, return_inverse=True)
    share = np.cumsum(np.bincount(grade, minlength=grades)[::-1])[::-1][1:] / texts
    share = np.clip(share, 0.01, 0.99)
    start = -np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    value = np.concatenate([np.zeros(len(used)), free])
    mean, square = np.zeros_like(value), np.zeros_like(value)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, t = value[: len(used)], value[len(used) :]
        cut = np.concatenate([[-np.inf], np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])), [np.inf]])
        score = np.bincount(owner, w[column], minlength=texts)
        above, beyond = sigmoid(score - cut[grade]), sigmoid(score - cut[grade + 1])
        chance = np.maximum(above - beyond, 1e-12)
        slope = 1 - above - beyond  # of the log chance by the score
        down, up = -above * (1 - above) / chance, beyond * (1 - beyond) / chance
        by_cut = np.bincount(grade, down, grades + 1) + np.bincount(grade + 1, up, grades + 1)
        by_cut = by_cut[1:grades]
        tail = np.cumsum(by_cut[::-1])[::-1]
        tail[1:] *= np.exp(t[1:])
        gradient = np.concatenate(
            [-np.bincount(column, slope[owner], minlength=len(used)) / texts + DECAY * w, -tail / texts]
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        value -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = value[: len(used)]
    t = value[len(used) :]
    return Model(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 sound but toxic, 2 sound; the least of repeated labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


GRADES = 3


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(buckets, grade) of (text, grade)."""
    for batch in batches:
        for row, end, data, at in words.chunks(batch.column(0)):
            buckets, first = features(data, at)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [lists, batch.column(1).slice(row, end - row)], ["buckets", "grade"]
            )


def _counted(levels: int):
    """Number of texts by grade and bucket, over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(levels * BUCKETS, np.int64)
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            grade = np.repeat(batch.column(1).to_numpy().astype(np.int64), sizes)
            seen += np.bincount(grade * BUCKETS + batch.column(0).flatten().to_numpy(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(seen[at])],
            ["grade", "bucket", "n"],
        )

    return run


def _only(marked):
    """The rows with the marked buckets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(0).flatten().to_numpy()
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            inside = marked.value[buckets]
            owner = np.repeat(np.arange(len(sizes)), sizes)[inside]
            first = np.searchsorted(owner, np.arange(len(sizes) + 1))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets[inside], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["buckets", "grade"])

    return run


def train(
    docs: DataFrame,
    grades: DataFrame,
    levels: int = GRADES,
    key: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Fit on at most ``max_rows`` graded keys, chosen by hash; rows without text are left out.

    Of the rows of a key the least text counts, so no more rows are fitted than that.

    The features are made, counted and chosen in the tasks; the driver gets a count per bucket and
    grade and of each fitted text the chosen features alone.
    """
    chosen = grades.select(F.col("doc_id").alias("graded"), "grade")
    chosen = chosen.orderBy(F.xxhash64("graded"), "graded").limit(max_rows)
    rows = docs.select(common.named(key).alias("key"), common.named(text).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(chosen), F.col("key") == F.col("graded"))
    rows = rows.groupBy("key", "grade").agg(F.min("text").alias("text")).select("text", "grade")

    found = common.stored(rows.mapInArrow(_featured, "buckets array<int>, grade int"), "quality_features")
    texts = np.zeros(levels, np.int64)
    for row in found.groupBy("grade").agg(F.count("*").alias("n")).collect():
        texts[row["grade"]] = row["n"]
    counted = found.mapInArrow(_counted(levels), "grade int, bucket int, n bigint")
    counted = counted.groupBy("grade", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((levels, BUCKETS))
    seen[counted["grade"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    marked = docs.sparkSession.sparkContext.broadcast(informative(seen, texts))
    left = found.mapInArrow(_only(marked), found.schema).toArrow()
    lists = left.column("buckets").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    buckets = lists.flatten().to_numpy().astype(np.int64)
    return fit(buckets, first, left.column("grade").to_numpy(), levels)


def scorer(model, text_at: int, wanted: list[int] | None, keep: float | None):
    """A function over Arrow batches: the columns ``wanted`` and the grades, or the rows to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            tails = []
            for _, _, data, at in words.chunks(batch.column(text_at)):
                buckets, first = features(data, at)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                tails.append(fitted.tails(np.bincount(owner, fitted.weights[buckets], len(first) - 1)))
            tails = np.concatenate(tails) if tails else np.zeros((0, len(fitted.thresholds)))
            if wanted is None:
                yield batch.filter(pa.array(tails[:, -1] >= keep))
                continue
            columns = [batch.column(i) for i in wanted]
            columns += [pa.array(tails.sum(axis=1))] + [pa.array(t) for t in tails.T]
            names = [batch.schema.names[i] for i in wanted] + ["expected_grade"]
            yield pa.RecordBatch.from_arrays(
                columns, names + [f"tail_{k + 1}" for k in range(tails.shape[1])]
            )

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_1, tail_2, ...) for every row; a null text is an empty one."""
    rows = docs.select(common.named(key).alias("doc_id"), common.named(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    tails = "".join(f", tail_{k + 1} double" for k in range(len(model.thresholds)))
    return rows.mapInArrow(
        scorer(shared, 1, [0], None), f"doc_id {kind}, expected_grade double{tails}"
    )


def select(docs: DataFrame, model: Model, text: str = "text", tail: float = TAIL) -> DataFrame:
    """The rows whose chance of the highest grade is at least ``tail``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = common.by_place(docs)
    kept = rows.mapInArrow(scorer(shared, docs.columns.index(text), None, tail), rows.schema)
    return kept.toDF(*docs.columns)


def query(spark: SparkSession, directory: str) -> DataFrame:
    """Fit on the labels whose key is not held out and score every document."""
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    model = train(docs, graded(labels.where(~fold())))
    return score(docs, model).select(
        "doc_id",
        fold().alias("held_out"),
        "expected_grade",
        "tail_1",
        "tail_2",
        (F.col("tail_2") >= TAIL).alias("keep"),
    )
