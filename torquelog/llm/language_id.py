"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
CHARS = 1 << 20  # characters worked on at once
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@functools.cache
def character_table() -> np.ndarray:
    """Lower case of every letter, a blank for every other character."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets by order and place, first place of each text, whether a text has a letter).

    Texts are two blanks apart, so that no n-gram of a text's characters reaches into the next; the
    places of those blanks have the number ``BUCKETS``, which counts for nothing.
    """
    pad = " " * (max(ORDERS) - 1)
    code = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "replace"), np.uint32)
    code = character_table()[code]
    sizes = np.array([len(t) + len(pad) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    letters = np.add.reduceat(code != 32, first, dtype=np.int64) > 0
    out = np.zeros((len(ORDERS), len(code)), np.int64)
    for row, n in enumerate(ORDERS):
        h = np.full(len(code), np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF), np.uint32)
        for j in range(n):
            h[: len(code) - j] ^= code[j:] * np.uint32(_MULTIPLIERS[j])
            h = (h << np.uint32(13)) | (h >> np.uint32(19))
        h *= np.uint32(0x9E3779B1)
        out[row] = h >> np.uint32(32 - (BUCKETS - 1).bit_length())
    out[:, ((first + sizes)[:, None] - np.arange(1, len(pad) + 1)).ravel()] = BUCKETS
    return out, first, letters


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHARS`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t) + 2
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each language over a partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, end in _groups(texts):
            buckets, first, _ = grams(texts[start:end])
            names = sorted(set(langs[start:end]))
            number = np.array([names.index(x) for x in langs[start:end]])
            row = BUCKETS + 1
            of = np.repeat(number * row, np.diff(np.append(first, buckets.shape[1])))
            total = sum(np.bincount(of + b, minlength=len(names) * row) for b in buckets)
            for i, name in enumerate(names):
                part = total[i * row : i * row + BUCKETS]
                counts[name] = counts[name] + part if name in counts else part.copy()
    for name, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
            ["lang", "bucket", "n"],
        )


@dataclass
class Model:
    """Languages in order and their log probabilities: one column per bucket, and the prior."""

    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", alpha: float = ALPHA) -> Model:
    """Count n-grams by language over all rows that have a text and a language.

    What reaches the driver has one row per language and bucket, whatever the number of documents.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    counted = rows.mapInArrow(_count, "lang string, bucket int, n bigint")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    documents = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(documents)
    table = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    table[counted["lang"].map(place).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"]
    table += alpha
    prior = np.log(np.array([documents[x] for x in languages], float)) if languages else np.zeros(0)
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)), prior)


def posterior(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the likeliest language, its probability, whether the text has a letter)."""
    best, share, has = [], [], []
    for start, end in _groups(texts):
        buckets, first, letters = grams(texts[start:end])
        scores = np.zeros((end - start, len(model.languages)))
        for i, row in enumerate(model.log_probability):
            row = np.append(row, 0.0)
            total = sum(row[b] for b in buckets)
            scores[:, i] = np.add.reduceat(total, first) + model.log_prior[i]
        top = scores.argmax(axis=1)
        weight = np.exp(scores - scores[np.arange(len(top)), top][:, None])
        best.append(top)
        share.append(1 / weight.sum(axis=1))
        has.append(letters)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(best, int), join(share, float), join(has, bool)


def predict(docs: DataFrame, model: Model, key: Column, extra: Column, text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, in the order and partitions it has.

    A null text, one without any letter, or a model of no language gives "und" with score 0. The
    score is the posterior probability; equal ones go to the alphabetically first language.
    """
    rows = docs.select(key.alias("doc_id"), extra.alias("held_out"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            if model_.languages:
                best, share, has = posterior(model_, texts)
            else:
                best = share = np.zeros(len(texts))
                has = np.zeros(len(texts), bool)
            names = [model_.languages[int(b)] if h else UNKNOWN for b, h in zip(best, has)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(has, share, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def fold(key: str = "doc_id") -> Column:
    """True for the fifth of the keys that is held out; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, directory: str) -> DataFrame:
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    model = train(docs.where(~fold() & F.col("doc_id").isNotNull()))
    return predict(docs, model, F.col("doc_id"), fold())
