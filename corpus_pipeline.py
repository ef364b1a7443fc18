"""A training corpus from raw documents, in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from torquelog.llm import common, decontaminate, line_dedup, ngram_join, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose chance of the highest grade is below one half.

    Fitted on the labelled ones among ``docs``; where none is labelled, every document stays.
    """
    labels = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, quality.train(docs, labels))


def line_winnowing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete the runs of three lines or of over 50 words that occurred before; every document stays."""
    return line_dedup.dedup_lines(docs, words=line_dedup.WORDS).select(*[common.named(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates (five words, similarity 0.8)."""
    return ngram_join.first_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise what is left and pack it into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_winnowing),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows are stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is fitted, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None
