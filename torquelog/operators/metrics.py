"""Classifier quality from (label, prediction) rows. One aggregation to classes x classes counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _per_class(df: DataFrame, label: str, prediction: str, labels: DataFrame | None) -> DataFrame:
    cells = confusion(df, label, prediction)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    # each cell counts for its label's row total and its prediction's column total
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label"),
                    hit.alias("hit"),
                    F.col("rows").alias("actual"),
                    zero.alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    zero.alias("hit"),
                    zero.alias("actual"),
                    F.col("rows").alias("predicted"),
                ),
            )
        )
    )
    if labels is not None:
        named = labels.select(
            labels.columns[0], zero.alias("hit"), zero.alias("actual"), zero.alias("predicted")
        ).toDF("label", "hit", "actual", "predicted")
        sides = sides.unionByName(named)
    sums = sides.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("hit").alias("hit"),
        F.sum("actual").alias("support"),
        F.sum("predicted").alias("predicted"),
    )
    precision = _ratio(F.col("hit"), F.col("predicted"))
    recall = _ratio(F.col("hit"), F.col("support"))
    return sums.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        "hit",
    )


def class_report(
    df: DataFrame, label: str, prediction: str, labels: DataFrame | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class; classes of ``labels`` always get a row."""
    rows = _per_class(df, label, prediction, labels)
    return rows.select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    rows = _per_class(df, label, prediction, None)

    def weighted(name: str):
        total = F.sum("support")
        return F.round(F.sum(F.col(name) * F.col("support")) / total, 6).alias(name)

    return rows.agg(
        F.round(F.sum("hit") / F.sum("support"), 6).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
    )
