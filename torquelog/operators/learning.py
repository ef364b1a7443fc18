"""Text classifiers on Spark ML: features, training, scoring, storage."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    IndexToString,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog.functions import lexicons, text
from torquelog.operators.classes import class_weights
from torquelog.operators.ranking import top_labels
from torquelog.runtime import lookup_join, materialize, scratch_path

SEED = 42
MAX_FEATURES = 1000


def _counting(df: DataFrame, column: str, max_features: int, stop: bool) -> list:
    """The stages from a text column to the counts of its most frequent words."""
    words = RegexTokenizer(
        inputCol=column, outputCol="_words", pattern=text.WORD, gaps=False, toLowercase=True
    )
    remover = StopWordsRemover(
        inputCol="_words", outputCol="_kept", stopWords=lexicons.STOP_KEYWORDS if stop else []
    )
    tokens = remover.transform(words.transform(df))
    # the filter on its size that an inner explode infers would make the list a second time
    found = tokens.select(F.explode_outer("_kept").alias("word")).where("word is not null")
    counts = found.groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(max_features).collect()
    counter = CountVectorizerModel.from_vocabulary(
        [r["word"] for r in top] or [""], inputCol="_kept", outputCol="_counts"
    )
    return [words, remover, counter]


def _weighing(counted: DataFrame) -> PipelineModel:
    """The stages from the counts to the features."""
    rest = [IDF(inputCol="_counts", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="features")]
    return Pipeline(stages=rest).fit(counted)


def fit_features(
    df: DataFrame, column: str, max_features: int = MAX_FEATURES, stop: bool = True
) -> PipelineModel:
    """TF-IDF stages for a text column, fitted on ``df``: give it the training rows only.

    The features are the most frequent words; of equally frequent ones the alphabetically first, so
    the same rows always give the same features. Spark's IDF is ``ln((rows + 1) / (df + 1))`` without
    an added 1, so a word of every row weighs 0.
    """
    counting = _counting(df, column, max_features, stop)
    return PipelineModel([*counting, *_weighing(PipelineModel(counting).transform(df)).stages])


def _labelled(df: DataFrame, label: str) -> StringIndexer:
    """Alphabetical label numbers. Only training rows pass through it, so none is unseen."""
    return StringIndexer(
        inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error"
    )


def _classifier(kind: str, weighted: bool, **options):
    weight = {"weightCol": "_weight"} if weighted else {}
    common = {"labelCol": "_label", "featuresCol": "features", **weight, **options}
    if kind == "forest":
        return RandomForestClassifier(**{"numTrees": 100, "maxDepth": 10, "seed": SEED, **common})
    if kind == "logistic":
        return LogisticRegression(**{"maxIter": 1000, "family": "multinomial", **common})
    raise ValueError(f"unknown classifier {kind!r}")


def train(
    df: DataFrame, column: str, label: str, kind: str = "forest", weighted: bool = False,
    stop: bool = True, **options,
) -> PipelineModel:
    """Fit features, labels and a classifier. ``weighted`` uses balanced class weights.

    The text is read twice, for the words and for their counts; the counts are stored, and every later
    pass of the fits reads them instead of the text.
    """
    rows = df.where(F.col(label).isNotNull()).withColumn(column, F.coalesce(F.col(column), F.lit("")))
    if weighted:
        weights = class_weights(rows, label).select(label, F.col("weight").alias("_weight"))
        rows = lookup_join(rows, weights, [label])
    counting = _counting(rows, column, MAX_FEATURES, stop)
    kept = [label, "_weight"] if weighted else [label]
    counted = materialize(PipelineModel(counting).transform(rows).select(*kept, "_counts"))
    labels = _labelled(counted, label).fit(counted)
    weighing = _weighing(counted)
    fitted = _classifier(kind, weighted, **options).fit(weighing.transform(labels.transform(counted)))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)
    return PipelineModel([*counting, *weighing.stages, fitted, names])


def label_names(model: PipelineModel) -> list[str]:
    return model.stages[-1].getLabels()


def score(df: DataFrame, model: PipelineModel, column: str, top: int = 3) -> DataFrame:
    """Add ``predicted`` and ``top_predictions`` (label, prob); blank texts stay, unscored."""
    original = df.columns
    keep_text = df.withColumn("_text", F.col(column)).withColumn(
        column, F.coalesce(F.col(column), F.lit(""))
    )
    scored = model.transform(keep_text)
    names = label_names(model)
    best = top_labels(F.slice(vector_to_array("probability"), 1, len(names)), names, top)
    empty = text.blank(F.col("_text"))
    others = [c for c in original if c != column]
    return scored.select(
        *others,
        F.col("_text").alias(column),
        F.when(~empty, F.col("predicted")).alias("predicted"),
        F.when(~empty, best).alias("top_predictions"),
    )


def predict_one(spark: SparkSession, model: PipelineModel, value: str, column: str) -> str | None:
    """Predicted label of a single text."""
    return score(spark.createDataFrame([(value,)], f"{column} string"), model, column).first()[
        "predicted"
    ]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_two_stage(
    df: DataFrame, column: str, system: str, part: str, kind: str = "logistic", **options
) -> tuple[PipelineModel, dict[str, PipelineModel]]:
    """A system model and, for each system, a model of its parts. One fit per system."""
    first = train(df, column, system, kind, **options)
    second = {}
    for name in label_names(first):
        rows = df.where(F.col(system) == name)
        if rows.select(part).distinct().limit(2).count() > 1:
            second[name] = train(rows, column, part, kind, **options)
    return first, second


def score_two_stage(
    df: DataFrame, models: tuple[PipelineModel, dict[str, PipelineModel]], column: str
) -> DataFrame:
    """Predicted system and, inside it, the predicted part (null for systems of one part).

    The first model reads the rows once; its result is stored by system, so each second model reads
    the rows of its own system only.
    """
    first, second = models
    staged = score(df, first, column).withColumnRenamed("predicted", "system")
    staged = staged.drop("top_predictions")
    path = scratch_path(df.sparkSession, "systems")
    staged.withColumn("_system", F.col("system")).write.partitionBy("_system").parquet(path)
    staged = df.sparkSession.read.schema(staged.schema.add("_system", "string")).parquet(path)
    named = F.col("_system").isin(list(second))
    result = staged.where(F.col("_system").isNull() | ~named).withColumn("part", F.lit(None).cast("string"))
    for name, model in second.items():
        chosen = score(staged.where(F.col("_system") == name), model, column)
        result = result.unionByName(
            chosen.withColumnRenamed("predicted", "part").drop("top_predictions")
        )
    return result.drop("_system")
