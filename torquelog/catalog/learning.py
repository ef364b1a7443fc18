"""Classifier queries. Trained models have no SQL form; neighbours and balancing do."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from torquelog.catalog import sql
from torquelog.catalog.registry import register
from torquelog.functions import ngrams
from torquelog.operators import classes, learning, metrics
from torquelog.operators.ranking import stratified_split
from torquelog.runtime import load, scratch_path


def training_set(spark, sf):
    """Documents in the role of solution texts; their language is the system to predict."""
    df = load(spark, sf, "documents", "doc_id").select("doc_id", "lang", "source", "text")
    return stratified_split(df, "doc_id", "lang")


def rows_of(df, split: str):
    return df.where(F.col("split") == split).drop("split")


@register(
    "text_features",
    "M1",
    f"""WITH w AS (SELECT doc_id, unnest({sql.keyword_tokens("text")}) AS word FROM documents),
        v AS (SELECT word, count(DISTINCT doc_id) AS df FROM w GROUP BY word
              ORDER BY count(*) DESC, word LIMIT 1000),
        t AS (SELECT doc_id, word, count(*) * ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) AS weight
              FROM w JOIN v USING (word) GROUP BY doc_id, word, df),
        s AS (SELECT doc_id, count(*) FILTER (weight > 0) AS terms, max(weight) / sqrt(sum(weight * weight)) AS top
              FROM t GROUP BY doc_id)
        SELECT doc_id, coalesce(terms, 0)::INTEGER AS terms, round(coalesce(top, 0), 6) AS top
        FROM documents LEFT JOIN s USING (doc_id)""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = vector_to_array("features")
    return learning.fit_features(df, "text").transform(df).select(
        "doc_id",
        F.size(F.filter(weights, lambda w: w > 0)).alias("terms"),
        F.round(F.array_max(weights), 6).alias("top"),
    )


@register("forest_report", "M1 M2 M3 M8 A10 A11 W9")
def _(spark, sf):
    df = training_set(spark, sf)
    model = learning.train(rows_of(df, "train"), "text", "lang", "forest")
    scored = learning.score(rows_of(df, "test"), model, "text")
    return metrics.class_report(scored, "lang", "predicted", df.select("lang").distinct())


@register("logistic_keyword_report", "M4 M8 T17")
def _(spark, sf):
    tokens = ngrams.keyword_tokens(F.col("text"))
    df = load(spark, sf, "documents", "doc_id").select("doc_id", "lang", tokens.alias("tokens"))
    df = df.select("doc_id", "lang", F.array_join("tokens", " ").alias("keywords"))
    df = stratified_split(df, "doc_id", "lang")
    model = learning.train(rows_of(df, "train"), "keywords", "lang", "logistic", stop=False)
    return metrics.summary(learning.score(rows_of(df, "test"), model, "keywords"), "lang", "predicted")


@register("weighted_classifier_report", "M12 M7 M4 M8")
def _(spark, sf):
    df = training_set(spark, sf)
    model = learning.train(rows_of(df, "train"), "text", "lang", "logistic", weighted=True)
    scored = learning.score(rows_of(df, "test"), model, "text")
    return metrics.class_report(scored, "lang", "predicted", df.select("lang").distinct())


@register("score_with_saved_model", "M9 M10 M11 W3 F4")
def _(spark, sf):
    df = training_set(spark, sf)
    path = scratch_path(spark, "model")
    trained = learning.train(rows_of(df, "train"), "text", "lang", "logistic")
    learning.save(trained, path)
    scored = learning.score(df.drop("split"), learning.load_model(path), "text")
    return scored.select(
        "doc_id",
        "predicted",
        F.array_join(F.transform("top_predictions", lambda x: x["label"]), " ").alias("top_labels"),
        F.round(F.col("top_predictions")[0]["prob"], 3).alias("prob"),
    )


@register("two_stage_prediction", "D5")
def _(spark, sf):
    df = training_set(spark, sf)
    quality = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("part"))
    rows = rows_of(df, "train").join(quality, "doc_id")
    models = learning.train_two_stage(rows, "text", "lang", "part")
    scored = learning.score_two_stage(rows_of(df, "test").select("doc_id", "text"), models, "text")
    return scored.select("doc_id", "system", "part")


def vectors(spark, sf):
    df = load(spark, sf, "embeddings")
    return df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@register(
    "class_neighbours",
    "M6 F3",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance
             FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), neighbour) AS rank
             FROM p)
       SELECT vec_id, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
       FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    pairs = classes.neighbour_pairs(vectors(spark, sf), "vec_id", "label", "v", 5, block_rows=256)
    return pairs.withColumn("distance", F.round("distance", 6))


PICK = "CAST(('0x' || substr(md5({} || '-{}'), 1, 8)) AS BIGINT)"


@register(
    "smote_balanced",
    "M6 U2",
    f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        p AS (SELECT a.vec_id, b.vec_id AS neighbour,
                row_number() OVER (PARTITION BY a.vec_id
                  ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS rank
              FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY rank <= 5),
        h AS (SELECT vec_id, count(*) AS have FROM p GROUP BY vec_id),
        c AS (SELECT label, count(*) AS n FROM e GROUP BY label),
        m AS (SELECT label, n, (SELECT max(n) FROM c) - n AS missing FROM c),
        r AS (SELECT vec_id, label, n, missing, row_number() OVER (PARTITION BY label
                ORDER BY {PICK.format("CAST(vec_id AS VARCHAR)", 42)}, vec_id) AS rn
              FROM e JOIN m USING (label) WHERE missing > 0),
        t AS (SELECT *, unnest(generate_series(1, missing // n + CASE WHEN rn <= missing % n THEN 1 ELSE 0 END))
              AS turn FROM r),
        d AS (SELECT *, rn + (turn - 1) * n AS draw, CAST(vec_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id
              FROM t),
        k AS (SELECT d.*, {PICK.format("id", 42)} % have + 1 AS rank,
                {PICK.format("id", 43)} / 4294967296.0 AS share FROM d JOIN h USING (vec_id))
        SELECT k.label, CAST(draw AS BIGINT) AS draw, k.vec_id, p.neighbour,
          round(list_sum(a.v) + (list_sum(b.v) - list_sum(a.v)) * share, 6) AS total
        FROM k JOIN p ON k.vec_id = p.vec_id AND k.rank = p.rank
        JOIN e a ON a.vec_id = k.vec_id JOIN e b ON b.vec_id = p.neighbour""",
)
def _(spark, sf):
    made = classes.smote(vectors(spark, sf), "vec_id", "label", "v", k=5)
    total = F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6)
    return made.select("label", "draw", "vec_id", "neighbour", total.alias("total"))
