"""Aggregates, labels, splits, balancing and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquelog.catalog import sql
from torquelog.catalog.registry import register
from torquelog.functions import text
from torquelog.operators import classes, metrics
from torquelog.operators.ranking import random_split, stratified_split, top_labels
from torquelog.plans import reports
from torquelog.runtime import load


@register(
    "group_text",
    "A1 K18",
    """SELECT source, doc_id // 500 AS piece, count(*) AS rows, md5(string_agg(text, ' ' ORDER BY doc_id)) AS text
       FROM documents WHERE trim(text) <> '' GROUP BY ALL""",
)
def _(spark, sf):
    df = reports.group_text(load(spark, sf, "documents"), "source", "doc_id", "text", span=500)
    return df.withColumn("text", F.md5("text"))


@register(
    "distinct_per_group",
    "A2 A5",
    "SELECT DISTINCT source, lang, md5(text) AS description FROM documents",
)
def _(spark, sf):
    df = load(spark, sf, "documents")
    return df.select("source", "lang", F.md5("text").alias("description")).distinct()


@register(
    "class_counts",
    "A4",
    "SELECT source, lang, count(*) AS rows FROM documents GROUP BY ALL",
)
def _(spark, sf):
    df = load(spark, sf, "documents")
    return df.groupBy("source", "lang").agg(F.count("*").alias("rows"))


@register(
    "class_weights",
    "A8 M7",
    """WITH c AS (SELECT lang, count(*) AS rows FROM documents GROUP BY lang)
       SELECT lang, rows, round((SELECT sum(rows) FROM c) / ((SELECT count(*) FROM c) * rows), 6) AS weight
       FROM c""",
)
def _(spark, sf):
    return classes.class_weights(load(spark, sf, "documents"), "lang")


@register(
    "merge_rare_classes",
    "A9",
    """WITH d AS (SELECT doc_id, source || '-' || lang || '-' || CAST(n_chars // 1000 AS VARCHAR) AS system
         FROM documents),
       c AS (SELECT system, count(*) AS n FROM d GROUP BY system)
       SELECT doc_id, CASE WHEN n < 3 THEN 'Other' ELSE system END AS system
       FROM d JOIN c USING (system)""",
)
def _(spark, sf):
    df = load(spark, sf, "documents").select(
        "doc_id", F.concat_ws("-", "source", "lang", F.floor(F.col("n_chars") / 1000).cast("string")).alias("system")
    )
    return classes.merge_rare(df, "system")


@register(
    "label_index",
    "W5 M2",
    """WITH c AS (SELECT source, min(doc_id) AS seen FROM documents GROUP BY source)
       SELECT source, row_number() OVER (ORDER BY source) - 1 AS alphabetical,
         row_number() OVER (ORDER BY seen, source) - 1 AS by_appearance FROM c""",
)
def _(spark, sf):
    df = load(spark, sf, "documents")
    a = classes.label_index(df, "source").withColumnRenamed("index", "alphabetical")
    b = classes.label_index(df, "source", "doc_id").withColumnRenamed("index", "by_appearance")
    return a.join(b, "source")


HASH = "CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '-{seed}'), 1, 8)) AS BIGINT)"


@register(
    "random_split",
    "W8",
    f"""SELECT doc_id, CASE WHEN {HASH.format(key="doc_id", seed=42)} % 5 = 0 THEN 'test' ELSE 'train' END
        AS split FROM documents""",
)
def _(spark, sf):
    return random_split(load(spark, sf, "documents").select("doc_id"), "doc_id")


@register(
    "stratified_split",
    "W9",
    f"""WITH r AS (SELECT doc_id, lang,
            row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(key="doc_id", seed=42)}, doc_id) AS rn,
            count(*) OVER (PARTITION BY lang) AS n FROM documents)
        SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
        FROM r""",
)
def _(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "lang")
    return stratified_split(df, "doc_id", "lang")


@register(
    "upsample_minority",
    "M5 U2 J4 F3",
    f"""WITH r AS (SELECT doc_id, source || '-' || lang AS system FROM documents
           UNION ALL SELECT doc_id, lang FROM documents),
        c AS (SELECT system, count(*) AS n FROM r GROUP BY system),
        d AS (SELECT doc_id, system, n, row_number() OVER (PARTITION BY system ORDER BY doc_id) - 1 AS pos
              FROM r JOIN c USING (system)),
        p AS (SELECT system, n, unnest(generate_series(1, 500)) AS draw FROM c WHERE n < 500),
        q AS (SELECT system, draw, {HASH.format(key="(system || '-' || CAST(draw AS VARCHAR))", seed=42)} % n AS pos
              FROM p)
        SELECT doc_id, system, 0 AS draw FROM d WHERE n >= 500
        UNION ALL
        SELECT doc_id, q.system, CAST(q.draw AS INTEGER) FROM q JOIN d ON q.system = d.system AND q.pos = d.pos""",
)
def _(spark, sf):
    """Classes large and small at every table size: languages, and languages within a source."""
    df = load(spark, sf, "documents")
    within = df.select("doc_id", F.concat_ws("-", "source", "lang").alias("system"))
    both = within.unionByName(df.select("doc_id", F.col("lang").alias("system")))
    return classes.upsample(both, "doc_id", "system")


SCORED_SQL = """scored AS (
  SELECT quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction
  FROM documents JOIN labels USING (doc_id))"""


def scored(spark, sf):
    labels = load(spark, sf, "labels")
    df = load(spark, sf, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    return df.select(
        F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("prediction")
    )


@register(
    "metrics_summary",
    "A10",
    f"""WITH {SCORED_SQL},
        k AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
        m AS (SELECT c, (SELECT count(*) FROM scored WHERE label = c AND prediction = c) AS hit,
                (SELECT count(*) FROM scored WHERE label = c) AS support,
                (SELECT count(*) FROM scored WHERE prediction = c) AS predicted FROM k),
        r AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS p,
                coalesce(hit / nullif(support, 0), 0) AS r FROM m)
        SELECT round(sum(hit) / sum(support), 6) AS accuracy,
          round(sum(p * support) / sum(support), 6) AS precision,
          round(sum(r * support) / sum(support), 6) AS recall,
          round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support), 6) AS f1 FROM r""",
)
def _(spark, sf):
    return metrics.summary(scored(spark, sf), "label", "prediction")


@register(
    "class_report",
    "A11",
    f"""WITH {SCORED_SQL}, k AS (SELECT unnest([0, 1, 2]) AS c),
        m AS (SELECT c, (SELECT count(*) FROM scored WHERE label = c AND prediction = c) AS hit,
                (SELECT count(*) FROM scored WHERE label = c) AS support,
                (SELECT count(*) FROM scored WHERE prediction = c) AS predicted FROM k),
        r AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS p,
                coalesce(hit / nullif(support, 0), 0) AS r FROM m)
        SELECT c AS label, round(p, 6) AS precision, round(r, 6) AS recall,
          round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM r""",
)
def _(spark, sf):
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    return metrics.class_report(scored(spark, sf), "label", "prediction", labels)


@register(
    "top_labels",
    "W3 F5",
    f"""WITH t AS (SELECT doc_id, {sql.words("text")} AS w FROM documents),
        s AS (SELECT doc_id, unnest(['de', 'en', 'fr']) AS label,
                unnest([len(list_filter(w, lambda t: t = 'der')), len(list_filter(w, lambda t: t = 'the')),
                        len(list_filter(w, lambda t: t = 'la'))]) / (len(w) + 1) AS prob FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label) AS k FROM s)
        SELECT doc_id, string_agg(label, ' ' ORDER BY k) AS labels, round(max(prob), 6) AS best
        FROM r WHERE k <= 2 GROUP BY doc_id""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id").select("doc_id", text.words(F.col("text")).alias("w"))

    def share(word: str):
        return F.size(F.filter("w", lambda t: t == word)) / (F.size("w") + 1)

    best = top_labels(F.array(share("der"), share("the"), share("la")), ["de", "en", "fr"], 2)
    return df.select("doc_id", best.alias("top")).select(
        "doc_id",
        F.array_join(F.transform("top", lambda x: x["label"]), " ").alias("labels"),
        F.round(F.col("top")[0]["prob"], 6).alias("best"),
    )
