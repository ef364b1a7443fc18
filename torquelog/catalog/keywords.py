"""Keyword, category and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquelog.catalog import sql
from torquelog.catalog.records import ASSET_VOCABULARY, CODES, asset_vocabulary, bare_codes, error_lists
from torquelog.catalog.registry import register
from torquelog.functions import lexicons, ngrams, text
from torquelog.operators import keywords, similarity
from torquelog.operators.vocabulary import different_rows
from torquelog.plans import reports
from torquelog.runtime import load


def tokens(spark, sf, *keep):
    df = load(spark, sf, "documents", "doc_id")
    return df.select("doc_id", *keep, ngrams.keyword_tokens(F.col("text")).alias("tokens"))


def shown(keywords_column):
    return F.array_join(
        F.transform(keywords_column, lambda x: F.concat_ws(":", x["word"], x["freq"].cast("string"))),
        ", ",
    )


TOKENS = f"d AS (SELECT doc_id, source, lang, {sql.keyword_tokens('text')} AS w FROM documents)"


def ranked_sql(relation: str, keys: str, k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cnt DESC, gram) AS rank
               FROM {relation} QUALIFY rank <= {k}"""


@register(
    "group_keywords",
    "K4 A1 W2",
    f"""WITH {TOKENS}, g AS ({sql.gram_rows("d", "source", "w")}),
        c AS (SELECT source, n, gram, count(*) AS cnt FROM g GROUP BY ALL),
        r AS ({ranked_sql("c", "source, n", 50)})
        SELECT source, n, gram, cnt, CAST(rank AS INTEGER) AS rank FROM r""",
)
def _(spark, sf):
    return keywords.group_keywords(tokens(spark, sf, "source"), "source", "doc_id", "tokens")


@register(
    "group_keywords_spanning_rows",
    "K4 A1 W2",
    f"""WITH {TOKENS},
        g AS ({sql.spanning_gram_rows("d", "source", "doc_id", "w")}),
        c AS (SELECT source, n, gram, count(*) AS cnt FROM g WHERE gram IS NOT NULL GROUP BY ALL),
        r AS ({ranked_sql("c", "source, n", 50)})
        SELECT source, n, gram, cnt, CAST(rank AS INTEGER) AS rank FROM r""",
)
def _(spark, sf):
    df = tokens(spark, sf, "source")
    return keywords.group_keywords(df, "source", "doc_id", "tokens", span_rows=True)


RECORD_KEYWORDS = f"""{TOKENS}, g AS ({sql.gram_rows("d", "doc_id", "w")}),
  c AS (SELECT doc_id, n, gram, count(*) AS cnt FROM g GROUP BY ALL),
  r AS ({ranked_sql("c", "doc_id, n", 50)})"""


@register(
    "record_keywords",
    "K5 W2 W6 F5",
    f"""WITH {RECORD_KEYWORDS}
        SELECT e.doc_id, e.n,
          coalesce(string_agg(gram || ':' || CAST(cnt AS VARCHAR), ', ' ORDER BY rank), '') AS keywords
        FROM (SELECT doc_id, unnest([1, 2, 3]) AS n FROM d) e
        LEFT JOIN r ON r.doc_id = e.doc_id AND r.n = e.n GROUP BY ALL""",
)
def _(spark, sf):
    lists = keywords.record_keyword_lists(tokens(spark, sf), "doc_id", "tokens")
    return lists.withColumn("keywords", shown("keywords"))


@register(
    "record_keywords_plain",
    "K6 W6 T17",
    f"""WITH {RECORD_KEYWORDS}
        SELECT e.doc_id, e.n, coalesce(string_agg(gram, ', ' ORDER BY rank), '') AS keywords
        FROM (SELECT doc_id, unnest([1, 2, 3]) AS n FROM d) e
        LEFT JOIN r ON r.doc_id = e.doc_id AND r.n = e.n GROUP BY ALL""",
)
def _(spark, sf):
    lists = keywords.record_keyword_lists(tokens(spark, sf), "doc_id", "tokens")
    words = keywords.words_only("keywords")
    return lists.select("doc_id", "n", F.array_join(words, ", ").alias("keywords"))


@register(
    "record_keywords_published_counts",
    "K5 W6",
    f"""WITH {RECORD_KEYWORDS},
        x AS (SELECT doc_id, gram, count(*) AS cnt FROM
              (SELECT doc_id, unnest({sql.running_words("text")}) AS gram FROM documents)
              GROUP BY ALL),
        f AS (SELECT r.doc_id, r.n, r.gram, CASE WHEN r.n = 1 THEN coalesce(x.cnt, 0) ELSE 0 END AS freq
              FROM r LEFT JOIN x ON r.doc_id = x.doc_id AND r.gram = x.gram)
        SELECT e.doc_id, e.n,
          coalesce(string_agg(gram || ':' || CAST(freq AS VARCHAR), ', ' ORDER BY freq DESC, gram), '') AS keywords
        FROM (SELECT doc_id, unnest([1, 2, 3]) AS n FROM d) e
        LEFT JOIN f ON f.doc_id = e.doc_id AND f.n = e.n GROUP BY ALL""",
)
def _(spark, sf):
    lists = keywords.published_lists(load(spark, sf, "documents", "doc_id"), "doc_id", "text")
    return lists.withColumn("keywords", shown("keywords"))


@register(
    "record_ngrams_sorted",
    "K7 T17",
    f"""WITH {TOKENS} SELECT doc_id, """
    + ", ".join(
        f"md5(array_to_string(list_sort(list_distinct({sql.grams('w', n)})), ', ')) AS keywords_{n}"
        for n in (1, 2, 3)
    )
    + " FROM d",
)
def _(spark, sf):
    df = tokens(spark, sf)
    return df.select(
        "doc_id",
        *[
            F.md5(ngrams.distinct_sorted(ngrams.ngrams(F.col("tokens"), n))).alias(f"keywords_{n}")
            for n in (1, 2, 3)
        ],
    )


@register(
    "incident_keywords",
    "K7 K1b T17",
    f"""WITH d AS (SELECT conv_id, turn, role, {sql.keyword_tokens(sql.clean_incident("text"))} AS w
                   FROM conversations)
        SELECT conv_id, turn, role, """
    + ", ".join(
        f"array_to_string(list_sort(list_distinct({sql.grams('w', n)})), ', ') AS keywords_{n}"
        for n in (1, 2, 3)
    )
    + " FROM d",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id")
    cleaned = ngrams.keyword_tokens(text.clean_incident(F.col("text")))
    df = df.select("conv_id", "turn", "role", cleaned.alias("tokens"))
    return df.select(
        "conv_id",
        "turn",
        "role",
        *[
            ngrams.distinct_sorted(ngrams.ngrams(F.col("tokens"), n)).alias(f"keywords_{n}")
            for n in (1, 2, 3)
        ],
    )


@register(
    "record_top_bigrams",
    "W1 P20",
    f"""WITH {TOKENS}, g AS (SELECT doc_id, unnest({sql.grams("w", 2)}) AS gram FROM d),
        c AS (SELECT doc_id, gram, count(*) AS cnt FROM g GROUP BY ALL),
        r AS (SELECT *, sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)) AS norm,
                row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, gram) AS rank FROM c)
        SELECT doc_id, gram, round(cnt / norm, 6) AS weight, CAST(rank AS INTEGER) AS rank
        FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    return keywords.record_top_grams(tokens(spark, sf), "doc_id", "tokens")


@register(
    "set_keywords",
    "K15",
    f"""WITH {TOKENS}, g AS (SELECT doc_id, unnest(w) AS gram FROM d),
        c AS (SELECT doc_id, gram, count(*) AS cnt FROM g GROUP BY ALL),
        f AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
              FROM c GROUP BY gram),
        w AS (SELECT doc_id, gram, cnt * idf AS w FROM c JOIN f USING (gram)),
        m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
        SELECT gram, round(sum(w / norm), 6) AS score FROM w JOIN m USING (doc_id)
        GROUP BY gram ORDER BY score DESC, gram LIMIT 25""",
)
def _(spark, sf):
    return keywords.set_keywords(tokens(spark, sf), "doc_id", "tokens", 1, 25)


# --------------------------------------------------------------------------------------- categories

VECTORS = f"""gk AS (SELECT source, n, gram FROM (
    SELECT source, n, gram, row_number() OVER (PARTITION BY source, n ORDER BY cnt DESC, gram) AS rank
    FROM (SELECT source, n, gram, count(*) AS cnt FROM gg GROUP BY ALL)) WHERE rank <= 50),
  gw AS (SELECT source, n, unnest({sql.words("gram")}) AS word FROM gk),
  tf AS (SELECT source, n, word, count(*) AS tf FROM gw GROUP BY ALL),
  nd AS (SELECT count(*) AS docs FROM (SELECT DISTINCT source, n FROM tf)),
  idf AS (SELECT word, ln((1 + (SELECT docs FROM nd)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY word),
  raw AS (SELECT source, n, word, idf, tf * idf AS w FROM tf JOIN idf USING (word)),
  vec AS (SELECT source, n, word, idf, w / sqrt(sum(w * w) OVER (PARTITION BY source, n)) AS weight
          FROM raw)"""


@register(
    "category_vectors",
    "K8",
    f"""WITH {TOKENS}, gg AS ({sql.gram_rows("(SELECT * FROM d WHERE source <> 'src0')", "source", "w")}),
        {VECTORS}
        SELECT source, n, word, round(idf, 6) AS idf, round(weight, 6) AS weight FROM vec""",
)
def _(spark, sf):
    found = keywords.group_keywords(tokens(spark, sf, "source"), "source", "doc_id", "tokens")
    vectors = similarity.category_vectors(found, "source", "src0")
    return vectors.select(
        "source", "n", "word", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight")
    )


def with_codes(word: str) -> str:
    return f"CASE WHEN {word} IN (SELECT substr(code, 2) FROM codes) THEN 'E' || {word} ELSE {word} END"


def assigned_sql(
    span: bool = False, records: str = "documents", other: str = "src0", vocabulary: bool = False
) -> str:
    known = f"""k AS (SELECT doc_id, source, {sql.keyword_tokens(sql.clean_asset("text"))} AS w
                 FROM {records} WHERE source <> '{other}')"""
    if vocabulary:
        known = f"""{ASSET_VOCABULARY}, every_{known},
          kp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM every_k),
          kv AS (SELECT doc_id, list({with_codes("word")} ORDER BY pos) AS w
                 FROM kp WHERE word IN (SELECT word FROM vocab) GROUP BY doc_id),
          k AS (SELECT doc_id, source, coalesce(kv.w, []) AS w FROM every_k LEFT JOIN kv USING (doc_id))"""
    grams = sql.gram_rows("k", "source", "w")
    if span:
        grams = sql.spanning_gram_rows("k", "source", "doc_id", "w")
    return f"""{known}, gg AS (SELECT * FROM ({grams}) WHERE gram IS NOT NULL), {VECTORS},
      o AS (SELECT doc_id, {sql.keyword_tokens(sql.one_line("text"))} AS w
            FROM {records} WHERE source = '{other}'),
      og AS ({sql.gram_rows("o", "doc_id", "w")}),
      oc AS (SELECT doc_id, n, gram, count(*) AS cnt FROM og GROUP BY ALL),
      ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY cnt DESC, gram) AS rank
             FROM oc QUALIFY rank <= 50),
      ow AS (SELECT doc_id, n, unnest({sql.words("gram")}) AS word FROM ok),
      oq AS (SELECT doc_id, n, word, count(*) * any_value(idf) AS q
             FROM ow JOIN idf USING (word) GROUP BY ALL),
      onorm AS (SELECT doc_id, n, sqrt(sum(q * q)) AS norm FROM oq GROUP BY ALL),
      dots AS (SELECT doc_id, oq.n, source, vec.n AS m, sum(q * weight) AS dot
               FROM oq JOIN vec USING (word) GROUP BY ALL),
      best AS (SELECT doc_id, n, source, round(dot / norm, 9) AS score
               FROM dots JOIN onorm USING (doc_id, n)
               QUALIFY row_number() OVER (PARTITION BY doc_id, n
                 ORDER BY round(dot / norm, 9) DESC, source) = 1),
      lists AS (SELECT doc_id, n,
                  string_agg(gram || ':' || CAST(cnt AS VARCHAR), ', ' ORDER BY rank) AS keywords
                FROM ok GROUP BY ALL),
      every AS (SELECT doc_id, unnest([1, 2, 3]) AS n FROM o),
      assigned AS (SELECT every.doc_id, every.n, coalesce(source, 'Unknown') AS assigned,
          round(coalesce(score, 0), 6) AS score, coalesce(keywords, '') AS keywords
        FROM every LEFT JOIN best ON every.doc_id = best.doc_id AND every.n = best.n
        LEFT JOIN lists ON every.doc_id = lists.doc_id AND every.n = lists.n)"""


def records(spark, sf):
    """Documents as work orders; the rows of one source stand for those without a category."""
    df = load(spark, sf, "documents", "doc_id")
    return df.select("doc_id", "source", "text")


def assigned(spark, sf, **options):
    return reports.assigned_categories(
        records(spark, sf), "doc_id", "source", "text", other="src0", **options
    )


@register(
    "assign_categories",
    "K9 K10 J6 W4 K8 K5",
    f"WITH {assigned_sql()} SELECT * FROM assigned",
)
def _(spark, sf):
    return assigned(spark, sf).withColumn("keywords", shown("keywords"))


@register(
    "assign_categories_spanning_rows",
    "K9 K10 K4",
    f"WITH {assigned_sql(span=True)} SELECT doc_id, n, assigned, score FROM assigned",
)
def _(spark, sf):
    return assigned(spark, sf, span_rows=True).drop("keywords")


@register(
    "relabel_records",
    "K10 J8 P17",
    f"""WITH {assigned_sql()}
        SELECT doc_id, CASE WHEN source = 'src0' THEN a.assigned ELSE source END AS category
        FROM documents LEFT JOIN (SELECT * FROM assigned WHERE n = 1) a USING (doc_id)""",
)
def _(spark, sf):
    done = reports.relabel(records(spark, sf), assigned(spark, sf), "doc_id", "source", other="src0")
    return done.select("doc_id", F.col("source").alias("category"))


def asset_sql(vocabulary: bool = False) -> str:
    return f"""WITH recs AS (SELECT doc_id, text, CASE WHEN source = 'src0' THEN coalesce(p_type, 'Other')
            ELSE source END AS source
          FROM documents LEFT JOIN part ON lang = 'fr' AND doc_id = p_partkey),
        {assigned_sql(records="recs", other="Other", vocabulary=vocabulary)}
        SELECT doc_id, CASE WHEN source = 'Other' THEN a.assigned ELSE source END AS category
        FROM recs LEFT JOIN (SELECT * FROM assigned WHERE n = 1) a USING (doc_id)"""


def asset_report(spark, sf, **options):
    df = load(spark, sf, "documents", "doc_id")
    serial = F.lpad(F.col("doc_id").cast("string"), 13, "0")
    category = F.when(F.col("source") == "src0", "Other").otherwise(F.col("source"))
    orders = df.select(
        "doc_id",
        serial.alias("asset_name"),
        F.concat_ws(":", serial, category, F.col("text")).alias("work_description"),
        F.when(F.col("lang") == "fr", F.col("doc_id").cast("string")).alias("part_name"),
        F.col("n_chars").alias("quantity"),
    )
    parts = load(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("part_name"), F.col("p_type").alias("system"),
        F.col("p_size").alias("pos"),
    )
    done = reports.asset_report(
        orders, "doc_id", parts, "pos", ["quantity"], ["asset_name", "work_description"], **options
    )
    return done.select("doc_id", "category")


@register("asset_report", "K16 J1 P17 K2 K3 T16 K8 K9 K10 J8", asset_sql(vocabulary=True))
def _(spark, sf):
    lists = different_rows(error_lists(spark, sf))
    words, codes = asset_vocabulary(spark, sf, lists), bare_codes(spark, sf, lists)
    return asset_report(spark, sf, vocabulary=words, bare_codes=codes)


@register(
    "keyword_matrix",
    "K11 A6 J5",
    f"""WITH {assigned_sql()}
        SELECT doc_id, max(keywords) FILTER (n = 1) AS keywords_1, max(keywords) FILTER (n = 2) AS keywords_2,
          max(keywords) FILTER (n = 3) AS keywords_3, max(assigned) FILTER (n = 1) AS assigned_category
        FROM assigned GROUP BY doc_id""",
)
def _(spark, sf):
    matrix = reports.keyword_matrix(assigned(spark, sf), "doc_id")
    return matrix.select(
        "doc_id",
        *[shown(f"keywords_{n}").alias(f"keywords_{n}") for n in (1, 2, 3)],
        "assigned_category",
    )


# ------------------------------------------------------------------------------------------ reports

PHRASES = ["of the", "is", "inea", "to the ha", "de-la", "und der", "the of the", "thtion"]
CLEANED = ["of the", "is", "inea", "to the ha", "dela", "und der", "the of the", "thtion"]

NOTE = f"""n AS (SELECT doc_id, source, lang, text,
    {sql.words(sql.punctuation(sql.html(sql.urls(sql.mentions(sql.one_line("text"))))))} AS w
  FROM documents),
  ph AS (SELECT *, list_sort(list_filter([{", ".join(sql.quoted(p) for p in CLEANED)}],
    lambda p: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' '))) AS matched FROM n)"""


def notes(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    part = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit("  "))
    return df.select("doc_id", "source", part.alias("part_name"), F.col("text").alias("note"))


@register(
    "phone_cases",
    "K12 U5",
    f"""WITH {NOTE} SELECT doc_id, source, array_to_string(matched, ', ') AS matched
        FROM ph WHERE len(matched) > 0""",
)
def _(spark, sf):
    cases = reports.phone_cases(notes(spark, sf), "note", PHRASES)
    return cases.select("doc_id", "source", F.array_join("matched", ", ").alias("matched"))


@register(
    "phone_case_keywords",
    "K12 K6 J4",
    f"""WITH {NOTE}, d AS (SELECT doc_id, {sql.keyword_tokens(sql.clean_asset("text"))} AS w
          FROM ph WHERE len(matched) > 0),
        g AS ({sql.gram_rows("d", "doc_id", "w")}),
        c AS (SELECT doc_id, n, gram, count(*) AS cnt FROM g GROUP BY ALL),
        r AS ({ranked_sql("c", "doc_id, n", 50)})
        SELECT e.doc_id, e.n, coalesce(string_agg(gram, ', ' ORDER BY rank), '') AS keywords
        FROM (SELECT doc_id, unnest([1, 2, 3]) AS n FROM d) e
        LEFT JOIN r ON r.doc_id = e.doc_id AND r.n = e.n GROUP BY ALL""",
)
def _(spark, sf):
    cases = reports.phone_cases(notes(spark, sf), "note", PHRASES)
    lists = reports.phone_case_keywords(cases, "doc_id", "note")
    return lists.select("doc_id", "n", F.array_join("keywords", ", ").alias("keywords"))


@register(
    "notes_without_part",
    "K13 J3 P19 A12 A13",
    f"""WITH {NOTE} SELECT doc_id, source, md5(text) AS note FROM ph
        WHERE lang <> 'en' AND len(matched) = 0""",
)
def _(spark, sf):
    rows = notes(spark, sf)
    cases = reports.phone_cases(rows, "note", PHRASES)
    left = reports.notes_without_part(rows, cases, "part_name", "doc_id")
    return left.select("doc_id", "source", F.md5("note").alias("note"))


def incident_sql(codes: bool = False) -> str:
    known = " OR word IN (SELECT substr(code, 2) FROM codes)" if codes else ""
    return (
        f"""WITH RECURSIVE {f"{CODES}, " if codes else ""}{sql.tagging_ctes("documents", "doc_id", "text")},
        s AS (SELECT doc_id,
            string_agg({sql.lemma("word")}, ' ' ORDER BY sentence, nr) FILTER (WHERE tag = 'V') AS actions,
            string_agg({sql.lemma("word")}, ' ' ORDER BY sentence, nr) FILTER (WHERE tag = 'N') AS observations
          FROM tagged GROUP BY doc_id),
        c AS (SELECT doc_id, source, text, {sql.tokens("lower(" + sql.clean_incident("text") + ")")} AS w
                   FROM documents),
        v AS (SELECT word FROM (SELECT unnest(w) AS word FROM c) GROUP BY word
              HAVING (length(word) >= 3 OR count(*) >= 5{known}) AND word NOT IN {sql.listed(lexicons.STOP_ENGLISH)}),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM c),
        k AS (SELECT doc_id, list({with_codes("word") if codes else "word"} ORDER BY pos) AS w FROM p WHERE word IN (SELECT word FROM v) GROUP BY doc_id),
        j AS (SELECT c.doc_id, c.source, c.text, coalesce(k.w, []) AS w FROM c LEFT JOIN k USING (doc_id)),
        g AS (SELECT *, {sql.keyword_tokens("array_to_string(w, ' ')")} AS kw,
                {sql.keyword_tokens("text")} AS raw FROM j),
        b AS (SELECT doc_id, gram, count(*) AS cnt FROM (SELECT doc_id, unnest({sql.grams("raw", 2)}) AS gram FROM g)
              GROUP BY ALL),
        br AS (SELECT *, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)) AS weight,
                 row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, gram) AS rank FROM b),
        bs AS (SELECT doc_id, string_agg(gram, ', ' ORDER BY rank) AS grams,
                 round(sum(round(weight, 6)), 6) AS weight FROM br WHERE rank <= 10 GROUP BY doc_id)
        SELECT g.doc_id, source, md5(array_to_string(w, ' ')) AS cleaned,
          md5(coalesce(actions, '')) AS actions, md5(coalesce(observations, '')) AS observations,
          """
    + ", ".join(
        f"md5(array_to_string(list_sort(list_distinct({sql.grams('kw', n)})), ', ')) AS keywords_{n}"
        for n in (1, 2, 3)
    )
    + """, coalesce(grams, '') AS significant, coalesce(weight, 0) AS weight
        FROM g LEFT JOIN bs USING (doc_id) LEFT JOIN s USING (doc_id)"""
    )


def incident_report(spark, sf, **options):
    df = load(spark, sf, "documents", "doc_id")
    report = reports.incident_report(df, "doc_id", "text", ["source"], **options)
    total = F.aggregate("significant", F.lit(0.0), lambda s, x: s + x["weight"])
    return report.select(
        "doc_id",
        "source",
        F.md5("cleaned").alias("cleaned"),
        *[F.md5(F.array_join(c, " ")).alias(c) for c in ("actions", "observations")],
        *[F.md5(f"keywords_{n}").alias(f"keywords_{n}") for n in (1, 2, 3)],
        F.array_join(F.transform("significant", lambda x: x["word"]), ", ").alias("significant"),
        F.round(total, 6).alias("weight"),
    )


@register("incident_report", "K1b K2 K3 T16 K7 K14 W1 P20 F1 F5", incident_sql(codes=True))
def _(spark, sf):
    return incident_report(spark, sf, bare_codes=bare_codes(spark, sf))
