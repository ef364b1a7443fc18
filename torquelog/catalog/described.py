"""Jobs the documents describe: associations, rules, search, recommendations, trends, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquelog.catalog import sql
from torquelog.catalog.registry import register
from torquelog.functions import ngrams, text
from torquelog.operators import association, entities, rules, search, similarity
from torquelog.runtime import load, scratch_path
from torquelog.streaming import counts

TYPES = ["click", "error", "purchase", "signup", "view"]


@register(
    "one_hot_events",
    "D1",
    "SELECT event_id, "
    + ", ".join(f"CAST(event_type = '{t}' AS INTEGER) AS event_type_{t}" for t in TYPES)
    + " FROM events",
)
def _(spark, sf):
    return association.one_hot(load(spark, sf, "events"), "event_id", "event_type", TYPES)


def tokens(spark, sf, table="documents", key="doc_id", column="text", *keep):
    df = load(spark, sf, table, key)
    return df.select(key, *keep, ngrams.keyword_tokens(F.col(column)).alias("tokens"))


@register(
    "enrich_with_pages",
    "D2",
    f"""WITH d AS (SELECT doc_id, {sql.keyword_tokens("text")} AS w FROM documents),
        k AS (SELECT DISTINCT doc_id, unnest(w) AS gram FROM d),
        p AS (SELECT page_id, unnest({sql.keyword_tokens(sql.html("html"))}) AS gram FROM pages),
        u AS (SELECT page_id, gram, count(*) AS uses FROM p GROUP BY ALL),
        i AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY uses DESC, page_id) AS rank FROM u
              QUALIFY rank <= 3)
        SELECT doc_id, gram, page_id, uses, CAST(rank AS INTEGER) AS rank FROM k JOIN i USING (gram)""",
)
def _(spark, sf):
    words = F.explode(F.array_distinct("tokens")).alias("gram")
    found = tokens(spark, sf).select("doc_id", words)
    pages = load(spark, sf, "pages", "page_id").select(
        "page_id", ngrams.keyword_tokens(text.remove_html(F.col("html"))).alias("tokens")
    )
    return association.enrich(found, "doc_id", pages, "page_id", "tokens")


@register(
    "entities_in_documents",
    "D3",
    f"""WITH b AS (SELECT {sql.words("text")} AS w FROM benchmark),
        e AS (SELECT DISTINCT gram AS entity FROM ({sql.gram_rows("b", "0 AS one", "w")})),
        d AS (SELECT doc_id, {sql.words("text")} AS w FROM documents),
        g AS (SELECT doc_id, gram AS entity FROM ({sql.gram_rows("d", "doc_id", "w")}))
        SELECT doc_id, entity, 'step' AS kind, count(*) AS mentions FROM g JOIN e USING (entity) GROUP BY ALL""",
)
def _(spark, sf):
    def split(table, key):
        return load(spark, sf, table, key).select(key, text.words(F.col("text")).alias("tokens"))

    sizes = (1, 2, 3)
    grams = F.flatten(F.array(*[ngrams.ngrams(F.col("tokens"), n) for n in sizes]))
    entries = split("benchmark", "item_id").select(
        F.explode(F.array_distinct(grams)).alias("entity"), F.lit("step").alias("kind")
    )
    return association.gazetteer(split("documents", "doc_id"), "doc_id", "tokens", entries, sizes)


@register(
    "longest_entities_in_documents",
    "D3",
    f"""WITH RECURSIVE b AS (SELECT {sql.words("text")} AS w FROM benchmark),
        e AS (SELECT DISTINCT gram AS entity, n || ' words' AS kind
              FROM ({sql.gram_rows("b", "0 AS one", "w", (2, 3, 4))})),
        d AS (SELECT doc_id, {sql.words("text")} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
        g AS (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS entity
              FROM p, (VALUES (2), (3), (4)) s(n) WHERE pos + n - 1 <= len(w)),
        m AS (SELECT doc_id, pos, max(n) AS n, arg_max(entity, n) AS entity, arg_max(kind, n) AS kind,
                pos + max(n) AS until
              FROM g JOIN e USING (entity) GROUP BY doc_id, pos),
        f AS (SELECT m.*, x.pos AS following FROM m ASOF LEFT JOIN m x ON m.doc_id = x.doc_id AND m.until <= x.pos),
        walk AS (
          SELECT * FROM f WHERE (doc_id, pos) IN (SELECT (doc_id, min(pos)) FROM f GROUP BY doc_id)
          UNION ALL SELECT f.* FROM walk JOIN f ON f.doc_id = walk.doc_id AND f.pos = walk.following)
        SELECT doc_id, entity, kind, count(*) AS mentions FROM walk GROUP BY ALL""",
)
def _(spark, sf):
    def split(table, key):
        return load(spark, sf, table, key).select(key, text.words(F.col("text")).alias("tokens"))

    phrases = F.array(
        *[F.struct(ngrams.ngrams(F.col("tokens"), n).alias("grams"), F.lit(f"{n} words").alias("kind")) for n in (2, 3, 4)]
    )
    entries = split("benchmark", "item_id").select(F.inline(phrases)).select(F.explode("grams").alias("entity"), "kind")
    found = entities.find_terms(split("documents", "doc_id"), "tokens", entries, longest=True)
    return entities.mentions(found, "doc_id", "tokens")


#: (rule, premises, conclusion): two premises, a chain of five, two cycles.
RULES = [
    ("r1", ["of", "the"], "english"),
    ("r2", ["english", "and"], "prose"),
    ("r3", ["prose"], "page"),
    ("r4", ["page"], "chapter"),
    ("r5", ["chapter"], "book"),
    ("r6", ["book"], "english"),
    ("r7", ["der", "und"], "german"),
    ("r8", ["german", "die"], "prose"),
    ("r9", ["la"], "romance"),
    ("r10", ["romance", "el", "los"], "spanish"),
    ("r11", ["romance", "des"], "french"),
    ("r12", ["spanish", "french"], "mixed"),
    ("r13", ["mixed"], "romance"),
]
PREMISES = sorted({p for _, premises, _ in RULES for p in premises})
RULES_SQL = ", ".join(f"{{'p': {premises}, 'c': '{conclusion}'}}" for _, premises, conclusion in RULES)


@register(
    "facts_by_rule_table",
    "D4",
    f"""WITH RECURSIVE f AS (
          SELECT doc_id, list_sort(list_distinct(list_filter({sql.words("text")}, lambda w: w IN {sql.listed(PREMISES)}))) AS facts,
            0 AS round FROM documents
          UNION ALL
          SELECT doc_id, grown, round + 1 FROM (
            SELECT doc_id, round, facts, list_sort(list_distinct(facts || list_transform(
                list_filter([{RULES_SQL}], lambda r: list_has_all(facts, r.p)), lambda r: r.c))) AS grown FROM f)
          WHERE len(grown) > len(facts)),
        u AS (SELECT doc_id, unnest(facts) AS fact, round FROM f)
        SELECT doc_id, fact, CAST(min(round) AS INTEGER) AS round FROM u GROUP BY doc_id, fact""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id").select("doc_id", text.words(F.col("text")).alias("w"))
    table = rules.rule_table(spark, RULES)
    found = rules.derive(rules.word_facts(df, "doc_id", "w", table), table)
    return found.withColumnRenamed("key", "doc_id")


PHRASE_RULES = {"of the": "wear", "thtion": "heat", "und der": "noise", "de la": "dust"}
FACT_RULES = {"heat": "fan", "fan": "cooling", "wear": "door", "dust": "fan"}
CLOSED = {
    "of the": ["wear", "door"],
    "thtion": ["heat", "fan", "cooling"],
    "und der": ["noise"],
    "de la": ["dust", "fan", "cooling"],
}


@register(
    "facts_by_rules",
    "D4",
    f"""WITH d AS (SELECT doc_id, ' ' || {sql.joined(sql.words("text"))} || ' ' AS t FROM documents),
        f AS ("""
    + " UNION ALL ".join(
        f"SELECT doc_id, unnest({facts}) AS fact FROM d WHERE contains(t, ' {phrase} ')"
        for phrase, facts in CLOSED.items()
    )
    + """) SELECT doc_id, string_agg(DISTINCT fact, ' ' ORDER BY fact) AS facts FROM f GROUP BY doc_id""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id").select("doc_id", text.words(F.col("text")).alias("t"))
    facts = association.forward_chain(df, "doc_id", "t", PHRASE_RULES, FACT_RULES)
    return facts.select("doc_id", F.array_join("facts", " ").alias("facts"))


CENTROIDS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  x AS (SELECT label, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM e),
  c AS (SELECT label, list(m ORDER BY pos) AS q FROM
        (SELECT label, pos, avg(value) AS m FROM x GROUP BY label, pos) GROUP BY label),
  s AS (SELECT 'label ' || CAST(c.label AS VARCHAR) AS query, vec_id,
          round(list_cosine_similarity(v, q), 6) AS score FROM e CROSS JOIN c),
  best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s
           QUALIFY rank <= 5)"""


def nearest(spark, sf, k=5):
    """Records nearest to the mean vector of each label: one query per label."""
    df = load(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    means = similarity.class_means(df, "label", "v")
    name = F.concat(F.lit("label "), F.col("label").cast("string")).alias("query")
    queries = means.select(name, F.col("mean").alias("vector"))
    return similarity.nearest_vectors(df, "vec_id", "v", queries, k)


@register(
    "semantic_search",
    "D6",
    f"WITH {CENTROIDS} SELECT query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM best",
)
def _(spark, sf):
    return nearest(spark, sf)


@register("semantic_search_indexed", "D6")
def _(spark, sf):
    """Rows nearest to every fiftieth row, found through the index; the tests hold its recall on a fixture."""
    df = load(spark, sf, "embeddings")
    queries = df.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = search.search(search.hyperplane_index(df, "vec_id", "embedding"), queries, 5)
    return found.withColumnRenamed("key", "vec_id")


@register(
    "recommend_pages",
    "D7",
    f"""WITH {CENTROIDS} SELECT query, page_id, url, score, CAST(rank AS INTEGER) AS rank
        FROM best JOIN pages ON vec_id = page_id""",
)
def _(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", "url")
    found = nearest(spark, sf).withColumnRenamed("vec_id", "page_id")
    return found.join(pages, "page_id").select("query", "page_id", "url", "score", "rank")


@register(
    "rule_priority",
    "D8",
    """WITH r AS (SELECT event_type, count(*) AS tries,
         round(avg(CAST(value > 20 AS INTEGER)), 6) AS success FROM events GROUP BY event_type)
       SELECT *, CAST(dense_rank() OVER (ORDER BY success DESC) AS INTEGER) AS priority FROM r""",
)
def _(spark, sf):
    return association.rule_priority(load(spark, sf, "events"), "event_type", F.col("value") > 20)


@register(
    "keyword_part_lift",
    "D9 P20",
    f"""WITH d AS (SELECT doc_id, source, list_distinct({sql.keyword_tokens("text")}) AS w FROM documents),
        p AS (SELECT source, word, count(*) AS records FROM (SELECT source, unnest(w) AS word FROM d) GROUP BY ALL),
        t AS (SELECT source, count(*) AS in_group FROM documents GROUP BY source),
        o AS (SELECT word, sum(records) AS with_word FROM p GROUP BY word)
        SELECT source, word, records,
          round(records * (SELECT count(*) FROM documents) / (in_group * with_word), 6) AS lift
        FROM p JOIN t USING (source) JOIN o USING (word) WHERE records >= 5""",
)
def _(spark, sf):
    df = tokens(spark, sf, "documents", "doc_id", "text", "source")
    return association.keyword_group_lift(df, "doc_id", "source", "tokens")


@register(
    "error_code_pairs",
    "D10",
    """WITH e AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS code FROM events
         WHERE event_type = 'error'),
       n AS (SELECT code, count(*) AS n FROM e GROUP BY code),
       p AS (SELECT a.code AS code_a, b.code AS code_b, count(*) AS groups
             FROM e a JOIN e b ON a.user_id = b.user_id AND a.code < b.code GROUP BY ALL)
       SELECT code_a, code_b, groups,
         round(groups * (SELECT count(DISTINCT user_id) FROM e) / (x.n * y.n), 6) AS lift
       FROM p JOIN n x ON code_a = x.code JOIN n y ON code_b = y.code WHERE groups >= 3""",
)
def _(spark, sf):
    errors = load(spark, sf, "events").where(F.col("event_type") == "error").select(
        "user_id", F.get_json_object("props", "$.k").alias("code")
    )
    return association.code_cooccurrence(errors, "user_id", "code", 3)


@register(
    "event_trend",
    "D11",
    """WITH c AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, event_type AS category,
         count(*) AS records FROM events GROUP BY ALL)
       SELECT *, records - lag(records, 1, 0) OVER (PARTITION BY category ORDER BY period) AS change FROM c""",
)
def _(spark, sf):
    return association.trend(load(spark, sf, "events"), "ts", "event_type", "week")


@register(
    "streamed_event_counts",
    "D12",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, CAST(count(*) AS BIGINT) AS records
       FROM events GROUP BY ALL""",
)
def _(spark, sf):
    schema = load(spark, sf, "events").schema
    stream = counts.read_stream(spark, f"{sf}/event[s].parquet", schema)
    table = scratch_path(spark, "event-counts")
    keys = {"day": F.date_format("ts", "yyyy-MM-dd"), "category": F.col("event_type")}
    counts.ingest_counts(stream, keys, table, scratch_path(spark, "ingest")).awaitTermination()
    return counts.running_counts(spark, table, list(keys))


@register(
    "streamed_event_windows",
    "D12",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS category, CAST(count(*) AS BIGINT) AS records
       FROM (SELECT *, date_trunc('hour', ts) AS w FROM events WHERE ts IS NOT NULL)
       WHERE w + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL""",
)
def _(spark, sf):
    schema = load(spark, sf, "events").schema
    stream = counts.read_stream(spark, f"{sf}/event[s].parquet", schema)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone
    windows = counts.windowed_counts(stream, "ts", "event_type")
    table = scratch_path(spark, "event-windows")
    counts.closed_windows(windows, table, scratch_path(spark, "ingest")).awaitTermination()
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return spark.read.schema(windows.schema).parquet(table).select(start, "category", "records")


@register(
    "streamed_keyword_counts",
    "D12 A3",
    f"""SELECT source, word, CAST(count(*) AS BIGINT) AS records FROM
        (SELECT source, unnest({sql.keyword_tokens("text")}) AS word FROM documents)
        GROUP BY ALL""",
)
def _(spark, sf):
    schema = load(spark, sf, "documents").schema
    stream = counts.read_stream(spark, f"{sf}/document[s].parquet", schema).select(
        "source", F.explode(ngrams.keyword_tokens(F.col("text"))).alias("word")
    )
    table = scratch_path(spark, "word-counts")
    keys = {"source": F.col("source"), "word": F.col("word")}
    counts.ingest_counts(stream, keys, table, scratch_path(spark, "ingest")).awaitTermination()
    return counts.running_counts(spark, table, list(keys))
