"""Record preparation, file round trips and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquelog.catalog import sql
from torquelog.catalog.registry import register
from torquelog.functions import lexicons, text
from torquelog.operators import joins, records, vocabulary
from torquelog.operators.ranking import first_per_key
from torquelog.runtime import load, scratch_path
from torquelog.sources import files

# ---------------------------------------------------------------------------------------- sources


@register(
    "csv_quoted_round_trip",
    "S1 S5 S7",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
)
def _(spark, sf):
    df = load(spark, sf, "part")
    path = scratch_path(spark, "parts-csv")
    files.write_csv(df, path, quote_all=True)
    return files.read_or_empty(spark, path, df.schema)


@register(
    "csv_multi_line_round_trip",
    "S2 S6",
    "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text "
    "FROM conversations",
)
def _(spark, sf):
    df = load(spark, sf, "conversations")
    path = scratch_path(spark, "turns-csv")
    files.write_csv(df, path, columns=["conv_id", "turn", "role", "text"])
    return files.read_error_list(spark, path)


@register(
    "json_lines_keyword_groups",
    "S3 T17",
    """SELECT p_partkey, p_brand AS part_info, array_to_string(string_split(p_name, ' '), ' ') AS keywords,
       len(string_split(p_name, ' ')) AS n FROM part""",
)
def _(spark, sf):
    df = load(spark, sf, "part")
    path = scratch_path(spark, "groups-json")
    df.select(
        "p_partkey", F.col("p_brand").alias("part_info"), F.split("p_name", " ").alias("keywords")
    ).write.json(path)
    rows = files.read_json_lines(
        spark, path, "p_partkey long, part_info string, keywords array<string>"
    )
    return rows.select(
        "p_partkey",
        "part_info",
        F.array_join("keywords", " ").alias("keywords"),
        F.size("keywords").cast("long").alias("n"),
    )


SHORT_FORMS = {**lexicons.ACRONYMS, "th": "the", "nd": "and", "ing": "in going", "": "dropped"}


@register(
    "dictionary_file_expansion",
    "S4 J7",
    f"""SELECT doc_id, {sql.joined(sql.swap(sql.tokens("lower(text)"),
        {k: v for k, v in SHORT_FORMS.items() if k}))} AS expanded FROM documents""",
)
def _(spark, sf):
    path = scratch_path(spark, "short-forms")
    entries = [(k, v) for k, v in SHORT_FORMS.items()]
    spark.createDataFrame(entries, "k string, v string").groupBy().agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")
    ).write.text(path)
    table = files.read_dictionary(spark, path).withColumnRenamed("key", "word")
    df = load(spark, sf, "documents", "doc_id").select(
        "doc_id", text.split_space(F.lower("text")).alias("tokens")
    )
    done = joins.expand_words(df, "doc_id", "tokens", table)
    return done.select("doc_id", F.array_join("tokens", " ").alias("expanded"))


@register(
    "staged_part_counts",
    "S8 A13 P14",
    "SELECT coalesce(p_type, 'Other') AS p_type, count(*) AS parts FROM part GROUP BY ALL",
)
def _(spark, sf):
    staged = files.stage(load(spark, sf, "part").select("p_partkey", "p_type"), "parts")
    counts = staged.fillna({"p_type": "Other"}).groupBy("p_type").agg(F.count("*").alias("parts"))
    path = scratch_path(spark, "counts-csv")
    if not files.write_if_any(counts, path):
        return counts
    return files.read_csv(spark, path, "p_type string, parts long")


# ---------------------------------------------------------------------------------------- records


def work_orders(spark, sf):
    """Documents in the role of work orders."""
    df = load(spark, sf, "documents", "doc_id")
    serial = F.lpad(F.col("doc_id").cast("string"), 13, "0")
    return df.select(
        "doc_id",
        F.when(F.col("lang") == "en", serial).otherwise("none").alias("asset_name"),
        F.concat_ws(
            ":",
            F.when(F.col("lang") != "de", serial).otherwise("n/a"),
            F.concat(F.lit(" "), F.col("source")),
            F.col("text"),
        ).alias("work_description"),
        F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("quantity"),
    )


@register(
    "asset_head",
    "K16 P1 P2 P3 P4 P5",
    f"""WITH w AS (
          SELECT doc_id, lang, source, text, n_chars, lpad(CAST(doc_id AS VARCHAR), 13, '0') AS s
          FROM documents),
        v AS (SELECT *, CASE WHEN lang = 'en' THEN s END AS a, CASE WHEN lang <> 'de' THEN s END AS b
              FROM w)
        SELECT doc_id, CAST(CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END AS BIGINT) AS quantity,
          coalesce(a, b) AS asset_name, coalesce(b, a) AS serial, {sql.strip("source")} AS category,
          md5(text) AS description FROM v""",
)
def _(spark, sf):
    head = records.asset_head(
        work_orders(spark, sf), ["quantity"], ["asset_name", "work_description"]
    )
    return head.select(
        "doc_id", "quantity", "asset_name", "serial", "category", F.md5("description").alias("description")
    )


@register(
    "claims_head",
    "K17 P6 P7 P8 P9 P10 P11",
    f"""WITH c AS (
          SELECT l_orderkey, l_linenumber, p_partkey, p_name, text, CASE WHEN l_linenumber = 1
            THEN CAST(l_orderkey AS VARCHAR) WHEN l_linenumber = 2 THEN 'S' || lpad(CAST(l_orderkey AS VARCHAR), 13, '0')
            WHEN l_linenumber > 2 THEN lpad(CAST(l_orderkey AS VARCHAR), 10 + l_linenumber, '0') END AS serial
          FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN documents ON doc_id = l_orderkey % 200
          WHERE upper(p_brand) = 'BRAND#13' AND l_returnflag = 'N' AND p_type IS NOT NULL
            AND starts_with(p_type, 'S') AND NOT starts_with(p_name, 'hot ')
            AND NOT starts_with(p_name, 'small '))
        SELECT l_orderkey, l_linenumber, p_partkey, p_name FROM c
        WHERE regexp_full_match(serial, '[0-9]{{13,}}') AND {sql.language("text")} = 'en'""",
)
def _(spark, sf):
    parts = load(spark, sf, "part").select(
        "p_partkey", "p_name", F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
        F.col("p_name").alias("part_number"), F.col("p_name").alias("part_description"),
    )
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    serial = F.when(line == 1, order).when(line == 2, F.concat(F.lit("S"), F.lpad(order, 13, "0")))
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("service_line_type"),
        serial.when(line > 2, F.lpad(order, 10 + line, F.lit("0"))).alias("serial_number"),
    )
    texts = load(spark, sf, "documents", "doc_id").select("doc_id", F.col("text").alias("summary"))
    claims = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    claims = claims.join(texts, F.col("l_orderkey") % 200 == F.col("doc_id"), "left")
    kept = records.claims_head(claims, "Brand#13", "N", "S", ("hot ", "small "))
    return kept.select("l_orderkey", "l_linenumber", "p_partkey", "p_name")


@register(
    "english_claims",
    "K17 P11 P12 P13",
    f"""SELECT conv_id, turn, role FROM conversations
        WHERE text IS NOT NULL AND {sql.strip("text")} <> '' AND {sql.language("text")} = 'en'""",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id").dropna(subset=["text"])
    kept = records.drop_blank(df, "text").where(text.language(F.col("text")) == "en")
    return kept.select("conv_id", "turn", "role")


@register(
    "part_labels",
    "P15 P16 P18",
    f"""SELECT p_partkey AS part_no, nullif(lower({sql.strip("p_type")}), '') AS system,
        CASE WHEN p_size > 45 THEN 'No part needed / no update'
             ELSE CAST(p_partkey AS VARCHAR) || ' - ' || p_name END AS part_info FROM part""",
)
def _(spark, sf):
    df = load(spark, sf, "part").withColumnRenamed("p_partkey", "part_no")
    blank_some = F.when(F.col("p_size") > 45, F.lit("  "))
    df = df.withColumns(
        {
            "number": blank_some.otherwise(F.col("part_no").cast("string")),
            "name": blank_some.otherwise(F.col("p_name")),
        }
    ).drop("p_brand", "p_retailprice")
    return df.select(
        "part_no",
        records.normalised("p_type").alias("system"),
        records.part_label("number", "name").alias("part_info"),
    )


# -------------------------------------------------------------------------------------- vocabulary


@register(
    "part_words",
    "T13",
    f"""SELECT DISTINCT unnest(list_filter({sql.tokens("lower(text)")}, lambda t: length(t) >= 3)) AS word
        FROM documents""",
)
def _(spark, sf):
    return vocabulary.part_words(load(spark, sf, "documents", "doc_id"), "text")


@register(
    "words_of_all_columns",
    "T14",
    f"""WITH c AS (
          SELECT unnest([CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR),
            CAST(p_retailprice AS VARCHAR)]) AS cell
          FROM part),
        t AS (SELECT unnest({sql.tokens("lower(cell)")}) AS word FROM c WHERE cell IS NOT NULL)
        SELECT DISTINCT word FROM t WHERE regexp_full_match(word, '[\\p{{L}}\\p{{N}}]+')""",
)
def _(spark, sf):
    return records.words_of_all_columns(load(spark, sf, "part"))


def error_lists(spark, sf):
    """Two overlapping error-code lists out of the events; codes look like ``E89``."""
    events = load(spark, sf, "events")
    code = F.concat(F.lit("E"), F.get_json_object("props", "$.k")).alias("Error Code")
    return [events.where(F.col("event_type") == t).select(code) for t in ("error", "purchase")]


def bare_codes(spark, sf, lists=None):
    lists = lists or error_lists(spark, sf)
    return vocabulary.bare_error_codes(vocabulary.error_codes(lists, "Error Code"))


CODES = """codes AS (
  SELECT DISTINCT 'e' || json_extract_string(props, '$.k') AS code FROM events
  WHERE event_type IN ('error', 'purchase') AND json_extract_string(props, '$.k') IS NOT NULL)"""


@register(
    "error_codes",
    "U1 T15 A5",
    f"WITH {CODES} SELECT code, substr(code, 2) AS bare FROM codes",
)
def _(spark, sf):
    codes = vocabulary.error_codes(error_lists(spark, sf), "Error Code")
    return codes.select("code", text.bare_code(F.col("code")).alias("bare"))


@register(
    "frequent_words",
    "A3",
    f"""SELECT word, count(*) AS cnt FROM (SELECT unnest({sql.words("text")}) AS word FROM documents)
        GROUP BY word HAVING count(*) >= 5""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    return vocabulary.frequent_words(df, text.words(F.col("text")))


STOP = sql.listed(lexicons.STOP_ENGLISH)


@register(
    "incident_vocabulary",
    "K2 U3 U4",
    f"""WITH c AS (SELECT lower({sql.clean_incident("text")}) AS cleaned FROM documents),
        t AS (SELECT unnest({sql.tokens("cleaned")}) AS word FROM c)
        SELECT word FROM t GROUP BY word
        HAVING (length(word) >= 3 OR count(*) >= 5) AND word NOT IN {STOP}""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id").select(
        text.clean_incident(F.col("text")).alias("cleaned")
    )
    return vocabulary.incident_vocabulary(df, "cleaned")


ASSET_VOCABULARY = f"""{CODES},
  freq AS (SELECT word FROM (SELECT unnest({sql.words("text")}) AS word FROM documents)
           GROUP BY word HAVING count(*) >= 5),
  parts AS (SELECT DISTINCT unnest(list_filter({sql.tokens("lower(p_name)")},
            lambda t: length(t) >= 3)) AS word FROM part),
  vocab AS (SELECT DISTINCT word FROM (SELECT word FROM freq UNION ALL SELECT word FROM parts
            UNION ALL SELECT code FROM codes UNION ALL SELECT substr(code, 2) FROM codes)
            WHERE word NOT IN {STOP})"""


def asset_vocabulary(spark, sf, lists=None):
    return vocabulary.asset_vocabulary(
        load(spark, sf, "documents", "doc_id"), text.words(F.col("text")),
        load(spark, sf, "part"), "p_name", lists or error_lists(spark, sf), "Error Code",
    )


@register("asset_vocabulary", "K2 U1 U3 U4", f"WITH {ASSET_VOCABULARY} SELECT word FROM vocab")
def _(spark, sf):
    return asset_vocabulary(spark, sf)


@register(
    "keep_vocabulary_words",
    "K3 J9 T16",
    f"""WITH {ASSET_VOCABULARY},
        d AS (SELECT conv_id, turn, {sql.words("text")} AS w FROM conversations),
        p AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        k AS (SELECT conv_id, turn, pos, CASE WHEN word IN (SELECT substr(code, 2) FROM codes)
                THEN 'E' || word ELSE word END AS word
              FROM p WHERE word IN (SELECT word FROM vocab))
        SELECT d.conv_id, d.turn, coalesce(string_agg(k.word, ' ' ORDER BY pos), '') AS kept
        FROM d LEFT JOIN k ON d.conv_id = k.conv_id AND d.turn = k.turn GROUP BY ALL""",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"),
        text.words(F.col("text")).alias("tokens"),
    )
    words = asset_vocabulary(spark, sf)
    bare = vocabulary.bare_error_codes(vocabulary.error_codes(error_lists(spark, sf), "Error Code"))
    kept = vocabulary.correct_codes(df, "id", "tokens", words, bare)
    return kept.select("conv_id", "turn", F.array_join("tokens", " ").alias("kept"))


@register(
    "keep_own_vocabulary",
    "K3 K2 F1",
    f"""WITH d AS (SELECT doc_id, {sql.tokens("lower(" + sql.clean_incident("text") + ")")} AS w FROM documents),
        v AS (SELECT word FROM (SELECT unnest(w) AS word FROM d) GROUP BY word
              HAVING (length(word) >= 3 OR count(*) >= 5) AND word NOT IN {STOP}),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        k AS (SELECT doc_id, pos, word FROM p WHERE word IN (SELECT word FROM v))
        SELECT d.doc_id, md5(coalesce(string_agg(k.word, ' ' ORDER BY pos), '')) AS kept,
          count(k.word) AS words
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id").select(
        "doc_id",
        text.split_space(F.lower(text.clean_incident(F.col("text")))).alias("tokens"),
    )
    kept = vocabulary.keep_own_vocabulary(df, "doc_id", "tokens")
    return kept.select(
        "doc_id",
        F.md5(F.array_join("tokens", " ")).alias("kept"),
        F.size("tokens").cast("long").alias("words"),
    )


# DuckDB's levenshtein counts bytes, so the check gives every accented letter one byte first.
ACCENTED = "áéíóúàèìòùâêîôûäëïöüãõñçßæœ"
ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*"


@register(
    "similar_words",
    "T18",
    f"""WITH a AS (SELECT DISTINCT unnest({sql.words("text")}) AS word FROM benchmark),
        v AS (SELECT match FROM (SELECT unnest({sql.words("text")}) AS match FROM documents)
              GROUP BY match HAVING count(*) >= 5),
        s AS (SELECT word, match, 1 - levenshtein(translate(word, '{ACCENTED}', '{ONE_BYTE}'),
                translate(match, '{ACCENTED}', '{ONE_BYTE}')) / greatest(length(word), length(match)) AS score
              FROM a JOIN v
              ON abs(length(word) - length(match)) <= 0.2 * greatest(length(word), length(match)) + 1),
        r AS (SELECT word, match, round(score, 6) AS score,
              row_number() OVER (PARTITION BY word ORDER BY round(score, 6) DESC, match) AS rank
              FROM s WHERE round(score, 6) >= 0.8)
        SELECT word, match, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    asked = load(spark, sf, "benchmark", "item_id")
    words = asked.select(F.explode(text.words(F.col("text"))).alias("word"))
    corpus = load(spark, sf, "documents", "doc_id")
    known = vocabulary.frequent_words(corpus, text.words(F.col("text")))
    return vocabulary.similar_words(words, known, 0.8, 3)


# -------------------------------------------------------------------------------------------- joins


@register(
    "category_from_part",
    "J1 P17 F2",
    """WITH dim AS (SELECT p_name, p_type FROM part
           QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1)
       SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'N' THEN coalesce(dim.p_type, 'Other') ELSE l_returnflag END AS category
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN dim ON part.p_name = dim.p_name""",
)
def _(spark, sf):
    parts = load(spark, sf, "part")
    names = parts.select("p_partkey", "p_name")
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "N", "Other").otherwise(F.col("l_returnflag")).alias("category"),
    )
    named = lines.join(names, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    done = joins.category_from_part(named, parts, "p_name", "category", "p_type", "p_partkey")
    return done.select("l_orderkey", "l_linenumber", "category")


@register(
    "parts_with_solutions",
    "J2",
    """WITH s AS (SELECT ' ' || CAST(doc_id // 2 AS VARCHAR) || ' ' AS fsrl_part_num, text FROM documents)
       SELECT p_partkey, p_name, s.fsrl_part_num, md5(s.text) AS fsr_solution
       FROM part LEFT JOIN s ON CAST(p_partkey AS VARCHAR) = trim(s.fsrl_part_num)""",
)
def _(spark, sf):
    solutions = load(spark, sf, "documents").select(
        F.concat(F.lit(" "), F.expr("doc_id div 2").cast("string"), F.lit(" ")).alias("fsrl_part_num"),
        F.md5("text").alias("fsr_solution"),
    )
    parts = load(spark, sf, "part").select("p_partkey", "p_name")
    return joins.parts_with_solutions(parts, solutions, "p_partkey", "fsrl_part_num")


@register(
    "orders_without_returns",
    "J3 A12",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def _(spark, sf):
    returned = load(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return joins.without(orders, returned, ["o_orderkey"])


@register(
    "records_of_large_classes",
    "J4",
    """SELECT doc_id, source, lang FROM documents WHERE lang IN
       (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 130)""",
)
def _(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "source", "lang")
    large = df.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") >= 130)
    return joins.only(df, large, ["lang"])


@register(
    "first_record_per_text",
    "W7 A7",
    """SELECT md5(text) AS text_id, source, min(doc_id) AS doc_id,
         arg_min(lang, doc_id) AS lang FROM documents GROUP BY md5(text), source""",
)
def _(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "source", "lang", F.md5("text").alias("text_id"))
    return first_per_key(df, ["text_id", "source"], "doc_id")
