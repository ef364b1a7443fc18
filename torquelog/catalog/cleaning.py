"""Text cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquelog.catalog import sql
from torquelog.catalog.registry import register
from torquelog.functions import lexicons, tagging, text
from torquelog.runtime import load, once

STEPS = {
    "stripped": (text.strip, sql.strip),
    "one_lined": (text.one_line, sql.one_line),
    "no_mentions": (text.remove_mentions_and_tags, sql.mentions),
    "no_urls": (text.remove_urls, sql.urls),
    "no_html": (text.remove_html, sql.html),
    "no_dates": (text.remove_dates, sql.dates),
    "no_punctuation": (text.remove_punctuation, sql.punctuation),
}


def _steps_sql(table: str, key: str, column: str) -> str:
    parts = ", ".join(f"md5({make(column)}) AS {n}" for n, (_, make) in STEPS.items())
    return f"SELECT {key}, {parts} FROM {table}"


@register("clean_steps_documents", "T1 T2 T3 T4 T5 T6 T7", _steps_sql("documents", "doc_id", "text"))
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    return df.select("doc_id", *[F.md5(make(F.col("text"))).alias(n) for n, (make, _) in STEPS.items()])


@register("clean_steps_pages", "T1 T2 T3 T4 T5 T6 T7", _steps_sql("pages", "page_id", "html"))
def _(spark, sf):
    df = load(spark, sf, "pages", "page_id")
    return df.select("page_id", *[F.md5(make(F.col("html"))).alias(n) for n, (make, _) in STEPS.items()])


@register(
    "strict_lower_pages",
    "T20",
    "SELECT page_id, lower("
    + sql.delete(
        "translate("
        + sql.urls(sql.html(sql.delete("replace(html, chr(10), ' ')", text.BRACKETS)))
        + f", {sql.quoted(text.ASCII_PUNCTUATION)}, '')",
        text.NUMBER_WORD,
    )
    + ") AS cleaned FROM pages",
)
def _(spark, sf):
    df = load(spark, sf, "pages", "page_id")
    return df.select("page_id", text.strict_lower(F.col("html")).alias("cleaned"))


@register(
    "expand_short_forms",
    "T8 T9 J7",
    f"""SELECT conv_id, turn,
        {sql.joined(sql.swap(sql.tokens("text"), lexicons.ACRONYMS))} AS acronyms,
        {sql.joined(sql.swap(sql.tokens("text"), lexicons.CONTRACTIONS))} AS contractions
        FROM conversations""",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id")
    return df.select(
        "conv_id",
        "turn",
        text.expand_acronyms(F.col("text")).alias("acronyms"),
        text.expand_contractions(F.col("text")).alias("contractions"),
    )


@register(
    "remove_stopwords",
    "T10",
    f"""SELECT conv_id, turn,
        {sql.joined(sql.drop(sql.tokens("text"), lexicons.STOP_ENGLISH))} AS cleaned
        FROM conversations""",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id")
    return df.select("conv_id", "turn", text.remove_stopwords(F.col("text")).alias("cleaned"))


@register(
    "lemmatize",
    "T11",
    f"""SELECT conv_id, turn, {sql.joined(sql.lemmas(sql.tokens("lower(text)")))} AS lemmas
        FROM conversations""",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id")
    return df.select("conv_id", "turn", text.lemmatize(F.lower("text")).alias("lemmas"))


@register(
    "tokenize",
    "T12 T19",
    f"""SELECT doc_id, len({sql.words("text")}) AS words,
        md5({sql.joined(sql.words("text"))}) AS word_text,
        len(regexp_extract_all(text, {sql.quoted(text.PIECE)})) AS pieces
        FROM documents""",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    return df.select(
        "doc_id",
        F.size(text.words(F.col("text"))).cast("long").alias("words"),
        F.md5(F.array_join(text.words(F.col("text")), " ")).alias("word_text"),
        F.size(text.pieces(F.col("text"))).cast("long").alias("pieces"),
    )


@register(
    "clean_asset_records",
    "K1 F1",
    f"SELECT doc_id, source, {sql.clean_asset('text')} AS cleaned FROM documents",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    return df.select("doc_id", "source", text.clean_asset(F.col("text")).alias("cleaned"))


@register(
    "clean_incident_summaries",
    "K1b F1",
    f"SELECT doc_id, source, {sql.clean_incident('text')} AS cleaned FROM documents",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    return df.select("doc_id", "source", text.clean_incident(F.col("text")).alias("cleaned"))


@register(
    "detect_language",
    "P11",
    f"SELECT doc_id, lang, {sql.language('text')} AS detected FROM documents",
)
def _(spark, sf):
    df = load(spark, sf, "documents", "doc_id")
    return df.select("doc_id", "lang", text.language(F.col("text")).alias("detected"))


@register(
    "actions_and_observations",
    "K14",
    f"""WITH RECURSIVE {sql.tagging_ctes("conversations", "conv_id, turn", "text")},
        words AS (SELECT conv_id, turn,
            string_agg(word, ' ' ORDER BY sentence, nr) FILTER (WHERE tag = 'V') AS actions,
            string_agg(word, ' ' ORDER BY sentence, nr) FILTER (WHERE tag = 'N') AS observations
          FROM tagged GROUP BY conv_id, turn)
        SELECT conv_id, turn, coalesce(actions, '') AS actions, coalesce(observations, '') AS observations
        FROM conversations LEFT JOIN words USING (conv_id, turn)""",
)
def _(spark, sf):
    df = load(spark, sf, "conversations", "conv_id")
    rows = once(df.select("conv_id", "turn", "text"), "pos", tagging.part_of_speech(F.col("text")))
    return rows.select(
        "conv_id",
        "turn",
        F.array_join("pos.actions", " ").alias("actions"),
        F.array_join("pos.observations", " ").alias("observations"),
    )
