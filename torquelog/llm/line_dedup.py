"""Winnowing over lines: delete runs of lines that occurred before.

Of every window of lines the least line hash is its fingerprint, so a run of a window's length or
more shares a fingerprint with each of its copies. Fingerprints that occur at two places or more are
joined to the windows they stand for; a window whose lines occurred earlier is a match, and the
windows around a fingerprint extend it both ways, line by line. The lines of all later matches go.

A window has a fixed number of lines; where a number of words is given too, fewer lines that hold more
words than that are also a window, so that no longer passage is kept twice for want of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog.llm import common

WINDOW = 3  # lines; a shorter repeated run stays, unless it has more than the given words
WORDS = 50  # words above which a run of fewer lines is a window too
BLANK = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _spans(window: int, words: int | None) -> Column:
    """(first, n) of the windows of ``n`` lines, from the lines ``l`` and their numbers of words ``w``.

    A window is left out where its first and its last ``n - 1`` lines have more than ``words`` words
    each: whatever repeats it repeats both of them, and they hold all its lines.
    """

    def longer(first: Column, n: int) -> Column:
        return F.aggregate(F.slice("w", first + 1, n), F.lit(0), lambda a, b: a + b) > words

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("l") - n, F.lit(0)))
        spans = F.transform(starts, lambda i: F.struct(i.alias("first"), F.lit(n).alias("n")))
        wanted = F.size("l") >= n

        def keep(span: Column) -> Column:
            first, kept = span["first"], wanted
            if words is not None and n < window:
                kept = kept & longer(first, n)
            if words is not None and n > 1:
                kept = kept & ~(longer(first, n - 1) & longer(first + 1, n - 1))
            return kept

        return F.filter(spans, keep)

    return F.concat(*[of(n) for n in range(window if words is None else 1, window + 1)])


def windows(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    words: int | None = None,
) -> DataFrame:
    """One row per window of ``window`` lines that are not blank, or of fewer with over ``words`` words.

    Words are what blanks and carriage returns separate. Windows that two shorter ones make up are
    left out.

    (none, id, digest: the document; first, last: places among its lines that are not blank; lines:
    places among all its lines; at, mark: place and hash of the window's fingerprint; same: a digest
    of its lines)
    """
    lines = F.split(F.coalesce(common.named(text), F.lit("")), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(_trimmed(x).alias("x"), i.alias("i")))
    rows = docs.select(
        common.named(key).isNull().alias("none"),
        common.named(key).alias("id"),
        F.md5(F.coalesce(common.named(text), F.lit(""))).alias("digest"),
        F.filter(numbered, lambda line: line["x"] != "").alias("l"),
    ).where(F.size("l") >= (window if words is None else 1))
    hashed = rows.withColumn("h", F.transform("l", lambda line: F.xxhash64(line["x"])))
    if words is not None:
        count = F.transform("l", lambda line: F.size(F.split(line["x"], f"[{BLANK}]+")))
        hashed = hashed.withColumn("w", count)
    spans = F.explode(_spans(window, words)).alias("span")
    exploded = hashed.select("none", "id", "digest", "l", "h", spans)
    exploded = exploded.select("none", "id", "digest", "l", "h", "span.first", "span.n")
    part = F.slice("l", F.col("first") + 1, F.col("n"))
    least = F.slice("h", F.col("first") + 1, F.col("n"))
    return exploded.select(
        "none",
        "id",
        "digest",
        "first",
        F.transform(part, lambda line: line["i"]).alias("lines"),
        F.array_min(least).alias("mark"),
        (F.col("first") + F.array_position(least, F.array_min(least)) - 1).alias("at"),
        F.md5(F.array_join(F.transform(part, lambda line: line["x"]), "\n")).alias("same"),
    )


def repeated_lines(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    words: int | None = None,
) -> DataFrame:
    """(none, id, digest, gone): for each document that repeats a run, the places of its lines to delete.

    Documents are in order of key (null last), then a digest of the text; rows equal in both are one
    document. Of the windows with the same lines the first stays; the others go, except where they
    overlap the first in its own document.
    """
    found = common.stored(windows(docs, window, key, text, words), "line_windows")
    place = F.struct("none", "id", "digest", F.col("at").alias("place"))
    marks = found.groupBy("mark").agg(
        F.count("*").alias("weight"), F.min(place).alias("low"), F.max(place).alias("high")
    )
    marks = marks.where(F.col("low") != F.col("high")).select("mark", "weight")
    marks = common.stored(marks, "line_fingerprints")
    met = common.stored(common.split_join(found, marks, "mark", "weight"), "line_candidates")
    origin = F.struct("none", "id", "digest", F.col("first").alias("place"))
    firsts = met.groupBy("same").agg(F.count("*").alias("weight"), F.min(origin).alias("origin"))
    firsts = common.stored(firsts.where("weight > 1"), "line_first_windows")
    matched = common.split_join(met, firsts, "same", "weight")
    elsewhere = ~(
        (F.col("none") == F.col("origin.none"))
        & F.col("id").eqNullSafe(F.col("origin.id"))
        & (F.col("digest") == F.col("origin.digest"))
    )
    later = elsewhere | (F.col("first") >= F.col("origin.place") + F.size("lines"))
    gone = matched.where(later).groupBy("none", "id", "digest")
    return gone.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` but those at the sorted places ``gone``, as the runs between them."""
    def run(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.element_at(gone, F.greatest(j, F.lit(1))) + 1)
        end = F.when(j == F.size(gone), F.size(lines)).otherwise(
            F.element_at(gone, F.least(j + 1, F.size(gone)))
        )
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run))


def dedup_lines(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    words: int | None = None,
) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``_lines`` and ``_gone`` lines counted.

    The two counts are the last columns; where ``docs`` has columns of these names, theirs end in one
    underscore more.

    A run has ``window`` lines or more or, where ``words`` is given, more words than that.
    Lines are compared without blanks and carriage returns around them; blank lines take no part
    and stay. Every row stays, if need be with an empty text; null texts stay null. All columns are
    kept; ``n_chars``, where there is one, becomes the length of the new text.
    """
    names = ("_lines", "_gone", "_md5", "_id", "_digest", "_places", "_kept")
    count, removed, md5, id_, digest, places, new = common.unused(docs, *names)
    gone = common.stored(repeated_lines(docs, window, key, text, words), "repeated_lines").select(
        F.col("id").alias(id_), F.col("digest").alias(digest), F.col("gone").alias(places)
    )
    content = F.coalesce(common.named(text), F.lit(""))
    rows = docs.withColumn(md5, F.md5(content))
    same = (F.col(md5) == F.col(digest)) & common.named(key).eqNullSafe(F.col(id_))
    joined = rows.join(gone.hint("merge"), same, "left")
    lines = F.split(content, "\n")
    changed = F.col(places).isNotNull()
    kept = F.when(changed, F.array_join(_without(lines, F.col(places)), "\n")).otherwise(common.named(text))
    joined = joined.withColumn(new, kept).withColumn(count, F.size(lines).cast("long"))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(new).alias(c))
        elif c == "n_chars":
            size = F.char_length(new).cast(docs.schema[c].dataType)
            columns.append(F.when(changed, size).otherwise(F.col(c)).alias(c))
        else:
            columns.append(common.named(c))
    return joined.select(*columns, count, F.coalesce(F.size(places), F.lit(0)).cast("long").alias(removed))


def query(spark: SparkSession, directory: str) -> DataFrame:
    """Runs of three lines or of over ``WORDS`` words go."""
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text")
    kept = F.coalesce(F.col("text"), F.lit(""))
    return dedup_lines(docs, words=WORDS).select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_gone").alias("n_removed"),
        F.char_length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


SQL = f"""
WITH docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
lines AS (
  SELECT doc_id, digest, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT DISTINCT * FROM docs)),
full_lines AS (
  SELECT doc_id, digest, i, trim(line, ' ' || chr(9) || chr(13)) AS x FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
counted AS (SELECT *, len(string_split_regex(x, '[ \\t\\r]+')) AS n FROM full_lines),
next AS (
  SELECT doc_id, digest, row_number() OVER o - 1 AS place, i, lead(i, 1) OVER o AS j, lead(i, 2) OVER o AS k,
    x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z, n, lead(n, 1) OVER o AS m
  FROM counted WINDOW o AS (PARTITION BY doc_id, digest ORDER BY i)),
runs AS (
  SELECT doc_id, digest, place, [i] AS places, x AS run FROM next WHERE n > {WORDS}
  UNION ALL SELECT doc_id, digest, place, [i, j], x || chr(10) || y FROM next WHERE n + m > {WORDS}
  UNION ALL SELECT doc_id, digest, place, [i, j, k], x || chr(10) || y || chr(10) || z FROM next WHERE z IS NOT NULL),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, digest, place) AS r FROM runs),
gone AS (
  SELECT DISTINCT b.doc_id, b.digest, unnest(b.places) AS i
  FROM firsts b JOIN firsts a ON a.run = b.run AND a.r = 1 AND b.r > 1
  WHERE a.doc_id IS DISTINCT FROM b.doc_id OR a.digest <> b.digest OR b.place >= a.place + len(b.places)),
kept AS (
  SELECT l.doc_id, l.digest, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.digest = g.digest AND l.i = g.i
  GROUP BY ALL)
SELECT d.doc_id, n_lines, n_removed, length(kept.text) AS kept_chars, sha256(kept.text) AS kept_sha256
FROM docs d JOIN kept ON d.doc_id IS NOT DISTINCT FROM kept.doc_id AND d.digest = kept.digest
"""
