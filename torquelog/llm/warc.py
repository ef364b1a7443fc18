"""Web archives without repeated payloads: equal payloads are stored once and revisited by the others.

Only the headers of the records (key, length, digest) are grouped by payload digest. The digests that
occur more than once then meet the records, and each record is written with a fresh header: the
original as a response with its payload, the others as revisits that name the original. Spark's own
text writer makes the files, gzip compressed WARC 1.1, so they go wherever Spark can write.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog import runtime
from torquelog.llm import common

LEAST_BYTES = 100  # of a payload that is worth a revisit
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Record-Key"  # header field of the key of the table's row


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, uri, payload, bytes, digest) of each row; a null payload is empty, a null url stays null."""
    content = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("uri"),
        content.alias("payload"),
        F.octet_length(content).cast("long").alias("bytes"),
        F.sha2(content, 256).alias("digest"),
    )


def resolve(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``rows`` with (type, refers_to): whether a record is a response or revisits that of another key.

    Of records with equal payloads of ``least_bytes`` or more the one with the smallest key is the
    response; a null key comes last. Rows that share the smallest key are all responses.
    """
    long_enough = rows.where(F.col("bytes") >= least_bytes)
    groups = long_enough.groupBy("digest").agg(
        F.min("key").alias("original"), F.count(F.lit(1)).alias("weight")
    )
    repeated = common.stored(groups.where("weight > 1"), "repeated_payloads")
    # short payloads, however many are equal, meet nothing
    apart = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    meeting = F.when(F.col("bytes") >= least_bytes, F.col("digest")).otherwise(apart)
    met = common.split_join(
        rows.withColumn("meeting", meeting),
        repeated.select(F.col("digest").alias("meeting"), "original"),
        "meeting",
        "weight",
        repeated.withColumnRenamed("digest", "meeting"),
        how="left",
    )
    revisits = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("key"))
    return met.select(
        "key", "uri", "payload", "bytes", "digest",
        F.when(revisits, F.lit("revisit")).otherwise("response").alias("type"),
        F.when(revisits, record_id(F.col("original"), F.col("digest"))).alias("refers_to"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line; control characters cannot end it early. No line for a null."""
    safe = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%20")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit(EOL))).otherwise("")


def record_id(key: Column, digest: Column) -> Column:
    """A name that depends on the key and the payload alone, so that a retry gives the same one."""
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def written(rows: DataFrame, path: str, date: str | None = None) -> None:
    """Write resolved ``rows`` as archives below ``path``, each record with a fresh header.

    A response holds an HTTP head and the payload, a revisit the head alone. One file per task;
    ``date`` is that of the records (default: now).
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(EOL + EOL),
    )
    revisit = F.col("type") == "revisit"
    block = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _field("WARC-Type", F.col("type")),
        _field("WARC-Record-ID", record_id(F.col("key"), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field(KEY, F.col("key")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block),
        F.lit(EOL),
        head,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    # what the writer puts between lines is what ends a record
    out = rows.select(record.alias("value")).write.option("lineSep", EOL + EOL)
    out.option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(EOL)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(data: bytes, last: bool) -> tuple[list[tuple[dict[str, str], bytes]], bytes]:
    """The whole records at the start of ``data`` and the bytes that follow them.

    A record is cut by its length, so its payload may hold anything. With ``last`` nothing comes
    after ``data``: a record that was cut off is left out.
    """
    out, at = [], 0
    while True:
        start = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", start) if start >= 0 else -1
        if end < 0:
            return out, b"" if last else data[at:]
        fields = _fields(data[start:end])
        length = fields.get("content-length", "")
        size = int(length) if length.isdecimal() else 0
        if len(data) < end + 4 + size:
            return out, b"" if last else data[at:]
        out.append((fields, data[end + 4 : end + 4 + size]))
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(record_id, type, uri, key, bytes, digest, declared, refers_to[, payload]) of every record below ``path``.

    ``bytes`` and ``digest`` are of the payload as it stands in the archive; ``declared`` is the digest
    that the header states. A file is read as a stream of lines and never held whole; a record is.
    Archives are gzip compressed, which Spark reads a file at a time, so no record is split. Payloads
    are UTF-8 text.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64(F.input_file_name()).alias("file"))
    kinds = "record_id string, type string, uri string, key string, bytes bigint, digest string, declared string, refers_to string"
    names = [part.split(" ")[0] for part in kinds.split(", ")] + ["payload"] * with_payload

    def rows_of(found) -> list[tuple]:
        rows = []
        for fields, block in found:
            if fields.get("warc-type") not in ("response", "revisit"):
                continue
            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            row = (
                fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"),
                fields.get(KEY.lower()), len(payload), hashlib.sha256(payload).hexdigest(),
                fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-refers-to"),
            )
            rows.append(row + (payload.decode("utf-8", "replace"),) * with_payload)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n == "bytes" else pa.string() for n in names]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        held, pieces, size, file = b"", [], 0, None
        for batch in batches:
            files = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                new = file is not None and files[a] != file
                if new or size > max(1 << 20, len(held)):  # a long record is looked through a few times only
                    found, held = parse(b"".join([held, *pieces]), last=new)
                    pieces, size = [], 0
                    if rows := rows_of(found):
                        yield packed(rows)
                file = files[a]
                text = b"\n".join(batch.column(0).slice(a, b - a).to_pylist()) + b"\n"
                pieces.append(text)
                size += len(text)
        if rows := rows_of(parse(b"".join([held, *pieces]), last=True)[0]):
            yield packed(rows)

    return lines.mapInArrow(run, kinds + ", payload string" * with_payload)


def located(archived: DataFrame) -> DataFrame:
    """Each record with the length and digest of its full payload and the key of the response it revisits.

    Revisits meet the responses by digest; the response has the name that the revisit refers to, so a
    response of another name is none of theirs.
    """
    columns = ["record_id", "uri", "key", "type"]
    own = archived.where("type = 'response'").select(
        *columns, "bytes", "digest", F.lit(None).cast("string").alias("refers_to")
    )
    revisits = archived.where("type = 'revisit'").withColumnRenamed("declared", "payload")
    counts = common.stored(revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("weight")), "revisit_counts")
    originals = archived.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("bytes").alias("full"), F.col("digest").alias("whole"),
        F.col("key").alias("original"),
    )
    originals = originals.dropDuplicates(["refers_to"])  # repeated rows have one name and one payload
    met = common.split_join(
        revisits.select(*columns, "payload", "refers_to"), originals, "refers_to", "weight", counts, how="left"
    )
    met = met.select(
        *columns, F.col("full").alias("bytes"), F.coalesce("whole", "payload").alias("digest"),
        F.col("original").alias("refers_to"),
    )
    return own.unionByName(met)


def deduplicate(
    pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None,
    key: str = "page_id", url: str = "url", payload: str = "html",
) -> DataFrame:
    """Write ``pages`` to archives below ``path`` with revisits and read them back.

    Returns (record_id, uri, key, type, bytes, digest, refers_to) for every row of ``pages``. A null
    payload is empty, and short ones are all responses. A null key is written as none and comes last;
    equal keys with equal payloads are all responses. Control characters of a url are written as
    ``%20``. Payloads may hold anything, also what looks like a record; one has to fit a task. Other
    columns are not read. An empty table gives no rows.
    """
    written(resolve(records(pages, key, url, payload), least_bytes), path, date)
    found = read_archives(pages.sparkSession, path)
    return located(common.stored(found, "archived_headers"))


def rewrite(spark: SparkSession, source: str, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Deduplicate existing archives: every record gets a fresh header, repeated payloads go.

    Keys are compared as text. Revisits in ``source`` name the response that their digest has now;
    those whose original is in other archives go on naming that one.
    """
    found = read_archives(spark, source, with_payload=True)
    rows = found.where("type = 'response'").select("key", "uri", "payload", "bytes", "digest")
    first = rows.groupBy("digest").agg(F.min("key").alias("original"), F.max("bytes").alias("full"))
    old = found.where("type = 'revisit'").select(
        "key", "uri", "bytes", F.col("declared").alias("digest"), F.col("refers_to").alias("former")
    )
    counts = common.stored(old.groupBy("digest").agg(F.count(F.lit(1)).alias("weight")), "old_revisits")
    again = common.split_join(old, first, "digest", "weight", counts, how="left").select(
        "key", "uri", F.lit("").alias("payload"), F.coalesce("full", "bytes").alias("bytes"), "digest",
        F.lit("revisit").alias("type"),
        F.when(F.col("full").isNull(), F.col("former"))
        .otherwise(record_id(F.col("original"), F.col("digest"))).alias("refers_to"),
    )
    written(resolve(rows, least_bytes).unionByName(again), path)


def query(spark: SparkSession, directory: str) -> DataFrame:
    pages = spark.read.parquet(f"{directory}/pages.parquet")
    found = deduplicate(pages, runtime.scratch_path(spark, "archives"))
    return found.select(
        F.col("key").cast("long").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM q
"""
