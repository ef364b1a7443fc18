"""Secret scan with multipart credential linking.

Strong findings are reported wherever they are. Weak ones (an account name, an address, an opaque
string) are parts of a credential only next to the other parts: access identifiers, secrets and
endpoints of a text are joined where their scopes, the text around them, overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelog.llm import common

SCOPE = 200  # code points around a part in which the others must be
ACCESS, SECRET, ENDPOINT = "access", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """What a pattern finds: its role, whether it counts alone, and what a match must be like."""

    name: str
    role: str
    strong: bool
    pattern: str
    group: int = 0
    least: int = 0
    like: str | None = None


#: In the order of the kinds in a result. The first three are the base kinds.
KINDS = (
    Kind(
        "assign",
        SECRET,
        True,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Kind("access", ACCESS, True, r"AKIA[A-Z0-9]+", least=18),
    Kind("hex", SECRET, True, r"[0-9a-f]{16,}", least=16),
    Kind(
        "account",
        ACCESS,
        False,
        r"""(?i)\b(?:client_?id|access_?key_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""",
        group=1,
        least=3,
    ),
    Kind(
        "opaque",
        SECRET,
        False,
        r"[A-Za-z0-9+/_-]{20,}",
        like=r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$",
    ),
    Kind(
        "endpoint",
        ENDPOINT,
        False,
        r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|redis|amqp|mongodb)://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.-]+""",
    ),
)
BASE = 3


def _matches(text: Column, kind: Kind) -> Column:
    """For every match of the pattern, in order: text before it since the last one, length, whether it counts.

    Null where the pattern has no match; the costlier parts are then not evaluated.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.char_length)
    part = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    right = F.transform(part, lambda p: F.char_length(p) >= kind.least)
    if kind.like:
        right = F.transform(part, lambda p: p.rlike(kind.like))
    gaps = F.slice(gaps, 1, F.size(found))
    rows = F.arrays_zip(
        gaps.alias("gap"), F.transform(found, F.char_length).alias("length"), right.alias("right")
    )
    return F.when(text.rlike(kind.pattern), rows)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, one array of matches per kind): one pass over the texts, nothing shuffled.

    ``digest`` names the text where any pattern matches and is null elsewhere.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("doc_id"), content.alias("t"))
    found = found.select("doc_id", "t", *[_matches(F.col("t"), k).alias(k.name) for k in KINDS])
    some = F.coalesce(*[F.col(k.name) for k in KINDS]).isNotNull()
    digest = F.when(some, F.sha2("t", 256)).alias("digest")
    return found.select("doc_id", digest, *[k.name for k in KINDS])


def positions(found: DataFrame) -> DataFrame:
    """(digest, kind, start, end) of the matches that count, once per distinct text.

    A match starts after all gaps and matches of its kind before it. The window is over one kind in
    one text; texts with the same digest are first reduced to one.
    """
    names = [k.name for k in KINDS]
    parts = found.where("digest is not null").groupBy("digest").agg(*[F.first(n).alias(n) for n in names])
    each = F.array(
        *[F.struct(F.lit(i).alias("kind"), F.col(n).alias("m")) for i, n in enumerate(names)]
    )
    rows = parts.select("digest", F.explode(each).alias("k")).where("k.m is not null")
    rows = rows.select("digest", "k.kind", F.posexplode("k.m").alias("i", "m"))
    order = Window.partitionBy("digest", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(order)
    placed = rows.select("digest", "kind", "m.right", (end - F.col("m.length")).alias("start"), end.alias("end"))
    return placed.where("right").select("digest", "kind", "start", "end")


def _of_kind(values: dict[int, object]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(table, F.col("kind"))


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that have their complement within ``scope`` code points.

    A weak secret needs an access identifier, a weak access identifier a secret, an endpoint both. A
    weak span inside a strong one is part of that and not reported. The interval join is an equi-join
    on pieces of ``scope`` code points: a weak span looks into the pieces its scope reaches, any span
    is in the pieces it covers, and no piece holds more spans than characters.
    """
    rows = spans.select(
        "digest",
        "kind",
        "start",
        "end",
        _of_kind({i: k.role for i, k in enumerate(KINDS)}).alias("role"),
        _of_kind({i: k.strong for i, k in enumerate(KINDS)}).alias("strong"),
    )
    piece = lambda c: F.floor(c / scope)
    weak = rows.where(~F.col("strong")).withColumn(
        "piece", F.explode(F.sequence(piece(F.col("start") - scope), piece(F.col("end") + scope)))
    )
    near = rows.select(
        "digest",
        F.col("kind").alias("k"),
        F.col("start").alias("s"),
        F.col("end").alias("e"),
        F.col("role").alias("r"),
        F.col("strong").alias("x"),
        F.explode(F.sequence(piece(F.col("start")), piece(F.col("end") - 1))).alias("piece"),
    )
    inside = (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))
    apart = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
    met = weak.join(near, ["digest", "piece"]).where(
        (apart <= scope) & ((F.col("r") != F.col("role")) | (F.col("x") & inside))
    )
    has = lambda role: F.max((F.col("r") == role) & ~inside)
    flags = met.groupBy("digest", "kind", "start", "end", "role").agg(
        has(ACCESS).alias("access"),
        has(SECRET).alias("secret"),
        F.max(F.col("x") & inside).alias("covered"),
    )
    needed = (
        F.when(F.col("role") == SECRET, F.col("access"))
        .when(F.col("role") == ACCESS, F.col("secret"))
        .otherwise(F.col("access") & F.col("secret"))
    )
    return flags.where(needed & ~F.col("covered")).select("digest", "kind", "start", "end")


def _printed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    each = F.transform(
        spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def find_secrets(
    docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row.

    Spans are ``kind:start:end`` in code points, the end exclusive, in order of start and then kind.
    ``base_sha256`` is over those of the three base kinds alone; ``spans`` has the linked weak ones
    too. Null texts are empty. Equal texts are linked once. Other columns are not read.
    """
    found = common.stored(scan(docs, key, text), "secret_matches")
    spans = common.stored(positions(found), "secret_spans")
    strong = spans.where(F.col("kind") < BASE)
    every = strong.unionByName(link(spans, scope))
    span = F.struct("start", "kind", "end")
    lists = every.groupBy("digest").agg(
        F.sort_array(F.collect_list(span)).alias("all"),
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{KINDS[i].name}") for i in range(BASE)],
        F.sum((F.col("kind") >= BASE).cast("long")).alias("n_linked"),
    )
    base = F.filter("all", lambda s: s["kind"] < BASE)
    counts = [*[f"n_{KINDS[i].name}" for i in range(BASE)], "n_linked"]
    lists = lists.select("digest", *counts, _printed(base).alias("base"), _printed(F.col("all")).alias("spans"))
    matched = found.select("doc_id", "digest").where("digest is not null")
    with_spans = matched.join(common.stored(lists, "secret_lists"), "digest", "left")
    without = found.where("digest is null").select("doc_id")
    rows = with_spans.unionByName(without, allowMissingColumns=True)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    return rows.select(
        "doc_id",
        *zero[:BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        zero[BASE],
    )


def query(spark: SparkSession, directory: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{directory}/documents.parquet"))
