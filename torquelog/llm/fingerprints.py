"""Document fingerprints by consistent weighted sampling of words.

For every word and every sample three numbers come from a hash of the two: r and c, gamma variables
of shape 2, and b, uniform. A word of weight w gets t = floor(ln w / r + b) and
a = c / exp(r (t - b) + r); the sample is the (word, t) of the least a. Two texts agree in a sample
with the chance of their generalised Jaccard similarity: the sum of the lesser weights over the sum
of the greater ones. The weight of a word is how often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog.llm import common

SAMPLES = 32
_SCALE, _SHIFT = float(1 << 23), 80.0  # ln a as a whole number of 31 bits
_LOW = (1 << 32) - 1
SPACES = "\n\t\r\f\v"
BLANK_KEYS = {  # by type of the key; what stands for a null one, which is told apart by a flag
    "string": "", "binary": "", "boolean": "false", "date": "1970-01-01",
    "timestamp": "1970-01-01 00:00:00", "timestamp_ntz": "1970-01-01 00:00:00",
}


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; may hold empty strings."""
    return F.split(F.translate(F.lower(text), SPACES, " " * len(SPACES)), " ")


def _bits(h: Column, shift: int, bits: int) -> Column:
    """Some bits of a hash as a number strictly between 0 and 1."""
    mask = F.lit((1 << bits) - 1)
    return (F.shiftrightunsigned(h, shift).bitwiseAND(mask) + F.lit(0.5)) * F.lit(2.0**-bits)


def draws(counted: DataFrame, weights: list[str], samples: int) -> DataFrame:
    """A row for every term and sample ``k`` with its r, ln c and b and the logarithms of the weights."""
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    h, g = F.xxhash64("term", 2 * F.col("k")), F.xxhash64("term", 2 * F.col("k") + 1)
    kept = [c for c in each.columns if c not in weights]
    return each.select(
        *kept,
        (-F.log(_bits(h, 43, 21) * _bits(h, 22, 21))).alias("r"),
        F.log(-F.log(_bits(g, 32, 32) * _bits(g, 0, 32))).alias("ln_c"),
        _bits(h, 1, 21).alias("b"),
        *[F.when(F.col(w) > 0, F.log(F.col(w))).alias(w) for w in weights],
    )


def least(ln_w: Column) -> Column:
    """Least over the terms of ln a, above 32 bits that name (term, t); terms without weight take no part."""
    t = F.floor(ln_w / F.col("r") + F.col("b"))
    ln_a = F.col("ln_c") - F.col("r") * (t - F.col("b")) - F.col("r")
    order = ((ln_a + _SHIFT) * _SCALE).cast("long")
    name = F.col("term").bitwiseXOR(F.shiftleft(t, 16)).bitwiseAND(F.lit(_LOW))
    return F.min(F.shiftleft(order, 32).bitwiseOR(name))


def _low_bits(values: Column) -> Column:
    return F.transform(values, lambda x: x.bitwiseAND(F.lit(_LOW)))


def signatures(counted: DataFrame, by: list[str], weights: list[str], samples: int) -> DataFrame:
    """(by, one array of samples per weight column) from rows (by, term, weights)."""
    drawn = draws(counted, weights, samples)
    found = drawn.groupBy(*by, "k").agg(*[least(F.col(w)).alias(w) for w in weights])
    rows = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", *weights))).alias("all"))
    names = [_low_bits(F.col("all")[w]).alias(w) for w in weights]
    return rows.select(*by, *names)


def printed(samples: Column) -> Column:
    """Eight hexadecimal digits per sample; a text without words has the empty fingerprint."""
    each = F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0"))
    return F.when(samples[0].isNull(), F.lit("")).otherwise(F.array_join(each, ""))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """The share of samples that agree; two texts without words are alike."""
    same = [F.when(a[k] == b[k], 1.0).otherwise(0.0) for k in range(samples)]
    total = same[0]
    for one in same[1:]:
        total = total + one
    both_empty = a[0].isNull() & b[0].isNull()
    return F.when(both_empty, F.lit(1.0)).otherwise(total / float(samples))


def fingerprint(
    docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs``; a null text is an empty one."""
    rows = docs.select(
        common.named(key).alias("doc_id"),
        F.xxhash64(F.coalesce(common.named(text), F.lit(""))).alias("h"),
        F.coalesce(common.named(text), F.lit("")).alias("t"),
    )
    terms = rows.groupBy("h").agg(F.first("t").alias("t"))
    terms = terms.select("h", F.explode(words_of(F.col("t"))).alias("word")).where("word <> ''")
    counted = terms.groupBy("h", F.xxhash64("word").alias("term")).agg(F.count("*").alias("w"))
    found = signatures(counted, ["h"], ["w"], samples)
    found = found.select("h", printed(F.col("w")).alias("fingerprint"))
    return (
        rows.select("doc_id", "h")
        .join(common.stored(found, "fingerprints"), "h", "left")
        .select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """The distinct keys (k1, k2) in descending order with their place in it.

    Only keys and lengths are put in order: ranges of them are sorted apart, then numbered.
    """
    keys = rows.groupBy("none", "k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_chars").alias("n_chars")
    )
    order = [F.col("none"), F.col("k1").desc(), F.col("k2").desc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.stored(common.numbered(ordered, [], "g", "document_order"), "document_places")


def _split_words(both: DataFrame) -> DataFrame:
    """Words whole in the kept part count for both texts; the rest of each text for its own."""
    blank = F.translate(F.col("kept"), SPACES, " " * len(SPACES))
    tail = F.char_length(F.substring_index(blank, " ", -1))
    cut = (F.char_length("kept") - tail).cast("int")
    cuts = both.withColumn("cut", cut)
    return cuts.select(
        "k1",
        "k2",
        words_of(F.expr("left(t, cut)")).alias("shared"),
        words_of(F.expr("substring(t, cut + 1)")).alias("own"),
        words_of(F.expr("concat(substring(kept, cut + 1), start)")).alias("new"),
    )


def compare_with_edits(
    docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are.

    The edit replaces the last third of a text by the start of the next document's text (descending
    key, null keys last, equal keys by a hash of their texts, after the last the first). Keys have any
    type that can be put in order and made from a string; no other column is read. Rows equal in
    key and text are one document that is returned as often as it occurs. A text travels once, to its
    key; the start of it that the previous document needs travels to that one.
    """
    content = F.coalesce(common.named(text), F.lit(""))
    id_ = common.named(key)
    blank = F.lit(BLANK_KEYS.get(docs.select(id_).schema[0].dataType.typeName(), "0"))
    blank = blank.cast(docs.select(id_).schema[0].dataType)
    rows = docs.select(
        F.coalesce(id_, blank).alias("k1"),
        F.xxhash64(content, id_.isNull()).alias("k2"),
        id_.isNull().alias("none"),
        content.alias("t"),
        F.char_length(content).cast("long").alias("n_chars"),
    )
    places = neighbours(rows)
    total, most = places.agg(F.count(F.lit(1)), F.max("copies")).first()
    ahead = places.select(
        F.pmod(F.col("g") - 1, F.lit(max(total, 1))).alias("g"),
        F.col("k1").alias("n1"),
        F.col("k2").alias("n2"),
    )
    links = common.stored(places.join(ahead, "g"), "document_links")
    if (most or 1) > 1:  # otherwise there is nothing to collapse
        rows = rows.dropDuplicates(["k1", "k2"])
    texts = rows.select("k1", "k2", "t").repartition("k1", "k2")
    wanted = links.select(
        F.col("n1").alias("k1"),
        F.col("n2").alias("k2"),
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("take"),
    )
    starts = texts.join(wanted, ["k1", "k2"]).select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("left(t, take)").alias("start"), "take"
    )
    both = texts.join(starts, ["k1", "k2"])
    keep = F.expr("left(t, cast(char_length(t) as int) - take)")
    edited = F.concat(keep, F.col("start"))
    digests = both.select("k1", "k2", F.sha2(edited, 256).alias("edited_sha256"))

    parts = _split_words(both.select("k1", "k2", "t", "start", keep.alias("kept")))
    terms = parts.select(
        "k1",
        "k2",
        F.size("shared").alias("a"),
        (F.size("shared") + F.size("own")).alias("b"),
        F.posexplode(F.concat("shared", "own", "new")).alias("pos", "word"),
    ).where("word <> ''")
    counted = terms.groupBy("k1", "k2", F.xxhash64("word").alias("term")).agg(
        F.sum((F.col("pos") < F.col("b")).cast("long")).alias("w"),
        F.sum(((F.col("pos") < F.col("a")) | (F.col("pos") >= F.col("b"))).cast("long")).alias("v"),
    )
    signed = digests.join(signatures(counted, ["k1", "k2"], ["w", "v"], samples), ["k1", "k2"], "left")
    signed = common.stored(signed, "signatures")  # in one job, so that the texts travel once
    following = signed.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("w").alias("x"))
    nothing = F.array(*[F.lit(None).cast("long")] * samples)
    s, e, x = (F.coalesce(F.col(c), nothing) for c in "wvx")
    return (
        links.join(signed, ["k1", "k2"])
        .join(following, ["n1", "n2"], "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            F.when(~F.col("none"), F.col("k1")).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            printed(s).alias("fingerprint"),
            printed(e).alias("edited_fingerprint"),
            likeness(s, e, samples).alias("near_edited"),
            likeness(s, x, samples).alias("near_next"),
        )
    )


def query(spark: SparkSession, directory: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{directory}/documents.parquet"))
