"""Similarity join of documents by the Jaccard similarity of their word shingles, to components.

Under any order of all shingles two documents that are similar enough share one among the first few
of each (the prefix). One order makes the candidates: shingles by hash, as the sets are stored, but those that turned out to be
in many prefixes go to the end, the most common last. A few turns find them: what a text's prefix takes
in for a shingle that went to the end may be common itself. A candidate pair must also have close
sizes, enough shingles from the first one in common on (its place bounds what they can share), counts
of its shingles by hash part that leave room for enough common ones, and a prefix shingle in common
under two further orders; only then are the sets fetched and compared.

Equal sets are one node. Within a group of nodes that share a prefix shingle not all pairs are made:
each node is compared to the group's pivot, rounds with new pivots join what is similar to them, and
at the end the pairs that are still in different components, and not ruled out as above, are all compared. So no link between
components is lost, while a group of copies costs a few comparisons per member. A pair is made at the first shingle it
shares, not once at each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelog.llm import common, words

SHINGLE = 4
PERCENT = 85  # similarity of a link
SEEDS = (0, 0x85A308D3, 0x13198A2E)  # of the orders; the first is that of the stored sets
HEAVY = 8  # prefixes that a shingle may be in before it goes to the end of the first order
FURTHER = 4  # shingles looked at beyond a prefix for each one of the text that goes to the end
COMMON = 1 << 22  # of them, the most common first; what is beyond concerns speed only
BITS = 27  # of a filter of values at most, ``LEAST_BITS`` at least; concerns speed only
LEAST_BITS = 20
BEFORE = 8  # shingles before one that tell whether a pair has met already; concerns speed only
ROUNDS = 2  # of pivots before all pairs in different components are compared
PIVOTS = 16  # of a group at most, one for each ``PIVOTS`` nodes of it
CHUNK = 1 << 17  # shingles that a task looks at together, a set at least
BATCH = 1000  # rows that a task holds as Arrow at a time; a set may be long
TEXT = 1 << 19  # bytes of text that a task cuts together, a text at least
PARTS = 32  # of a set, by hash, whose sizes bound the common part of two sets


def sets_of(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after another, and where each text starts."""
    low = words.LOWER[data]
    starts, ends, first = words.spans(low, at, words.NOT_SPACE)
    h, of = words.shingles(words.hashes(low, starts, ends), first, n)
    texts = len(at) - 1
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16 if texts < 65536 else np.int64), kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(texts + 1))


def digests(h: np.ndarray, first: np.ndarray) -> list[int | None]:
    """A 64-bit name of each set; none for an empty one."""
    out: list[int | None] = []
    for a, b in zip(first[:-1], first[1:]):
        name = hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest()
        out.append(int.from_bytes(name, "little", signed=True) if b > a else None)
    return out


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set come before it has too few left to be similar."""
    return np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)


def levels(h: np.ndarray, common_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common each shingle is: 0 if it is not known to be, else the logarithm of its count."""
    known, level = common_
    if not len(known):
        return np.zeros(len(h), np.uint64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, level[at], 0).astype(np.uint64)


def prefixes(
    h: np.ndarray, first: np.ndarray, level: np.ndarray, seed: int, percent: int, further: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The prefix shingles of each set under one order, and the text each is of.

    With ``further`` a prefix is longer by so many shingles for each of the set's that has a level.
    """
    sizes = np.diff(first)
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = None  # as stored
    if seed:
        order = np.argsort((level << np.uint64(58)) | (words.mix(h ^ np.uint64(seed)) >> np.uint64(6)))
    elif level.any():
        order = np.argsort(level.astype(np.uint8), kind="stable")
    if order is not None:
        order = order[np.argsort(of[order].astype(np.uint16 if len(sizes) < 65536 else np.int64), kind="stable")]
        h = h[order]
    place = np.arange(len(h)) - first[:-1][of]
    most = prefix_sizes(sizes, percent)
    if further:
        many = level > 0 if order is None else level[order] > 0
        most = most + further * np.bincount(of[many], minlength=len(sizes))
    kept = place < most[of]
    return h[kept], of[kept]


def packed(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps between a set's shingles, the first one whole: the highest byte of each, and the other seven.

    The shingles of a set are in order, so the highest bytes are small numbers, which Parquet compresses.
    """
    step = h.copy()
    step[1:] -= h[:-1]
    start = first[:-1][np.diff(first) > 0]
    step[start] = h[start]
    parts = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    return parts[:, 7].copy(), parts[:, :7].copy()


def unpacked(high: np.ndarray, low: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The shingles of sets, none of them empty, from what ``packed`` made of them."""
    parts = np.empty((len(high), 8), np.uint8)
    parts[:, 7], parts[:, :7] = high, low.reshape(-1, 7)
    step = parts.view("<u8").reshape(-1).astype(np.uint64, copy=False)
    total = np.cumsum(step)  # modulo 2 ** 64, as are the differences
    start = first[:-1]
    return total - np.repeat(total[start] - step[start], np.diff(first))


def _joined(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, d, n, high, low) of every text; the members of a set, packed, come once per partition.

    What follows reads the stored sets, so that no text is cut into words and hashed again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row, end, data, at in words.chunks(batch.column(1), TEXT):
                h, first = sets_of(data, at, n)
                names = digests(h, first)
                fresh = [x is not None and x not in seen and not seen.add(x) for x in names]
                columns = [batch.column(0).slice(row, end - row), pa.array(names, pa.int64()), pa.array(np.diff(first))]
                for part in packed(h, first):
                    members = [part[first[t] : first[t + 1]].tobytes() if fresh[t] else None for t in range(len(names))]
                    columns.append(pa.array(members, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "d", "n", "high", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, d bigint, n bigint, high binary, low binary")


def _over_sets(emit: Callable, wanted=None) -> Callable:
    """A function over Arrow batches (d, high, low) that calls ``emit`` with their sets, some at a time:
    all shingles, where each set starts, and the names; each set once, if the filter lets it through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names = batch.column(0).to_numpy()
            new = np.array([x not in seen and not seen.add(x) for x in names.tolist()], bool)
            if wanted is not None:
                new &= _in_filter(wanted.value, names)
            high, low = batch.column(1), batch.column(2)
            if not new.all():
                names, high, low = names[new], high.filter(pa.array(new)), low.filter(pa.array(new))
            sizes = pc.binary_length(high).to_numpy().astype(np.int64)
            run_of = np.cumsum(sizes) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    first = np.concatenate([[0], np.cumsum(sizes[a:b])])
                    h = unpacked(_joined(high[a:b]), _joined(low[a:b]), first)
                    yield from emit(h, first, names[a:b])

    return run


Known = tuple[np.ndarray, np.ndarray]


def _with_known(known: Known, rows: DataFrame) -> Known:
    """``known`` and the shingles of ``rows`` (shingle, many) in order, with the logarithms of their counts."""
    top = rows.orderBy(F.desc("many"), "shingle").limit(COMMON - len(known[0])).toPandas()
    level = np.minimum(np.log2(np.maximum(top["many"].to_numpy(float), 1)).astype(np.int64), 63)
    h = np.concatenate([known[0], top["shingle"].to_numpy(np.int64).view(np.uint64)])
    level = np.concatenate([known[1], level])
    order = np.argsort(h)
    return h[order], level[order]


def hash_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle) of the prefixes by hash alone."""

    def emit(h, first, d):
        p, _ = prefixes(h, first, np.zeros(len(h), np.uint64), SEEDS[0], percent)
        yield pa.RecordBatch.from_arrays([_signed(p)], ["shingle"])

    return sets.mapInArrow(_over_sets(emit), "shingle bigint")


def _news(sets: DataFrame, percent: int, seen_by: list[tuple[Known, int]], known: Known, further: int, name: str) -> DataFrame:
    """(shingle): what the prefixes take in under ``known`` beside those of the orders ``seen_by``, stored.

    The prefix of a set without known shingles is that by hash, which was seen.
    """
    shared = sets.sparkSession.sparkContext.broadcast((seen_by, known))

    def emit(h, first, d):
        seen_by, known = shared.value
        level = levels(h, known)
        sizes = np.diff(first)
        has = np.add.reduceat(level > 0, first[:-1], dtype=np.int64) > 0
        h, level = h[np.repeat(has, sizes)], level[np.repeat(has, sizes)]
        first = np.concatenate([[0], np.cumsum(sizes[has])])
        if not len(h):
            return

        def of_order(level, further):
            p, of = prefixes(h, first, level, SEEDS[0], percent, further)
            return p, words.mix(p ^ words.mix(of.astype(np.uint64)))  # a shingle of a text as one number

        p, mark = of_order(level, further)
        kept = np.ones(len(p), bool)
        for order, beyond in seen_by:
            kept &= ~np.isin(mark, of_order(levels(h, order), beyond)[1])
        yield pa.RecordBatch.from_arrays([_signed(p[kept])], ["shingle"])

    out = common.stored(sets.mapInArrow(_over_sets(emit), "shingle bigint"), name)
    shared.destroy()
    return out


def first_order(sets: DataFrame, percent: int) -> tuple[Known, DataFrame]:
    """The shingles that go to the end of the first order, and (shingle, weight) of those in several prefixes.

    Shingles in more than ``HEAVY`` prefixes by hash go there, in order of the logarithm of their count;
    then those that are as common among what comes into the prefixes, and some way beyond, in their
    place. Any outcome is a valid order. The weights are of all shingles that were looked at; a set
    that several partitions hold counts in each, which lets groups of one node through.
    """
    nothing: Known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    start = hash_prefixes(sets, percent)
    often = lambda frame: frame.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > HEAVY)
    one = _with_known(nothing, often(start))
    more = _news(sets, percent, [(nothing, 0)], one, FURTHER, "join_second_look")
    two = _with_known(one, often(more).join(_known_rows(sets, one), "shingle", "left_anti"))
    last = _news(sets, percent, [(nothing, 0), (one, FURTHER)], two, 0, "join_last_look")
    looked = start.unionByName(more).unionByName(last)
    groups = looked.groupBy("shingle").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1")
    return two, common.stored(groups, "join_shingles")


def _known_rows(sets: DataFrame, known: Known) -> DataFrame:
    """The known shingles as a table; there are at most ``COMMON``."""
    table = pa.table({"shingle": pa.array(known[0].view(np.int64), pa.int64())})
    return sets.sparkSession.createDataFrame(table)


def prefix_rows(sets: DataFrame, percent: int, shared, filter_) -> DataFrame:
    """(shingle, d, n, rest): of the first order's prefix of each set what the filter lets through, the set's
    size and how many of its shingles come from that one on."""

    def emit(h, first, d):
        p, of = prefixes(h, first, levels(h, shared.value), SEEDS[0], percent)
        rest = np.diff(first)[of] - (np.arange(len(of)) - np.searchsorted(of, of))
        kept = _in_filter(filter_.value, p.view(np.int64))
        p, of = p[kept], of[kept]
        columns = [_signed(p), pa.array(d[of]), pa.array(np.diff(first)[of]), pa.array(rest[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["shingle", "d", "n", "rest"])

    return sets.mapInArrow(_over_sets(emit), "shingle bigint, d bigint, n bigint, rest bigint")


def profile_rows(sets: DataFrame, wanted) -> DataFrame:
    """(d, parts) of each set that the filter lets through, once per partition: the sizes of its parts by hash."""

    def emit(h, first, d):
        owner = np.repeat(np.arange(len(d)), np.diff(first))
        slot = owner * PARTS + (h >> np.uint64(7)).astype(np.int64) % PARTS
        counts = np.bincount(slot, minlength=len(d) * PARTS)
        edges = pa.array(np.arange(len(d) + 1) * PARTS, pa.int32())
        columns = [pa.array(d), pa.ListArray.from_arrays(edges, pa.array(counts, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["d", "parts"])

    return sets.mapInArrow(_over_sets(emit, wanted), "d bigint, parts array<int>")


def order_rows(sets: DataFrame, percent: int, wanted) -> DataFrame:
    """(d, second, third) of each set that the filter lets through, once per partition: its prefixes under
    the further orders as 32 bits of each shingle."""

    def emit(h, first, d):
        columns = [pa.array(d)]
        for seed in SEEDS[1:]:
            p, of = prefixes(h, first, np.zeros(len(h), np.uint64), seed, percent)
            edge = pa.array(np.searchsorted(of, np.arange(len(d) + 1)), pa.int32())
            short = (p >> np.uint64(32)).astype(np.uint32).view(np.int32)
            columns.append(pa.ListArray.from_arrays(edge, pa.array(short)))
        yield pa.RecordBatch.from_arrays(columns, ["d", "second", "third"])

    schema = "d bigint, second array<int>, third array<int>"
    return sets.mapInArrow(_over_sets(emit, wanted), schema)


def close_sizes(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar enough, by their sizes; ``a`` and ``b`` are the columns' endings."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def enough_left(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar enough, if the shingle they meet at is the first they share.

    All they share then comes from it on, so the smaller rest bounds it. A pair that is similar enough
    passes at its first shared shingle, whatever it does at later ones.
    """
    rest = F.least(F.col(f"rest{a}"), F.col(f"rest{b}"))
    return (100 + percent) * rest >= percent * (F.col(f"n{a}") + F.col(f"n{b}"))


def both_sides(pairs: DataFrame, table: DataFrame, column: str, short: str) -> DataFrame:
    """``pairs`` (x, y) with a column of ``table`` (d, column) for either node, as shortx and shorty.

    A node that is in very many pairs is split over partitions. Every node is in ``table``, so both
    sides are counted before anything is joined.
    """
    met = pairs
    for side in "xy":
        counts = common.stored(pairs.groupBy(side).agg(F.count("*").alias("weight")), "join_pair_counts")
        one = table.select(F.col("d").alias(side), F.col(column).alias(f"{short}{side}"))
        met = common.split_join(met, one, side, "weight", counts)
    return met


def may_link(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets can have enough in common, by the sizes of their parts."""
    met = both_sides(pairs, parts, "parts", "p")
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda total, v: total + v)
    most = size(F.zip_with("px", "py", lambda p, q: F.least(p, q)))
    needed = percent * (size(F.col("px")) + size(F.col("py")))
    return met.where((100 + percent) * most >= needed).select("x", "y")


def bit_filter(rows: DataFrame, name: str) -> np.ndarray:
    """A bit for the lower bits of every value: 32 or more for each row, up to a fixed size."""
    bits = max(LEAST_BITS, min(BITS, rows.count().bit_length() + 5))
    slot = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    parts = rows.groupBy(F.shiftright(slot, 15).alias("part")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")
    )
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for row in parts.collect():
        out[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.reshape(-1)


def _in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def set_rows(sets: DataFrame, wanted) -> DataFrame:
    """(d, high, low): the sets that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_filter(wanted.value, batch.column(0).to_numpy())))

    return sets.mapInArrow(run, "d bigint, high binary, low binary")


def share_prefixes(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (x, y) that share a prefix shingle under each of the further orders."""
    both = profiles.select("d", F.struct("second", "third").alias("orders"))
    met = both_sides(pairs, both, "orders", "o")
    shared = [F.arrays_overlap(f"ox.{order}", f"oy.{order}") for order in ("second", "third")]
    return met.where(shared[0] & shared[1]).select("x", "y")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough; a node in very many pairs is split on either side."""
    sets = sets.select("d", F.struct("high", "low").alias("members"))
    both = both_sides(pairs, sets, "members", "m").select("x", "y", "mx.high", "mx.low", "my.high", "my.low")
    both = both.toDF("x", "y", "highx", "lowx", "highy", "lowy")

    def members(high: pa.BinaryScalar, low: pa.BinaryScalar) -> np.ndarray:
        high, low = (np.frombuffer(v.as_buffer(), np.uint8) for v in (high, low))
        return unpacked(high, low, np.array([0, len(high)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (highx, lowx, highy, lowy) in enumerate(zip(*batch.columns[2:])):
                a, b = members(highx, lowx), members(highy, lowy)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                inside = int((b[at] == a).sum())
                keep[i] = 100 * inside >= percent * (len(a) + len(b) - inside)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep))

    return both.mapInArrow(run, "x bigint, y bigint")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every x has one y and no y is an x."""
    ends = edges.select(F.col("x").alias("u"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(
        edges.select("y", F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("u").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return sums.where("child + root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(d, label) for every node of ``edges`` (x, y): the least node it is connected to.

    In turn each node's greater neighbours, then its lesser ones, are linked to its least neighbour,
    until every node hangs on the least of its component; that takes about the logarithm of the
    longest path in rounds. A node with very many neighbours is split over partitions.
    """
    edges = edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    edges = common.stored(edges.distinct(), "join_edges")
    while not _are_stars(edges):
        ways = edges.union(edges.select("y", "x")).toDF("u", "v")
        least = ways.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("weight")
        )
        large = common.split_join(ways, common.stored(least, "join_least"), "u", "weight")
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stored(large.distinct(), "join_large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        least = common.stored(least, "join_least")
        small = common.split_join(large, least, "u", "weight").where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", "m")).distinct()
        edges = common.stored(small.toDF("x", "y"), "join_small_star")
    labels = edges.select(F.col("x").alias("d"), F.col("y").alias("label"))
    return labels.union(labels.select("label", "label").distinct())


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("d"))
    return rows.join(labels, "d", "left").withColumn("label", F.coalesce("label", "d"))


def pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, y) of nodes in one group but in different components that can be similar enough by
    their sizes and places, of ``rows`` (shingle, d, label, n, rest).

    Of two such nodes one at least is not in the largest component of the group; those meet all others,
    so that no two nodes of the largest component ever meet. A pair that shares one of the last
    shingles before has met there, or was ruled out there.
    """
    before = Window.partitionBy("d").orderBy(F.desc("rest")).rowsBetween(-BEFORE, -1)
    counts = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("many"))
    tops = counts.groupBy("shingle").agg(F.max(F.struct("many", "label"))["label"].alias("top"))
    rows = rows.withColumn("before", F.collect_list("shingle").over(before)).join(tops.hint("merge"), "shingle")
    rows = common.stored(rows.withColumn("top", F.col("label") == F.col("top")), "join_last_groups")

    def side(of: DataFrame, end: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}{end}") for c in ("d", "label", "n", "rest", "top", "before")]
        return of.select(F.col("shingle").alias(f"shingle{end}"), *columns).hint("merge")

    here = (F.col("shinglex") == F.col("shingley")) & (F.col("labelx") != F.col("labely"))
    here &= F.col("topy") | (F.col("dx") < F.col("dy"))
    here &= close_sizes("x", "y", percent) & enough_left("x", "y", percent)
    met = side(rows.where(~F.col("top")), "x").join(side(rows, "y"), here & ~F.arrays_overlap("beforex", "beforey"))
    return met.select(F.least("dx", "dy").alias("x"), F.greatest("dx", "dy").alias("y")).distinct()


def pivots_of(rows: DataFrame, turn: int) -> DataFrame:
    """(shingle, weight, many, pivots) of each group of ``rows``: its size and the nodes all are compared to.

    A large group has several, up to ``PIVOTS``: where few of its nodes are similar to any one of them,
    one pivot would leave most of the group to the comparison of all pairs.
    """
    mark = F.struct(F.xxhash64("d", F.lit(turn)).alias("h"), "d", "label", "n", "rest")
    slot = F.pmod(F.xxhash64("d", F.lit(turn)), F.lit(PIVOTS)).alias("slot")
    least = rows.groupBy("shingle", slot).agg(F.count("*").alias("weight"), F.min(mark).alias("p"))
    found = least.groupBy("shingle").agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_list("p")).alias("pivots"))
    many = F.least(F.greatest(F.floor(F.col("weight") / PIVOTS), F.lit(1)), F.lit(PIVOTS)).cast("int")
    return found.withColumn("many", many).withColumn("pivots", F.slice("pivots", F.lit(1), F.col("many")))


def link(groups: DataFrame, check: Callable[[DataFrame], DataFrame], percent: int, rounds: int = ROUNDS) -> DataFrame | None:
    """(d, label) of the nodes that have a link, from ``groups`` (shingle, d, n, rest).

    ``check`` gives the links among some pairs, stored. Each round has a pivot per group, or several of a large one,
    by another hash each time, and compares every node to the pivots that most of its groups have; after ``rounds`` of them,
    at every size of the data, the last one compares all pairs in different components.
    """
    edges = labels = None
    fields = ("d", "label", "n", "rest")
    for turn in range(rounds + 1):
        rows = _labelled(groups, labels)
        per = rows.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b"))
        open_ = common.stored(per.where("a <> b").select("shingle"), "join_open_groups")
        if open_.isEmpty():
            break
        rows = common.stored(rows.join(open_.hint("merge"), "shingle", "left_semi"), "join_groups")
        groups = rows.drop("label")  # a group of one component stays so
        final = turn == rounds
        if final:
            pairs = pairs_across(rows, percent)
        else:
            pivots = common.stored(pivots_of(rows, turn), "join_pivots")
            a = rows.select("shingle", *[F.col(c).alias(f"{c}x") for c in fields])
            met = common.split_join(a, pivots, "shingle", "weight")
            met = met.withColumn("p", F.explode("pivots")).drop("pivots")
            met = met.select("*", *[F.col(f"p.{c}").alias(f"{c}y") for c in fields])
            met = met.where((F.col("labelx") != F.col("labely")) & close_sizes("x", "y", percent))
            pairs = met.groupBy(F.col("dx").alias("x"), F.col("dy").alias("y")).agg(
                F.count("*").alias("m"), F.max(enough_left("x", "y", percent)).alias("can"), F.max("many").alias("many")
            ).where("can")
            # the pivots it shares most with; the last round sees to all others
            best = Window.partitionBy("x").orderBy(F.desc("m"), F.desc("y"))
            pairs = pairs.withColumn("place", F.row_number().over(best)).where("place <= many")
        pairs = common.stored(pairs.select("x", "y"), "join_pairs")
        found = check(pairs)
        edges = found if edges is None else edges.union(found)
        labels = common.stored(components(edges), "join_labels")
        if final:
            break
    return labels


def similar_groups(
    docs: DataFrame,
    n: int = SHINGLE,
    percent: int = PERCENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A text without words, empty or null has no shingles, is linked with nothing and is its own
    component; with fewer than ``n`` words it is one shingle. The component id is the least key
    reachable by links, null where no row of the component has a key. Sets are known by 64-bit
    hashes of their shingles. Repeated rows are equal sets. Other columns are not read.
    """
    with common.small_batches(docs.sparkSession, BATCH):
        return _similar_groups(docs, n, percent, key, text)


def _similar_groups(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(common.named(key).alias("doc_id"), common.named(text).alias("t"))
    described = common.stored(describe(texts, n), "join_texts")
    rows = described.select("doc_id", "d", "n")
    sets = described.where(F.col("high").isNotNull()).select("d", "high", "low")
    known, groups = first_order(sets, percent)
    shared = spark.sparkContext.broadcast(known)
    in_groups = spark.sparkContext.broadcast(bit_filter(groups, "shingle"))
    members = common.split_join(prefix_rows(sets, percent, shared, in_groups), groups, "shingle", "weight")
    once = [F.first(c).alias(c) for c in ("n", "rest")]  # equal in all copies of a set
    members = common.stored(members.groupBy("shingle", "d").agg(*once), "join_members")
    shared.destroy()
    in_groups.destroy()

    def with_nodes(nodes: DataFrame, rows_of: Callable[..., DataFrame], name: str) -> DataFrame:
        """What ``rows_of`` makes of a filter that lets the sets of ``nodes`` through, stored."""
        wanted = spark.sparkContext.broadcast(bit_filter(nodes, "d"))
        out = common.stored(rows_of(wanted), name)
        wanted.destroy()
        return out

    profiles = with_nodes(
        members.select("d"), lambda wanted: profile_rows(sets, wanted).dropDuplicates(["d"]), "join_profiles"
    )

    def check(pairs: DataFrame) -> DataFrame:
        """Sizes of parts first, then the prefixes under the further orders, then the sets; the last two
        are made for the nodes of a pair, shuffled once for both its sides and not stored."""

        def kept(pairs: DataFrame, of: Callable[..., DataFrame], holds: Callable[..., DataFrame], name: str) -> DataFrame:
            nodes = pairs.select(F.col("x").alias("d")).union(pairs.select("y"))
            return with_nodes(nodes, lambda wanted: holds(pairs, of(wanted).dropDuplicates(["d"])), name)

        pairs = common.stored(may_link(pairs, profiles, percent), "join_possible")
        pairs = kept(pairs, lambda wanted: order_rows(sets, percent, wanted), share_prefixes, "join_candidates")
        return kept(
            pairs, lambda wanted: set_rows(sets, wanted), lambda *both: verify(*both, percent), "join_links"
        )

    labels = link(members, check, percent)

    nodes = rows.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("low"), F.count("*").alias("weight"))
    nodes = common.stored(_labelled(nodes, labels), "join_nodes")
    lows = nodes.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("weight"))
    lows = common.stored(lows, "join_components")
    named = common.split_join(nodes.withColumnRenamed("weight", "copies"), lows, "label", "weight")
    named = common.stored(named.select("d", "component_id", F.col("copies").alias("weight")), "join_named")
    placed = common.split_join(rows.where("n > 0").select("doc_id", "d", "n"), named, "d", "weight")
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed.select("doc_id", "n", "component_id").unionByName(empty).withColumnRenamed("n", "n_shingles")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first document of each component by key (null last) and a hash of the text, with all columns.

    Rows equal in key and text are one document and stay together; another text of that key is not
    touched by it.
    """
    id_, content = common.named(key), common.named(text)
    name = F.struct(id_.isNull().alias("none"), id_.alias("key"), F.xxhash64(content).alias("hash"))
    groups = similar_groups(docs.select(name.alias("doc_id"), content.alias("text")), **options)
    gone = groups.where("doc_id <> component_id").select("doc_id.*").distinct()
    left, digest = common.unused(docs, "_gone", "_hash")
    gone = common.stored(gone.select(F.col("key").alias(left), F.col("hash").alias(digest)), "join_gone")
    same = id_.eqNullSafe(F.col(left)) & (F.xxhash64(content) == F.col(digest))
    return docs.join(gone.hint("merge"), same, "left_anti")


def query(spark: SparkSession, directory: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{directory}/documents.parquet"))
