"""Benchmark decontamination by sorted suffixes of the training texts.

Each shard (the texts a task holds at a time) gets a suffix array: the places in its texts, sorted
by the words that follow. Every suffix of the benchmark is looked up in it by binary search, which
gives all places of its first window and, between neighbours, the longest verbatim match. Texts are
worked on where they are read; nothing is shuffled.

Places whose first two words never follow each other in the benchmark cannot start a match of two
words; they are left out of the array before it is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelog.llm import common, words

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text in a broadcast
HELD = 8  # broadcasts that the tasks hold at a time
_BITS = 31  # bits of a word number in a sort key; two words to a key


@dataclass
class Suffixes:
    """The benchmark suffixes of one block, with word numbers in place of words.

    ``table`` has a row for each distinct suffix start and ``depth`` columns of word numbers (0: past
    the end). Windows shorter than ``window`` are whole items; ``needs`` is the length to match.
    ``order`` are all places of ``flat``, sorted by the words up to the end of their item; ``at`` is
    the range of it that starts with each window, ``ends`` and ``owner`` are the end and the item (in
    the sorted ``names``) of each place.
    """

    vocabulary: np.ndarray
    firsts: np.ndarray
    pairs: np.ndarray
    table: np.ndarray
    needs: np.ndarray
    items: list[list[str]]
    flat: np.ndarray
    at: np.ndarray
    order: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    names: list[str]


def sorted_places(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places, sorted by the words from there to the end of the item (by doubling)."""
    places, longest = np.arange(len(ends)), int((ends - np.arange(len(ends))).max())
    rank, k = flat[: len(ends)].copy(), 1
    order = np.argsort(rank, kind="stable")
    while k < longest:
        ahead = np.where(places + k < ends, rank[np.minimum(places + k, len(ends) - 1)], 0)
        order = np.lexsort((ahead, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0)
        rank = np.empty(len(ends), np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(new)])
        if new.all():
            break
        k *= 2
    return order


def index_items(items: list[tuple[str, str]], window: int = WINDOW) -> Suffixes | None:
    """Number the words of the items and list their distinct windows; None without words."""
    found = [(i, words.hash_of(t)) for i, t in items]
    found = [(i, h) for i, h in found if len(h)]
    if not found:
        return None
    vocabulary = np.unique(np.concatenate([h for _, h in found]))
    numbers = [(i, np.searchsorted(vocabulary, h).astype(np.int64) + 1) for i, h in found]
    owners: dict[bytes, set[str]] = {}
    place: dict[bytes, int] = {}
    flat = np.concatenate([n for _, n in numbers] + [np.zeros(window, np.int64)])
    names = sorted({i for i, _ in numbers})
    number_of = {i: k for k, i in enumerate(names)}
    owner = np.repeat([number_of[i] for i, _ in numbers], [len(n) for _, n in numbers])
    start = 0
    for item, n in numbers:
        long = min(window, len(n))
        for p in range(len(n) - long + 1):
            key = n[p : p + long].tobytes()
            owners.setdefault(key, set()).add(item)
            if key not in place:
                place[key] = start + p
        start += len(n)
    # ends of items, so that the longest match never runs from one item into the next
    end_of = np.repeat(
        np.cumsum([len(n) for _, n in numbers]), [len(n) for _, n in numbers]
    )
    keys = sorted(owners)
    needs = np.array([len(k) // 8 for k in keys])
    table = np.zeros((len(keys), window), np.int64)
    for r, k in enumerate(keys):
        table[r, : needs[r]] = np.frombuffer(k, np.int64)
    order = sorted_places(flat, end_of)
    differs = np.zeros(len(order), bool)  # from the place before it, within a window
    for d in range(window):
        word = np.where(order + d < end_of[order], flat[order + d], 0)
        differs[1:] |= word[1:] != word[:-1]
    heads = np.flatnonzero(differs | (np.arange(len(order)) == 0))
    found_at = np.empty(len(order), np.int64)
    found_at[order] = np.arange(len(order))
    group = np.searchsorted(heads, found_at[[place[k] for k in keys]], "right") - 1
    at = np.stack([heads[group], np.append(heads[1:], len(order))[group]], axis=1)
    two = needs > 1
    return Suffixes(
        vocabulary,
        np.unique(table[~two, 0]),
        np.unique((table[two, 0] << _BITS) | table[two, 1]),
        table,
        needs,
        [sorted(owners[k]) for k in keys],
        flat,
        at,
        order,
        end_of,
        owner,
        names,
    )


def _keys(columns: np.ndarray) -> list[np.ndarray]:
    """Two word numbers to a sort key."""
    out = []
    for i in range(0, columns.shape[1], 2):
        key = np.zeros(len(columns), np.int64)
        for j in range(i, i + 2):
            key <<= _BITS
            if j < columns.shape[1]:
                key |= columns[:, j]
        out.append(key)
    return out


def suffix_array(numbers: np.ndarray, end: np.ndarray, index: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places that can start a match, sorted by their next words, and those words."""
    depth = index.table.shape[1]
    following = np.append(numbers[1:], 0)
    following[end == np.arange(len(numbers)) + 1] = 0
    known = np.isin((numbers << _BITS) | following, index.pairs) & (following > 0)
    if len(index.firsts):
        known |= np.isin(numbers, index.firsts)
    places = np.flatnonzero(known & (numbers > 0))
    padded = np.concatenate([numbers, np.zeros(depth, numbers.dtype)])
    steps = places[:, None] + np.arange(depth)
    columns = np.where(steps < end[places][:, None], padded[steps], 0)
    order = np.lexsort(_keys(columns)[::-1])
    return places[order], columns[order]


def search(columns: np.ndarray, index: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For every benchmark suffix the range of the suffix array that starts with its window."""
    n, m = len(columns), len(index.table)
    ranges = []
    for upper in (False, True):
        low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            row = columns[np.minimum(middle, n - 1)]
            less = np.zeros(m, bool)
            same = np.ones(m, bool)
            for d in range(columns.shape[1]):
                in_window = d < index.needs
                less |= same & in_window & (row[:, d] < index.table[:, d])
                same &= ~in_window | (row[:, d] == index.table[:, d])
            right = less | (same if upper else False)
            low = np.where(open_ & right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        ranges.append(low)
    return ranges[0], ranges[1]


def extend(
    p: np.ndarray, which: np.ndarray, numbers: np.ndarray, end: np.ndarray, index: Suffixes
) -> tuple[np.ndarray, np.ndarray]:
    """The longest match at each place ``p`` with window ``which``: its words and its range of ``order``.

    Word by word, each range is cut to the places that go on like the text, until none does.
    """
    length, span = index.needs[which].copy(), index.at[which].copy()

    def next_word(at: np.ndarray, deep: np.ndarray) -> np.ndarray:
        place = index.order[np.minimum(at, len(index.order) - 1)]
        return np.where(place + deep < index.ends[place], index.flat[np.minimum(place + deep, len(index.flat) - 1)], 0)

    live = np.arange(len(p))
    while len(live):
        live = live[p[live] + length[live] < end[p[live]]]
        deep, want = length[live], numbers[p[live] + length[live]]
        live, deep, want = live[want > 0], deep[want > 0], want[want > 0]
        bounds = []
        for last in (want - 1, want):  # the first place beyond each of them
            low, high = span[live, 0], span[live, 1]
            while (open_ := low < high).any():
                middle = (low + high) // 2
                right = next_word(middle, deep) <= last
                low = np.where(open_ & right, middle + 1, low)
                high = np.where(open_ & ~right, middle, high)
            bounds.append(low)
        on = bounds[0] < bounds[1]
        live = live[on]
        span[live] = np.stack(bounds, axis=1)[on]
        length[live] += 1
    return length, span


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals."""
    out: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _shard(data: np.ndarray, at: np.ndarray, index: Suffixes | None):
    """For each text of a shard: number of words, hit runs, items, and the longest match."""
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, at, words.ALNUM)
    counts = np.diff(first)
    found: dict[int, tuple] = {}
    if index is None or not len(starts):
        return counts, found
    h = words.hashes(data, starts, ends)
    at_ = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    numbers = np.where(index.vocabulary[at_] == h, at_ + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    end = first[1:][owner]
    places, columns = suffix_array(numbers, end, index)
    if not len(places):
        return counts, found
    low, high = search(columns, index)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return counts, found
    sizes = high[hit] - low[hit]
    which = np.repeat(hit, sizes)
    offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    p = places[np.repeat(low[hit], sizes) + offsets]
    length, span = extend(p, which, numbers, end, index)
    order = np.argsort(owner[p], kind="stable")
    cut = np.flatnonzero(np.diff(owner[p][order])) + 1
    for part in np.split(order, cut):
        t = int(owner[p[part[0]]])
        begin = p[part] - first[t]
        best = part[np.lexsort((p[part], -length[part]))[0]]
        items = {i for w in np.unique(which[part]) for i in index.items[w]}
        found[t] = (
            _merged(begin, begin + index.needs[which[part]]),
            items,
            (
                int(length[best]),
                int(p[best] - first[t]),
                index.items[which[best]][0]  # below a window only whole items count
                if index.needs[which[best]] < index.table.shape[1]
                else index.names[int(index.owner[index.order[slice(*span[best])]].min())],
            ),
        )
    return counts, found


def _searcher(index, text: int, extra: list[str]):
    """A function over Arrow batches that adds what the block of the benchmark finds."""
    types = {
        "_n": pa.int64(),
        "_runs": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
        "_items": pa.list_(pa.string()),
        "_longest": pa.struct([("words", pa.int32()), ("place", pa.int32()), ("item", pa.string())]),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            for row, end, data, at in words.chunks(batch.column(text)):
                counts, found = _shard(data, at, block)
                piece = batch.slice(row, end - row)
                old = {c: piece.column(piece.schema.get_field_index(c)).to_pylist() for c in extra}
                out: dict[str, list] = {c: [] for c in types}
                for t in range(end - row):
                    runs, items, best = found.get(t, ([], set(), None))
                    before = old["_runs"][t] if extra else []
                    if before:
                        runs = _merged(
                            np.array([r["start"] for r in before] + [s for s, _ in runs]),
                            np.array([r["end"] for r in before] + [e for _, e in runs]),
                        )
                    other = old["_longest"][t] if extra else None
                    best = dict(zip(("words", "place", "item"), best)) if best else None
                    if other and best:  # the longest, then the first place, then the first item
                        best = min(other, best, key=lambda m: (-m["words"], m["place"], m["item"]))
                    best = best or other
                    out["_n"].append(int(counts[t]))
                    out["_runs"].append([{"start": s, "end": e} for s, e in runs])
                    out["_items"].append(sorted({*items, *(old["_items"][t] if extra else [])}))
                    out["_longest"].append(best)
                kept = [i for i, n in enumerate(piece.schema.names) if n not in extra]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(i) for i in kept] + [pa.array(out[c], t) for c, t in types.items()],
                    [piece.schema.names[i] for i in kept] + list(types),
                )

    return run


FOUND = {
    "_n": "bigint",
    "_runs": "array<struct<start:int,end:int>>",
    "_items": "array<string>",
    "_longest": "struct<words:int,place:int,item:string>",
}


def blocks(tests: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about ``most`` bytes; rows without text are left out."""
    rows = tests.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    rows = rows.where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    for b in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r["i"] or "", r["t"]) for r in block.collect()]


def find_matches(
    docs: DataFrame,
    tests: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``_n`` words, hit ``_runs`` of words, ``_items`` and the ``_longest`` match.

    Words are runs of ASCII letters and digits and of all other characters above U+007F, after A-Z
    is made lower case. A window is ``window`` consecutive words of an item; an item of fewer words
    is one window. Each block of the benchmark has a bounded size and is one pass over rows already
    in memory; after ``HELD`` blocks the rows are stored and the blocks let go, so what the tasks hold
    does not grow with the benchmark. Null and empty texts have no words; a null item id counts as the empty one; repeated
    items count once per id; an empty benchmark finds nothing. All columns of ``docs`` are kept; where
    it has one of the new names, the new column's ends in one underscore more.
    """
    context = docs.sparkSession.sparkContext
    out = common.by_place(docs)
    added = T.StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in FOUND.items()))
    schema = T.StructType(out.schema.fields + added.fields)
    place = docs.columns.index(text)
    extra: list[str] = []
    held: list = []
    for block in blocks(tests, item, item_text, block_bytes):
        if len(held) == HELD:
            out = common.stored(out, "searched")
            while held:
                held.pop().destroy()
        held.append(context.broadcast(index_items(block, window)))
        out = out.mapInArrow(_searcher(held[-1], place, extra), schema)
        extra = list(FOUND)
    return out.toDF(*docs.columns, *common.unused(docs, *FOUND))


def report(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, longest) for every document."""
    found = find_matches(docs.select(common.named(key).alias("doc_id"), common.named(text).alias("text")), tests)
    hit = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return found.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"),
        (F.size("_runs") > 0).alias("contaminated"),
        F.col("_longest.words").alias("longest_words"),
        F.col("_longest.place").alias("longest_place"),
        F.col("_longest.item").alias("longest_item"),
    )


def decontaminate(docs: DataFrame, tests: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    found = find_matches(docs, tests, text=text, **options)
    runs = found.columns[len(docs.columns) + list(FOUND).index("_runs")]
    return found.where(F.size(runs) == 0).select(*[common.named(c) for c in docs.columns])


def query(spark: SparkSession, directory: str) -> DataFrame:
    return report(
        spark.read.parquet(f"{directory}/documents.parquet"),
        spark.read.parquet(f"{directory}/benchmark.parquet"),
    )
