"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the number of pieces of each length decides a packing, so it is planned on that histogram (at
most one row per possible length) and then carried out by joining each piece's number among those of
its length to the plan. Pieces above a third of the capacity go first: at most two of them share a
sequence, by greedy matching from the longest down. Shorter ones fill the tightest gap left.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelog.llm import common

CAPACITY = 2048
END = 0  # the id put after every document
TOKENIZER = "byte_bpe_50k.json"

_encodings: dict[str, object] = {}


def _byte_of_character() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoding(path: str | None = None):
    """The byte-level BPE tokenizer of a vocabulary file, once per process.

    Reads the vocabulary and its special tokens from the file; ids equal those that the tokenizers
    library gives with ``add_special_tokens=False`` (special tokens written in a text get their id).
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _encodings:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of_character()
        ranks = {
            bytes(byte[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in special
        }
        _encodings[path] = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _encodings[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; all are full but the first."""
    first = n if n <= capacity else n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every row.

    A null text is an empty one, whose only token is the end id. Equal rows give equal pieces.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_to_numpy
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

        def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [id_type, *types[1 : len(names)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names
            )

        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(value.as_py(), allowed_special="all"), END).astype("<u4")
                for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc, number, start, length, zlib.crc32(part.tobytes()))
                    rows.append(row + ((part.astype(np.int32),) if with_ids else ()))
            yield batch_of(rows, batch.schema.field(0).type)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return source.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, pieces, per sequence, first sequence, offset).

    The pieces number first, first + 1, ... of a length go ``per sequence`` each into successive
    sequences. Every step uses up a length or a group of equal sequences, so there are at most a few
    runs per length, however many pieces there are.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    gaps: list[int] = []  # sorted; groups: the sequences that have exactly this gap
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, many: int, per: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], many, per, sequence, offset))
        used[length] += many
        left[length] -= many

    def free(gap: int, sequence: int, many: int) -> None:
        if gap and many:
            if gap not in groups:
                bisect.insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((sequence, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        if not left[longest]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - longest) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == longest and left[longest] < 2)):
            at -= 1
        if at < 0:
            many, room = left[longest], capacity - longest
            put(longest, many, 1, sequences, 0)
        elif large[at] == longest:
            many, room = left[longest] // 2, capacity - 2 * longest
            put(longest, 2 * many, 2, sequences, 0)
        else:
            partner = large[at]
            many, room = min(left[longest], left[partner]), capacity - longest - partner
            put(longest, many, 1, sequences, 0)
            put(partner, many, 1, sequences, longest)
        free(room, sequences, many)
        sequences += many

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            else:
                gap, first = capacity, sequences
                many = -(-left[length] // (capacity // length))
                sequences += many
            per = gap // length
            full = min(many, left[length] // per)
            if full:
                put(length, full * per, per, first, capacity - gap)
                free(gap - per * length, first, full)
            if full < many:
                rest = left[length]
                if rest:
                    put(length, rest, rest, first + full, capacity - gap)
                    free(gap - rest * length, first + full, 1)
                    full += 1
                free(gap, first + full, many - full)
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows with a ``length``) with ``sequence_id`` and ``offset``.

    Sequences are gapless from 0 and as few as the plan finds; a table without rows stays empty. The
    histogram and the plan have a bounded number of rows, as lengths are at most ``capacity``.
    """
    rows = common.numbered(found, ["length"], "_number", "pieces")
    rows = common.stored(rows, "pieces_numbered")
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    runs = sorted(plan({r["length"]: r["n"] for r in histogram}, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = found.sparkSession.sparkContext.broadcast(table)
    length_at, number_at = rows.columns.index("length"), rows.columns.index("_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = shared.value
        starts = (plan_[:, 0] << 45) | plan_[:, 1]
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False)
            number = batch.column(number_at).to_numpy(zero_copy_only=False)
            row = plan_[np.searchsorted(starts, (length << 45) | number, "right") - 1]
            along = number - row[:, 1]
            sequence = row[:, 4] + along // row[:, 3]
            offset = row[:, 5] + along % row[:, 3] * length
            kept = [i for i in range(batch.num_columns) if i != number_at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(sequence), pa.array(offset)],
                [batch.schema.names[i] for i in kept] + ["sequence_id", "offset"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, capacity, **options), capacity)


def query(spark: SparkSession, directory: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{directory}/documents.parquet"))
