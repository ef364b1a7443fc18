"""Dictionary terms in token lists, by one multi-pattern automaton per bounded block of the dictionary.

A term is a sequence of words. A task builds the automaton of a block over word numbers and runs every
token list through it once, however many terms the block has. Rows stay where they are: nothing but
the terms found leaves a row, and the text is read once per block. After ``HELD`` blocks the rows are
stored and the blocks let go, so the memory of a task does not grow with the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelog.runtime import materialize

BLOCK_WORDS = 100_000  # words of the terms in a block
HELD = 8  # blocks that the tasks hold at a time
PLACE = "array<struct<at:int,n:int,kind:string>>"


def blocks(entries: DataFrame, most: int) -> Iterator[list[tuple[str, list[str | None]]]]:
    """(term, kinds) in blocks of about ``most`` words; null and empty terms are left out."""
    terms = entries.where("entity <> ''").groupBy("entity").agg(
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.max(F.col("kind").isNull()).alias("bare"),
    )
    terms = materialize(terms.withColumn("words", F.size(F.split("entity", " "))))
    total = terms.agg(F.sum("words")).first()[0] or 0
    n = max(1, -(-total // most))
    for b in range(n):
        block = terms if n == 1 else terms.where(F.pmod(F.xxhash64("entity"), F.lit(n)) == b)
        yield [(r["entity"], [*r["kinds"], *([None] if r["bare"] else [])]) for r in block.collect()]


def _automaton(terms: list[tuple[str, list[str | None]]]):
    """The number of each word (from 1) and the automaton over them.

    Its values are the number of words and the kinds, each as (none, kind), which can be put in order.
    """
    numbers: dict[str, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for term, kinds in terms:
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in term.split(" "))
        machine.add_word(key, (len(key), [(k is None, k or "") for k in kinds]))
    machine.make_automaton()
    return numbers, machine


def _numbered(column: pa.ListArray, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all token lists, 0 for other words and nulls, and where each list ends."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = column.flatten().dictionary_encode()
    known = np.array([numbers.get(w, 0) for w in words.dictionary.to_pylist()] + [0], np.int64)
    at = words.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
    return known[at], np.cumsum(sizes)


def leftmost_longest(places: list[tuple]) -> list[tuple]:
    """Of the sorted (at, n, ...) those that a reader takes who always takes the longest term, then goes on."""
    kept: list[tuple] = []
    longest = {at: n for at, n, *_ in places}  # the last one of a place
    free, taken = 0, -1
    for place in places:
        at, n = place[:2]
        if n == longest[at] and (at >= free or at == taken):
            kept.append(place)
            free, taken = at + n, at
    return kept


def _column(rows: list[list[tuple]]) -> pa.ListArray:
    """The places of all rows as one column."""
    ends = np.cumsum([0, *map(len, rows)])
    at, n, bare, kind = zip(*chain.from_iterable(rows)) if ends[-1] else ((),) * 4
    kinds = pa.array(kind, pa.string(), mask=np.array(bare, bool))
    fields = [pa.array(at, pa.int32()), pa.array(n, pa.int32()), kinds]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["at", "n", "kind"]))


def _searcher(shared, column: int, again: bool, resolve: bool):
    """A function over Arrow batches that adds the terms of a block to the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, machine = _automaton(shared.value)
        for batch in batches:
            flat, ends = _numbered(batch.column(column), numbers)
            old = batch.column(batch.num_columns - 1).to_pylist() if again else None
            out, start = [], 0
            for row, end in enumerate(ends.tolist()):
                found = [(p["at"], p["n"], p["kind"] is None, p["kind"] or "") for p in old[row]] if again else []
                part = flat[start:end]
                start = end
                if numbers and part.any():
                    for last, (n, kinds) in machine.iter(tuple(part.tolist())):
                        found += [(last - n + 1, n, *k) for k in kinds]
                found.sort()
                out.append(leftmost_longest(found) if resolve else found)
            kept = batch.columns[: batch.num_columns - again]
            names = [f"c{i}" for i in range(len(kept))] + ["places"]
            yield pa.RecordBatch.from_arrays([*kept, _column(out)], names)

    return run


def find_terms(
    df: DataFrame,
    tokens: str,
    entries: DataFrame,
    longest: bool = False,
    places: str = "places",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``df`` with the ``places`` (at, n, kind) of the terms of ``entries`` (entity, kind) in ``tokens``.

    A term's words are separated by single spaces. All terms are found, also inside each other; with
    ``longest`` the leftmost, then longest ones that do not overlap. A term of several kinds is there
    once per kind. A null list has no terms; null words match nothing; an empty dictionary finds nothing.
    """
    context = df.sparkSession.sparkContext
    column = df.columns.index(tokens)
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType(out.schema.fields + T.StructType.fromDDL(f"places {PLACE}").fields)
    waiting = blocks(entries, block_words)
    block, again, held = next(waiting), False, []
    while block is not None:
        following = next(waiting, None)
        if len(held) == HELD:
            out = materialize(out)
            while held:
                held.pop().destroy()
        held.append(context.broadcast(block))
        search = _searcher(held[-1], column, again, longest and following is None)
        out = out.mapInArrow(search, schema)
        block, again = following, True
    return out.toDF(*df.columns, places)


def mentions(found: DataFrame, key: str, tokens: str, places: str = "places") -> DataFrame:
    """(key, entity, kind, mentions) from the rows of ``find_terms``, counted before any shuffle."""
    rows = found.select(F.col(key), F.col(tokens).alias("t"), F.explode(places).alias("p"))
    entity = F.array_join(F.slice("t", F.col("p.at") + 1, F.col("p.n")), " ").alias("entity")
    return rows.groupBy(F.col(key), entity, F.col("p.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("mentions")
    )
