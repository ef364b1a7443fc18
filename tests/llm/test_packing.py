"""Packing: tokens of the tokenizers library, cuts, places and the number of sequences."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from torquelog.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def expected_pieces(text, capacity):
    ids = token_ids(text)
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity
    edges = ([0] if first else []) + list(range(first, len(ids), capacity)) + [len(ids)]
    return [
        (i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_odd_rows(odd, capacity):
    rows = packing.pack_documents(odd, capacity).collect()
    want = Counter()
    for d in odd.select("doc_id", "text").collect():
        want.update((d["doc_id"], *p) for p in expected_pieces(d["text"], capacity))
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = check_places(rows, capacity)
    total = sum(r["length"] for r in rows)
    assert sequences <= math.ceil(total / capacity) * 1.05 + 1


def test_query(spark, directory):
    rows = packing.query(spark, directory).collect()
    sequences = check_places(rows, packing.CAPACITY)
    assert sequences <= math.ceil(sum(r["length"] for r in rows) / packing.CAPACITY) + 1
    docs = spark.read.parquet(f"{directory}/documents.parquet").collect()
    want = {(d["doc_id"], *p) for d in docs for p in expected_pieces(d["text"], packing.CAPACITY)}
    assert {tuple(r)[:5] for r in rows} == want


def test_ids_of_the_pieces(odd):
    rows = packing.pieces(odd.where("doc_id = 7"), with_ids=True).orderBy("piece").collect()
    text = odd.where("doc_id = 7").first()["text"]
    assert [i for r in rows for i in r["ids"]] == token_ids(text)


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


ALPHABET = list("ab cé\n\t\r\x0b\x1c\x85 　​ 's123٣²½漢字😀ßİ-_.!?") + ["<|endoftext|>", "'ll", "  "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20))
def test_ids_equal_those_of_the_tokenizers_library(parts):
    text = "".join(parts)
    assert packing.encoding().encode(text, allowed_special="all") == token_ids(text)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 64))
def test_plan_places_every_piece_once(lengths, capacity):
    counts = Counter(lengths)
    used, room = Counter(), defaultdict(list)
    for length, first, many, per, sequence, offset in packing.plan(counts, capacity):
        assert first == used[length]
        used[length] += many
        for i in range(many):
            room[sequence + i // per].append((offset + i % per * length, length))
    assert used == counts
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(room) == list(range(len(room)))
    assert len(room) <= 11 / 9 * math.ceil(sum(lengths) / capacity) + 2


def test_two_large_pieces_at_most_share_a_sequence_and_pair_greedily():
    runs = packing.plan({60: 2, 50: 1, 45: 1, 40: 1, 34: 1}, 100)
    together = defaultdict(list)
    for length, _, many, per, sequence, _ in runs:
        for i in range(many):
            together[sequence + i // per].append(length)
    assert sorted(map(sorted, together.values())) == [[34, 60], [40, 60], [45, 50]]


def test_plan_is_small_and_close_to_full():
    rng = random.Random(3)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(200_000))
    runs = packing.plan(counts)
    sequences = max(r[4] + -(-r[2] // r[3]) for r in runs)
    assert len(runs) < 4 * 2048
    assert sequences <= math.ceil(sum(k * v for k, v in counts.items()) / 2048) + 2


def test_bad_length():
    with pytest.raises(ValueError):
        packing.plan({2049: 1})
