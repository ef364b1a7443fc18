"""Words, shingles and their hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from torquelog.llm import words

TEXTS = [
    "The quick  brown\tfox", "", None, "ünï cödé 漢 字", "A1-b2_c3", "x" * 50, " lead and trail ", "end", "end\x1cx",
    "a b c",
]
CASES = [(words.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


@pytest.mark.parametrize("table, pattern", CASES)
@pytest.mark.parametrize("most", [1, 7, 1 << 21])
def test_words_are_those_of_the_pattern(table, pattern, most):
    got = []
    for _, _, data, at in words.chunks(pa.array(TEXTS), most):
        data = words.LOWER[data]
        starts, ends, first = words.spans(data, at, table)
        found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
        got += [found[a:b] for a, b in zip(first[:-1], first[1:])]
    assert got == [re.findall(pattern, lower(t)) for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_are():
    data = np.frombuffer(b"one two one three two one", np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), words.NOT_SPACE)
    h = words.hashes(data, starts, ends)
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("n", [1, 2, 4])
def test_shingles_stay_within_their_text(n):
    texts = [t or "" for t in TEXTS] + ["a b c d e f a b c d"]
    _, _, data, at = next(words.chunks(pa.array(texts)))
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, at, words.NOT_SPACE)
    h, of = words.shingles(words.hashes(data, starts, ends), first, n)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    runs = [
        {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
        for w in tokens
    ]
    assert [len(set(h[of == i].tolist())) for i in range(len(texts))] == [len(r) for r in runs]
    assert len(set(h.tolist())) == len(set().union(*runs))


def test_a_slice_of_a_column_is_read_from_its_place():
    column = pa.array(["zero", "one two", "three"]).slice(1, 2)
    (_, _, data, at) = next(words.chunks(column))
    assert bytes(data) == b"one twothree" and at.tolist() == [0, 7, 12]


def test_a_task_works_on_half_a_megabyte_of_text_at_once():
    texts = pa.array(["ab " * 60_000] * 9)  # 1.6 MB
    runs = list(words.chunks(texts))
    assert max(len(data) for _, _, data, _ in runs) <= 1 << 19
    assert sum(len(data) for _, _, data, _ in runs) == 9 * 180_000
    assert [end for _, end, _, _ in runs][-1] == 9
