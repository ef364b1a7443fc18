"""Words of many texts at once, in numpy, on the bytes of an Arrow string column.

A text is cut at single bytes only, and no byte of a multi-byte UTF-8 character is below 0x80, so
classes of ASCII bytes cut texts exactly as classes of characters do. Words are known by 64-bit
hashes: a polynomial in the bytes, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes worked on at once; a longer text is worked on alone
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lower_table() -> np.ndarray:
    """Bytes with A-Z made a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: Bytes of words cut at white space: all but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of letters and digits after lower-casing: 0-9, a-z, all above 0x7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes."""
    raw, at = text_bytes(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = int(np.searchsorted(at, at[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    size = max([size, *(k for k in _powers if size < k <= CHUNK)])  # one table of a usual size, the largest needed so far
    if size not in _powers:
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, _BACK):
                steps = np.full(size + 1, base, np.uint64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        for old in [k for k in _powers if k > CHUNK or size <= CHUNK]:  # keep no table of an unusual size
            del _powers[old]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def spans(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    inside = word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cut = at[at < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word; with more than one array of ends, a row for each of them."""
    powers, back = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        begin, shift = sums[starts], back[starts]
        rows = [mix((sums[e] - begin) * shift) for e in ends]
    return rows[0] if len(rows) == 1 else np.stack(rows)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the text each is of; a shorter text is one run."""
    texts = len(first) - 1
    sizes = np.diff(first)
    with np.errstate(over="ignore"):
        k = np.uint64(0xD6E8FEB86659FD93)
        total = len(words) - n + 1
        if total > 0:
            h = np.zeros(total, np.uint64)
            for i in range(n):
                h = h * k + words[i : i + total]
            owner = np.repeat(np.arange(texts), sizes)
            whole = owner[:total] == owner[n - 1 :]
            h, of = h[whole], owner[:total][whole]
        else:
            h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j, t in enumerate(short):
                for w in words[first[t] : first[t + 1]]:
                    extra[j] = extra[j] * k + w
                extra[j] += np.uint64(sizes[t])
            h, of = np.concatenate([h, extra]), np.concatenate([of, short])
        return mix(h), of


def hash_of(text: str, word: np.ndarray = ALNUM) -> np.ndarray:
    """The word hashes of one text."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = spans(data, np.array([0, len(data)]), word)
    return hashes(data, starts, ends)
