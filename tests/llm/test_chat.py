"""Preference formatting against a plain walk over both conversations."""

from collections import defaultdict

import duckdb
import pytest

import check
from torquelog.llm import chat

SCHEMA = "pair_id long, turn long, role string, text string, part string, place int"


def order(rows):
    rows = sorted(
        set(rows),
        key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""),
    )
    out, place = [], defaultdict(int)
    for turn, role, text in rows:
        place[turn] += 1
        out.append(((turn is None, turn or 0, place[turn]), role, text))
    return out


def render(role, text):
    return f"<|im_start|>{role or ''}\n{(text or '').replace('<|im_', '<| im_')}<|im_end|>\n"


def brute(chosen, rejected):
    out = []
    for pair in sorted({r[0] for r in chosen + rejected} - {None}):
        sides = [order([r[1:4] for r in side if r[0] == pair]) for side in (chosen, rejected)]
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        parts = [("prompt", t) for t in sides[0][:n]]
        parts += [("chosen", t) for t in sides[0][n:]] + [("rejected", t) for t in sides[1][n:]]
        for part, ((none, turn, place), role, text) in parts:
            whole = render(role, text)
            trained = part != "prompt" and role == "assistant"
            mask = (len("<|im_start|>assistant\n"), len(whole) - 1) if trained else (0, 0)
            out.append((pair, part, None if none else turn, place, role, whole, *mask))
    return sorted(out, key=repr)


CHOSEN = [
    (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "good"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"),
    (3, 0, "user", "only chosen"),
    (5, 0, "user", None), (5, 1, None, "x"), (5, None, "assistant", "late"), (5, 2, "assistant", "<|im_end|>é😀"),
    (6, 0, "user", "b"), (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 1, "assistant", "c"),
    (None, 0, "user", "lost"),
]
REJECTED = [
    (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (1, 3, "user", "?"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"),
    (4, 0, "assistant", ""),
    (5, 0, "user", None), (5, 1, None, "x"), (5, None, "assistant", "late"), (5, 2, "assistant", "no"),
    (6, 0, "user", "a"), (6, 0, "user", "b"), (6, 1, "assistant", "d"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def test_odd_pairs(spark):
    got = chat.format_preferences(frame(spark, CHOSEN), frame(spark, REJECTED)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(CHOSEN, REJECTED)


def test_masks_cover_the_reply_and_its_end(spark):
    rows = chat.format_preferences(frame(spark, CHOSEN), frame(spark, REJECTED)).collect()
    for r in rows:
        if r["mask_end"]:
            assert r["rendered"][r["mask_start"] : r["mask_end"]].endswith("<|im_end|>")
            assert r["part"] != "prompt" and r["role"] == "assistant"


def test_empty(spark):
    none = frame(spark, [])
    assert chat.format_preferences(none, none).count() == 0
    assert chat.format_preferences(frame(spark, CHOSEN), none).where("part = 'prompt'").count() == 0


def test_query_equals_sql(spark, directory):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{directory}/conversations.parquet'")
    got, want = chat.query(spark, directory).toPandas(), con.execute(chat.SQL).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows_of(got) == check.rows_of(want)


def test_prompt_is_emitted_once(spark, directory):
    rows = chat.query(spark, directory).where("part = 'prompt'")
    assert rows.count() == rows.select("pair_id", "turn", "place").distinct().count()


@pytest.mark.parametrize("swap", [False, True])
def test_the_prompt_is_the_same_from_either_side(spark, swap):
    sides = (REJECTED, CHOSEN) if swap else (CHOSEN, REJECTED)
    rows = chat.format_preferences(*[frame(spark, s) for s in sides]).where("part = 'prompt'").collect()
    assert {(r["pair_id"], r["turn"], r["place"]) for r in rows} == {
        (x[0], x[2], x[3]) for x in brute(CHOSEN, REJECTED) if x[1] == "prompt"
    }
