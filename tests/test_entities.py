"""Dictionary terms against a plain search, for blocks of any size."""

import random

import pytest

from torquelog.operators import association, entities

SCHEMA = "id long, tokens array<string>, places string"


def plain(tokens, entries, longest):
    found = []
    for at in range(len(tokens or [])):
        for entity, kind in {e for e in entries if e[0]}:
            n = len(entity.split(" "))
            if tokens[at : at + n] == entity.split(" "):
                found.append((at, n, kind))
    if not longest:
        return set(found)
    out, free = set(), 0
    for at in range(len(tokens or [])):
        n = max((f[1] for f in found if f[0] == at), default=0)
        if at >= free and n:
            out |= {f for f in found if f[:2] == (at, n)}
            free = at + n
    return out


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice("abcde")
    entries = [(" ".join(word() for _ in range(rng.randrange(1, 5))), rng.choice(["x", "y", None])) for _ in range(60)]
    entries += [("", "x"), (None, "x"), ("a", "x"), ("a", "y"), ("ünï 漢", "z"), ("a b c d e a b c d e", "long")]
    lists = [[word() for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    lists += [None, [], [None, "a", None], ["zz"], ["ünï", "漢", "ünï"], list("abcde") * 2000, list("abcde")]
    return entries, lists


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("words,held", [(100_000, 8), (20, 2), (20, 8)])
def test_terms(spark, monkeypatch, longest, words, held):
    monkeypatch.setattr(entities, "HELD", held)
    entries, lists = cases()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(lists)], SCHEMA).repartition(3)
    table = spark.createDataFrame(entries, "entity string, kind string")
    got = entities.find_terms(docs, "tokens", table, longest, "found", words)
    assert got.columns == ["id", "tokens", "places", "found"]
    rows = got.collect()
    assert len(rows) == len(lists)
    for r in rows:
        assert [tuple(p) for p in r["found"]] == sorted(
            plain(lists[r["id"]], entries, longest), key=lambda p: (p[0], p[1], p[2] is None, p[2] or "")
        )


def test_empty_tables(spark):
    table = spark.createDataFrame([("a", "x")], "entity string, kind string")
    docs = spark.createDataFrame([(1, ["a", "b", "a"], "x")], SCHEMA)
    assert entities.find_terms(docs.limit(0), "tokens", table).count() == 0
    assert entities.find_terms(docs, "tokens", table.limit(0), places="found").first()["found"] == []
    assert association.gazetteer(docs, "id", "tokens", table.limit(0), (1,)).count() == 0
    assert [tuple(r) for r in association.gazetteer(docs, "id", "tokens", table, (1, 2)).collect()] == [(1, "a", "x", 2)]


def test_nothing_but_the_counts_is_shuffled(spark):
    table = spark.createDataFrame([("a b", "x")], "entity string, kind string")
    docs = spark.createDataFrame([(1, ["a", "b", "a"], "x")], SCHEMA)
    plan = association.gazetteer(docs, "id", "tokens", table, (1, 2))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("Exchange") == 1 and "Join" not in physical
