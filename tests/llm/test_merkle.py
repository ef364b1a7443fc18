"""The Merkle manifest against a plain tree, its proofs, and odd rows."""

import hashlib
import zlib

import duckdb
import pytest

import check
from torquelog.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    values = [None if row[c] is None else str(row[c]) for c in COLUMNS]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """The levels of a tree, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def fold(tree, i, node):
    """The digests of the siblings and the root with ``node`` in place ``i``."""
    proof = ""
    for level in tree[:-1]:
        run = i // 8 * 8
        before, after = "".join(level[run:i]), "".join(level[i + 1 : run + 8])
        proof, node, i = proof + before + after, sha(before + node + after), i // 8
    return proof, node


def brute(rows, changed):
    order = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in order:
        own = [(r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), leaf_of(changed(r)), r["doc_id"]) for r in rows if r["lang"] == lang]
        groups.append(sorted(own, key=lambda x: x[:3]))
    trees = [climb([x[2] for x in g]) for g in groups]
    top = climb([t[-1][0] for t in trees])
    out = []
    for g, (rows_, tree) in enumerate(zip(groups, trees)):
        for i, (_, _, leaf, other, key) in enumerate(rows_):
            proof, node = fold(tree, i, other)
            more, node = fold(top, g, node)
            out.append((key, leaf, tree[-1][0], top[-1][0], sha(proof + more), node, node == top[-1][0]))
    return sorted(out, key=repr)


def lowered(row):
    row = row.asDict()
    if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
        row["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])
    return row


def run(docs):
    from pyspark.sql import functions as F

    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(chosen, F.translate(docs["text"], capitals, capitals.lower())).otherwise(docs["text"])
    found = merkle.fold(merkle.build(docs, changed={"text": text}))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_odd_rows(odd):
    docs = odd.withColumnsRenamed({"shard": "digest2"})
    rows = docs.collect()
    got = run(docs)
    assert got == brute(rows, lowered) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512, 513, 4100])
def test_sizes_of_trees(spark, n):
    """One language with ``n`` rows beside small ones: full, single and short runs of every level."""
    docs = spark.range(n).selectExpr(
        "id as doc_id", "'s' as source", "'en' as lang", "cast(null as bigint) as n_chars", "concat('Text ', id) as text"
    )
    more = docs.where("doc_id < 3").selectExpr("doc_id", "source", "concat('l', doc_id) as lang", "n_chars", "text")
    both = docs.union(more) if n != 9 else docs  # and a table of one language
    assert run(both) == brute(both.collect(), lowered)


def test_many_languages(spark):
    docs = spark.range(700).selectExpr(
        "id as doc_id", "'s' as source", "concat('l', id) as lang", "id as n_chars", "concat('Text ', id) as text"
    )
    assert run(docs) == brute(docs.collect(), lowered)


def test_proofs_lead_to_the_root(spark, odd):
    tree = merkle.build(odd)
    leaves = {(r["g"], r["i"]): r["digest"] for r in tree.leaves.collect()}
    rows = merkle.proofs(tree).collect()
    assert len(rows) == len(leaves)
    for r in rows:
        node = leaves[r["g"], r["i"]]
        for slot, parent in merkle.unpacked(r["path"]):
            assert parent.children[slot] == node
            node = parent.digest
        assert node == tree.root


def test_parents_resume_their_states():
    children = [sha(str(i)) for i in range(5)]
    parent = merkle.Parent(children)
    assert parent.digest == sha("".join(children))
    for slot in range(5):
        assert parent.fold(slot, children[slot]) == parent.digest
        assert parent.fold(slot, sha("x")) == sha("".join(children[:slot] + [sha("x")] + children[slot + 1 :]))


def test_order_of_rows_does_not_matter(odd):
    assert merkle.build(odd).root == merkle.build(odd.repartition(7, "h", "text")).root


def test_empty_table(no_docs):
    tree = merkle.build(no_docs)
    assert tree.root is None and merkle.fold(tree).count() == 0 and merkle.proofs(tree).count() == 0


def test_query(spark, directory):
    got = merkle.query(spark, directory).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{directory}/documents.parquet'")
    assert check.rows_of(got) == check.rows_of(con.execute(merkle.SQL).fetchdf()) and len(got)
