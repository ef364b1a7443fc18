"""A Merkle tree over the rows of a dataset, with proofs and folding of changed rows.

Rows are leaves in the order of a key, group by group; every eight consecutive nodes have a parent,
until one node is left, the root of the group. The roots of the groups are the leaves of a tree of
their own. A parent keeps a copy of its hash state before each child slot, so that folding a changed
child resumes the state of its slot with the replacement and the siblings to its right.

The tree is built in tiers of a few levels: a task makes the nodes above one aligned run of 512, whose
top node is a leaf of the next tier. What a run needs to know about the tree above it comes down the
same tiers, one row per run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelog.llm import common

FANOUT = 8
LEVELS = 3  # of a tier
RUN = FANOUT**LEVELS


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 in hexadecimal of the values: ``-`` for null, else the UTF-8 byte count, a colon, the value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Parent:
    """The children of a node and the copied hash states before each of their slots."""

    children: list[str]
    states: list = field(default_factory=list)
    digest: str = ""

    def __post_init__(self) -> None:
        state = hashlib.sha256()
        for child in self.children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])

    def fold(self, slot: int, replacement: str) -> str:
        """The digest with another child in ``slot``: its state, the replacement, what is to the right."""
        state = self.states[slot].copy()
        state.update((replacement + "".join(self.children[slot + 1 :])).encode())
        return state.hexdigest()


def levels(nodes: list[str], first: bool) -> list[list[Parent]]:
    """The parents above a run of nodes, from the lowest level up.

    The ``first`` run of a tree goes up until one node is left: if it is not full, it is the only
    one. Any other run goes up all the levels of its tier, also where a level has one node.
    """
    out: list[list[Parent]] = []
    while len(nodes) > 1 if first else len(out) < LEVELS:
        parents = [Parent(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(parents)
        nodes = [p.digest for p in parents]
    return out


def way(tree: list[list[Parent]], i: int) -> list[tuple[int, Parent]]:
    """The parents above node ``i`` of a run and the slots it hangs on."""
    out = []
    for parents in tree:
        out.append((i % FANOUT, parents[i // FANOUT]))
        i //= FANOUT
    return out


def packed(steps: list[tuple[int, Parent]]) -> list[str]:
    return [f"{slot}:{''.join(parent.children)}" for slot, parent in steps]


def unpacked(path: list[str]) -> list[tuple[int, Parent]]:
    out = []
    for step in path:
        slot, _, text = step.partition(":")
        out.append((int(slot), Parent([text[i : i + 64] for i in range(0, len(text), 64)])))
    return out


def _run_tree(rows: pa.Table) -> tuple[pa.Table, list[list[Parent]]]:
    rows = rows.sort_by("i")
    return rows, levels(rows["digest"].to_pylist(), rows["i"][0].as_py() < RUN)


def _top(rows: pa.Table) -> pa.Table:
    """One row for a run: the node above it, a leaf of the next tier."""
    rows, tree = _run_tree(rows)
    top = tree[-1][0].digest if tree else rows["digest"][0].as_py()
    run = rows["i"][0].as_py() // RUN
    return pa.table({"g": rows["g"].slice(0, 1), "i": pa.array([run], pa.int64()), "digest": pa.array([top])})


def _ways(key, rows: pa.Table, above: pa.Table) -> pa.Table:
    """The whole way to the root for every node of a run, from that of the run's top."""
    rows, tree = _run_tree(rows)
    rest, subroot = above["path"][0].as_py(), above["subroot"][0].as_py()
    paths = [packed(way(tree, i)) + rest for i in range(rows.num_rows)]
    columns = {"g": rows["g"], "i": rows["i"], "path": pa.array(paths, pa.list_(pa.string()))}
    return pa.table(columns | {"subroot": pa.array([subroot] * rows.num_rows, pa.string())})


def _folded(key, rows: pa.Table, above: pa.Table) -> pa.Table:
    """For every leaf of a run the digest of its proof and the root that its replacement gives."""
    rows, tree = _run_tree(rows)
    # the states of the parents above the run are copied once for all its leaves
    rest, subroot = unpacked(above["path"][0].as_py()), above["subroot"][0].as_py()
    tail = "".join(parent.siblings(slot) for slot, parent in rest).encode()
    proofs, roots = [], []
    for i, node in enumerate(rows["changed"].to_pylist()):
        own = way(tree, i)
        proofs.append(hashlib.sha256("".join(p.siblings(s) for s, p in own).encode() + tail).hexdigest())
        for slot, parent in own + rest:
            node = parent.fold(slot, node)
        roots.append(node)
    columns = {"key": rows["key"], "leaf": rows["digest"]}
    for name, values in (("subroot", [subroot] * len(roots)), ("proof_sha256", proofs), ("folded_root", roots)):
        columns[name] = pa.array(values, pa.string())
    return pa.table(columns)


def _run() -> Column:
    return F.floor(F.col("i") / RUN).cast("long").alias("run")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Rows (g, i, digest) of each tier, from ``nodes`` up to the one with a single node per group."""
    out = [nodes]
    while out[-1].agg(F.max("i")).first()[0]:
        runs = out[-1].select("g", "i", "digest").groupBy("g", _run())
        out.append(common.stored(runs.applyInArrow(_top, "g bigint, i bigint, digest string"), "tree_tier"))
    return out


def _above(paths: DataFrame):
    """The paths of the tops of runs by run, with columns of their own also where both sides are one table."""
    paths = paths.select("g", "i", "path", "subroot").toDF("g", "run", "path", "subroot")
    return paths.groupBy("g", "run")


def _down(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """(g, i, path, subroot) of the nodes of the lowest of ``tiers``, from ``paths`` of the tier above them."""
    for tier in reversed(tiers):
        runs = tier.select("g", "i", "digest").groupBy("g", _run())
        schema = "g bigint, i bigint, path array<string>, subroot string"
        paths = common.stored(runs.cogroup(_above(paths)).applyInArrow(_ways, schema), "tree_paths")
    return paths


def placed(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with the number ``g`` of its group and its place ``i`` there.

    Groups are numbered in order, null first. Ranges of rows are sorted apart and stored; of a group
    only one count per range is put in order, so that a group may hold any share of the rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(group).asc_nulls_first(), *order]
    base = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    base = common.stored(base.withColumn("place", F.monotonically_increasing_id()), "tree_rows")
    base = base.withColumn("piece", F.shiftright("place", 33))
    counts = base.groupBy(F.col(group).alias("of"), F.col("piece").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("start")
    )
    counts = common.stored(counts, "tree_counts")
    first = F.col("same").asc_nulls_first()
    names = counts.select(F.col("of").alias("same")).distinct()
    names = names.repartitionByRange(parts, first).sortWithinPartitions(first)
    names = common.numbered(names, [], "g", "tree_groups")
    named = counts.join(names, F.col("of").eqNullSafe(F.col("same")))
    before = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = base.join(named, (F.col("piece") == F.col("p")) & F.col(group).eqNullSafe(F.col("of")))
    i = F.col("before") + F.col("place") - F.col("start")
    return met.select("g", i.cast("long").alias("i"), *[base[c] for c in rows.columns])


@dataclass
class Tree:
    """A stored manifest: ``leaves`` (g, i, key, digest, changed), the tiers above them, those over the
    roots of the groups, and the root (None without rows)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    upper: list[DataFrame]
    root: str | None


def build(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    changed: dict[str, Column] | None = None,
) -> Tree:
    """The tree over the rows of ``docs``; a leaf is the digest of ``columns``.

    Per ``group`` (null first, then in byte order) leaves stand in the order of ``key``, null first;
    equal keys by digest, so that repeated rows, which are leaves of their own, give one tree in any
    order. ``changed`` has other values for some of the columns, whose digests are kept beside the
    leaves. Nulls and empty values differ. A text of any length is hashed where it is read and never
    travels. Other columns are not read. An empty table has no root.
    """
    leaf = leaf_digest([docs[c] for c in columns])
    other = leaf_digest([changed.get(c, docs[c]) for c in columns]) if changed else leaf
    rows = docs.select(
        docs[key].alias("key"), docs[group].alias("name"), leaf.alias("digest"), other.alias("changed")
    )
    order = [F.col("key").asc_nulls_first(), F.col("digest")]
    leaves = common.stored(placed(rows, "name", order).drop("name"), "tree_leaves")
    tiers = _tiers(leaves)
    upper = _tiers(tiers[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "digest"))
    top = upper[-1].select("digest").first()
    return Tree(leaves, tiers, upper, top[0] if top else None)


def _run_paths(tree: Tree) -> DataFrame:
    """(g, i, path, subroot) of the top of each run of leaves."""
    nothing, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    paths = tree.upper[-1].select("g", "i", nothing.alias("path"), none.alias("subroot"))
    paths = _down(tree.upper[:-1], paths).select(F.col("i").alias("g"), "path")
    tops = tree.tiers[-1].select("g", "i", F.col("digest").alias("subroot"))
    return _down(tree.tiers[1:-1], tops.join(paths, "g").select("g", "i", "path", "subroot"))


def proofs(tree: Tree) -> DataFrame:
    """(g, i, path, subroot) of every leaf; a step of ``path`` is the slot and the children of a parent."""
    return _down([tree.leaves], _run_paths(tree))


def fold(tree: Tree) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``proof_sha256`` is the digest of the siblings on the way to the root, ``folded_root`` the root
    with the leaf's changed digest in its place; ``verified`` tells whether that is the root.
    """
    kind = tree.leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    runs = tree.leaves.groupBy("g", _run())
    found = runs.cogroup(_above(_run_paths(tree))).applyInArrow(_folded, schema)
    root = F.lit(tree.root).cast("string")
    return found.select(
        "key", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def query(spark: SparkSession, directory: str) -> DataFrame:
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    capitals = "".join(map(chr, range(65, 91)))
    lowered = F.translate(docs["text"], capitals, capitals.lower())
    text = F.when(chosen, lowered).otherwise(docs["text"])
    return fold(build(docs, changed={"text": text})).withColumnRenamed("key", "doc_id")


#: CRC-32 of the decimal key: each byte is added, then eight bits are shifted out (256 stands for a shift).
_CRC = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(range(strlen(doc_id::VARCHAR)),
    lambda i: [ascii(substr(doc_id::VARCHAR, (i + 1)::INTEGER, 1))::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
  lambda a, x: CASE WHEN x = 256 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, x) END), 4294967295)"""

SQL = f"""
WITH RECURSIVE heads AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         CASE WHEN {_CRC} % 3 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed
  FROM heads
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS many
  FROM hashed
), tree AS (
  SELECT 0 AS l, g, i, leaf AS digest, many FROM leaves
  UNION ALL
  SELECT l + 1, g, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (max(many) + 7) // 8
  FROM tree WHERE many > 1 GROUP BY l, g, i // 8
), tops AS (
  SELECT g, digest, count(*) OVER () AS many FROM tree WHERE many = 1
), upper_tree AS (
  SELECT 0 AS l, -1 AS g, g AS i, digest, many FROM tops
  UNION ALL
  SELECT l + 1, g, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (max(many) + 7) // 8
  FROM upper_tree WHERE many > 1 GROUP BY l, g, i // 8
), nodes AS (
  SELECT * FROM tree UNION ALL SELECT * FROM upper_tree
), siblings AS (
  SELECT a.l, a.g, a.i, any_value(a.many) AS many,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.l = b.l AND a.g = b.g AND a.i // 8 = b.i // 8
  GROUP BY a.l, a.g, a.i
), folded AS (
  SELECT f.g AS own, f.i AS at, 0 AS l, f.g, f.i, f.changed AS digest, '' AS proof FROM leaves f
  UNION ALL
  SELECT f.own, f.at, CASE WHEN s.many = 1 THEN 0 ELSE f.l + 1 END,
         CASE WHEN s.many = 1 THEN -1 ELSE f.g END,
         CASE WHEN s.many = 1 THEN f.own ELSE f.i // 8 END,
         CASE WHEN s.many = 1 THEN f.digest ELSE sha256(s.before || f.digest || s.after) END,
         f.proof || s.before || s.after
  FROM folded f JOIN siblings s ON s.l = f.l AND s.g = f.g AND s.i = f.i
  WHERE NOT (s.many = 1 AND f.g = -1)
), ended AS (
  SELECT f.own, f.at, f.digest, f.proof FROM folded f
  JOIN siblings s ON s.l = f.l AND s.g = f.g AND s.i = f.i WHERE s.many = 1 AND f.g = -1
)
SELECT v.doc_id, v.leaf, t.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256,
       e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves v JOIN ended e ON e.own = v.g AND e.at = v.i JOIN tops t ON t.g = v.g
CROSS JOIN (SELECT digest FROM upper_tree WHERE many = 1) r
"""
