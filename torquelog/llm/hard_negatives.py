"""Hard negatives for contrastive training, found by segment summaries of the vectors.

A vector is cut into segments. Of each segment its mean m and the length d of its deviations from the
mean are stored, for ever finer cuts. Over a segment of n components two vectors have the inner
product n m m' give or take d d', so the sums over the segments bound their score from both sides.
For every anchor the coarsest cut is bounded for all vectors of a block, each finer one for those
that the cuts before could not rule out, and only what is left is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelog.llm import common

POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # per cent of the positive's score that a negative's may have
SCALE = 256
CUTS = (1, 4, 16)  # segments of each cut, from coarse to fine
BLOCK, ANCHORS = 2048, 1024  # vectors and anchors of a block, about
EXACT = float(1 << 53)  # whole numbers below it are exact in floating point


def summaries(x: np.ndarray, cuts: Sequence[int] = CUTS) -> np.ndarray:
    """For each row of ``x`` and each segment of each cut: mean times root of n, length of deviations."""
    parts = []
    for segments in cuts:
        for piece in np.array_split(x, max(1, min(segments, x.shape[1])), axis=1):
            n = max(piece.shape[1], 1)
            mean = piece.sum(axis=1) / n
            parts += [mean * np.sqrt(n), np.sqrt(((piece - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1)


def _edges(dim: int, cuts: Sequence[int]) -> list[slice]:
    """Where the summaries of each cut stand."""
    at, out = 0, []
    for segments in cuts:
        size = 2 * max(1, min(segments, dim))
        out.append(slice(at, at + size))
        at += size
    return out


def survivors(
    a: np.ndarray, summary: np.ndarray, norm: float, block: np.ndarray, norms: np.ndarray,
    edges: list[slice], may: np.ndarray, k: int, low: float, high: float,
) -> np.ndarray:
    """Places in a block that can be among the ``k`` best of scores from ``low`` to ``high``.

    ``summary`` and ``block`` are the summaries of the anchor and of the block, ``may`` the places to
    look at. A place goes when its bounds miss the range, or when ``k`` others that are surely in the
    range are surely better.
    """
    for cut in edges:
        if not len(may):
            break
        ours, theirs = summary[cut], block[may, cut]
        middle = theirs[:, 0::2] @ ours[0::2]
        reach = theirs[:, 1::2] @ ours[1::2] + 1e-9 * norm * norms[may] + 1e-9  # room for rounding
        upper, lower = middle + reach, middle - reach
        keep = (upper >= low) & (lower <= high)
        sure = lower[(lower >= low) & (upper <= high)]
        if len(sure) >= k:
            keep &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
        may = may[keep]
    return may


def exact(a: np.ndarray, x: np.ndarray, norm: float, most: float) -> np.ndarray:
    """Whole inner products; beyond the exact range of floating point by whole numbers of any size."""
    if norm * most < EXACT:
        return (x @ a).astype(np.int64)
    big = [sum(int(p) * int(q) for p, q in zip(row, a)) for row in x]
    return np.array(big, np.int64) if big else np.zeros(0, np.int64)


class Block:
    """The rows of one group as matrices."""

    def __init__(self, rows: pa.Table) -> None:
        # vectors without a key come last among equal scores
        self.key = rows["id"].to_pylist()
        self.null = rows["id"].is_null().to_numpy()
        self.order = rows["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.name = rows["name"].to_numpy()
        self.label = rows["label"].to_numpy()
        self.dim = rows["dim"][0].as_py()
        self.x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(rows.num_rows, self.dim)
        size = sum(2 * max(1, min(s, self.dim)) for s in CUTS)
        self.s = np.frombuffer(b"".join(rows["s"].to_pylist()), np.float64).reshape(rows.num_rows, size)
        self.norm = np.sqrt((self.x**2).sum(axis=1))


def _best(anchors: Block, i: int, block: Block, edges, may, k: int, low: float, high: float):
    """(places, scores) of the ``k`` best in range, by score and then key."""
    may = survivors(
        anchors.x[i], anchors.s[i], anchors.norm[i], block.s, block.norm, edges, may, k, low, high
    )
    scores = exact(anchors.x[i], block.x[may], anchors.norm[i], block.norm[may].max(initial=0))
    inside = (scores >= low) & (scores <= high)
    may, scores = may[inside], scores[inside]
    order = np.lexsort((block.order[may], -scores))[:k]
    return may[order], scores[order]


def _others(anchors: Block, i: int, block: Block, same: bool) -> np.ndarray:
    """Places of the anchor's label, or of the other labels, without its own key."""
    like = (block.label == anchors.label[i]) == same
    return np.flatnonzero(like & ((block.order != anchors.order[i]) | block.null))


def _positives(k: int) -> Callable:
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            anchors, block = Block(left), Block(right)
            edges = _edges(block.dim, CUTS)
            for i in range(len(anchors.key)):
                may = _others(anchors, i, block, True)
                for j, score in zip(*_best(anchors, i, block, edges, may, k, -np.inf, np.inf)):
                    out.append((int(anchors.name[i]), block.key[j], int(block.order[j]), int(score)))
        names = ["name", "positive_id", "tie", "score"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names)

    return run


def _negatives(k: int, least: int, most: int) -> Callable:
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            anchors, block = Block(left), Block(right)
            edges = _edges(block.dim, CUTS)
            for i, scores in enumerate(left["scores"].to_pylist()):
                may = _others(anchors, i, block, False)
                for turn, score in enumerate(scores):
                    low, high = -(-least * score // 100), most * score // 100
                    if low > high:
                        continue
                    for j, found in zip(*_best(anchors, i, block, edges, may, k, low, high)):
                        out.append((int(anchors.name[i]), turn, block.key[j], int(block.order[j]), int(found)))
        names = ["name", "turn", "negative_id", "tie", "negative_score"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names)

    return run


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """(id, label, v): the rows that take part, once each, with whole components."""
    v = F.col(vector)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & v.isNotNull() & ~bad)
    return rows.select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v")).distinct()


def summarised(rows: DataFrame) -> DataFrame:
    """(id, name, label, dim, x, s): each row with its components and its summaries, as stored."""
    wide = rows.select("id", F.xxhash64("id", "label", "v").alias("name"), "label", "v")

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = np.asarray(part.column(3).flatten(), np.float64).reshape(part.num_rows, dim)
                columns = [part.column(i) for i in range(3)] + [pa.array(np.full(len(x), dim), pa.int32())]
                for matrix in (x, summaries(x)):
                    matrix = np.ascontiguousarray(matrix)
                    columns.append(pa.array([row.tobytes() for row in matrix], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "name", "label", "dim", "x", "s"])

    schema = "id bigint, name bigint, label bigint, dim int, x binary, s binary"
    return wide.mapInArrow(run, schema)


def _meet(
    anchors: DataFrame, rows: DataFrame, by: list[str], blocks: int, groups: int, run: Callable, schema: str
) -> DataFrame:
    """Every group of anchors with every block of rows; both are of bounded size."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("name", F.lit(n)), F.lit(n)).cast("int")
    left = anchors.toDF(*anchors.columns)  # columns of its own, also where both sides are one table
    left = left.withColumn("p", every(blocks)).withColumn("q", part(groups))
    right = rows.withColumn("p", part(blocks)).withColumn("q", every(groups))
    keys = ["dim", *by, "p", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mine(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    scale: float = SCALE,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` picks the anchors by their ``id`` (default: all with an id). For an anchor and each of
    its best ``positives`` the best ``negatives`` of other labels whose score is between ``least`` and
    ``most`` per cent of the positive's. Rows with a null label, a null vector or a component that is
    null or not finite take no part; repeated rows are one. Ties go to the smaller key, a null key
    comes last and is never an anchor. Rows of the anchor's own key are neither. Other rows that
    share a key but differ are rows of their own. Vectors of different lengths never meet; empty
    ones score 0. Scores must fit 64 bits. Other columns are not read. An empty table gives no rows.
    """
    anchor = F.lit(True) if anchor is None else anchor
    rows = common.stored(summarised(usable(vectors, key, vector, label, scale)), "vector_summaries")
    chosen = rows.where(F.col("id").isNotNull() & anchor)
    blocks = max(1, -(-rows.count() // BLOCK))
    groups = max(1, -(-chosen.count() // ANCHORS))
    met = _meet(
        chosen, rows, ["label"], blocks, groups, _positives(positives),
        "name bigint, positive_id bigint, tie bigint, score bigint",
    )
    order = Window.partitionBy("name").orderBy(F.desc("score"), "tie", F.col("positive_id").isNull())
    turns = met.withColumn("turn", F.row_number().over(order) - 1).where(F.col("turn") < positives)
    turns = common.stored(turns.select("name", "turn", "positive_id", "score"), "positives")
    lists = turns.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("turn", "score"))).alias("all"))
    asked = chosen.join(lists.select("name", F.col("all.score").alias("scores")), "name")
    found = _meet(
        asked, rows, [], blocks, groups, _negatives(negatives, least, most),
        "name bigint, turn bigint, negative_id bigint, tie bigint, negative_score bigint",
    )
    order = Window.partitionBy("name", "turn").orderBy(
        F.desc("negative_score"), "tie", F.col("negative_id").isNull()
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = chosen.select("name", F.col("id").alias("anchor_id"))
    return ranked.join(turns, ["name", "turn"]).join(ids, "name").select(
        "anchor_id", "positive_id", "rank", "negative_id",
        F.col("score").alias("positive_score"), "negative_score",
    )


def query(spark: SparkSession, directory: str) -> DataFrame:
    vectors = spark.read.parquet(f"{directory}/embeddings.parquet")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", changed.alias("label"))
    return mine(rows, F.col("id") % 100 == 0)


SQL = """
WITH rows_ AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id IS DISTINCT FROM b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 10
"""
