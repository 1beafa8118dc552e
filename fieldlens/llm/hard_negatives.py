"""Hard-negative mining (13) by Fagin's threshold algorithm.

1. Vectors become integers, a score is an integer inner product. Candidates are dealt into shards of about ``SHARD`` rows,
   anchors (a stated query set) into blocks of about ``ANCHORS``; every block meets every shard in a group of its own, so
   no group grows with the data. Positives need only the shards of the anchor's own label.
2. In a group each dimension has its candidates sorted by value. An anchor reads the lists of its non-zero dimensions
   from the end that its sign prefers, in rounds that go ``STEP`` times deeper. Rows met for the first time are scored
   with the whole vector (random access). The threshold, the anchor's product with the last values read, bounds every
   row not yet met.
3. Positives: reading stops when the threshold is strictly below the k-th best score, so ties are all met. Negatives: every
   positive opens a window of scores; reading stops when the threshold is strictly below each window's k-th best score,
   or below its lower end.
4. Each shard's best rows are merged: the first ``positives`` of an anchor, the first ``negatives`` of an anchor and
   positive, higher scores first, ties by smaller id. Spark limits each task's ranks before it shuffles.

Defined results: rows whose id, label or vector is null, or whose vector is empty or holds null or non-finite components,
take no part; of rows that repeat an id the one with the smallest label and vector does; vectors of different lengths
have no score together; components saturate at a long, and the job stops if a score doesn't fit one. Anchors without
positives, or without negatives in any window, have no rows; an empty table gives none. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import read_table, stage, unstage

SCALE = 256
SHARD = 16_384
ANCHORS = 16_384
FIRST, STEP = 16, 3  # entries of each list in the first round; depth grows by this factor
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95


# ------------------------------------------------------------------ rows

def integer_rows(embeddings: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Staged (vec_id, label, dim, x) of the rows that take part, one for each id; x holds the integers as bytes."""
    c = F.col("c")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                             F.col(vector_col).cast("array<double>").alias("c"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & c.isNotNull() & (F.size(c) > 0)
             & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long"))
    one = (rows.where(F.coalesce(sound, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("label", x.alias("x"))).alias("r"))
           .select("vec_id", "r.label", F.size("r.x").alias("dim"), F.col("r.x").alias("x")))

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column(3)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *batch.column(2).to_pylist()])
            small = (flat >= -(1 << 15)) & (flat < 1 << 15)
            x = [flat[a:b].astype("<i2" if small[a:b].all() else "<i8").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.binary())], ["vec_id", "label", "dim", "x"])
    return stage(one.mapInArrow(pack, "vec_id long, label long, dim int, x binary"), "rows")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Packed vectors as a matrix of longs."""
    packed = column.to_pylist()
    out = np.empty((len(packed), dim), np.int64)
    sizes = np.array([len(p) for p in packed])
    for size, kind in ((2 * dim, "<i2"), (8 * dim, "<i8")):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(packed[i] for i in at), kind).reshape(-1, dim)
    return out


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices in the narrowest numbers whose inner products are exact: floats, doubles or Python's own."""
    top = [int(np.abs(p.astype(np.float64)).max(initial=0)) + 1 for p in parts]
    bound = max(top) ** 2 * parts[0].shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    return [p.astype(kind) for p in parts]


# ------------------------------------------------------------------ threshold algorithm

class Lists:
    """A shard's rows with a list for each dimension, sorted by value."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, order, axis=0).T.copy()
        self.order = order.T.astype(np.int32).copy()

    def rounds(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """(rows met first in this round, their scores, threshold: no row that isn't yet met has a higher score)."""
        total = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = np.zeros(total, bool)
        depth = 0
        while depth < total:
            deeper = min(total, max(FIRST, STEP * depth)) if len(up) + len(down) else total
            now = met.copy() if deeper < total else np.ones(total, bool)
            if deeper < total:
                now[self.order[up, total - deeper:total - depth].ravel()] = True
                now[self.order[down, depth:deeper].ravel()] = True
                threshold = (anchor[up] @ self.values[up, total - deeper] if len(up) else 0) + \
                    (anchor[down] @ self.values[down, deeper - 1] if len(down) else 0)
            else:
                threshold = -math.inf  # every row is met
            rows = np.flatnonzero(now & ~met)
            met, depth = now, deeper
            yield rows, self.x[rows] @ anchor, threshold


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k: higher scores first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def nearest(lists: Lists, ids: np.ndarray, anchor: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows but the anchor's own."""
    top, score = ids[:0], lists.x[:0, 0]
    for rows, scores, threshold in lists.rounds(anchor):
        some = ids[rows] != own
        top, score = np.concatenate((top, ids[rows][some])), np.concatenate((score, scores[some]))
        at = best(top, score, k)
        top, score = top[at], score[at]
        if len(top) == k and threshold < score[-1]:
            break
    return top, score


def in_windows(lists: Lists, ids: np.ndarray, other: np.ndarray, anchor: np.ndarray, windows: list[tuple[int, int]],
               k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (lowest, highest) score the ids and scores of the k best rows in it, among rows where ``other`` is true."""
    found = [(ids[:0], lists.x[:0, 0])] * len(windows)
    least = min(lo for lo, _ in windows)
    for rows, scores, threshold in lists.rounds(anchor):
        some = other[rows] & (scores >= least)
        rows, scores = rows[some], scores[some]
        done = True
        for w, (lo, hi) in enumerate(windows):
            inside = (scores >= lo) & (scores <= hi)
            top, score = found[w]
            if inside.any():
                top, score = np.concatenate((top, ids[rows[inside]])), np.concatenate((score, scores[inside]))
                at = best(top, score, k)
                found[w] = top, score = top[at], score[at]
            done &= bool(threshold < lo or len(top) == k and threshold < score[-1])
        if done:
            break
    return found


# ------------------------------------------------------------------ groups

def paired(candidates: DataFrame, anchors: DataFrame, keys: list[str]):
    """Candidates and anchors grouped by (keys, shard, block): every block of a key's anchors meets every shard of its
    candidates."""
    def parts(rows, size, name):
        return rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = parts(candidates, SHARD, "shards").join(parts(anchors, ANCHORS, "blocks"), keys)
    number = F.xxhash64("vec_id")
    left = (candidates.join(sizes, keys).withColumn("shard", F.pmod(number, F.col("shards")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks"))
    right = (anchors.join(sizes, keys).withColumn("block", F.pmod(number, F.col("blocks")).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "blocks"))
    group = [*keys, "shard", "block"]
    return left.groupBy(*group).cogroup(right.toDF(*right.columns).groupBy(*group))


def first(rows: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group(left: pa.Table, right: pa.Table):
    """(lists, ids, labels of candidates; anchor vectors, ids, labels), or None if a side is missing."""
    if not left.num_rows or not right.num_rows:
        return None
    dim = left.column("dim")[0].as_py()
    x, q = exact(matrix(left.column("x"), dim), matrix(right.column("x"), dim))
    return (Lists(x), left.column("vec_id").to_numpy(), left.column("label").to_numpy(), q,
            right.column("vec_id").to_numpy(), right.column("label").to_numpy())


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    # Scores are whole numbers; one beyond a long stops the job here.
    def whole(parts):
        flat = [v for p in parts for v in np.asarray(p).tolist()]
        return pa.array([int(v) for v in flat], pa.int64())
    return pa.table([whole(c) for c in columns], names=names)


def positives_of(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, positive_score, rank): each anchor's first k other rows of its label."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        group = _group(left, right)
        if group:
            lists, ids, _, q, own, _ = group
            for anchor, i in zip(q, own):
                top, score = nearest(lists, ids, anchor, i, k)
                for c, v in zip(out, (np.full(len(top), i), top, score)):
                    c.append(v)
        return _table(out, names)
    found = paired(rows, anchors, ["dim", "label"]).applyInArrow(search, ", ".join(f"{n} long" for n in names))
    return first(found, ["anchor_id"], "positive_score", "positive_id", k)


def negatives_of(rows: DataFrame, anchors: DataFrame, positives: DataFrame, k: int = NEGATIVES, low: int = LOW,
                 high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first k rows of another label
    with low * positive_score <= 100 * negative_score <= high * positive_score."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    lists_of = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("goals"))  # a few an anchor

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        group = _group(left, right)
        if group:
            lists, ids, labels, q, own, own_label = group
            for anchor, i, label, goals in zip(q, own, own_label, right.column("goals").to_pylist()):
                goals = [(g["positive_id"], g["positive_score"]) for g in goals]
                windows = [(-(-low * s // 100), high * s // 100) for _, s in goals]
                open_ = [w for w, (lo, hi) in enumerate(windows) if lo <= hi]
                if not open_:
                    continue
                found = in_windows(lists, ids, labels != label, anchor, [windows[w] for w in open_], k)
                for w, (top, score) in zip(open_, found):
                    n = len(top)
                    for c, v in zip(out, (np.full(n, i), np.full(n, goals[w][0]), np.full(n, goals[w][1], object), top, score)):
                        c.append(v)
        return _table(out, names)
    searching = anchors.join(lists_of, "vec_id")
    found = paired(rows, searching, ["dim"]).applyInArrow(search, ", ".join(f"{n} long" for n in names))
    return first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id",
                   vector_col: str = "embedding") -> DataFrame:
    """``negatives_of`` the rows for which ``is_anchor`` (over the column vec_id) holds."""
    rows = integer_rows(embeddings, F.col("label") if label is None else label, id_col, vector_col)
    anchors = rows.where(is_anchor)
    found = stage(positives_of(rows, anchors, positives), "positives")
    out = stage(negatives_of(rows, anchors, found, negatives, low, high), "negatives")
    unstage(rows, found)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(e AS DOUBLE)) FOR e IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR e IN embedding IF e IS NULL OR isnan(e) OR isinf(e)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
