"""Embedding near-dedup (5): a forest of random-projection trees with spill, compared within leaves.

1. Vectors that are equal number for number are one class (smallest vec_id, number of copies), so a vector that a third
   of all rows share is one entry.
2. The trees' split points are fitted on a bounded sample of classes (``SAMPLE_ROWS``, by a hash); every class is routed
   through every tree. Each inner node projects on a random direction and splits at the sample's median; vectors within
   ``spill`` of the median go to both sides.
3. Leaves are compared in blocks: a leaf of more than ``BLOCK`` rows is dealt into parts and every pair of parts is a
   group of its own, so no group grows with the data and no pair of the leaf is left out. Cosines are in double
   precision. Pairs stay inside the task: each vector leaves with the number of its partners (a pair found at several
   leaves counts at the first of them) and with the smallest vector that the block's links reach.
4. Links are united by connected components.

Defined results: a vector that is null, empty, zero or holds null or non-finite components has no links and is its own
component; vectors of different lengths never link; equal rows that repeat a vec_id are one vector and come back once
each; rows without vec_id have no links; no rows give no rows; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import components, read_table, stage, unstage

THRESHOLD = 0.95
TREES = 10
LEAF = 200
BLOCK = 1024
SAMPLE_ROWS = 20_000
MAX_NODES = 1 << 24  # of a tree; far above what a sample of that size grows
SPILL = 0.5  # of the standard deviation of a projected difference between two vectors just at the threshold


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(sample: np.ndarray, total: int, tree: int, spill: float, leaf: int = LEAF):
    """One tree as arrays: direction seed, split point and left child of each node (-1: leaf; right is left + 1)."""
    scale = total / max(1, len(sample))
    cut, left = [0.0], [-1]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * scale <= leaf or len(rows) < 16:
            continue
        p = sample[rows] @ direction(tree, node, sample.shape[1])
        middle = float(np.median(p))
        lo, hi = rows[p <= middle + spill], rows[p > middle - spill]
        if max(len(lo), len(hi)) > 0.9 * len(rows):
            continue  # a clump that this direction can't tell apart; compared in blocks
        cut[node], left[node] = middle, len(cut)
        todo += [(len(cut), lo), (len(cut) + 1, hi)]
        cut += [0.0, 0.0]
        left += [-1, -1]
    return np.array(cut), np.array(left)


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    v = np.random.default_rng((7, tree, node)).standard_normal(dim)
    return v / np.linalg.norm(v)


def route(x: np.ndarray, tree: int, cut: np.ndarray, left: np.ndarray, spill: float):
    """(row, leaf) of every place where the tree puts the vectors."""
    rows, nodes = [], []
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if left[node] < 0:
            rows.append(own)
            nodes.append(np.full(len(own), node))
            continue
        p = x[own] @ direction(tree, node, x.shape[1])
        todo += [(left[node], own[p <= cut[node] + spill]), (left[node] + 1, own[p > cut[node] - spill])]
    return np.concatenate(rows), np.concatenate(nodes)


def links(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """Staged (rep, root, others) of the classes (rep, n, dim, x) whose cosine with another one reaches the threshold:
    the sum of ``others`` over a class's rows is the number of vectors linked with it, its roots tie the components."""
    spark = vectors.sparkSession
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row per vector length
    forests = {}
    for dim, total in sizes.items():
        rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("x")
        sample = unit(r["x"] for r in rows.collect())
        spill = SPILL * math.sqrt((2 - 2 * threshold) / dim)
        forests[dim] = spill, [grow(sample, total, t, spill) for t in range(trees)]
    sent = spark.sparkContext.broadcast(forests)

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                dims = part.column(1).to_numpy()
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = unit(part.column(2).take(pa.array(at)).to_pylist())
                    spill, forest = sent.value[int(dim)]
                    own, code = [], []
                    for t, (cut, left) in enumerate(forest):
                        rows, leaf = route(x, t, cut, left, spill)
                        own.append(rows)
                        code.append(leaf + t * MAX_NODES)
                    own, code = np.concatenate(own), np.concatenate(code)
                    order = np.lexsort((code, own))
                    ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(at)))))
                    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), places],
                        ["rep", "dim", "places"])
    placed = stage(vectors.select("rep", "dim", "x").mapInArrow(place, "rep long, dim int, places array<long>"), "places")
    leaf = ["dim", "place"]
    each = placed.select("rep", "dim", F.explode("places").alias("place"))
    parts = each.groupBy(*leaf).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("size"))
    dealt = (each.join(parts.where("size > 1").drop("size"), leaf)
             .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*leaf, "rep", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
             .join(vectors.select("rep", "n", "x"), "rep").join(placed.select("rep", "places"), "rep"))

    def compare(key, pdf):
        import pandas as pd
        _, place, i, j = key
        own, ids, n = (pdf[c].to_numpy() for c in ("part", "rep", "n"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = _near(pdf["x"], left, right, threshold)
        some, other = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near, left, right = near[np.ix_(some, other)], left[some], right[other]
        # A pair counts at the first place that both are in.
        new = near & ~_met(pdf["places"].iloc[left], pdf["places"].iloc[right], place)
        others, root = np.zeros(len(pdf), np.int64), ids.copy()
        others[left] += new @ n[right]
        if i != j:
            others[right] += new.T @ n[left]
        while len(left):
            low = root.copy()
            low[left] = np.minimum(low[left], np.where(near, root[right], root.max()).min(axis=1))
            low[right] = np.minimum(low[right], np.where(near, root[left][:, None], root.max()).min(axis=0))
            if (low == root).all():
                break
            root = low
        rows = np.union1d(left, right)
        return pd.DataFrame({"rep": ids[rows], "root": root[rows], "others": others[rows]})
    found = dealt.groupBy(*leaf, "i", "j").applyInPandas(compare, "rep long, root long, others long")
    out = stage(found.groupBy("rep", "root").agg(F.sum("others").alias("others")), "links")
    unstage(placed)
    return out


def _near(vectors, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of ``left`` and ``right`` (row numbers) reach the threshold; a row isn't its own partner."""
    raw = np.array(list(vectors), np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    x = raw / norm[:, None]
    cosine = x[left] @ x[right].T
    near = cosine >= threshold + 1e-9
    for row in np.flatnonzero((np.abs(cosine - threshold) < 1e-9).any(axis=1)):  # too close for the rounded units
        at = np.flatnonzero(np.abs(cosine[row] - threshold) < 1e-9)
        a, b = left[row], right[at]
        near[row, at] = np.einsum("j,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= threshold
    return near & (left[:, None] != right[None, :])


def _met(left, right, place: int) -> np.ndarray:
    """Which members of ``left`` and ``right`` (lists of places) are together in a place before this one."""
    sizes = [len(x) for x in (*left, *right)]
    if not sizes:
        return np.zeros((0, 0), bool)
    whose, places = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*left, *right])
    whose, places = whose[places < place], places[places < place]
    _, code = np.unique(places, return_inverse=True)
    m = np.zeros((len(sizes), int(code.max(initial=-1)) + 1), np.float32)
    m[whose, code] = 1
    return m[:len(left)] @ m[len(left):].T > 0


def embedding_components(embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
                         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    x = F.col("x")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    sound = F.coalesce(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite
                       & F.exists(x, lambda v: v != 0), F.lit(False))
    h = [F.xxhash64("x"), F.xxhash64(F.reverse("x"), F.lit(1))]
    marked = rows.withColumn("sound", sound)
    keyed = marked.select("vec_id", "sound", F.when(F.col("sound"), h[0]).alias("h1"),
                          F.when(F.col("sound"), h[1]).alias("h2"))
    classes = stage(marked.where("sound").select("vec_id", h[0].alias("h1"), h[1].alias("h2"), "x")
                    .groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"),
                                             F.first("x").alias("x"))
                    .withColumn("dim", F.size("x")), "vectors")
    found = links(classes.select("rep", "n", "dim", "x"), threshold, trees)
    linked = found.groupBy(F.col("rep").alias("id")).agg(F.sum("others").alias("others"))
    comp = components(found, "rep", "root")
    known = (classes.select("h1", "h2", "rep", "n").join(linked, F.col("rep") == linked["id"], "left").drop("id")
             .join(comp, F.col("rep") == comp["id"], "left")
             .select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    known = stage(known, "known")
    return (keyed.join(known, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op5(spark, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"))
