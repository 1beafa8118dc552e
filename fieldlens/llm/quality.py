"""Quality classifier (3): histogram gradient-boosted trees over document statistics.

Statistics come from the whole text only (bytes, words, lines); language, source, ids and labels are never inputs of a
score. The trees are fitted on a bounded sample of labelled rows (``MAX_FIT_ROWS``, chosen by a hash of doc_id from the
training folds) on the driver, flattened into arrays, and applied to every document by vectorised traversal in tasks.

Defined results: a null or empty text has the statistics of no bytes and gets a score like any other; equal texts score
equally; no documents give no rows; without usable labels every score is 0.5; rows repeat as they come; extra columns
are passed through by ``keep_quality`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import read_table

MAX_FIT_ROWS = 12_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
ACCEPT = 0.5

_UPPER, _LOWER, _DIGIT = np.zeros((3, 256), bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SIGNS = np.array([c for c in range(33, 127) if not (_UPPER | _LOWER | _DIGIT)[c]])
FEATURES = ["bytes", "words", "lines", "upper", "lower", "digit", "sign", "space", "wide", "control", "word_bytes",
            "long_word", "distinct_words", "top_word", "distinct_lines", "line_bytes", "shouted", "signed", "numeric",
            "sentences", "short_words", "repeated_pairs", *(f"sign_{chr(c)}" for c in _SIGNS)]


def statistics(text: bytes) -> list[float]:
    """The features of one text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    w = max(1, len(words))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    joined = b" ".join(words)
    ends = np.frombuffer(joined + b" ", np.uint8)
    at = np.flatnonzero(ends == 32)
    lengths = np.diff(np.concatenate(([-1], at))) - 1
    before = ends[at - 1] if len(words) else np.zeros(0, np.uint8)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        count[_UPPER].sum() / n, count[_LOWER].sum() / n, count[_DIGIT].sum() / n, count[_SIGNS].sum() / n,
        (count[32] + count[9:14].sum()) / n, count[128:].sum() / n, (count[:9].sum() + count[14:32].sum()) / n,
        lengths.mean() if len(words) else 0.0, float(lengths.max()) if len(words) else 0.0,
        len(seen) / w, max(seen.values(), default=0) / w, len(set(lines)) / len(lines), n / len(lines),
        sum(x.isupper() and len(x) > 1 for x in words) / w,
        float(np.isin(before, _SIGNS).mean()) if len(words) else 0.0, float(_DIGIT[before].mean()) if len(words) else 0.0,
        float((before == 46).mean()) if len(words) else 0.0, float((lengths <= 3).mean()) if len(words) else 0.0,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        *(count[_SIGNS] / n)]


def statistics_of(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.binary()).to_pylist()
    return np.array([statistics(t or b"") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


# ------------------------------------------------------------------ trees
class Trees:
    """Flat arrays of all nodes: feature (-1: leaf), threshold, left child, value; right child is left + 1."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []

    def freeze(self):
        self.feature, self.left = np.array(self.feature, np.int32), np.array(self.left, np.int32)
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                go = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(go, self.left[node] + right, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
        least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for log loss; splits are searched over per-feature histograms of at most ``BINS`` bins."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))))
    if len(y) < 2 * least or y.min() == y.max():
        out.base = 0.0
        return out.freeze()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    n_features = x.shape[1]
    flat = binned + np.arange(n_features) * BINS
    raw = np.full(len(y), out.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        out.roots.append(len(out.feature))
        level = [(_node(out), np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if d < depth and len(rows) >= 2 * least:
                    keys = flat[rows].ravel()
                    hist = [np.bincount(keys, weights=np.repeat(v[rows], n_features), minlength=n_features * BINS)
                            .reshape(n_features, BINS).cumsum(axis=1) for v in (grad, hess)]
                    size = np.bincount(keys, minlength=n_features * BINS).reshape(n_features, BINS).cumsum(axis=1)
                    gain = (hist[0] ** 2 / (hist[1] + ridge) + (g - hist[0]) ** 2 / (h - hist[1] + ridge)
                            - g * g / (h + ridge))
                    gain[(size < least) | (len(rows) - size < least)] = 0
                    f, b = divmod(int(gain.argmax()), BINS)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        best = f, b
                if best is None:
                    out.value[node] = -rate * g / (h + ridge)
                    raw[rows] += out.value[node]
                    continue
                f, b = best
                out.feature[node], out.threshold[node] = f, float(cuts[f][b])
                right = binned[rows, f] > b
                out.left[node] = _node(out)
                below += [(out.left[node], rows[~right]), (_node(out), rows[right])]
            level = below
    return out.freeze()


def _node(trees: Trees) -> int:
    for column, v in ((trees.feature, -1), (trees.threshold, 0.0), (trees.left, -1), (trees.value, 0.0)):
        column.append(v)
    return len(trees.feature) - 1


# ------------------------------------------------------------------ Spark
def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_FIT_ROWS) -> Trees:
    """Trees fitted on at most ``max_rows`` labelled documents of the training folds, picked by a hash of their id;
    of rows that repeat an id the least text."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
              .where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("_y").alias("_y")))
    picked = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # the bound of the fitting sample
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # one row an id

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = statistics_of(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"), pa.array(list(x), pa.list_(pa.float64()))],
                ["_id", "_y", "x"])
    got = rows.mapInArrow(measure, "_id long, _y int, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(got["x"].tolist())
    order = np.lexsort((*x.T, got["_id"].to_numpy()))
    return fit(x[order], got["_y"].to_numpy(float)[order])


def _scored(docs: DataFrame, trees: Trees, id_col: str, text_col: str) -> DataFrame:
    def score(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(trees.score(statistics_of(part.column(1))))], ["doc_id", "score"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(score, "doc_id long, score double"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = _scored(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    trees = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def accept(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield part.filter(pa.array(trees.score(statistics_of(part.column(at))) >= ACCEPT))
    return docs.mapInArrow(accept, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
