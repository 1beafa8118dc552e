"""Substring dedup (6): seed on winnowed anchors, extend, keep maximal repeats of at least ``window`` words.

A word run of ``window`` words in one document is removed when the same run also starts in a document with a smaller
doc_id. Winnowing picks, for every run, the ``seed``-word gram with the least hash (leftmost on ties), so equal runs pick
equal anchors at equal places, and one anchor stands for a stretch of consecutive runs:

1. Seed: documents emit (anchor hash, hash of the stretch around it, place); both hashes, 128 bits, name a stretch. Equal stretches are pre-aggregated
   to their smallest doc_id, so thousands of copies are one row an anchor. Anchors of one document only end here.
2. Extend: an anchor with one stretch needs no comparison. Where stretches differ, the runs on both sides of the anchor
   are compared by their hashes (with the anchor's, 128 bits), taken once for each distinct stretch, and get the smallest doc_id that has them.
3. Each document unites its runs that an earlier document has into maximal removed intervals.

Groups are never paired: the work is linear in distinct stretches. Joins are on 128-bit hashes or doc_id and left to
Spark, which splits skewed ones.

Defined results: null text has no words and, like a text shorter than the window, loses nothing; no documents give no
rows; rows that repeat a doc_id are one document, each cut by what its own text shares with smaller ids; rows
without doc_id lose nothing and take nothing away; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import read_table, stage, unstage
from fieldlens.llm.hashing import chunks, mix, rolling, spans, utf8, word_hashes

WINDOW = 50
SEED = 10


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least entry of each run of ``width`` entries (doubling)."""
    best, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        have += step
    return best


def _anchors(lanes: list[np.ndarray], window: int, seed: int):
    """For one document's words: first run, number of runs, anchor hash, hash of the stretch; per anchor."""
    grams = rolling(lanes[0], seed)
    pick = _least(grams, window - seed + 1)
    edge = np.flatnonzero(np.diff(pick)) + 1
    first = np.concatenate(([0], edge))
    runs = np.diff(np.concatenate((first, [len(pick)])))
    anchor = pick[first]
    place = (anchor - first).astype(np.uint64) * np.uint64(1 << 20)
    c = mix(spans(lanes[1], first, first + runs + window - 1, 1) + place)
    return first, runs, grams[anchor], c


def _documents(batch: pa.RecordBatch):
    """(index, two lanes of word hashes) of each text of a batch, chunk by chunk."""
    texts = utf8(batch.column(1))
    for lo, hi in chunks(texts):
        lanes, first, _, _ = word_hashes(texts[lo:hi], 2)
        for i in range(hi - lo):
            yield lo + i, [lane[first[i]:first[i + 1]] for lane in lanes]


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc, t, first, runs, a, c) of every anchor; t is the hash of the text."""
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found, size = [], 0
            for i, lanes in _documents(batch):
                if len(lanes[0]) >= window:
                    first, runs, *hashes = _anchors(lanes, window, seed)
                    found.append((np.full(len(first), ids[i], np.int64), np.full(len(first), marks[i], np.int64),
                                  first.astype(np.int32), runs.astype(np.int32), *(x.view(np.int64) for x in hashes)))
                    size += len(first)
                if size > 100_000:
                    yield _batch(found)
                    found, size = [], 0
            if found:
                yield _batch(found)
    return docs.mapInArrow(emit, "doc long, t long, first int, runs int, a long, c long")


def _batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                      ["doc", "t", "first", "runs", "a", "c"])


def _run_hashes(docs: DataFrame, window: int) -> DataFrame:
    """(a, c, owner, run, w) of every run of the stretches listed in ``wanted`` (structs), from their document."""
    names = ["a", "c", "owner", "run", "w"]

    def emit(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found, size = [], 0
            for i, lanes in _documents(batch):
                w = rolling(lanes[1], window, 1).view(np.int64)
                for s in wanted[i]:
                    lo, n = s["first"], s["runs"]
                    found.append((np.full(n, s["a"]), np.full(n, s["c"]), np.full(n, ids[i], np.int64),
                                  np.arange(n, dtype=np.int32), w[lo:lo + n]))
                    size += n
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)
    return docs.mapInArrow(emit, "a long, c long, owner long, run int, w long")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc, t, spans): the maximal word intervals [from, to) of each text (t is its hash) that an earlier document has too."""
    narrow = (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"),
                          F.xxhash64(F.col(text_col)).alias("t"))
              .where("doc is not null and text is not null"))
    seeds = stage(_seeds(narrow, window, seed), "seeds")
    shared = seeds.groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("a")
    kept = stage(seeds.join(shared, "a"), "shared")
    unstage(seeds)
    # A stretch's smallest document, and where in it the stretch stands.
    stretch = ["a", "c"]
    classes = stage(kept.groupBy(*stretch).agg(F.min(F.struct("doc", "t", "first", "runs")).alias("lead"))
                    .select(*stretch, "lead.*"), "stretches")
    kinds = classes.groupBy("a").agg(F.count("*").alias("kinds"))
    known = classes.join(kinds, "a")

    # One kind of stretch: all its runs are the smallest document's.
    plain = known.where("kinds = 1").select(*stretch, F.col("doc").alias("owner"))
    plain = plain.withColumn("owners", F.lit(None).cast("array<struct<run:int,owner:long>>"))
    wanted = (known.where("kinds > 1").groupBy("doc", "t")
              .agg(F.collect_list(F.struct(*stretch, "first", "runs")).alias("wanted")))
    texts = narrow.join(wanted, ["doc", "t"]).select("doc", "text", "wanted")
    runs = stage(_run_hashes(texts, window), "runs")
    best = (runs.groupBy("a", "w").agg(F.min("owner").alias("best"), F.max("owner").alias("worst"))
            .where("best < worst").select("a", "w", "best"))
    earlier = (runs.join(best, ["a", "w"]).where("best < owner").groupBy(*stretch)
               .agg(F.collect_list(F.struct("run", F.col("best").alias("owner"))).alias("owners")))
    several = known.where("kinds > 1").select(*stretch, F.col("doc").alias("owner"))
    by_run = several.join(earlier, stretch, "left").select(*stretch, "owner", "owners")
    owners = stage(plain.unionByName(by_run), "owners")
    unstage(runs, classes)

    # Every anchor of every document against the owners of its runs.
    hits = (kept.join(owners, stretch)
            .withColumn("lost", F.when(F.col("owner") < F.col("doc"), F.array(F.struct(
                F.col("first").alias("from"), (F.col("first") + F.col("runs") + window - 1).alias("to"))))
                .otherwise(F.transform(F.col("owners"), lambda r: F.struct(
                    (F.col("first") + r["run"]).alias("from"), (F.col("first") + r["run"] + window).alias("to")))))
            .select("doc", "t", F.explode("lost").alias("s")).select("doc", "t", "s.*"))
    lost = hits.groupBy("doc", "t").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    lost = stage(lost, "lost")
    unstage(kept, owners)
    return lost


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, kept (the remaining words joined by one space), n_words, n_removed of every document."""
    lost = repeats(docs, window, seed, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(lost, (rows["doc_id"] == lost["doc"]) & (F.xxhash64("text") == lost["t"]), "left")

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                kept, n_words, n_removed = [], [], []
                for text, gone in zip(utf8(part.column(1)), part.column(2).to_pylist()):
                    words = text.split()  # bytes: exactly the separators above
                    n_words.append(len(words))
                    if gone:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, [s["from"] for s in gone], 1)
                        np.add.at(change, [s["to"] for s in gone], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                    kept.append(b" ".join(words))
                    n_removed.append(n_words[-1] - len(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()),
                     pa.array(n_removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])
    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, kept string, n_words long, n_removed long")


def op6(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50),
runs AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
owners AS (SELECT h, min(doc_id) AS owner FROM runs GROUP BY h),
gone AS (SELECT doc_id, i FROM runs JOIN owners USING (h) WHERE owner < doc_id),
edges AS (
  SELECT doc_id, i, sum(d) AS d
  FROM (SELECT doc_id, i, 1 AS d FROM gone UNION ALL SELECT doc_id, i + 50, -1 FROM gone) GROUP BY doc_id, i),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
marked AS (
  SELECT p.doc_id, p.i, p.word, sum(coalesce(e.d, 0)) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS depth
  FROM placed p LEFT JOIN edges e ON e.doc_id = p.doc_id AND e.i = p.i),
cut AS (
  SELECT doc_id, count(*) FILTER (WHERE depth > 0) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE depth = 0) AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""
