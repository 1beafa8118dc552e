"""Line dedup (8): a sharded minimal perfect hash over line hashes, probed by the documents.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except those of the largest
doc_id that holds the key.

1. Documents emit each of their long keys once as a 128-bit hash; one aggregation with map-side combine gives a key's
   document count and last document. A line that a third of all documents share is a few partial rows a task.
2. The repeated keys' hashes are dealt to shards; each shard becomes a minimal perfect hash (levels of bit arrays)
   that indexes three arrays: 64-bit fingerprint, count and last document.
3. Documents probe the arrays. If all shards together are within ``broadcast_bytes`` (measured), every task gets them;
   beyond that, the documents' hashes are routed to the shards, hot shards salted by document, and the verdicts come
   back by doc_id. Both ways give the same rows.

Defined results: null or empty text is one empty line and is returned as an empty text; no documents give no rows;
rows that repeat a doc_id are one document; rows without doc_id never count and keep all their lines; extra columns
are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import partitions_for, read_table, stage, unstage
from fieldlens.llm.hashing import MASK, mix

STRIP = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 50_000
PROBES_PER_GROUP = 200_000
BROADCAST_BYTES = 64 << 20
LEVELS = 24


def _hashes(text: str | None, min_chars: int) -> tuple[list[str], list[int], list[bytes]]:
    """Lines of a text, the numbers of those with a long key, and these keys' 16-byte hashes."""
    from xxhash import xxh3_128_digest
    lines = (text or "").split("\n")
    which, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(STRIP)) >= min_chars:
            which.append(i)
            keys.append(xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, which, keys


def _pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)


# ------------------------------------------------------------------ minimal perfect hash
def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & MASK)
    return (mix(keys + step) % np.uint64(size)).astype(np.int64)


def build_mphf(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct uint64 keys: (size of each level, packed bits of all levels, the keys that no
    level placed, the slot of each key). A key's slot is the rank of its bit; unplaced keys follow in sorted order."""
    slots, rest, sizes, bits = np.full(len(keys), -1, np.int64), np.arange(len(keys)), [], []
    at = np.zeros(len(keys), np.int64)
    base = 0
    for level in range(LEVELS):
        if not len(rest):
            break
        size = -(-max(64, int(1.4 * len(rest))) // 8) * 8
        pos = _place(keys[rest], level, size)
        alone = np.bincount(pos, minlength=size)[pos] == 1
        mark = np.zeros(size, bool)
        mark[pos[alone]] = True
        at[rest[alone]] = base + pos[alone]
        slots[rest[alone]] = 0
        bits.append(mark)
        sizes.append(size)
        base += size
        rest = rest[~alone]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(flat) - 1
    placed = slots == 0
    slots[placed] = rank[at[placed]]
    order = rest[np.argsort(keys[rest])]
    slots[order] = int(flat.sum()) + np.arange(len(order))
    return sizes, np.packbits(flat), keys[order], slots


class Shard:
    """One shard's perfect hash and its arrays."""

    def __init__(self, row):
        self.sizes = list(row["sizes"])
        packed = np.frombuffer(row["bits"], np.uint8)
        self.packed = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))
        self.rest = np.frombuffer(row["rest"], "<u8")
        self.prints = np.frombuffer(row["prints"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.last = np.frombuffer(row["last"], "<i8")

    def probe(self, index: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for one that isn't in the shard."""
        slot, todo, base = np.full(len(index), -1, np.int64), np.arange(len(index)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            pos = base + _place(index[todo], level, size)
            byte, bit = pos >> 3, pos & 7
            hit = (self.packed[byte] >> (7 - bit).astype(np.uint8)) & 1 == 1
            head = self.packed[byte[hit]] >> (8 - bit[hit]).astype(np.uint16)
            slot[todo[hit]] = self.before[byte[hit]] + np.bitwise_count(head)
            todo = todo[~hit]
            base += size
        first = int(self.before[-1])
        i = np.searchsorted(self.rest, index[todo])
        while len(todo):  # keys that agree in the whole index hash stand next to each other
            same = i < len(self.rest)
            same[same] = self.rest[i[same]] == index[todo[same]]
            todo, i = todo[same], i[same]
            hit = self.prints[first + i] == prints[todo]
            slot[todo[hit]] = first + i[hit]
            todo, i = todo[~hit], i[~hit] + 1
        known = slot >= 0
        slot[known] = np.where(self.prints[slot[known]] == prints[known], slot[known], -1)
        return slot


SHARD_SCHEMA = ("shard long, sizes array<int>, bits binary, rest binary, prints binary, counts binary, last binary, "
                "load long")


def _build_shard(pdf):
    import pandas as pd
    index = pdf["h1"].to_numpy(np.int64).view(np.uint64)
    sizes, bits, rest, slots = build_mphf(index)
    arrays = {c: np.zeros(len(index), np.int64) for c in ("h2", "n_docs", "last_doc")}
    for c, a in arrays.items():
        a[slots] = pdf[c].to_numpy(np.int64)
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "sizes": sizes, "bits": bits.tobytes(),
        "rest": rest.astype("<u8").tobytes(), "prints": arrays["h2"].astype("<i8").tobytes(),
        "counts": arrays["n_docs"].astype("<i8").tobytes(), "last": arrays["last_doc"].astype("<i8").tobytes(),
        "load": int(pdf["n_docs"].sum())}])


def line_counts(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, n_docs, last_doc) of every distinct long line key."""
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, got = [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = list(dict.fromkeys(_hashes(text, min_chars)[2]))
                    got += own
                    ids += [i] * len(own)
                h = _pairs(got).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc"])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = narrow.where("doc_id is not null and text is not null").mapInArrow(emit, "h1 long, h2 long, doc long")
    ids = narrow.select("doc_id")
    if not ids.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).isEmpty():
        seen = seen.distinct()
    return seen.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))


def build_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, **cols) -> tuple[DataFrame, int]:
    """The staged shards of all keys found in at least ``min_docs`` documents, and how many shards keys go to."""
    repeated = stage(line_counts(docs, min_chars, **cols).where(F.col("n_docs") >= min_docs), "lines")
    n = partitions_for(repeated.count(), KEYS_PER_SHARD)
    dealt = repeated.withColumn("shard", F.pmod("h1", F.lit(n)).cast("long"))
    shards = stage(dealt.groupBy("shard").applyInPandas(_build_shard, SHARD_SCHEMA), "shards")
    unstage(repeated)
    return shards, n


def _drop(ids, texts, min_chars, verdict):
    """Kept text, line count and dropped count of each text; ``verdict(doc ids, hash pairs)`` gives a mask."""
    parsed = [_hashes(t, min_chars) for t in texts]
    docs = np.repeat(np.array([-1 if i is None else i for i in ids], np.int64), [len(p[1]) for p in parsed])
    named = np.repeat(np.array([i is not None for i in ids], bool), [len(p[1]) for p in parsed])
    mask = verdict(docs, _pairs([k for p in parsed for k in p[2]])) & named
    kept, n_lines, n_dropped, at = [], [], [], 0
    for lines, which, _ in parsed:
        gone = {i for i, m in zip(which, mask[at:at + len(which)]) if m}
        at += len(which)
        kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines))
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
    return kept, n_lines, n_dropped


def _probe(shards: dict, n: int, docs: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Mask of the lines to drop: keys in the index whose last document is another one."""
    drop = np.zeros(len(docs), bool)
    index, prints = pairs[:, 0], pairs[:, 1]
    home = index.view(np.int64) % n  # as pmod does
    for k, shard in shards.items():
        own = np.flatnonzero(home == k)
        slot = shard.probe(index[own], prints[own])
        hit = slot >= 0
        drop[own[hit]] |= shard.last[slot[hit]] != docs[own[hit]]
    return drop


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
               text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, plus ``_n_lines`` and ``_n_dropped``."""
    spark = docs.sparkSession
    shards, n = build_index(docs, min_chars, min_docs, id_col=id_col, text_col=text_col)
    width = sum(F.coalesce(F.length(c), F.lit(0)) for c in ("bits", "rest", "prints", "counts", "last"))
    total = shards.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    names = docs.columns
    i_id, i_text = names.index(id_col), names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()),
                           T.StructField("_n_dropped", T.LongType())])

    def rebuilt(batch, kept, n_lines, n_dropped):
        cols = list(batch.columns[:len(names)])
        cols[i_text] = pa.array(kept, pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                          [*names, "_n_lines", "_n_dropped"])

    if total <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([r.asDict() for r in shards.collect()])

        def clean(batches):
            index = {r["shard"]: Shard(r) for r in sent.value}
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    ids = part.column(i_id).cast(pa.int64()).to_pylist()
                    yield rebuilt(part, *_drop(ids, part.column(i_text).to_pylist(), min_chars,
                                               lambda d, p: _probe(index, n, d, p)))
        return docs.mapInArrow(clean, schema)

    verdicts = _routed(docs, shards, n, min_chars, id_col, text_col)
    lost = verdicts.groupBy("doc").agg(F.array_sort(F.collect_list("h")).alias("_lost"))
    joined = docs.join(lost, docs[id_col].cast("long") == lost["doc"], "left").select(*[docs[c] for c in names], "_lost")

    def apply(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column(i_id).cast(pa.int64()).to_pylist()
                gone = [set(x or ()) for x in part.column(len(names)).to_pylist()]
                whose = np.repeat(np.arange(len(ids)), [len(_hashes(t, min_chars)[1])
                                                       for t in part.column(i_text).to_pylist()])
                yield rebuilt(part, *_drop(ids, part.column(i_text).to_pylist(), min_chars, lambda d, p: np.array(
                    [p[j].tobytes() in gone[whose[j]] for j in range(len(p))], bool)))
    return joined.mapInArrow(apply, schema)


def _routed(docs, shards, n, min_chars, id_col, text_col) -> DataFrame:
    """(doc, h): the line hashes that each document loses, found at the shards."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("load") / PROBES_PER_GROUP)).cast("int")
    plan = shards.select("shard", salts.alias("salts"))

    def emit(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = list(dict.fromkeys(_hashes(text, min_chars)[2]))
                h = _pairs(keys)
                home = h[:, 0].view(np.int64) % n if len(keys) else []
                by: dict[int, list[bytes]] = {}
                for k, s in zip(keys, home):
                    by.setdefault(int(s), []).append(k)
                rows += [(s, i, b"".join(v)) for s, v in by.items() if v]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary())], ["shard", "doc", "keys"])

    def judge(left, right):
        import pandas as pd
        out = []
        if len(right):
            shard = Shard(right.iloc[0])
            for doc, blob in zip(left["doc"], left["keys"]):
                pairs = np.frombuffer(blob, "<u8").reshape(-1, 2)
                slot = shard.probe(pairs[:, 0], pairs[:, 1])
                out += [(doc, pairs[j].tobytes()) for j in np.flatnonzero(slot >= 0) if shard.last[slot[j]] != doc]
        return pd.DataFrame(out, columns=["doc", "h"])

    probes = (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
              .where("doc is not null and text is not null").mapInArrow(emit, "shard long, doc long, keys binary"))
    probes = (probes.join(F.broadcast(plan) if n <= 10_000 else plan, "shard")
              .withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")))
    tables = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return (probes.groupBy("shard", "salt").cogroup(tables.groupBy("shard", "salt"))
            .applyInPandas(judge, "doc long, h binary").distinct())


def op8(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.k IS NOT NULL AND o.last_doc <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE o.k IS NULL OR o.last_doc = doc_id), ''))
         AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY doc_id
"""
