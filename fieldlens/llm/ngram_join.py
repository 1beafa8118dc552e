"""N-gram Jaccard join (10): parity sketches, pigeonhole blocks per size band, exact verification.

A document's set is its distinct ``k``-word shingles (A-Z lower-cased; a shorter text is one shingle, a text without words
has none). Two documents link when ``den * |A & B| >= num * |A | B|``.

* Sketch. Every shingle flips one bit of a bit sketch, so the Hamming distance of two sketches is at most the size of
  the symmetric difference, which a link bounds by ``d = (den - num) / (den + num) * (|A| + |B|)``.
* Pigeonhole per size band. In a band of sizes up to T, ``d`` follows from 2T. The sketch has ``d + 1 + spare`` blocks of
  2^32 bits, nearly all zero, so a block is held as the exclusive or of the hashes of its set bits. Linked documents
  agree in at least ``spare + 1`` whole blocks. Only blocks of ``MIN_TOKENS`` shingles or more become join keys (an empty
  block is in everybody's sketch); a document with more than ``spare`` poorer blocks also joins on the shingles of its
  prefix (the ``n - ceil(t n) + 1`` least hashes), on which any two linked documents
  agree. A document near the top of its band joins the next one too. As hashes deal the differing shingles to blocks at
  random, linked documents agree in many more blocks than the guaranteed ones (``agreeing``: all but one pair in a
  thousand million), so ``need`` of a document's keys must be shared, and documents with fewer (a common line or passage
  gives some) leave before their texts are looked at.
* Copies. Documents of equal sets are one class from the start and one vertex in the join.
* Verify. First the members of a key are compared with one centre, the member whose keys are the most shared (a text
  that others were edited from), so groups of alike documents collapse. Where a key still holds several components,
  members of different ones are compared in blocks by the number of keys they share, of which linked documents have
  ``need`` or more; only such pairs go on to the exact test. All pairs of a group are never emitted.

Defined results: null, empty or blank text has an empty set and is its own component; no documents give no rows; rows
that repeat a doc_id are one document; rows without doc_id have no component; extra columns aren't read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import components, maybe_broadcast, read_table, stage, unstage
from fieldlens.llm.hashing import chunks, mix, rolling, utf8, word_hashes

MIN_TOKENS = 2
GROWTH = 1.5
SIGMAS = 6
BLOCK = 128
#: Keys that a part of a key's members holds about (512 KB): a member is sent once for each part of its key.
KEYS_PER_PART = 1 << 16
ROWS_PER_GROUP = 4_000


def band_tops(largest: int) -> np.ndarray:
    """Top size of each band, up to the first that holds ``largest``."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    return np.array(tops)


def blocks_of(top: int, num: int, den: int) -> tuple[int, int]:
    """(number of blocks, spare) for sizes up to ``top``."""
    d = (den - num) * 2 * top // (den + num)
    spare = d // 5 + 2
    return d + 1 + spare, spare


def agreeing(blocks: int, d: int) -> int:
    """Blocks that ``d`` differing shingles leave alone, at least: mean less ``SIGMAS`` standard deviations of balls
    thrown into bins (below that with a probability of about 1e-9)."""
    mean = blocks * (1 - 1 / blocks) ** d if blocks > 1 else 0.0
    both = blocks * (blocks - 1) * (1 - 2 / blocks) ** d if blocks > 2 else 0.0
    return math.floor(mean - SIGMAS * math.sqrt(max(0.0, both + mean - mean * mean)))


def join_keys(shingles: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Join keys of a set of shingle hashes (sorted, distinct), and how many of them any linked set has too, at least."""
    n = len(shingles)
    tops = band_tops(n)
    own = tops[np.searchsorted(tops, n)]
    bands = [int(own)]
    if n * den >= own * num:  # a partner of up to n * den / num shingles may be in the next band
        bands.append(max(int(own) + 1, int(own * GROWTH)))
    out, need = [], n
    for top in bands:
        blocks, spare = blocks_of(top, num, den)
        block = ((shingles >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)  # ascending
        start = np.flatnonzero(np.diff(block, prepend=-1))
        rich = np.diff(start, append=n) >= MIN_TOKENS
        words = np.bitwise_xor.reduceat(mix(shingles & np.uint64(0xFFFFFFFF)), start)
        place = block[start].astype(np.uint64) + np.uint64(top << 24)
        out.append(mix(words[rich] + mix(place[rich])))
        untouched = agreeing(blocks, (den - num) * (n + n * den // num) // (den + num))
        need = min(need, max(spare + 1, untouched) - (blocks - int(rich.sum())))
    if need < 1:
        prefix = n - -(-n * num // den) + 1
        out.append(mix(shingles[:prefix] ^ np.uint64(0x5DEECE66D)))
    return np.concatenate(out), max(1, need)


def _sets(batch: pa.RecordBatch, k: int):
    """(index, sorted distinct shingle hashes) of each text of a batch."""
    texts = [t.lower() for t in utf8(batch.column(1))]  # bytes: A-Z only
    for lo, hi in chunks(texts):
        (h,), first, _, _ = word_hashes(texts[lo:hi])
        for i in range(hi - lo):
            words = h[first[i]:first[i + 1]]
            width = min(k, len(words))
            yield lo + i, np.unique(rolling(words, width) + np.uint64(width)) if width else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc, n, s1, s2, need, keys): set size, 128-bit hash of the set, join keys and how many a partner shares."""
    names = ["doc", "n", "s1", "s2", "need", "keys"]

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, size = [], 0
            for i, s in _sets(batch, k):
                keys, need = join_keys(s, num, den) if len(s) else (s, 0)
                rows.append((ids[i], len(s), int(mix(s).sum().view(np.int64)),
                             int(mix(s ^ np.uint64(0xA5A5A5A5)).sum().view(np.int64)), need, keys.view(np.int64)))
                size += len(keys)
                if size > 200_000:
                    yield _rows(rows, names)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, names)
    return docs.mapInArrow(emit, "doc long, n long, s1 long, s2 long, need long, keys array<long>")


def _rows(rows, names) -> pa.RecordBatch:
    head = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:-1]]
    ends = np.cumsum([0, *(len(r[-1]) for r in rows)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[-1] for r in rows]), pa.int64()))
    return pa.RecordBatch.from_arrays([*head, lists], names)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, s): the shingle hashes themselves, for verification."""
    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, size = [], 0
            for i, s in _sets(batch, k):
                rows.append((ids[i], s.view(np.int64)))
                size += len(s)
                if size > 200_000:
                    yield _rows(rows, ["doc", "s"])
                    rows, size = [], 0
            if rows:
                yield _rows(rows, ["doc", "s"])
    return docs.mapInArrow(emit, "doc long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy the bound exactly."""
    left = sets.select(F.col("doc").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
            .where(F.col("both") * den >= (F.col("sum") - F.col("both")) * num).select("a", "b"))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document id."""
    if num * GROWTH < den:
        raise ValueError("similarities below 1 / GROWTH would need wider bands")
    narrow = (docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
              .where("doc is not null"))
    drawn = stage(sketches(narrow, k, num, den), "sketches")
    # One vertex for each distinct set: the smallest document that has it.
    classes = stage(drawn.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc")).distinct()
    keyed = (drawn.where("n > 0").join(maybe_broadcast(reps, classes.count()), "doc", "left_semi")
             .select(F.explode("keys").alias("key"), "doc"))
    common = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    shared = stage(keyed.join(common, "key"), "shared")
    needs = drawn.where("n > 0").groupBy("doc").agg(F.max("n").alias("n"), F.min("need").alias("need"))
    enough = (shared.groupBy("doc").agg(F.count_distinct("key").alias("have")).join(needs, "doc")
              .where("have >= need").select("doc", "n", "need"))
    members = stage(shared.join(enough, "doc").select("key", "doc", "n", "need").distinct(), "members")
    unstage(shared)
    comp = _link(narrow, members, k, num, den)
    unstage(members)
    out = (drawn.select("doc", "n", "s1", "s2").groupBy("doc").agg(F.max("n").alias("n"), F.min(F.struct("s1", "s2"))
                                                                  .alias("s"))
           .select("doc", "n", "s.*"))
    reps = classes.select("s1", "s2", "rep")
    if comp is not None:
        reps = reps.join(comp, reps["rep"] == comp["id"], "left").select(
            "s1", "s2", F.coalesce("component", "rep").alias("rep"))
    return (out.join(reps, ["s1", "s2"], "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("rep", "doc")).otherwise(F.col("doc")).alias("component_id")))


def _link(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """(id, component) of the vertices that have links; None if there are no candidates."""
    wanted = stage(members.select("doc").distinct().withColumnRenamed("doc", "_w"), "wanted")
    n_wanted = wanted.count()
    if not n_wanted:
        return None
    sets = stage(shingle_sets(docs.join(maybe_broadcast(wanted, n_wanted), F.col("doc") == F.col("_w"), "left_semi"),
                              k), "sets")
    if sets.count() > n_wanted:  # rows that repeat a doc_id
        sets, rows = stage(sets.dropDuplicates(["doc"]), "sets"), sets
        unstage(rows)
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    # From here on a key begins with its number of members, so that rare keys come first in its order.
    rarer = F.shiftleft(F.least("size", F.lit((1 << 19) - 1)), 43).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 43) - 1)))
    sized = stage(members.join(sizes, "key").select(rarer.alias("key"), "doc", "n", "need", "size").distinct(), "sized")
    unstage(wanted)

    # First every member against one centre of its key: the member whose keys are the most shared.
    scores = sized.groupBy("doc").agg(F.sum("size").alias("score"))
    centres = (sized.join(scores, "doc").groupBy("key")
               .agg(F.max_by(F.struct(F.col("doc").alias("b"), F.col("n").alias("nb")),
                             F.struct("score", -F.col("doc"))).alias("c")).select("key", "c.*"))
    pairs = (sized.join(centres, "key").where("doc <> b")
             .where(F.least("n", "nb") * den >= F.greatest("n", "nb") * num)
             .select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct())
    edges = stage(verified(pairs, sets, num, den), "edges")
    comp = components(edges)

    # Then the members of different components, where a key still holds several.
    more = stage(_across(sized, comp, sets, num, den), "edges")
    unstage(sized, sets)
    if not more.isEmpty():
        comp = components(edges.unionByName(more))
    unstage(edges, more)
    return comp


def _across(sized: DataFrame, comp: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of a key that are in different components.

    A document's keys in order of the number of members: linked documents share ``need`` of them, so also one of the
    first ``have - need + 1``, and only those rare ones are looked at; each pair once, at its rarest common key. A key's members are
    dealt to parts of about ``KEYS_PER_PART`` keys, every two parts meet in one task, and are compared there in squares of
    ``BLOCK`` members: first by counting shared keys, which leaves the members that reach ``need`` with another one, then these
    by their sets. Both comparisons stay inside a task; only members and links come out.
    """
    rare = Window.partitionBy("doc").orderBy("key")
    whole = Window.partitionBy("doc")
    named = (sized.join(comp, sized["doc"] == comp["id"], "left")
             .select("key", "doc", "n", "need", F.coalesce("component", "doc").alias("component"),
                     F.row_number().over(rare).alias("r"), F.count("*").over(whole).alias("have")))
    first = stage(named.where(F.col("r") <= F.col("have") - F.col("need") + 1), "rare")
    still = (first.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                      F.ceil(F.sum("have") / KEYS_PER_PART).cast("int").alias("parts"))
             .where("x < y").select("key", "parts"))
    lists = sized.groupBy("doc").agg(F.collect_list("key").alias("keys"))  # one document's own keys
    dealt = (first.join(still, "key").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", "doc", "n", "need", "component", "part", F.least("part", "other").alias("i"),
                     F.greatest("part", "other").alias("j")))
    groups = max(1, math.ceil(dealt.count() / ROWS_PER_GROUP))
    dealt = dealt.join(lists, "doc")

    def near(key, lists, c, n, need, a, b):
        """Which of the members ``a`` and ``b`` (places, ascending) share enough keys with one of the others."""
        rows = np.union1d(a, b)
        left, right = np.searchsorted(rows, a), np.searchsorted(rows, b)
        whose = np.repeat(np.arange(len(rows)), [len(lists[r]) for r in rows])
        known, code, count = np.unique(np.concatenate([lists[r] for r in rows]), return_inverse=True, return_counts=True)
        often = count > 1
        column = np.cumsum(often) - 1
        hit = often[code]
        m = np.zeros((len(rows), int(often.sum())), np.float32)
        m[whose[hit], column[code[hit]]] = 1
        ok = m[left] @ m[right].T >= np.maximum(need[a][:, None], need[b][None, :])
        ok &= c[a][:, None] != c[b][None, :]
        # A pair is looked at where its rarest common key is.
        before = m[:, :int(often[:np.searchsorted(known, key)].sum())]
        ok &= before[left] @ before[right].T == 0
        ok &= np.minimum(n[a][:, None], n[b][None, :]) * den >= np.maximum(n[a][:, None], n[b][None, :]) * num
        return a[ok.any(axis=1)], b[ok.any(axis=0)]

    def compare(pdf):
        """A part's members against another's in squares of ``BLOCK``; a square's members come out with its number."""
        import pandas as pd
        out = []
        for (key, i, j), g in pdf.groupby(["key", "i", "j"], sort=False):
            c, n, need, doc, part = (g[x].to_numpy() for x in ("component", "n", "need", "doc", "part"))
            lists = g["keys"].tolist()
            sides = [np.flatnonzero(part == x) for x in (i, j)]
            for x in range(0, len(sides[0]), BLOCK):
                for y in range(x if i == j else 0, len(sides[1]), BLOCK):
                    a, b = sides[0][x:x + BLOCK], sides[1][y:y + BLOCK]
                    if (c[a] == c[a[0]]).all() and (c[b] == c[a[0]]).all():
                        continue
                    a, b = near(key, lists, c, n, need, a, b)
                    places = (np.int64(i) << 32) + x // BLOCK, (np.int64(j) << 32) + y // BLOCK
                    for own, rows in zip(places, (a, b) if places[0] < places[1] else (np.union1d(a, b),)):
                        out.append(pd.DataFrame({"key": key, "doc": doc[rows], "component": c[rows], "part": own,
                                                 "i": places[0], "j": places[1]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["key", "doc", "component", "part", "i", "j"])

    def link(pdf):
        import pandas as pd
        out = [np.zeros((2, 0), np.int64)]
        for (_, i, j), g in pdf.groupby(["key", "i", "j"], sort=False):
            c, own, ids = (g[x].to_numpy() for x in ("component", "part", "doc"))
            lists = g["s"].tolist()
            n = np.array([len(x) for x in lists])
            _, code = np.unique(np.concatenate(lists), return_inverse=True)
            ends = np.concatenate(([0], np.cumsum(n)))
            right = np.flatnonzero(own == j)
            codes = np.concatenate([code[ends[r]:ends[r + 1]] for r in right]) if len(right) else code[:0]
            starts = np.concatenate(([0], np.cumsum(n[right])))[:-1]
            mark = np.zeros(int(code.max()) + 1, np.int32)
            for x in np.flatnonzero(own == i) if len(right) else ():
                mine = code[ends[x]:ends[x + 1]]
                mark[mine] = 1
                both = np.add.reduceat(mark[codes], starts)
                mark[mine] = 0
                y = right[(both * den >= (n[x] + n[right] - both) * num) & (c[right] != c[x])]
                out.append(np.stack((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]))))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))
    some = stage(dealt.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        compare, "key long, doc long, component long, part long, i long, j long"), "near")
    unstage(first)
    bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, math.ceil(some.count() / (ROWS_PER_GROUP // 8)))))
    out = (some.join(sets, "doc").withColumn("bucket", bucket).groupBy("bucket")
           .applyInPandas(link, "a long, b long").distinct())
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that aren't the smallest doc_id of their group; of rows that repeat a kept doc_id and
    its text one stays (its other texts stay too), rows without doc_id stay."""
    gone = "_lost_" + uuid.uuid4().hex  # no column of docs
    lost = stage(ngram_components(docs, k, num, den, id_col, text_col).where("component_id <> doc_id")
                 .select(F.col("doc_id").alias(gone)), "lost")
    kept = docs.join(maybe_broadcast(lost, lost.count()), docs[id_col].cast("long") == lost[gone], "left_anti")
    again = docs.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1))
    if not again.isEmpty():
        kept = (kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
                .unionByName(kept.where(F.col(id_col).isNull())))
    return kept


def op10(spark, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT s.b, reach.r FROM reach JOIN sym s ON s.a = reach.v WHERE reach.r < s.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.r AS component_id
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON m.v = d.doc_id
"""
