"""Packing (1): non-negative least squares over a length histogram.

1. Tokenise every text; cut it at whole windows, so a document is some full windows and one remainder. The pieces with
   their ids are staged (``tokens``); planning reads only the lengths.
2. The histogram of piece lengths (at most ``window`` counts, whatever the corpus) is all the driver gets. It enumerates
   pairs and triples of lengths that fill a window exactly, solves for non-negative repeat counts that reproduce the
   histogram, rounds them down, and packs the residual greedily, longest first, a pattern at a time.
3. The recipe (a few thousand rows at most) is broadcast. Pieces are ranked within their length in blocks dealt by hash,
   so one very common length is many blocks, and the rank picks the sequence and the place in it.

A sequence is padded to the window unless its length is a power of two.

Defined results: a null or empty text is the closing id alone; no documents give no rows; rows that repeat a doc_id are
packed each for itself; rows without doc_id are packed too; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import read_table, stage
from fieldlens.llm.hashing import process_state

WINDOW = 2048
END_ID = 1
ROWS_PER_BLOCK = 2_000
CACHE_WORDS = 600_000
TOKENIZER = "word_bpe_49k.json"
_TAIL = b".,!?;:%$&*#|"
TOKEN_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


# ------------------------------------------------------------------ tokens
class WordTokenizer:
    """Ids of whole texts, looked up per space-separated word.

    For tokenizers that lower the case and drop white space (so that no token spans it). Words are cached, and a
    word's closing ASCII punctuation is encoded apart: the tokenizer splits between a letter and such a sign itself.
    Added tokens (``<|endoftext|>``), as written, are single ids and part the text, as in a plain call of the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab()
        added = {a.content: i for i, a in self.model.get_added_tokens_decoder().items()}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # words not seen for a while; dropped when ``recent`` fills again

    def _learn(self, words: set[bytes]) -> None:
        if len(self.recent) > CACHE_WORDS:
            self.recent, self.older = {}, self.recent
        recent, older, parts, need = self.recent, self.older, {}, set()
        for w in words:
            if (ids := older.get(w)) is not None:
                recent[w] = ids
                continue
            core = w.rstrip(_TAIL)
            if len(core) == len(w) or not core or not 97 <= core[-1] <= 122:
                need.add(w)
                continue
            parts[w] = core
            for x in (core, w[len(core):]):
                if x not in recent:
                    if (ids := older.get(x)) is not None:
                        recent[x] = ids
                    else:
                        need.add(x)
        recent.update(self._ids(need))
        for w, core in parts.items():
            recent[w] = recent[core] + recent[w[len(core):]]

    def _ids(self, words: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each word. Words of letters only are encoded many in one text: each ends with a closing token."""
        text = [(w, w.decode()) for w in words]
        single = [x for x in text if not x[1].isalpha()]
        letters = [x for x in text if x[1].isalpha()] if self.closes.any() else []
        runs = [letters[i:i + 100] for i in range(0, len(letters), 100)]
        for run, e in zip(runs, self.model.encode_batch_fast([" ".join(x[1] for x in r) for r in runs],
                                                             add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.closes[ids])
            if len(cut) != len(run):  # a sign that Python takes for a letter and the tokenizer doesn't
                single += run
                continue
            whole, at = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
            for (w, _), lo, hi in zip(run, at, at[1:]):
                yield w, whole[lo:hi]
        for (w, _), e in zip(single, self.model.encode_batch_fast([x[1] for x in single], add_special_tokens=False)):
            yield w, array("I", e.ids).tobytes()

    def _encode(self, text: str) -> bytes:
        words = text.encode().lower().split()
        ids = list(map(self.recent.get, words))
        if missing := [i for i, x in enumerate(ids) if x is None]:
            self._learn({words[i] for i in missing})
            for i in missing:
                ids[i] = self.recent[words[i]]
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Native 32-bit ids of each text."""
        out = []
        for t in texts:
            if any(x in t for x in self.added):
                out.append(b"".join(self.added.get(x) or self._encode(x) for x in self.parts.split(t)))
            else:
                out.append(self._encode(t))
        return out


def tokens(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Staged pieces: doc_id, start, length, doc_tokens, ids (32-bit, little-endian) and ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]):
        state = process_state("tokenizers")
        model = state.setdefault(tokenizer, None) or WordTokenizer(tokenizer)
        state[tokenizer] = model
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), model.encode(texts)):
                    ids += end
                    for at in range(0, len(ids), 4 * window):
                        piece = ids[at:at + 4 * window]
                        rows.append((doc, at // 4, len(piece) // 4, len(ids) // 4, piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.binary(),))],
                    ["doc_id", "start", "length", "doc_tokens", "ids"])
    cut_up = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
              .mapInArrow(cut, TOKEN_SCHEMA))
    return stage(cut_up.withColumn("ids_crc32", F.crc32("ids")), "tokens")


# ------------------------------------------------------------------ recipe
def combinations(counts: np.ndarray, window: int, deep: int = 48) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill the window exactly: every pair of lengths that occur, and the
    triples that begin with two of the ``deep`` most frequent lengths."""
    there = counts > 0
    lengths = np.flatnonzero(there)
    found = [(int(a), window - int(a), 0) for a in lengths if 2 * a <= window and there[window - a]]
    often = lengths[np.argsort(-counts[lengths], kind="stable")][:deep]
    triples = {tuple(sorted((int(a), int(b), int(window - a - b)))) for a in often for b in often
               if window - a - b > 0 and there[window - a - b]}
    return np.array(found + sorted(triples), dtype=np.int64).reshape(-1, 3)


def solve_counts(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - counts|^2 (projected gradient with momentum; A has the
    lengths of each combination)."""
    if not len(combos):
        return np.zeros(0)
    goal = counts.astype(float)
    goal[0] = 0

    def use(x):
        u = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=len(counts))
        u[0] = 0
        return u
    degree = use(np.ones(len(combos)))
    step = 1 / (3 * max(1.0, degree.max()))  # |A|^2 is at most its largest row sum times its largest column sum
    x = y = np.zeros(len(combos))
    pace = 1.0
    for _ in range(rounds):
        gap = use(y) - goal
        nxt = np.maximum(0, y - step * gap[combos].sum(axis=1))
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y, x, pace = nxt + (pace - 1) / faster * (nxt - x), nxt, faster
    return x


def recipe(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using every piece of the histogram once."""
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    share = solve_counts(combos, left)
    for i in np.argsort(-share, kind="stable"):
        lengths = [int(v) for v in combos[i] if v]
        need = np.bincount(lengths, minlength=len(left))
        n = min(int(share[i]), *(int(left[v] // need[v]) for v in lengths))
        if n > 0:
            out.append((tuple(lengths), n))
            left -= n * need
    while left.any():
        pattern, room, free = [], window, left.copy()
        while room:
            fits = np.flatnonzero(free[:room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            pattern.append(v)
            free[v] -= 1
            room -= v
        need = np.bincount(pattern, minlength=len(left))
        n = min(int(left[v] // need[v]) for v in pattern)
        out.append((tuple(pattern), n))
        left -= n * need
    return out


def _places(plan) -> list[tuple]:
    """(length, first rank, end rank, first sequence, uses of the length, their offsets, sequence length)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in plan:
        at, offsets = 0, {}
        for v in lengths:
            offsets.setdefault(v, []).append(at)
            at += v
        for v, o in offsets.items():
            lo = used.get(v, 0)
            used[v] = lo + n * len(o)
            rows.append((v, lo, used[v], sequence, len(o), o, at))
        sequence += n
    return rows


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length and others) with sequence_id, offset, sequence_tokens, padded_tokens."""
    spark = pieces.sparkSession
    histogram = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row per length up to the window
        histogram[length] = n
    rows = _places(recipe(histogram, window))
    places = spark.createDataFrame(rows, "length long, lo long, hi long, first_sequence long, uses long, "
                                         "offsets array<long>, sequence_tokens long")
    blocks = spark.createDataFrame([(v, math.ceil(n / ROWS_PER_BLOCK)) for v, n in enumerate(histogram.tolist()) if n],
                                   "length long, _blocks long")
    cut = (pieces.join(F.broadcast(blocks), "length")
           .withColumn("_block", F.pmod(F.xxhash64("doc_id", "start"), F.col("_blocks"))))
    sizes = cut.groupBy("length", "_block").count()
    before = sizes.withColumn("_before", F.sum("count").over(
        Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (cut.withColumn("_own", F.row_number().over(
        Window.partitionBy("length", "_block").orderBy("doc_id", "start", "ids_crc32")))
        .join(before.select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before")),
              ["length", "_block"])
        .withColumn("_rank", F.col("_before") + F.col("_own") - 1))
    i = F.col("_rank") - F.col("lo")
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return (ranked.join(F.broadcast(places), "length").where("_rank >= lo and _rank < hi")
            .withColumn("sequence_id", F.col("first_sequence") + F.floor(i / F.col("uses")))
            .withColumn("offset", F.element_at("offsets", (i % F.col("uses") + 1).cast("int")))
            .withColumn("padded_tokens", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(window).cast("long")))
            .select(*pieces.columns, "sequence_id", "offset", "sequence_tokens", "padded_tokens"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
                   with_ids: bool = False, **cols) -> DataFrame:
    """One row per piece with its place; ``with_ids`` carries the ids themselves along."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path(TOKENIZER)
    pieces = tokens(docs, tokenizer, window, end_id, **cols)
    return pack(pieces if with_ids else pieces.drop("ids"), window)


def op1(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                      "sequence_tokens", "padded_tokens")
