"""SentencePiece encoding and decoding (11) for merge-type (BPE) vocabularies, by a score-ordered agenda of pairs.

1. The model file is read on the driver (its few thousand pieces, scores and flags) and broadcast; no executor opens it.
2. A text is put in the model's form (spaces become U+2581, one is put in front) and cut where no piece of the vocabulary
   reaches across: before a run of U+2581, if no piece holds one after another sign, around signs that occur in no longer
   piece, and between a letter and a sign that follows a letter in no piece. So the parts' merges don't touch each other, and a part's ids may be remembered (``CACHE_PARTS``).
3. Within a part, an agenda holds the adjacent pairs of symbols that are a piece, highest score first, ties by the place
   further left. Its top is merged, and the new symbol's two pairs come in. The new short parts of a batch go side by
   side, a row of ranks each; a long part has a heap. Pieces marked unused are taken apart again as they were merged. Symbols outside the vocabulary
   become bytes, or the unknown id (one for a run of them) where the model has no bytes.
4. Every Arrow batch is encoded and decoded by the sentencepiece library too; ``agrees`` says whether both are equal.

Defined results: a null text is encoded as an empty one; null ids decode to null; an empty table gives no rows; rows
aren't compared, so ties and repeated rows come back as they are; other columns pass through whatever their names. The
texts are whole: a part that can't be cut (a very long text without a space) is one agenda, some 300 bytes a sign.
Models that aren't merge-type, have a normalisation table, user-defined pieces, or strip or suffix spaces are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import read_table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts whose ids a worker remembers: about twice as many at most, besides those of one slice of ``CHECK_SIGNS``.
CACHE_PARTS = 150_000
#: Signs up to which parts are merged side by side, in groups of so many, and remembered; longer ones have a heap.
SHORT, ROWS = 40, 20_000
NONE = 1 << 30
#: Signs of text that go to the library at once.
CHECK_SIGNS = 4_000_000

# Fixed values of the model file's format: field numbers of the message and the kinds of pieces and models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def model_bytes(model: str = MODEL) -> bytes:
    """The model file's content; ``model`` is a path or the name of a public tokenizer."""
    import os

    import public_tokenizers
    with open(model if os.path.exists(model) else public_tokenizers.path(model), "rb") as f:
        return f.read()


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at:at + size]
        at += size


def packed(i: int) -> bytes:
    return i.to_bytes(4, "little")


class Vocabulary:
    """A merge-type model: encodes and decodes as the library does."""

    def __init__(self, data: bytes):
        top = list(message(data))
        trainer = dict(kv for f, v in top if f == TRAINER for kv in message(v))
        form = dict(kv for f, v in top if f == NORMALIZER for kv in message(v))
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("not a merge-type (BPE) model")
        if form.get(2) or form.get(6) or form.get(4, 1) or not form.get(5, 1) or trainer.get(24):
            raise ValueError("the model normalises texts, strips spaces or puts them last: not supported")
        self.prefix = bool(form.get(3, 1))
        pieces = [dict(message(v)) for f, v in top if f == PIECES]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if USER_DEFINED in kinds:
            raise ValueError("user-defined pieces are not supported")
        names = [p.get(1, b"").decode() for p in pieces]
        self.scores = [float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0 for p in pieces]
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k in (NORMAL, UNUSED)}
        self.costs = {n: -self.scores[i] for n, i in self.ids.items()}
        self.unused = {n for n, k in zip(names, kinds) if k == UNUSED}
        self.packed = {n: packed(i) for n, i in self.ids.items()}
        self.unknown = packed(kinds.index(UNKNOWN))
        self.bytes = [packed(i) for i, k in enumerate(kinds) if k == BYTE] if trainer.get(35) else []
        self.bos, self.eos = packed(trainer.get(41, 1)), packed(trainer.get(42, 2))
        surface = trainer.get(44, b" \xe2\x81\x87 ")
        texts = [b"" if k == CONTROL else surface if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE
                 else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds)]
        self.n_bytes = np.array([len(t) for t in texts])
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.all_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.control = np.array([k == CONTROL for k in kinds])
        self.spaced = np.array([n.startswith(SPACE) and k not in (CONTROL, BYTE) for n, k in zip(names, kinds)])
        self.parts = self._cuts()
        self._tables()
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cuts(self) -> re.Pattern:
        long = [n for n in self.ids if len(n) > 1]
        joined = set("".join(long))
        signs = joined - {SPACE}

        def one_of(some):
            return "[" + "".join(re.escape(c) for c in sorted(some)) + "]"
        if not signs:
            return re.compile(f"{SPACE}+|.", re.S)
        if any(SPACE in n.lstrip(SPACE) for n in long):
            return re.compile(f"{one_of(joined)}+|.", re.S)
        letters = {c for c in signs if c.isalpha()}
        after_letter = {b for n in long for a, b in zip(n, n[1:]) if a in letters}
        # Letters end a part before a sign that no piece has right after a letter.
        words = [f"{SPACE}*{one_of(signs - letters)}*+{one_of(letters)}++(?={one_of(signs - after_letter)})"] \
            if letters and signs - letters and signs - after_letter else []
        return re.compile("|".join([*words, f"{SPACE}*{one_of(signs)}+", f"{SPACE}+", "."]), re.S)

    def merge(self, part: str) -> list[str]:
        """The symbols of a part after all merges, in order."""
        symbols, apart = list(part), {}
        if len(symbols) > 1:
            self._merge(symbols, apart)
        if not apart:
            return [s for s in symbols if s]
        out = []
        for s in symbols:
            todo = [s] if s else []
            while todo:
                s = todo.pop()
                if s in apart:
                    todo += [apart[s][1], apart[s][0]]
                else:
                    out.append(s)
        return out

    def _merge(self, symbols: list[str], apart: dict):
        """The agenda is a heap; merged symbols leave an empty one behind, stale entries are passed over."""
        n, costs = len(symbols), self.costs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []

        def add(left: int, right: int):
            both = symbols[left] + symbols[right]
            if both in costs:
                heapq.heappush(agenda, (costs[both], left, right, both))
        for p in range(n - 1):
            add(p, p + 1)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != both:
                continue
            if both in self.unused:
                apart[both] = symbols[left], symbols[right]
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                add(left, after[left])
            if before[left] >= 0:
                add(before[left], left)

    def _tables(self):
        """Arrays for ``merge_many``: a number for each symbol, the pairs of symbols that make a piece, sorted."""
        signs = sorted(set("".join(self.ids)))
        names = [*self.ids, *(c for c in signs if c not in self.ids)]
        number = {n: k for k, n in enumerate(names)}
        self.n_symbols = len(names)
        self.sign = np.full(0x110000, -1, np.int64)
        for c in signs:
            self.sign[ord(c)] = number[c]
        rank = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        pairs = sorted((number[n[:k]] * self.n_symbols + number[n[k:]], number[n], rank[self.costs[n]])
                       for n in self.ids for k in range(1, len(n)) if n[:k] in number and n[k:] in number)
        none = (1 << 62, -1, NONE)  # what a pair outside the table finds
        self.pair, self.made, self.rank = (np.array(c, np.int64) for c in zip(*pairs, none))
        # Where no two pieces share a score, the rank says which piece is made.
        self.made_by = None
        if len(rank) == len(self.ids):
            self.made_by = np.zeros(len(rank), np.int32)
            self.made_by[[rank[self.costs[n]] for n in self.ids]] = [number[n] for n in self.ids]
        out = [self.packed.get(n) or self._outside(n) for n in names]
        self.n_ids = np.array([len(o) // 4 for o in out])
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.symbol_ids = np.frombuffer(b"".join(out), "<u4")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the score, symbol made) of adjacent symbols; NONE where they are no piece."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n_symbols + right, -1)
        at = np.searchsorted(self.pair, key)
        at[self.pair[at] != key] = len(self.pair) - 1
        return self.rank[at], self.made[at]

    def merge_many(self, parts: list[str]) -> list[bytes]:
        """Packed ids of parts whose signs all occur in pieces. Every row has its own agenda, the ranks of its adjacent
        pairs in order; a round merges the first of the best ranked pairs of every row that has one."""
        n = len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, n)
        width = int(sizes.max()) + 1  # a column of none at the end
        symbols = np.full((n, width), -1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        symbols[inside] = self.sign[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        agenda = self._rank(symbols[:, :-1], symbols[:, 1:])[0].astype(np.int32)
        place = np.arange(width - 1)
        rows = np.arange(n)  # that may still have a pair
        while len(rows):
            at = agenda.argmin(axis=1)
            own = np.arange(len(rows))
            best = agenda[own, at]
            some = best < NONE
            if not some.all():
                rows, at, agenda, best = rows[some], at[some], agenda[some], best[some]
                own = np.arange(len(rows))
                if not len(rows):
                    break
            now = symbols[rows]
            made = self.made_by[best] if self.made_by is not None else self._rank(now[own, at], now[own, at + 1])[1]
            moved = place > at[:, None]  # one place to the left
            now[:, :-1] = np.where(moved, now[:, 1:], now[:, :-1])
            now[own, at] = made
            now[:, -1] = -1
            symbols[rows] = now
            agenda[:, :-1] = np.where(moved[:, :-1], agenda[:, 1:], agenda[:, :-1])
            agenda[:, -1] = NONE
            agenda[own, at] = self._rank(now[own, at], now[own, at + 1])[0]
            before = at > 0
            agenda[own[before], at[before] - 1] = self._rank(now[own[before], at[before] - 1], now[own[before], at[before]])[0]
        flat = symbols[symbols >= 0]
        many = self.n_ids[flat]
        starts = np.repeat(self.first_id[flat] - (np.cumsum(many) - many), many)
        data = self.symbol_ids[starts + np.arange(len(starts))].tobytes()
        held = np.add.reduceat(many, np.concatenate(([0], np.cumsum((symbols >= 0).sum(axis=1))[:-1])))
        ends = (4 * np.cumsum(held)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def part_ids(self, part: str) -> bytes:
        """Packed ids of one part."""
        return b"".join([self.packed.get(s) or self._outside(s) for s in self.merge(part)])

    def learn(self, parts: set[str]):
        """Have the ids of all parts in ``newer``. Parts remembered are in two generations: the older one goes when the
        newer is full."""
        if len(self.newer) > CACHE_PARTS:
            self.older, self.newer = self.newer, {}
        newer, older = self.newer, self.older
        short: dict[int, list[str]] = {}
        for p in parts.difference(newer):
            if p in older:
                newer[p] = older[p]
            elif 1 < len(p) <= SHORT and not self.unused:
                short.setdefault((len(p) + 3) // 4, []).append(p)
            else:
                newer[p] = self.part_ids(p)
        for some in short.values():
            for lo in range(0, len(some), ROWS):
                newer.update(zip(some[lo:lo + ROWS], self.merge_many(some[lo:lo + ROWS])))

    def _outside(self, sign: str) -> bytes:
        return b"".join([self.bytes[b] for b in sign.encode()]) if self.bytes else self.unknown

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts."""
        forms = [t.replace(" ", SPACE) for t in texts]
        cut = [self.parts.findall(SPACE + f if f and self.prefix else f) for f in forms]
        parts = set().union(*cut)
        self.learn(parts)
        known, out = self.newer.__getitem__, []
        for c in cut:
            body = b"".join(map(known, c))
            if not self.bytes:
                ids = np.frombuffer(body, "<u4")
                unknown = ids == np.frombuffer(self.unknown, "<u4")
                body = ids[np.concatenate(([True], ~(unknown[1:] & unknown[:-1])))[:len(ids)]].tobytes()
            out.append((self.bos if bos else b"") + body + (self.eos if eos else b""))
        for p in parts:
            if len(p) > SHORT:
                self.newer.pop(p, None)
        return out

    def decode(self, packed_ids: list[bytes]) -> list[str]:
        """The texts of packed ids: the bytes of all pieces are gathered at once and split by text."""
        sizes = np.array([len(p) // 4 for p in packed_ids], np.int64)
        ids = np.frombuffer(b"".join(packed_ids), "<u4").astype(np.int64)
        if not len(ids):
            return [""] * len(packed_ids)
        if ids.max() >= len(self.control):
            raise ValueError(f"id {ids.max()} is outside the vocabulary")
        control = self.control[ids]
        many = self.n_bytes[ids]
        at = np.cumsum(sizes) - sizes
        if self.prefix:  # the space in front of a text's first piece
            first = np.minimum.reduceat(np.where(control, len(ids), np.arange(len(ids))), at[sizes > 0])
            first = first[first < len(ids)]
            first = first[self.spaced[ids[first]]]
            many[first] -= 1
        else:
            first = ids[:0]
        skip = np.zeros(len(ids), np.int64)
        skip[first] = 1
        ends = np.cumsum(many)
        source = np.repeat(self.first_byte[ids] + skip - (ends - many), many)
        data = self.all_bytes[source + np.arange(len(source))].tobytes()
        ends = np.concatenate(([0], ends))
        inner = control.copy()
        inner[at[sizes > 0]] = inner[(at + sizes - 1)[sizes > 0]] = False
        split = set((np.searchsorted(at, np.flatnonzero(inner), side="right") - 1).tolist())
        out = []
        for k, (a, b) in enumerate(zip(ends[at].tolist(), ends[at + sizes].tolist())):
            cuts = [a, b]
            if k in split:  # no sign's bytes reach over a control id
                cuts[1:1] = ends[at[k] + np.flatnonzero(inner[at[k]:at[k] + sizes[k]])].tolist()
            out.append("".join([data[x:y].decode("utf-8", "each_byte") for x, y in zip(cuts, cuts[1:])]))
        return out


_VOCABULARIES: dict[int, tuple] = {}


def _loaded(sent):
    """The worker's vocabulary and library processor of a broadcast model."""
    if sent.id not in _VOCABULARIES:
        import sentencepiece
        _VOCABULARIES.clear()
        _VOCABULARIES[sent.id] = Vocabulary(sent.value), sentencepiece.SentencePieceProcessor(model_proto=sent.value)
    return _VOCABULARIES[sent.id]


class _Sent:
    """A broadcast value with a name that a worker can remember it by."""

    def __init__(self, spark, data: bytes):
        self.value_of = spark.sparkContext.broadcast(data)
        self.id = hash(data)

    @property
    def value(self):
        return self.value_of.value


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for n, size in enumerate(sizes):
        if n > lo and total + size > CHECK_SIGNS:
            yield lo, n
            lo, total = n, 0
        total += size
    if len(sizes) > lo:
        yield lo, len(sizes)


def encode_texts(docs: DataFrame, text_col: str = "text", model: str = MODEL, bos: bool = True, eos: bool = True,
                 out: str = "pieces") -> DataFrame:
    """``docs`` with a struct ``out``: ids (binary, little-endian unsigned 32-bit; see ``unpack``), decoded (text of these
    ids) and agrees (the library has the same ids and the same text for them)."""
    sent = _Sent(docs.sparkSession, model_bytes(model))

    kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()),
                         T.StructField("agrees", T.BooleanType())])
    texts_of = "_pieces_text"
    while texts_of in docs.columns:
        texts_of += "_"
    kept = [f for f in docs.schema if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, kind)])

    def encoded(column: pa.Array) -> pa.Array:
        own, library = _loaded(sent)
        parts = []
        texts = ["" if t is None else t for t in column.to_pylist()]
        for lo, hi in _slices([len(t) for t in texts]):
            some = texts[lo:hi]
            ids = own.encode(some, bos, eos)
            decoded = own.decode(ids)
            theirs = library.encode(some, out_type="numpy", add_bos=bos, add_eos=eos, num_threads=1)
            same = [a.astype("<u4").tobytes() == b and d == e for a, b, d, e in
                    zip(theirs, ids, decoded, library.decode(theirs, num_threads=1))]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                ["ids", "decoded", "agrees"]))
        return pa.concat_arrays(parts) if parts else pa.nulls(0, pa.struct(
            [("ids", pa.binary()), ("decoded", pa.string()), ("agrees", pa.bool_())]))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            others = [batch.column(i) for i in range(batch.num_columns - 1)]  # the text comes last
            yield pa.RecordBatch.from_arrays([*others, encoded(batch.column(batch.num_columns - 1))], [f.name for f in schema])
    given = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).cast("string").alias(texts_of))
    return given.mapInArrow(batches, schema)


def decode_ids(rows: DataFrame, ids_col: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """``rows`` with the text of packed ids; null ids give null, ids outside the vocabulary stop the job."""
    sent = _Sent(rows.sparkSession, model_bytes(model))

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        own, _ = _loaded(sent)
        values = column.to_pylist()
        parts = []
        for lo, hi in _slices([len(i or b"") for i in values]):
            texts = own.decode([i or b"" for i in values[lo:hi]])
            parts += [None if i is None else t for i, t in zip(values[lo:hi], texts)]
        return pa.array(parts, pa.string())
    return rows.withColumn(out, decoded(F.col(ids_col)))


def unpack(rows: DataFrame, ids_col: str = "ids", out: str = "ids") -> DataFrame:
    """``rows`` with packed ids as an array<long>."""
    @F.arrow_udf("array<long>")
    def unpacked(column: pa.Array) -> pa.Array:
        return pa.array([None if i is None else np.frombuffer(i, "<u4") for i in column.to_pylist()], pa.list_(pa.int64()))
    return rows.withColumn(out, unpacked(F.col(ids_col)))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs).select(
        "doc_id", (F.octet_length("pieces.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("pieces.ids", 256).alias("ids_sha256"), F.sha2("pieces.decoded", 256).alias("decoded_sha256"),
        "pieces.agrees")
