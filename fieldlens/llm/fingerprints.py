"""Document fingerprints (9): threshold-scaled sketches of word shingles. DataFrame functions only.

A sketch keeps every hash of a 5-word shingle below a fixed fraction (1 / ``SCALE``) of the hash range, and always the
smallest one, so that a short text has a sketch too. Sketches of one scale merge (union of the hashes) and estimate both
likeness (Jaccard) and containment, also between very unequal documents.

The edited text needs each document's successor by doc_id. Documents are dealt to buckets of neighbouring ids (bounds
from approximate percentiles), each bucket also gets a copy of the next bucket's first document, and a window inside the
bucket looks one row ahead: the texts are shuffled once and no task holds more than its bucket.

Defined results: null text is empty; a text without words has an empty fingerprint; two empty fingerprints have
likeness 1, an empty and another 0; a single document is its own successor; rows that repeat a doc_id follow each other
by text, rows without doc_id come first; no documents give no rows; extra columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import let, read_table

SHINGLE = 5
SCALE = 4
ROWS_PER_BUCKET = 500
MAX_SIDE = 256  # bounds come in two levels of at most so many


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """Ascending distinct shingle hashes of a text below 1 / scale of the range, and the smallest."""
    limit = -(1 << 63) + (1 << 64) // scale
    words = F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), r"[\x20\x09-\x0D]+")

    def shingles(h):
        at = F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
        many = F.transform(at, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) < k, F.array(F.xxhash64(h))).otherwise(many)

    def kept(s):
        return F.array_sort(F.array_distinct(F.concat(F.array(F.array_min(s)), F.filter(s, lambda x: x < limit))))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    out = let(let(hashes, shingles), kept)
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", F.array().cast("array<bigint>")).otherwise(out)


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard of two sketches."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        let(F.size(F.array_intersect(a, b)), lambda i: i / (F.size(a) + F.size(b) - i)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """Sketch of the union of two documents' shingles."""
    return F.array_sort(F.array_union(a, b))


def _bucket(rows: DataFrame) -> Column:
    """Monotone bucket number of doc_id."""
    n = rows.count()
    side = min(MAX_SIDE, max(1, math.ceil(math.sqrt(n / ROWS_PER_BUCKET))))
    parts = side * side
    if parts == 1:
        return F.lit(0)
    at = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * parts))).first()[0]
    if not bounds:
        return F.lit(0)
    coarse = bounds[side - 1::side]
    fine = F.array(*[F.array(*[F.lit(x) for x in bounds[i * side:i * side + side - 1]]) for i in range(side)])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    upper = below(F.array(*[F.lit(x) for x in coarse]))
    return upper * side + below(F.get(fine, upper))


def with_next(docs: DataFrame, carried: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, *carried) of every row and ``next_*`` of the row with the following doc_id (after the last: the
    first). ``carried`` are expressions over text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    bucket = _bucket(ids)
    # The first id of each bucket goes to the bucket before it as well; at most MAX_SIDE squared rows.
    heads = ids.groupBy(bucket.cast("int").alias("bucket")).agg(F.min(F.struct("doc_id"))["doc_id"].alias("head"))
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(everything)).alias("to"))
    own = rows.withColumns({"bucket": bucket.cast("int"), "copy": F.lit(0)})
    copies = (rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
              .select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("copy")))
    both = own.unionByName(copies).withColumns(carried)
    ahead = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    return (both.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in ("text", *carried)})
            .where("copy = 0").drop("bucket", "copy"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and the next document's."""
    rows = with_next(docs, {"own": sketch(F.col("text"))}, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.withColumn("edit", sketch(F.col("edited")))
    own, edit, nxt = F.col("own"), F.col("edit"), F.col("next_own")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"),
                       as_text(edit).alias("edited_fingerprint"), likeness(own, edit).alias("near_edited"),
                       likeness(own, nxt).alias("near_next"), containment(own, edit).alias("contained_edited"))


def op9(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
