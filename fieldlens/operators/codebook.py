"""Generated ids that never merge two codes.

An id is a prefix and the code's slug, cut to 28 signs, so codes may share one. Here every code has an id of its own: a code
already in the book or among the masters keeps its id; of new codes with one cut slug the smallest gets it, unless the
id is taken; each other one gets the cut slug and sixteen digits of its own hash. The result doesn't depend on the order
of rows or partitions, and a stored book keeps it stable over later batches that bring further codes.

Everything runs on distinct codes, grouped by cut slug with map-side minima; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.text import slug
from fieldlens.sources.versions import VersionedTable

BOOK = "kind string, code string, id string"
CUT, HASH_DIGITS = 28, 16


def assign_ids(codes: DataFrame, prefixes: dict[str, str], known: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(kind, code, id) of distinct (kind, code): ids of ``known`` (kind, code, id), else generated ones that neither
    ``known`` nor ``taken`` (kind, id) holds."""
    used = known.select("kind", "id")
    used = (used if taken is None else used.unionByName(taken)).distinct()
    codes = codes.where(F.col("code").isNotNull()).distinct()
    held = known.groupBy("kind", "code").agg(F.min("id").alias("id"))
    j = codes.join(held, ["kind", "code"], "left")
    prefix = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, p in prefixes.items()])
    fresh = j.where(F.col("id").isNull()).select("kind", "code", F.concat(prefix, slug("code", CUT)).alias("base"))
    first = (fresh.groupBy("kind", "base").agg(F.min("code").alias("owner"))
             .join(used.withColumnRenamed("id", "base"), ["kind", "base"], "left_anti"))
    longer = F.concat("base", F.lit("_"), F.upper(F.substring(F.sha2("code", 256), 1, HASH_DIGITS)))
    made = fresh.join(first, ["kind", "base"], "left").select(
        "kind", "code", F.when(F.col("owner") == F.col("code"), F.col("base")).otherwise(longer).alias("id"))
    return j.where(F.col("id").isNotNull()).select("kind", "code", "id").unionByName(made)


def stored_book(table: VersionedTable) -> DataFrame:
    """The book's rows; none before its first version."""
    return table.read() if table.current() else table.spark.createDataFrame([], BOOK)


def record(table: VersionedTable, assigned: DataFrame) -> DataFrame:
    """Add the ids that the book doesn't hold yet, in one commit, and return the book. Ids once stored never change."""
    book = stored_book(table)
    new = assigned.select("kind", "code", "id").join(book.select("kind", "code"), ["kind", "code"], "left_anti")
    table.append(new)
    return table.read()
