"""Key-based joins and per-key selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cond(left: DataFrame, right: DataFrame, keys, null_safe: bool):
    parts = [(left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k]) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def keep_matching(df: DataFrame, other: DataFrame, keys, null_safe: bool = False) -> DataFrame:
    """EXISTS: semi join. ``null_safe`` makes NULL keys match (IS NOT DISTINCT FROM)."""
    keys = list(keys)
    other = other.select(*keys)
    if not null_safe:
        return df.join(other, keys, "left_semi").select(*df.columns)
    return df.join(other, _cond(df, other, keys, True), "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, keys, null_safe: bool = False) -> DataFrame:
    """NOT EXISTS: anti join. With plain equality NULL keys never match, so such rows stay."""
    keys = list(keys)
    other = other.select(*keys)
    if not null_safe:
        return df.join(other, keys, "left_anti").select(*df.columns)
    return df.join(other, _cond(df, other, keys, True), "left_anti")


def first_per_key(df: DataFrame, keys, seq: str) -> DataFrame:
    """The row with the smallest ``seq`` per key.

    The smallest ``seq`` is found first, with partial aggregates of a key and a number, so a hot key never gathers its
    rows in one task and no rows are sorted by key. Only the rows that hold it are then reduced to one per key
    (``min_by`` over a struct, which sorts what it reduces).
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(seq).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    at = reduce(lambda x, y: x & y, [first["_first"] == df[seq], *[first[f"_k_{k}"].eqNullSafe(df[k]) for k in keys]])
    held = first.join(df, at, "left")  # a key without any ``seq`` keeps its place, with no values
    picked = held.groupBy(*[F.col(f"_k_{k}").alias(k) for k in keys]).agg(
        F.min_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The greatest row per key by the tuple ``order`` (ties: later columns)."""
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_children(parent: DataFrame, child: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Attach the sorted list of child values; parents without children get []."""
    lists = child.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(out))
    joined = parent.join(lists, key, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(lists.schema[out].dataType)))
