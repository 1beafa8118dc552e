"""Table maintenance as set operations on DataFrames.

A change table replaces the reference's statement-at-a-time writes: the
last change per key wins (by a sequence column), then
``target ANTI changes UNION changes``. Writing the result back touches only
the partitions that hold changed keys (``write_upsert``: dynamic partition
overwrite of a checkpointed merge, so no job reads and overwrites the same
files).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.keys import drop_matching, latest_per_key
from fieldlens.schema import MANAGER_ROLES


def _latest_changes(changes: DataFrame, keys, seq) -> DataFrame:
    seq = [seq] if isinstance(seq, str) else list(seq)
    return latest_per_key(changes, keys, seq).drop(*seq)


def upsert(target: DataFrame, changes: DataFrame, keys, seq, columns=None, keep_if_null=(),
           null_safe: bool = False) -> DataFrame:
    """Keyed upsert.

    ``columns=None`` replaces whole rows. With ``columns`` only those change on
    a matched row (others keep the stored value); ``keep_if_null`` columns keep
    the stored value when the change carries NULL. ``null_safe`` lets NULL key
    parts match (IS NOT DISTINCT FROM).
    """
    keys = list(keys)
    latest = _latest_changes(changes, keys, seq)
    cols = target.columns
    if columns is None and not keep_if_null:
        kept = drop_matching(target, latest, keys, null_safe=null_safe)
        return kept.unionByName(latest.select(*cols))
    columns = set(cols if columns is None else columns) | set(keep_if_null)
    t = target.withColumn("_t", F.lit(True))
    c = latest.select(*[F.col(k).alias(f"_c_{k}") for k in latest.columns]).withColumn("_c", F.lit(True))
    cond = reduce(lambda a, b: a & b, [
        (t[k].eqNullSafe(c[f"_c_{k}"]) if null_safe else t[k] == c[f"_c_{k}"]) for k in keys])
    j = t.join(c, cond, "full_outer")
    out = []
    for name in cols:
        new = F.col(f"_c_{name}") if name in latest.columns else F.lit(None)
        old = F.col(name)
        has_c, has_t = F.col("_c").isNotNull(), F.col("_t").isNotNull()
        if name in keys:
            expr = F.when(has_t, old).otherwise(new)
        elif name in keep_if_null:
            expr = F.when(has_c, F.coalesce(new, old)).otherwise(old)
        elif name in columns:
            expr = F.when(has_c, new).otherwise(old)
        else:
            expr = F.when(has_t, old).otherwise(new)
        out.append(expr.cast(target.schema[name].dataType).alias(name))
    return j.select(*out)


def insert_absent(target: DataFrame, changes: DataFrame, keys, seq=None) -> DataFrame:
    """Insert rows whose key is absent (ON CONFLICT DO NOTHING); first change wins."""
    keys = list(keys)
    new = changes
    if seq is not None:
        from fieldlens.operators.keys import first_per_key
        new = first_per_key(changes, keys, seq).drop(seq)
    else:
        new = changes.dropDuplicates(keys) if len(changes.columns) > len(keys) else changes.distinct()
    return target.unionByName(drop_matching(new.select(*target.columns), target, keys))


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Plain append, duplicates kept."""
    return target.unionByName(rows.select(*target.columns))


def map_values(df: DataFrame, col: str, mapping: dict, default=None) -> DataFrame:
    """M4: value backfill by mapping; unmapped values stay (or take ``default``)."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == F.lit(k), F.lit(v)) if expr is None
                else expr.when(F.col(col) == F.lit(k), F.lit(v)))
    other = F.col(col) if default is None else F.lit(default)
    return df.withColumn(col, other if expr is None else expr.otherwise(other))


def align_schema(df: DataFrame, schema, defaults: dict | None = None) -> DataFrame:
    """M9: add missing nullable columns (default filled), cast present ones, order as ``schema``."""
    defaults = defaults or {}
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            expr = F.col(f.name)
            if f.name in defaults:
                expr = F.coalesce(expr, F.lit(defaults[f.name]))
        else:
            expr = F.lit(defaults.get(f.name))
        out.append(expr.cast(f.dataType).alias(f.name))
    return df.select(*out)


def deactivate(table: DataFrame, ids: DataFrame, key: str, actor=None,
               guard_managers: bool = False) -> tuple[DataFrame, DataFrame]:
    """M6: soft delete by id list.

    Refused: unknown ids, the acting user, and - for employees - a manager
    whose deactivation would leave no active manager. Requests are processed
    in id order, so with m active managers the first m-1 active managers in
    the batch pass and later ones are refused.
    """
    req = ids.select(F.col("id").alias(key)).distinct()
    unknown = req.join(table.select(key), key, "left_anti").withColumn("reason", F.lit("not found"))
    known = req.join(table.select(key), key, "left_semi")
    refused = unknown
    if actor is not None:
        is_actor = F.col(key) == F.lit(actor)
        refused = refused.unionByName(known.filter(is_actor).withColumn("reason", F.lit("acting user")))
        known = known.filter(~is_actor)
    if guard_managers:
        from fieldlens.sources.rownum import with_source_row_number
        active_mgr = table.filter((F.col("status") == "Active") & F.col("role").isin(*MANAGER_ROLES))
        m = active_mgr.agg(F.count(F.lit(1)).alias("_m"))
        batch_mgr = known.join(active_mgr.select(key), key, "left_semi")
        ranked = with_source_row_number(batch_mgr.orderBy(key), start=0, col="_rank")
        last = (ranked.crossJoin(F.broadcast(m))  # one row
                .filter(F.col("_m") - F.col("_rank") <= 1).select(key))
        refused = refused.unionByName(last.withColumn("reason", F.lit("last active manager")))
        known = known.join(last, key, "left_anti")
    hit = known.withColumn("_hit", F.lit(True))
    out = (table.join(hit, key, "left")
           .withColumn("status", F.when(F.col("_hit"), F.lit("Inactive")).otherwise(F.col("status")))
           .drop("_hit"))
    return out.select(*table.columns), refused


def remove_pairs(df: DataFrame, pairs: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """M7: delete by key pair; report pairs that were not there."""
    keys = list(keys)
    pairs = pairs.select(*keys).distinct()
    return df.join(pairs, keys, "left_anti"), pairs.join(df.select(*keys), keys, "left_anti")


# Which columns of which domain table point at a purged master.
PURGE_REFS = {
    "daily_report": {"employee": ["employee_id"]},
    "kpi_target": {"employee": ["employee_id"], "product": ["product_id"], "territory": ["territory_id"]},
    "prescription": {"employee": ["employee_id"], "customer": ["customer_id"], "product": ["product_id"]},
    "manual_sales": {"employee": ["employee_id"], "customer": ["customer_id"], "product": ["product_id"]},
    "sheet_sales": {"employee": ["employee_id"], "customer": ["customer_id"], "product": ["product_id"]},
    "tender": {"employee": ["employee_id"], "customer": ["customer_id"], "product": ["product_id"],
               "tender": ["tender_id"]},
    "employee_customer": {"employee": ["employee_id"], "customer": ["customer_id"]},
    "employee_territory": {"employee": ["employee_id"], "territory": ["territory_id"]},
    "account": {"employee": ["employee_id"]},
    "customer": {"customer": ["customer_id"]},
    "employee": {"employee": ["employee_id"]},
    "product": {"product": ["product_id"]},
    "territory": {"territory": ["territory_id"]},
}


def purge(tables: dict[str, DataFrame], keys: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """M8: cascaded purge; a row goes when ANY referencing column holds a purged key.

    Each key list is a one-column DataFrame; every reference is an anti join
    (NULL references never match, so such rows stay). A kind that no table
    refers to is an error.
    """
    unknown = set(keys) - {kind for refs in PURGE_REFS.values() for kind in refs}
    if unknown:
        raise ValueError(f"unknown kinds of keys to purge: {sorted(unknown)}")
    out = {}
    for name, df in tables.items():
        for kind, cols in PURGE_REFS.get(name, {}).items():
            if kind not in keys:
                continue
            k = keys[kind].select(F.col(keys[kind].columns[0]).alias("_k")).distinct()
            for c in cols:
                df = df.join(k, df[c] == k["_k"], "left_anti")
        out[name] = df
    return out


def write_upsert(spark, path: str, changes: DataFrame, keys, seq, partition_cols, **upsert_args) -> str:
    """M1 as a sink: rewrite only the partitions a change batch touches.

    The stored rows of the touched partitions are read, merged with the
    changes, cut from their lineage (checkpoint in the shared folder, so the
    job never reads and overwrites the same files) and written back with
    dynamic partition overwrite: untouched partitions are not rewritten. The
    partition columns must be among ``keys``: a change can't move a key, and a
    reader may meet the folder half overwritten. ``sources.versions`` has
    neither limit.
    """
    from fieldlens.session import checkpoint_dir
    partition_cols = list(partition_cols)
    if not set(partition_cols) <= set(keys):
        raise ValueError("a key could move between partitions: use VersionedTable.upsert")
    stored = spark.read.parquet(path)
    touched = changes.select(*partition_cols).distinct()
    old = stored.join(touched, partition_cols, "left_semi")
    merged = upsert(old, changes, keys, seq, **upsert_args)
    checkpoint_dir(spark)
    merged = merged.checkpoint(eager=True)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))
    return path
