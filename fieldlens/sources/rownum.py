"""Stable row numbers in file (or sort) order without a one-partition window (S3).

Each task numbers its own rows (``monotonically_increasing_id`` keeps the
index in the low 33 bits); counts - one row per partition, or per block of a
file - are turned into prefix offsets and joined back.

* A sorted frame: the range partitions are in key order, so partition order
  equals row order.
* Files (``path_col``): numbering restarts in every file. A partition may hold
  blocks of several files in any order, so rows are counted per (file, block)
  and blocks are taken in the order of their place in the file
  (``BLOCK_COL``, the byte where the block starts; see ``read_resource_csv``).

Counts and rows are two passes, so both must see the same partitions. A plain
file scan is stable (``stable=True``). Anything with a shuffle (a sort) is
tagged once and staged as Parquet in the shared checkpoint folder, so a lost
executor re-reads the tagged rows instead of recomputing a different
partitioning, and the pass that counts reads the tags alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.session import at_path, staged

BLOCK_COL = "source_block"


def with_source_row_number(df: DataFrame, start: int = 2, path_col: str | None = None,
                           col: str = "source_row", stable: bool = False) -> DataFrame:
    tagged = (df.withColumn("_pid", F.spark_partition_id().cast("long"))
              .withColumn("_idx", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    if not stable:
        tagged = staged(tagged, "tagged-rows")
    place = BLOCK_COL if path_col and BLOCK_COL in df.columns else "_pid"
    group = [path_col, place] if path_col else [place]
    counts = tagged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    w = (Window.partitionBy(path_col) if path_col else Window.partitionBy()).orderBy(place) \
        .rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition or block of a file, as in Spark's own listing of them: sent out, so that the rows, which may be
    # the whole text of a sheet, are not shuffled by it.
    offsets = counts.select(*group, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_off"))
    numbered = tagged.join(F.broadcast(offsets), group) \
        .withColumn(col, (F.col("_off") + F.col("_idx") + F.lit(start)).cast("long")) \
        .drop("_pid", "_idx", "_off", *([BLOCK_COL] if place == BLOCK_COL else []))
    return numbered if stable else at_path(numbered, tagged.staged_path)
