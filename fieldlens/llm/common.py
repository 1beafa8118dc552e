"""Shared helpers: tables in the shared scratch folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame is broadcast by hand only when it has been counted and holds no more rows than this
#: (ids and a few numbers a row: under 64 MB).
MAX_BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local[") and \
                spark.conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fieldlens-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, math.ceil(rows / per_partition))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when the counted rows are within the bound; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Minimum-label propagation with pointer jumping; each round is staged. Minima are pre-aggregated
    map-side, so an id with very many edges is no hot spot, and nothing is collected.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = stage(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(links.groupBy(F.col("a").alias("id"))
                   .agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = (links.join(labels, links.b == labels.id).groupBy("a").agg(F.min("component").alias("near")))
        moved = (labels.join(near, labels.id == near.a)
                 .select("id", F.col("component").alias("old"), F.least("component", "near").alias("c")))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("further"))
        nxt = stage(moved.join(jump, moved.c == jump.j, "left")
                    .select("id", "old", F.least("c", F.coalesce("further", "c")).alias("component")), "labels")
        changed = nxt.where("component < old").limit(1).count()
        unstage(labels)
        labels = nxt
        if not changed:
            unstage(links)
            return labels.select("id", "component")
