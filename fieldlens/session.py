"""Session construction and shared runtime settings."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.schema import MANAGER_ROLES

# Settings that matter at scale: AQE re-plans joins from runtime sizes,
# splits skewed partitions and coalesces small ones. Broadcast stays under the
# default size threshold, which Spark checks against plan statistics.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None,
                  app_name: str = "fieldlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is None and master.startswith("local"):
        shuffle_partitions = 8
    if shuffle_partitions is not None:  # else the cluster's own setting holds
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only when it is unset (local tests) do we create one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="fieldlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    try:
        spark.sparkContext.setCheckpointDir(configured)
    except Exception:  # a Spark Connect session has no SparkContext; the server's setting applies
        pass
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written tables."""
    root = checkpoint_dir(spark)
    if "://" in root:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=root)


#: Spark's setting that drops the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written within it leaves no shuffle files on the executors' disks."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


#: Rows of a slice, and slices of a frame at most: so many times it is read.
SLICE_ROWS, MAX_SLICES = 5_000_000, 8


def in_slices(df: DataFrame, keys, rows: int) -> list[DataFrame]:
    """A frame of so many rows in slices by a hash of its keys; a row is in one slice, and equal keys share it.

    Written one after the other, wide rows that are joined and shuffled take the disk of a slice, not of the whole. The
    test is on columns of ``df`` and goes below its joins.
    """
    n = min(MAX_SLICES, math.ceil(rows / SLICE_ROWS))
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) for i in range(n)]


#: Bytes of a row group of a staged table: what one task reads at least.
STAGED_BLOCK = 32 << 20


def staged(df: DataFrame | list[DataFrame], name: str) -> DataFrame:
    """The rows written once to a fresh folder under the shared checkpoint root, and read from there.

    It cuts the lineage as ``checkpoint()`` does, but by columns and compressed: later reads take only the columns that
    they use, and Spark splits large files into tasks of its own size. Slices are written one after the other, and the
    shuffles of each are gone before the next.
    """
    parts = df if isinstance(df, list) else [df]
    spark = parts[0].sparkSession
    path = scratch_path(spark, name) + "/rows"
    for part in parts:
        with shuffles_freed(spark):
            part.write.mode("append").option("compression", "zstd").option("parquet.block.size", STAGED_BLOCK).parquet(path)
    return at_path(spark.read.schema(parts[0].schema).parquet(path), path)


def at_path(df: DataFrame, path: str | None) -> DataFrame:
    """The frame with the folder of the staged rows that it reads, for ``unstage``."""
    df.staged_path = path
    return df


def unstage(df: DataFrame) -> None:
    """Delete the staged rows below a frame, which nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path is not None:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Viewer:
    """Who is looking: employee id plus role. Managers see every row."""

    employee_id: object
    role: str = "NhanVien"

    @property
    def is_manager(self) -> bool:
        return self.role in MANAGER_ROLES
