"""Versioned Parquet tables: data files and numbered manifests (M1, M3 and the batch state as sinks).

A table's folder has ``data/`` (Parquet files, never changed once written) and ``_versions/`` (one JSON manifest a
version: the schema, the files with the group each belongs to, and a small note). A version is written in two steps: the
data first, then its manifest under the next number, by one rename that fails if that number is taken. Readers resolve
the highest number. So a failure before the commit leaves the old version as it was, a reader never sees half a version,
and of two writers that started from one version the second gets ``Conflict``.

A manifest lists files, not rows: it grows with the table's files, as Spark's own file listing does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldlens.operators.merge import upsert
from fieldlens.session import shuffles_freed


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: StructType
    files: dict[str, str]  # path below the table's folder -> group
    note: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # ---------------------------------------------------------------- files
    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self._conf)

    def _list(self, folder: str) -> list[str]:
        """Paths below the table's folder of all files in one of its folders."""
        if not self._system().exists(self._path(folder)):
            return []
        top = self._system().makeQualified(self._path()).toUri().getPath().rstrip("/") + "/"
        out, files = [], self._system().listFiles(self._path(folder), True)
        while files.hasNext():
            out.append(files.next().getPath().toUri().getPath()[len(top):])
        return out

    # ------------------------------------------------------------- versions
    def versions(self) -> list[int]:
        names = [f.rsplit("/", 1)[1] for f in self._list("_versions")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> Manifest:
        stream = self._system().open(self._path("_versions", f"{version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = json.loads(text)
        return Manifest(version, StructType.fromJson(m["schema"]), m["files"], m["note"])

    def current(self) -> Manifest | None:
        """The manifest that readers resolve; None before the first version."""
        versions = self.versions()
        return self.manifest(versions[-1]) if versions else None

    def commit(self, base: Manifest | None, schema: StructType, add: dict[str, str] | None = None, drop=(),
               note: dict | None = None) -> Manifest:
        """The next version: the base's files without ``drop``, with ``add``. One rename makes it current."""
        files = {p: g for p, g in (base.files if base else {}).items() if p not in set(drop)} | (add or {})
        done = Manifest((base.version if base else 0) + 1, schema, files,
                        {**(base.note if base else {}), **(note or {})})
        body = json.dumps({"schema": schema.jsonValue(), "files": files, "note": done.note}, ensure_ascii=False)
        own = self._path("_versions", f"tmp-{uuid.uuid4().hex}")
        out = self._system().create(own, False)
        try:
            out.write(body.encode())
        finally:
            out.close()
        context = self._fs.FileContext.getFileContext(self._path().toUri(), self._conf) if "://" in self.root else \
            self._fs.FileContext.getFileContext(self._conf)
        options = self.spark._sc._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(own, self._path("_versions", f"{done.version:020d}.json"), options)
        except Exception as e:
            self._system().delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {done.version} of {self.root} was committed by another writer") from None
            raise
        return done

    # ------------------------------------------------------------------ read
    def read(self, version: int | None = None, files: list[str] | None = None) -> DataFrame:
        """The rows of a version (default: the current one), or of some of its files."""
        m = self.current() if version is None else self.manifest(version)
        if m is None:
            raise ValueError(f"{self.root} has no version")
        paths = sorted(m.files) if files is None else files
        if not paths:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*[f"{self.root}/{p}" for p in paths])

    # ----------------------------------------------------------------- write
    def write_files(self, df: DataFrame | list[DataFrame], partition_cols=()) -> list[str]:
        """Write rows as data files that no version lists yet; files never hold more than one value of the partition
        columns, which stay inside the files (their statistics prune a filtered read). Slices (``session.in_slices``) are
        written one after the other, and the shuffles of each are gone before the next."""
        folder = f"data/{uuid.uuid4().hex}"
        copies = {f"_{c}": F.col(c) for c in partition_cols}
        for part in df if isinstance(df, list) else [df]:
            if copies:  # rows of a partition come together; Spark splits the large ones
                part = part.withColumns(copies).hint("rebalance", *copies)
            with shuffles_freed(part.sparkSession):
                (part.write.mode("append").option("compression", "zstd").partitionBy(*copies)
                 .parquet(f"{self.root}/{folder}"))
        return [f for f in self._list(folder) if f.endswith(".parquet")]

    def replace(self, df: DataFrame | list[DataFrame], group: str = "", partition_cols=(),
                note: dict | None = None) -> Manifest:
        """M3: the rows of ``df`` (a frame, or its slices) take the place of all rows of their group (a source); other
        groups' files stay."""
        base = self.current()
        schema = (df[0] if isinstance(df, list) else df).schema
        _same_schema(base, schema)
        add = self.write_files(df, partition_cols)
        drop = [p for p, g in base.files.items() if g == group] if base else []
        return self.commit(base, schema if base is None else base.schema, dict.fromkeys(add, group), drop, note)

    def append(self, df: DataFrame, group: str = "", partition_cols=(), note: dict | None = None) -> Manifest:
        base = self.current()
        _same_schema(base, df.schema)
        add = self.write_files(df, partition_cols)
        return self.commit(base, df.schema if base is None else base.schema, dict.fromkeys(add, group), note=note)

    def locate(self, keys: DataFrame, null_safe: bool = False) -> list[str]:
        """The files that hold a row of one of the keys. Only the key columns are read; Spark broadcasts the keys, or
        prunes the scan with a Bloom filter of them, by their size. What comes back is file names."""
        at = self.read().select(*keys.columns, F.col("_metadata.file_path").alias("_file"))
        wanted = keys.distinct().select(*[F.col(c).alias(f"_k_{c}") for c in keys.columns])
        on = None
        for c in keys.columns:
            same = at[c].eqNullSafe(wanted[f"_k_{c}"]) if null_safe else at[c] == wanted[f"_k_{c}"]
            on = same if on is None else on & same
        top = self._system().makeQualified(self._path()).toUri().getPath().rstrip("/") + "/"
        hit = at.join(wanted, on, "left_semi").select("_file").distinct().collect()
        return sorted(unquote(urlparse(r["_file"]).path)[len(top):] for r in hit)

    def upsert(self, changes: DataFrame, keys, seq, partition_cols=(), null_safe: bool = False,
               note: dict | None = None, **upsert_args) -> Manifest:
        """M1: merge a change batch copy-on-write. Files that hold a changed key are merged and written anew, wherever
        the change puts its rows; all other files are listed again as they are. A key that moves to another partition
        leaves no copy behind."""
        base = self.current()
        touched = self.locate(changes.select(*keys), null_safe) if base.files else []
        old = self.read(base.version, touched) if touched else self.spark.createDataFrame([], base.schema)
        merged = upsert(old, changes, keys, seq, null_safe=null_safe, **upsert_args)
        add = self.write_files(merged.select(*base.schema.names), partition_cols)
        groups = {base.files[p] for p in touched}
        group = groups.pop() if len(groups) == 1 else ""
        return self.commit(base, base.schema, dict.fromkeys(add, group), touched, note)

    def expire(self, keep: int = 2) -> list[str]:
        """Drop all but the newest versions, and the data files that only those listed."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        live = {p for v in kept for p in self.manifest(v).files}
        gone = sorted({p for v in old for p in self.manifest(v).files} - live)
        for v in old:
            self._system().delete(self._path("_versions", f"{v:020d}.json"), False)
        for p in gone:
            self._system().delete(self._path(p), False)
        return gone


def _same_schema(base: Manifest | None, schema: StructType) -> None:
    if base is not None and [(f.name, f.dataType) for f in base.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"columns differ from the table's: {schema.simpleString()}, not {base.schema.simpleString()}")
