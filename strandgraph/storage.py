"""Versioned snapshots of frames on any file system that Spark writes.

A version is a folder of Parquet tables; it counts once its marker table is
written, which happens last. Readers take the newest complete version, so a
reader never sees a half-written one, and writers never change files."""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.schema import SCHEMA_VERSION, GraphError

MARKER = "complete"
#: Columns that a table's files are dealt out and sorted by, so that look-ups by
#: them read few row groups.
LAYOUT = {"nodes": ("name_key", "qualified_name"), "edges": ("src", "edge_type")}


def checkpoint_folder(spark: SparkSession, shared: str | None = None) -> str:
    """The session's folder for checkpoints: its own setting, else ``shared``; a
    temporary one only where all of Spark runs in this process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None) or shared
        if not base and not (sc.master == "local" or sc.master.startswith("local[")):
            raise GraphError("no_checkpoint_folder", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="strandgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep_versions = spark, root.rstrip("/"), keep

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def children(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.delete(p, True) if fs.exists(p) else False

    def base(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise GraphError("invalid_argument", f"bad name '{name}'")
        return f"{self.root}/{name}"

    def versions(self, name: str) -> list[int]:
        found = [int(v[1:]) for v in self.children(self.base(name)) if re.fullmatch(r"v\d+", v)]
        return sorted(v for v in found if self.exists(f"{self.base(name)}/v{v}/{MARKER}/_SUCCESS"))

    def begin(self, name: str) -> Version:
        taken = [int(v[1:]) for v in self.children(self.base(name)) if re.fullmatch(r"v\d+", v)]
        return Version(self, name, max(taken, default=0) + 1)

    def current(self, name: str) -> Version | None:
        done = self.versions(name)
        return Version(self, name, done[-1]) if done else None

    def write(self, name: str, **frames: DataFrame) -> Version:
        v = self.begin(name)
        for table, df in frames.items():
            v.put(table, df)
        return v.commit()


class Version:
    def __init__(self, store: Store, name: str, number: int):
        self.store, self.name, self.number = store, name, number
        self.path = f"{store.base(name)}/v{number}"

    def put(self, table: str, df: DataFrame) -> DataFrame:
        if "name" in df.columns and table == "nodes":
            df = df.withColumn("name_key", F.lower("name"))
        by = [c for c in LAYOUT.get(table, ()) if c in df.columns]
        if by:
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
        df.write.parquet(f"{self.path}/{table}")
        return self.get(table)

    def append(self, table: str, df: DataFrame) -> None:
        """Adds rows to a small table beside those of a complete version."""
        df.write.mode("append").parquet(f"{self.path}/{table}")

    def has(self, table: str) -> bool:
        return self.store.exists(f"{self.path}/{table}")

    def get(self, table: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.path}/{table}")

    def commit(self) -> Version:
        """Makes this version the current one; drops versions that no reader of
        the last few needs."""
        stamp = self.store.spark.createDataFrame([(SCHEMA_VERSION, int(time.time()))], "schema_version int, written_at_unix long")
        stamp.coalesce(1).write.parquet(f"{self.path}/{MARKER}")
        for old in self.store.versions(self.name)[: -self.store.keep_versions]:
            self.store.delete(f"{self.store.base(self.name)}/v{old}")
        return self
