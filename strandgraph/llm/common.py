"""Shared helpers of the training-data operators: vectorised hashing, packed
shuffles and session plumbing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    h = (a * _M1) ^ (b + (a >> U(29)))
    h *= _M2
    h ^= h >> U(32)
    return h


class WordHashes(dict):
    """Memo of 64-bit word hashes, emptied when it reaches ``bound`` words."""

    bound = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_words = WordHashes()
_LOWER = bytes(range(256)).lower()


def to_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates are replaced."""
    return text.encode("utf-8", "replace") if text else b""


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def ascii_words(raw: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return raw.translate(_LOWER).split()


def forget_words() -> None:
    _words.clear()


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; a shorter, non-empty text is one run."""
    n = len(w) - k + 1
    if len(w) == 0:
        return w
    if n <= 0:
        h = w[:1] ^ U(len(w))
        for i in range(1, len(w)):
            h = mix(h, w[i : i + 1])
        return h
    h = w[:n]
    for i in range(1, k):
        h = mix(h, w[i : i + n])
    return h


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None
_given_back = 0.0


def give_back(seconds: float = 2.0) -> None:
    """Returns freed memory to the system, at most once in ``seconds``: a Python worker
    outlives its tasks, and allocators keep what the largest of them needed."""
    global _given_back
    if time.monotonic() - _given_back < seconds:
        return
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    _given_back = time.monotonic()


def frugal(run):
    """``run``, a function of ``mapInArrow``; gives memory back before and after."""

    def inner(batches):
        give_back()
        yield from run(batches)
        give_back()

    return inner


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession, rows_per_batch: int = 512, batch_bytes: int = 16 << 20) -> SparkSession:
    """Ships this package to the executors, bounds Arrow batches by rows and bytes (one
    row may have more), and makes sure
    that checkpoint() has a folder: the session's own, or a temporary one where
    all of Spark runs in this process. Elsewhere ``spark.checkpoint.dir`` has to
    name a folder that the executors share."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandgraph-"))
    if getattr(sc, "_strandgraph_shipped", False):
        return spark
    root = Path(__file__).resolve().parents[2]
    fd, name = tempfile.mkstemp(prefix="strandgraph-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "strandgraph").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(name)
    sc._strandgraph_shipped = True
    return spark


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that end in here leave no shuffle files."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Scratch:
    """Tables of one run in the shared checkpoint folder. Each cuts lineage where
    it is written and is deleted once what follows from it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_freed(self.spark):
            df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables; names may be patterns (``step*``)."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            fs = path.getFileSystem(sc.hadoopConfiguration())
            for found in fs.globStatus(path) or ():
                fs.delete(found.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(df: DataFrame, n: int, *key: str) -> DataFrame:
    """Adds ``pid``, one of ``n`` groups of rows by hash; groups, not rows, are
    what the packed shuffles exchange, so a hot key adds one entry a group."""
    return df.withColumn("pid", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def file_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of ``df``; 0 where it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def number_of_groups(spark: SparkSession, rows: int = 0, rows_per_group: int = 100_000) -> int:
    """Groups for packed shuffles: two per shuffle partition, more for many rows (or
    bytes, where these are given)."""
    return max(2 * partitions(spark), -(-rows // rows_per_group))


def pack(bucket: np.ndarray, n_buckets: int, *columns: np.ndarray):
    """Yields (bucket, bytes of the rows' columns side by side)."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    flat = np.column_stack(columns)[order]
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if edges[b] < edges[b + 1]:
            yield b, flat[edges[b] : edges[b + 1]].tobytes()


def unpack(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, width)


def capped(rows: np.ndarray) -> np.ndarray:
    """Sorted rows in which each distinct row stands once, or twice if repeated."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort(rows.T[::-1])]
    same = (rows[1:] == rows[:-1]).all(axis=1)
    keep = np.ones(len(rows), bool)
    keep[2:] = ~(same[1:] & same[:-1])
    return rows[keep]


def as_table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)
