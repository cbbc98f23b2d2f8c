"""Shared plumbing of the training-data operators.

Everything that must outlive a stage is written as Parquet below the folder
the cluster names in ``spark.checkpoint.dir``; executors and the driver share
nothing else.  Only where that setting is missing in local mode (tests on one
machine) a temporary folder is made once per application; a cluster without it
is refused.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only if unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _own_dirs[sc.applicationId]


#: Has Spark delete the shuffle files of an execution when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    pins values that depend on task layout, survives lost executors.  What the
    write has shuffled is deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._llm_path = path
    return out


def trim() -> None:
    """Give freed memory of this Python worker back, for the next task's sake."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns that an operator is about to add (clashing extras)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (one row
    at least), so that memory does not follow the batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.binary_length(b.column(b.schema.get_field_index(text)).cast(pa.large_binary())).fill_null(0)
        group = np.cumsum(np.asarray(size, dtype=np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)


# ---------------------------------------------------------------- arrays as bytes

def pack(a: np.ndarray) -> bytes:
    """An integer array as zstd-compressed byte planes."""
    a = np.ascontiguousarray(a)
    head = np.array([a.dtype.itemsize, "iu".index(a.dtype.kind)], np.uint8).tobytes()
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return head + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    item, kind = b[0], "iu"[b[1]]
    raw = zstandard.ZstdDecompressor().decompress(bytes(b[2:]))
    planes = np.frombuffer(raw, np.uint8).reshape(item, -1)
    return np.ascontiguousarray(planes.T).view(f"{kind}{item}").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array as packed differences."""
    a = a.astype(np.uint64)
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wrapping multiply and shifts)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


# ---------------------------------------------------------------- components

def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(src, dst)`` as ``(node, component)``,
    component being the smallest node reachable.

    Contraction: every node points to its smallest neighbour, pointers jump
    once, end points are renamed and the distinct edges left are contracted
    again.  All steps are joins and pre-aggregated minima; only the number of
    edges left comes to the driver.
    """
    e = materialize(
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(),
        f"{name}-edges",
    )
    total = None
    while True:
        both = e.select("src", "dst").union(e.select(F.col("dst"), F.col("src")))
        up = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = materialize(up, f"{name}-up")
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        step = materialize(up.join(jump, "up").select("node", F.col("upper").alias("component")), f"{name}-step")
        if total is None:
            total = step
        else:
            s = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            total = materialize(
                total.join(s, "component", "left").select("node", F.coalesce("next", "component").alias("component")),
                f"{name}-total",
            )
        a = step.select(F.col("node").alias("src"), F.col("component").alias("a"))
        b = step.select(F.col("node").alias("dst"), F.col("component").alias("b"))
        left = e.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        e = materialize(left, f"{name}-edges")
        if e.isEmpty():
            return total
