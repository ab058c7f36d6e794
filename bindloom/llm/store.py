"""Shared storage for intermediate tables and files.

Everything an operator writes goes below the folder that ``spark.checkpoint.dir``
names, the one place that the driver and all executors share; only where that is
unset (tests on one machine) a temporary folder is made. All access goes through
Spark's readers and writers or Hadoop's FileSystem, so any store that Spark can
reach will do.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Bytes of a written table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
#: Groups of at least so many rows, or of one in HEAVY_SHARE of all if that is more, meet their rows by
#: broadcast: at most HEAVY_SHARE of them.
HEAVY, HEAVY_SHARE = 1_000, 100_000

#: Setting of how many bytes go to a Python worker at a time, and how many that are here.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode and where that is unset."""
    return storage.shared_folder(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file from the driver to any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may have ended already
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as zstd Parquet in the shared folder and read it back: lineage ends there,
    so a lost executor costs at most the tasks of the next stage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned and nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.shared_path)


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker and the JVM beside it hold by bytes: 10,000 rows may be long texts. A session that already
    has a smaller bound keeps it."""
    now = re.match(r"(\d+)b?$", spark.conf.get(BATCH_SETTING) or "")
    if not (now and 0 < int(now[1]) <= BATCH_BYTES):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def held(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its values, at 8 bytes a number and 24 a row, are few bytes."""
    size = F.lit(24)
    for f in df.schema.fields:
        text = f.dataType.typeName() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if text else F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def joined(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """``rows`` left-joined with the one row of each ``key`` in the written table ``groups``. Large groups, which
    ``size`` tells, are few and broadcast, so no group's rows meet in one task."""
    least = max(HEAVY, (groups.agg(F.sum(size).alias("n")).first()["n"] or 0) // HEAVY_SHARE)
    heavy = groups.where(F.col(size) >= least)
    if not heavy.limit(1).count():
        return rows.join(held(groups), key, "left")
    light = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(groups.where(F.col(size) < least), key, "left")
    return light.unionByName(rows.join(F.broadcast(heavy), key))


def write_blobs(df: DataFrame, column: str, path: str) -> None:
    """Write a binary column as raw files, one per partition: the rows' bytes in order, each followed by
    one newline. Goes through Spark's text writer, hence its commit protocol and any store."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files that ``write_blobs`` wrote, one file a partition or so."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", "content").where("length > 0")


#: Least hash: where a key's first range begins.
LEAST = -(2**63)


def id_ranges(df: DataFrame, key: str, per_range: int, most: int = 100_000) -> list[tuple[int, int]]:
    """Ascending cut points (key, hash) that deal rows into ranges of about ``per_range`` rows, in the order of an
    integer ``key`` without nulls and of a 64-bit hash where it repeats: a key of many rows has many ranges.

    Reads only the key column. A few numbers for each range go to the driver: at most ``most``.
    """
    n = df.count()
    parts = max(1, min(most, -(-n // per_range)))
    if parts == 1:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("q")).first()["q"]
    out = []
    for k, m in sorted(Counter(got or []).items()):
        out += [(k, LEAST + j * 2**64 // m) for j in range(m)]
        if m > 1 and k < 2**63 - 1:  # what comes after a key of many ranges has one of its own
            out.append((k + 1, LEAST))
    return sorted(set(out))


def range_of(key: str, hashed: str, cuts: list[tuple[int, int]]) -> Column:
    """Index of the range of (``key``, ``hashed``) among ``cuts`` (0: below the first cut)."""
    if len(cuts) <= 256:
        return _tree(key, hashed, cuts, 0, len(cuts))
    keys, hashes = (np.array([c[i] for c in cuts], dtype=np.int64) for i in (0, 1))
    many = [k for k, n in Counter(keys.tolist()).items() if n > 1]

    @F.pandas_udf("int")
    def find(k: pd.Series, h: pd.Series) -> pd.Series:
        k, h = k.to_numpy("int64"), h.to_numpy("int64")
        lo, hi = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
        at = np.where((hi > lo) & (h >= hashes[np.minimum(lo, len(keys) - 1)]), lo + 1, lo)
        for key_of_many in many:
            rows = np.flatnonzero(k == key_of_many)
            if len(rows):
                i, j = lo[rows[0]], hi[rows[0]]
                at[rows] = i + np.searchsorted(hashes[i:j], h[rows], side="right")
        return pd.Series(at.astype("int32"))

    return find(F.col(key).cast("long"), F.col(hashed))


def _tree(key: str, hashed: str, cuts: list[tuple[int, int]], lo: int, hi: int) -> Column:
    """Nested comparisons: log2(len(cuts)) of them a row, inside generated code."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    k, h = cuts[mid]
    after = F.col(key) >= F.lit(k) if h == LEAST else (F.col(key) > F.lit(k)) | (F.col(key) == F.lit(k)) & (F.col(hashed) >= F.lit(h))
    return F.when(after, _tree(key, hashed, cuts, mid + 1, hi)).otherwise(_tree(key, hashed, cuts, lo, mid))
