"""Tables that outlive a plan: snapshots of a graph in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to every executor only if it was counted and is no larger, its rows' own cost included.
BROADCAST_BYTES, ROW_BYTES = 128 << 20, 96

_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where that is unset, a temporary folder on one machine, an error
    on a cluster, whose executors would not see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="bindloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, as text."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet."""
    p, fs = _file_system(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later plans start there, with statistics and pushdown,
    and a lost executor costs no recomputation of what came before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _left.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, name: str) -> DataFrame:
    """A snapshot that rows look things up in. It is counted, in rows and bytes, and goes to every executor if it
    is small: what looks it up is not shuffled then."""
    return counted_lookup(df, name)[0]


def counted_lookup(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``lookup``, with the number of its rows."""
    out = snapshot(df, name)
    size = F.lit(ROW_BYTES).cast("long")
    for c, kind in out.dtypes:
        if kind in ("string", "array<string>"):
            text = F.col(c) if kind == "string" else F.array_join(F.col(c), "--------")
            size = size + F.coalesce(F.octet_length(text), F.lit(0))
    n, total = out.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(out) if (total or 0) <= BROADCAST_BYTES else out, n


def watermark(spark: SparkSession, *paths: str) -> str:
    """Changes whenever a file of one of the tables is replaced, added or removed."""
    out = []
    for path in paths:
        p, fs = _file_system(spark, path)
        out.append("-".join(str(x) for s in fs.listStatus(p) for x in (s.getPath().getName(), s.getLen(), s.getModificationTime())))
    return "|".join(out)


def replace(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a table anew; with a partition column only the partitions that ``df`` has."""
    out = df.write.mode("overwrite")
    if partition:
        out = out.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    out.parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        with contextlib.suppress(Exception):  # the JVM may have ended already
            p, fs = _file_system(spark, path)
            fs.delete(p, True)
