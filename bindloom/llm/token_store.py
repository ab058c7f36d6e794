"""Token ids in files: frequency-ranked ids in byte-aligned variable-length code.

Ids are replaced by their rank in the corpus' own frequency order, so that most take one byte. The
lengths of four ids share a control byte, kept apart from the data bytes; a reader turns control
bytes into lengths, places and masks by table lookup, for a whole shard at once in numpy.

A store is a folder of ``part-*`` files, written by Spark's own committer and so complete or
absent, in ascending key order. Keys are dealt into ranges, a key of very many rows into several by a hash of
the ids; a file holds whole ranges, a range is a run of shards. A shard: header (magic, range, ids of the range before it, documents, ids, bytes of
data), keys, null flags, ids of each document, control bytes, data bytes, one newline. Beside it
lies ``ranks``: the id of each rank as unsigned 32-bit numbers.

Edge cases: null and empty texts hold the end id alone; null keys come first; repeated keys are
kept, in any order among each other; an empty table gives a store without documents; other columns
of the input are ignored; a very long text may fill a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, store

MAGIC = b"RVB1"
HEADER = struct.Struct("<4sIQIQQ")
#: Ids in a shard, and in a range of keys, about.
SHARD_IDS, RANGE_IDS = 1 << 20, 1 << 22

#: Length of each of the four ids of a control byte; mask of an id of each length.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = ((ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF).view(np.uint8) + (ranks > 0xFFFFFF).view(np.uint8)).astype(np.uint8)
    four = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    four[: len(size)] = size
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of control and data bytes."""
    lens = LENGTHS[control].reshape(-1)[:n]
    if not n:
        return np.empty(0, np.uint32)
    at = np.cumsum(lens, dtype=np.int64) - lens
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in range(1, int(lens.max())):
        out |= data[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[lens]


def shard(part: int, before: int, keys: list, sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = HEADER.pack(MAGIC, part, before, len(keys), len(ranks), len(data))
    known = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    return b"".join([head, known, bytes(k is None for k in keys), np.array(sizes, "<u8").tobytes(), control, data])


def shards(content: memoryview) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(range, ids of the range before, keys, sizes, ranks) of each shard of a file."""
    at = 0
    while at < len(content):
        magic, part, before, docs, ids, size = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at += HEADER.size
        keys = np.frombuffer(content, "<i8", docs, at).tolist()
        at += 8 * docs
        keys = [None if content[at + i] else k for i, k in enumerate(keys)]
        at += docs
        sizes = np.frombuffer(content, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        control = np.frombuffer(content, np.uint8, -(-ids // 4), at)
        at += len(control)
        yield part, before, keys, sizes, unpack(control, np.frombuffer(content, np.uint8, size, at), ids)
        at += size + 1  # the newline


def encoded(docs: DataFrame, tokenizer: str, end: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, ids): packed little-endian ids of each whole text and the end id."""
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))

    def run(batches):
        enc = bpe.word_chunks(tokenizer)
        for b in bpe.parts(batches, 1, 8 << 20):
            ids, at = enc.encode(b.column(1))
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
            bound = (at * ids.itemsize).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(bound.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), packed.cast(pa.binary())], names=["key", "n", "ids"])

    return rows.mapInArrow(run, "key long, n long, ids binary")


def frequencies(enc: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Count of each id over all documents; at most one row an id goes to the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            ids = b.column(0).cast(pa.large_binary())
            at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            if len(ids) and at[-1] > at[0]:
                total += np.bincount(np.frombuffer(ids.buffers()[2], dtype, (at[-1] - at[0]) // np.dtype(dtype).itemsize, at[0]), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in enc.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the store of ``docs`` at ``path``; returns (part, base): ids before each range."""
    spark = docs.sparkSession
    enc = store.written(encoded(docs, tokenizer, end, key=key, text=text), "token-ids")
    table = bpe.word_chunks(tokenizer)
    size, dtype = table.size, table.dtype
    order = np.argsort(-frequencies(enc, size, dtype), kind="stable").astype("<u4")
    store.write_bytes(spark, f"{path}/ranks", order.tobytes())
    rank = np.empty(size, "<u4")
    rank[order] = np.arange(size)
    total = enc.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    each = max(1, int(RANGE_IDS * total["rows"] / max(1, total["ids"])))
    enc = enc.withColumn("sk", F.coalesce("key", F.lit(store.LEAST))).withColumn("same", F.xxhash64("ids"))
    cuts = store.id_ranges(enc, "sk", each)
    enc = enc.withColumn("part", store.range_of("sk", "same", cuts))
    sent = spark.sparkContext.broadcast(rank)  # one number an entry of the vocabulary

    def run(batches):
        rank, part, before, held = sent.value, None, 0, []

        def flush():
            ids = np.frombuffer(b"".join([x for _, x in held]), dtype)
            out = shard(part, before, [k for k, _ in held], [len(x) // ids.itemsize for _, x in held], rank[ids])
            return len(ids), pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["shard"])

        pending = 0
        for b in batches:
            for p, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if held and (p != part or pending >= SHARD_IDS):
                    n, out = flush()
                    yield out
                    before, held, pending = before + n, [], 0
                if p != part:
                    part, before = p, 0
                held.append((k, x := x.as_py()))
                pending += len(x) // np.dtype(dtype).itemsize
        if held:
            yield flush()[1]

    dealt = enc.select("part", "key", "ids", "same").repartitionByRange(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "same")
    store.write_blobs(dealt.mapInArrow(run, "shard binary"), "shard", f"{path}/ids")
    base = enc.groupBy("part").agg(F.sum("n").alias("n"))
    return base.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_stats(spark: SparkSession, path: str, base: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files of a store."""
    order = spark.read.format("binaryFile").load(f"{path}/ranks").first()["content"]
    sent = spark.sparkContext.broadcast(bytes(order))

    def run(batches):
        ids_of = np.frombuffer(sent.value, "<u4")
        for b in batches:
            for content in b.column(0):
                for part, before, keys, sizes, ranks in shards(memoryview(content.as_buffer())):
                    raw, at = memoryview(ids_of[ranks].tobytes()), np.concatenate([[0], np.cumsum(sizes)])
                    crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(at[:-1] + before), pa.array(sizes), pa.array(crc, pa.int64())], names=["part", "key", "at", "n_tokens", "ids_crc32"])

    files = store.blobs(spark, f"{path}/ids").select("content")
    got = files.mapInArrow(run, "part int, key long, at long, n_tokens long, ids_crc32 long")
    return got.join(base, "part").select(F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, ids) of each document, from the files of a store."""
    order = spark.read.format("binaryFile").load(f"{path}/ranks").first()["content"]
    sent = spark.sparkContext.broadcast(bytes(order))

    def run(batches):
        ids_of = np.frombuffer(sent.value, "<u4")
        for b in batches:
            for content in b.column(0):
                for _, _, keys, sizes, ranks in shards(memoryview(content.as_buffer())):
                    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids_of[ranks].astype(np.int32)))], names=[key, "ids"])

    return store.blobs(spark, f"{path}/ids").select("content").mapInArrow(run, f"`{key}` long, ids array<int>")
