"""SpotSigs: fingerprints from chains of content words that follow common words.

Common words are spread evenly over running text and absent from boilerplate. From each of them, the
next CHAIN content words (common ones skipped) form a signature with it; a text's fingerprint is the
set of its signatures, whole, as sorted 32-bit numbers. Likeness is the Jaccard similarity of two
sets. For pairs, sets are partitioned by length, since sets of too different lengths cannot be
similar, and looked up by their rarest signatures only, as many as a similar set cannot all lack.

Edge cases: a text without common words has the runs of CHAIN words as signatures, one without words
the text itself as its only one, null being empty; equal texts have equal fingerprints; repeated
rows are fingerprinted each; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, hashing, store

#: Content words in a signature.
CHAIN = 3
#: Common words of the corpus' languages.
COMMON = (
    "the of and to in is was that for on with as by be it at from this are or an a he which not have has his they you "
    "der die das und ist ein eine zu von mit nicht den dem des auf für im sich als auch es an werden aus er hat dass sie nach bei "
    "le la les de des et un une du dans est que qui pour pas sur il elle ne ce au aux par plus avec son sa "
    "el los las y en del que es por con no se una para lo su al como más pero sus o este"
).split()
#: Rows of a range of keys.
RANGE_ROWS = 4_000
_common = np.sort(np.array([hashing.word_hashes(pa.array([w]))[0][0] for w in dict.fromkeys(COMMON)], np.uint64))


def signatures(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    words, at = hashing.word_hashes(texts)
    place = np.minimum(np.searchsorted(_common, words), len(_common) - 1)
    anchor = _common[place] == words
    spots, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    end = np.searchsorted(content, at[1:])  # content words before the end of each text
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    q, stop = np.searchsorted(content, spots, side="right"), end[doc[spots]]
    h = words[spots].copy()
    for k in range(CHAIN):
        ok = q + k < stop
        part = np.zeros(len(spots), np.uint64)
        part[ok] = words[content[(q + k)[ok]]]
        h = hashing.mixed(h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    some = q < stop  # at least one content word follows
    h, who = (h[some] >> np.uint64(32)).astype(np.uint32), doc[spots[some]]
    cut = np.searchsorted(who, np.arange(len(texts) + 1))
    out = [np.unique(h[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
    for i, s in enumerate(out):
        if not len(s):
            run = hashing.shingle_hashes(words[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), CHAIN)[0]
            out[i] = np.unique((run >> np.uint64(32)).astype(np.uint32))
            if not len(run):
                raw = hashlib.sha256((texts[i].as_py() or "").encode()).digest()
                out[i] = np.frombuffer(raw[:4], "<u4").astype(np.uint32)
    return out


def printed(signs: np.ndarray) -> str:
    return base64.b64encode(signs.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - common
    return common / whole if whole else 1.0


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signatures): the fingerprint of each row as an array. One narrow stage."""
    rows = docs.select(docs[key].alias(key), docs[text].alias("text"))

    def run(batches):
        for b in bpe.parts(batches, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.int64) for s in signatures(b.column(1))], pa.list_(pa.int64()))], names=[key, "signatures"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, signatures array<bigint>")


def compare_edited(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each
    row and its edited text: the last quarter of its code points replaced by as many first ones of
    the text with the next key, or all it has.

    Keys are dealt into ranges, a key of very many rows into several by the hash of its texts, and each range's
    rows sorted; the first row of a range is also sent to the range before, where it comes last. Texts are
    shuffled once. Null keys come first, equal keys in order of their texts' hashes, then of their texts. One row
    a range goes to the driver, at most 100,000."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = rows.withColumn("sk", F.coalesce("key", F.lit(store.LEAST))).withColumn("same", F.xxhash64("text"))
    cuts = store.id_ranges(rows, "sk", RANGE_ROWS)
    rows = rows.withColumn("part", store.range_of("sk", "same", cuts))
    # equal rows of a range's start are one and the same to the row before: the place of one of them is enough
    least = rows.groupBy("part").agg(F.min(F.struct("sk", "same")).alias("m")).select("part", "m.sk", "m.same").collect()  # one row a range
    firsts = sorted((r["part"], r["sk"], r["same"]) for r in least)
    before = [(sk, same, firsts[i - 1][0]) for i, (_, sk, same) in enumerate(firsts)]
    link = F.broadcast(spark.createDataFrame(before, "sk long, same long, to int"))
    rows = rows.join(link, ["sk", "same"], "left").withColumn("go", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("extra")))).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("to").alias("part"), F.lit(1).alias("extra"))))))
    rows = rows.select("go.part", "go.extra", "sk", "key", "text", "same").repartitionByRange(len(cuts) + 1, "part").sortWithinPartitions("part", "extra", "sk", "same", "text")

    def run(batches):
        held = None  # (part, extra, key, text, signatures) whose next row is still to come
        for b in bpe.parts(batches, 4, 4 << 20):
            signs = signatures(b.column(4))
            seq = ([held] if held else []) + list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), [t or "" for t in b.column(4).to_pylist()], signs, strict=True))
            held = seq[-1]
            pairs = [(x, y) for x, y in zip(seq, seq[1:], strict=False) if not x[1]]
            if not pairs:
                continue
            edited = [x[3][: len(x[3]) - len(x[3]) // 4] + y[3][: len(x[3]) // 4] for x, y in pairs]
            changed = signatures(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([printed(x[4]) for x, _ in pairs], pa.string()),
                    pa.array([printed(c) for c in changed], pa.string()),
                    pa.array([likeness(x[4], c) for (x, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                ],
                names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def similar(prints: DataFrame, threshold: float = 0.8, *, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of fingerprints. members: (key, set_id), rows with equal sets share one;
    pairs: (a, b, sim) of different sets, a < b, of at least ``threshold``.

    Sets of n signatures are kept in the partition floor(log(n) / log(1 / threshold)): a similar set
    is in the same or a neighbouring one. Two similar sets share one of the n - ceil(t n) + 1 rarest
    signatures of each, so only those are joined, within partitions; then sets are compared."""
    rows = prints.select(F.col(key).alias("key"), F.array_sort("signatures").alias("s"))
    sets = store.written(rows.select("s").distinct().withColumn("set_id", F.monotonically_increasing_id()), "sets")
    members = rows.join(sets, "s").select(F.col("key").alias(key), "set_id")
    each = sets.select("set_id", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("df"))
    ranked = each.join(often, "x").groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    part = F.floor(F.log("n") / F.lit(-np.log(threshold).item()) + F.lit(1e-9)).cast("int")
    lead = ranked.select("set_id", "n", part.alias("part"), F.explode(F.expr(f"transform(slice(o, 1, n - cast(ceil({threshold} * n - 1e-9) as int) + 1), e -> e.x)")).alias("x"))
    lead = store.written(lead, "rare-signatures")
    near = lead.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "x", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = lead.withColumnRenamed("set_id", "a").join(near, ["part", "x"]).where((F.col("a") < F.col("b")) & (F.least("n", "nb") >= F.lit(threshold) * F.greatest("n", "nb"))).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    full = full.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("sim"))
    return members, full.where(F.col("sim") >= threshold)
