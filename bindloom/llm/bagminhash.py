"""Near-duplicates by weighted Jaccard similarity of word-shingle multisets: BagMinHash signatures,
banding, verification, classes.

Signatures. A shingle that occurs w times covers [0, w) of a weight axis that is cut at 1, 2, 4, 8
and so on. Each block of the axis has a Poisson process of its own, seeded by the shingle and the
block, whose rate is the block's length; its points come in order of time, each with a place in
the block and a component of the signature. Points beyond w do not count. A component keeps the
first point it gets, over all shingles. Two texts keep the same point with a probability equal to
their weighted Jaccard similarity, and only early points are ever made: their number depends on the
signature's length, hardly on the text's.

Pairs. Texts with equal words are one text from the start. Signatures are cut into bands; within a
band's bucket each text is compared with one of them, exactly, on the shingles themselves: the one that
shares buckets with most others, so that the heart of a group meets all of it once. Links form classes.
Only in buckets that still hold several classes the remaining pairs of different classes are looked at, so
that no link between classes is lost and yet large groups of copies never become all pairs. Three bounds,
none of them an estimate, rule out nearly all of these before any text is compared:

* shingles that no other text in question has can be common to no pair. A text with too many of them has no
  partner at all and leaves;
* of two texts, neither can bring in more than its shingles that others have too;
* a sketch counts a text's shingles in bins, in unary, so that the common bits of two sketches are at least
  as many as their common shingles.

What is left of pairs within one bucket costs a few machine instructions each and makes no row; only pairs
that pass are compared. Their number can still grow with the square of a group in which hardly any two texts
are within the threshold and nearly all are just below it.

With 40 bands of 6 rows a pair at similarity 0.8 shares a bucket with probability 1 - 5e-6.

Edge cases: null and empty texts are one class of their own, texts without words are copies only if
equal; a text of fewer than five words is one shingle; rows with equal ids are kept as rows; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, hashing, store

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 6
#: Partners of one text that go to one task.
PARTNERS = 512
#: 64-bit numbers of a sketch, 32 bins of two bits in each.
SKETCH = 32
#: Texts that are signed or sketched at a time: what each takes there is of a fixed size.
TOGETHER = 256
_SEED = np.uint64(0xD1B54A32D192ED03)


def signatures(h: np.ndarray, count: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """(texts, m) identities of the first points; 0 where a text has no shingles."""
    docs = len(at) - 1
    doc = np.repeat(np.arange(docs), np.diff(at))
    total = np.zeros(docs)
    np.add.at(total, doc, count)
    first = np.full(docs * m, np.inf)
    kept = np.zeros(docs * m, np.uint64)
    # one process for each shingle and block below its count: block 0 is [0, 1), block k [2^(k-1), 2^k)
    blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    source = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    rate = np.where(block > 0, 2.0 ** (block - 1), 1.0)
    low = np.where(block > 0, rate, 0.0)
    seed = hashing.mixed(h[source] + block.astype(np.uint64) * _SEED)
    weight, doc = count[source].astype(float), doc[source]
    time = np.zeros(len(source))
    with np.errstate(divide="ignore", invalid="ignore"):
        horizon = np.where(total > 0, (np.log(m) + 6) / total, 0)
    open_docs = total > 0
    step = np.zeros(len(source), np.uint64)
    # each process' next point; a process rests while that lies beyond its text's horizon
    state = hashing.mixed(seed + _SEED)
    time += -np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (rate * m)
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc] & (time <= horizon[doc]))
        while len(live):
            ident = hashing.mixed(seed[live] ^ hashing.mixed(step[live] * _SEED + np.uint64(1)))
            place = (ident >> np.uint64(32)).astype(float) * 2.0**-32 * rate[live] + low[live]
            cell = doc[live] * m + ((ident & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            ok = place < weight[live]
            cells, times, idents = cell[ok], time[live][ok], ident[ok]
            better = times < first[cells]
            cells, times, idents = cells[better], times[better], idents[better]
            np.minimum.at(first, cells, times)
            won = first[cells] == times
            kept[cells[won]] = idents[won]
            step[live] += np.uint64(1)
            state = hashing.mixed(seed[live] + (step[live] + np.uint64(1)) * _SEED)
            time[live] += -np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (rate[live] * m)
            live = live[time[live] <= horizon[doc[live]]]
        unfilled = np.isinf(first).reshape(docs, m).any(axis=1)
        open_docs &= unfilled
        horizon = horizon * 2
    return kept.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) one number for each band."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = hashing.mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out


def text_keys(words: np.ndarray, at: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers of each text's sequence of words; of the text itself if it has none."""
    out = []
    n = np.diff(at)
    place = np.arange(len(words)) - np.repeat(at[:-1], n)
    for salt in (1, 2):
        each = hashing.mixed(words + hashing.mixed(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        key = hashing.mixed(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
        for i in np.flatnonzero(n == 0):
            raw = (texts[int(i)].as_py() or "").encode()
            h = np.full(1, salt, np.uint64)
            for k in range(0, len(raw), 8):
                h = hashing.mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int.from_bytes(raw[k : k + 8], "little")))
            key[i] = h[0] ^ np.uint64(len(raw))
        out.append(key.view(np.int64))
    return out[0], out[1]


def signed(docs: DataFrame, *, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(key, hash, k1, k2, weight, keys): the text's hash, the words' sequence as two numbers, shingles,
    band keys."""
    store.small_batches(docs.sparkSession)
    rows_in = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))

    def run(batches):
        bpe.forget_encoders()
        for b in bpe.parts(batches, 1, 2 << 20):
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                words, at = hashing.word_hashes(part.column(1))
                k1, k2 = text_keys(words, at, part.column(1))
                h, where = hashing.shingle_hashes(words, at, SHINGLE)
                size = np.diff(where)
                keys = band_keys(signatures(*hashing.multiset(h, where), bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(k1), pa.array(k2), pa.array(size), lists], names=["key", "hash", "k1", "k2", "weight", "keys"])

    return rows_in.mapInArrow(run, "key long, hash long, k1 long, k2 long, weight long, keys array<long>")


def sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((texts, SKETCH) counts of shingles in bins as runs of up to two bits; shingles beyond those)."""
    n, bins = len(at) - 1, SKETCH * 32
    doc = np.repeat(np.arange(n), np.diff(at))
    count = np.bincount(doc * bins + (hashing.mixed(h) % np.uint64(bins)).astype(np.int64), minlength=n * bins)[: n * bins]
    kept = np.minimum(count, 2)
    unary = ((1 << kept) - 1).astype(np.uint8).reshape(-1, 4)
    packed = unary[:, 0] | unary[:, 1] << 2 | unary[:, 2] << 4 | unary[:, 3] << 6
    return packed.reshape(n, bins // 4).view("<i8"), (count - kept).reshape(n, bins).sum(axis=1)


def similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim): exact weighted Jaccard of the shingles of each pair of ``texts`` (rid, text).

    A text with many partners is dealt out over tasks, a copy of it to each."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("salts"))
    left = texts.join(spread, F.col("rid") == F.col("a")).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = pairs.join(spread, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "b", "salt")
    right = dealt.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1)
            sims = []
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                words, at = hashing.word_hashes(part.column(3))
                hs, ns, wh = hashing.multiset(*hashing.shingle_hashes(words, at, SHINGLE))
                for i in range(part.num_rows):
                    if a[lo + i] != last or held is None:
                        one, cut = hashing.word_hashes(part.column(2).slice(i, 1))
                        held, last = hashing.multiset(*hashing.shingle_hashes(one, cut, SHINGLE))[:2], a[lo + i]
                    h, n = hs[wh[i] : wh[i + 1]], ns[wh[i] : wh[i + 1]]
                    place = np.minimum(np.searchsorted(held[0], h), len(held[0]) - 1) if len(held[0]) else np.zeros(len(h), int)
                    same = held[0][place] == h if len(held[0]) else np.zeros(len(h), bool)
                    common = int(np.minimum(held[1][place[same]], n[same]).sum())
                    whole = int(held[1].sum() + n.sum()) - common
                    sims.append(common / whole if whole else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), b, pa.array(sims, pa.float64())], names=["a", "b", "sim"])
        bpe.released()

    return both.mapInArrow(run, "a long, b long, sim double")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label): the least id of each connected component of ``links`` (a, b). Labels spread to
    neighbours and then jump to their own label's label, so long chains take few rounds. Each round
    is written, so none is worked out twice."""
    edges = store.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    lab = store.written(edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        least = edges.join(lab.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = lab.join(least, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lab.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = store.written(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        store.discard(lab)
        if not step.where("label <> old").limit(1).count():
            store.discard(edges)
            return step.select("id", "label")
        lab = step


def _texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, text) of the ``wanted`` (rid, k1, k2, first, hash), one row each."""
    body = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))
    wanted = wanted.withColumnRenamed("hash", "wanted_hash")
    body = body.join(store.held(wanted), F.col("key").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("wanted_hash"))).select("rid", "k1", "k2", "text")

    def own(batches):
        for b in bpe.parts(batches, 3, 2 << 20):
            words, at = hashing.word_hashes(b.column(3))
            k1, k2 = text_keys(words, at, b.column(3))
            same = (k1 == b.column(1).to_numpy()) & (k2 == b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], names=["rid", "text"]).filter(pa.array(same))

    return body.mapInArrow(own, "rid long, text string").dropDuplicates(["rid"])


def _bounds(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketched, alone) of ``texts`` (rid, text). sketched: (rid, sketch, beyond). alone: (rid, alone), the
    shingles, repeated ones as often, that no other of the texts has; texts without any are not in it."""

    def sketch(batches):
        for b in bpe.parts(batches, 1, 2 << 20):
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                h, at = hashing.shingle_hashes(*hashing.word_hashes(part.column(1)), SHINGLE)
                bits, beyond = sketches(h, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SKETCH), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(beyond)], names=["rid", "sketch", "beyond"])

    def single(batches):
        for b in bpe.parts(batches, 1, 2 << 20):
            h, n, at = hashing.multiset(*hashing.shingle_hashes(*hashing.word_hashes(b.column(1)), SHINGLE))
            rid = np.repeat(b.column(0).to_numpy(), np.diff(at))
            # what several texts of this part have is known not to be alone: one row for all of them
            _, first, times = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(rid[first]), pa.array(n[first].astype(np.int64)), pa.array(times)], names=["h", "rid", "n", "texts"])

    owners = texts.mapInArrow(single, "h long, rid long, n long, texts long").groupBy("h").agg(F.sum("texts").alias("texts"), F.min("rid").alias("rid"), F.min("n").alias("n"))
    return texts.mapInArrow(sketch, "rid long, sketch array<long>, beyond long"), owners.where("texts = 1").groupBy("rid").agg(F.sum("n").alias("alone"))


def _others(rest: DataFrame, body: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different classes within the buckets of ``rest`` (bucket, rid, weight, label, main) that the bounds
    leave and ``pairs`` lacks: all outside a bucket's largest class against all in the bucket."""
    texts = store.written(body.join(store.held(store.written(rest.select("rid").distinct(), "mixed-texts")), "rid", "left_semi"), "mixed-bodies")
    sketched, alone = _bounds(texts)
    alone = store.written(alone, "alone")
    known = store.written(sketched.join(alone, "rid", "left").select("rid", "sketch", "beyond", F.coalesce("alone", F.lit(0)).alias("alone")), "bounds")
    rest = rest.join(known, "rid").withColumn("shared", F.col("weight") - F.col("alone"))
    rest = store.written(rest.where(F.col("shared") >= F.lit(threshold) * F.col("weight") - F.lit(1e-6)), "candidates")

    def side(name: str) -> list:
        return [F.col(c).alias(f"{c}_{name}") for c in ("rid", "weight", "label", "shared", "sketch", "beyond")]

    x = rest.where("label <> main").select("bucket", *side("x"))
    y = rest.select("bucket", "main", *side("y"))
    once = (F.col("label_x") != F.col("label_y")) & ((F.col("label_y") == F.col("main")) | (F.col("label_x") < F.col("label_y")))
    need = F.lit(threshold) * (F.col("weight_x") + F.col("weight_y")) - F.lit(1e-6)
    common = F.least("beyond_x", "beyond_y")
    for i in range(SKETCH):
        common = common + F.bit_count(F.col("sketch_x")[i].bitwiseAND(F.col("sketch_y")[i]))
    enough = (F.least("shared_x", "shared_y") * F.lit(1 + threshold) >= need) & (common * F.lit(1 + threshold) >= need)
    more = x.join(y, "bucket").where(once & enough).select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()
    met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return more.join(met, ["a", "b"], "left_anti")


def linked(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links). members: (key, hash, label, class_id, class_size, class_texts, n_links) of each row: the
    least key of its class of near copies, the rows and the different texts in the class, and the links of its
    text. links: (a_key, b_key, sim) between texts of different words that were compared and found similar; they
    hold each class together, but are not all pairs within it."""
    every = store.written(signed(docs, bands=bands, rows=rows, key=key, text=text), "signed")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("least")
    grouped = every.groupBy("k1", "k2").agg(least, F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("keys").alias("keys"))
    grouped = grouped.select("k1", "k2", F.col("least.key").alias("first"), F.col("least.hash").alias("hash"), "copies", "weight", "keys")
    texts = store.written(grouped.withColumn("rid", F.monotonically_increasing_id()), "texts")
    banded = texts.where("weight > 0").select("rid", "weight", F.explode("keys").alias("bucket"))
    buckets = store.written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    crowded = store.written(banded.join(store.held(buckets), "bucket"), "crowded")
    store.discard(buckets)
    heart = crowded.join(store.written(crowded.groupBy("rid").agg(F.sum("n").alias("met")), "met"), "rid")
    heart = store.written(heart.groupBy("bucket").agg(F.max(F.struct("met", "rid"))["rid"].alias("a")), "hearts")
    pairs = store.written(crowded.join(store.held(heart), "bucket").where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), "pairs")
    wanted = store.written(texts.select("rid", "k1", "k2", "first", "hash").join(crowded.select("rid").distinct(), "rid", "left_semi"), "wanted")
    body = store.written(_texts_of(docs, wanted, key, text), "wanted-texts")
    found = store.written(similarity(pairs, body).where(F.col("sim") >= threshold), "links")
    label = components(found)
    mixed = store.written(crowded.join(label.withColumnRenamed("id", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid")), "labelled-buckets")
    spans = mixed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", "n").alias("main")).where("labels > 1")
    rest = store.written(mixed.join(store.held(store.written(spans.select("bucket", "main"), "spans")), "bucket").select("bucket", "rid", "weight", "label", "main"), "mixed")
    store.discard(crowded, mixed)
    if rest.limit(1).count():
        more = store.written(_others(rest, body, pairs, threshold), "more-pairs")
        extra = store.written(similarity(more, body).where(F.col("sim") >= threshold), "more-links")
        if extra.limit(1).count():
            found = found.unionByName(extra)
            label = components(found)
    store.discard(wanted, pairs, body, rest)
    degree = found.select(F.col("a").alias("rid")).unionByName(found.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count("*").alias("n_links"))
    # only texts with links are in classes of several texts
    some = store.written(texts.select("rid", "first", "copies").join(label.withColumnRenamed("id", "rid"), "rid").join(degree, "rid"), "linked-texts")
    sizes = store.written(some.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("class_texts")), "sizes")
    named = store.written(store.joined(some.select("rid", "label", "n_links"), sizes, ["label"], "class_texts"), "named")
    whole = texts.select("rid", "k1", "k2", "first", "copies").join(store.held(named), "rid", "left")
    own = {"label": F.col("rid"), "class_id": F.col("first"), "class_size": F.col("copies"), "class_texts": F.lit(1), "n_links": F.lit(0)}
    linked_too = F.col("label").isNotNull()
    whole = whole.select("k1", "k2", "copies", *[F.when(linked_too, F.col(c)).otherwise(v.cast("long")).alias(c) for c, v in own.items()])
    members = store.joined(every.select("key", "hash", "k1", "k2"), store.written(whole, "named-texts"), ["k1", "k2"], "copies").drop("k1", "k2", "copies")
    ends = texts.select("rid", "first")
    links = found.join(ends.select(F.col("rid").alias("a"), F.col("first").alias("a_key")), "a").join(ends.select(F.col("rid").alias("b"), F.col("first").alias("b_key")), "b").select("a_key", "b_key", "sim")
    return members, links


def classes(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size, is_first, class_texts, n_links) of each row: the least key of its class of near
    copies, the rows in the class, whether the row has that key, the different texts in the class and the links of
    the row's text to others that were compared with it."""
    members = linked(docs, bands=bands, rows=rows, threshold=threshold, key=key, text=text)[0]
    return members.select(F.col("key").alias(key), "class_id", "class_size", F.col("key").eqNullSafe(F.col("class_id")).alias("is_first"), "class_texts", "n_links")


def keep_first(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near copies, as it is: the one with the least key, of equal keys the
    one with the least hash of its text, of equal rows any one."""
    names = docs.columns
    members = store.written(linked(docs, bands=bands, rows=rows, threshold=threshold, key=key, text=text)[0].where("class_size > 1"), "members")
    first = F.col("key").eqNullSafe(F.col("class_id"))
    best = members.where(first).groupBy("label").agg(F.min("hash").alias("best"))
    firsts = members.where(first).join(best, "label").select("key", "hash", (F.col("hash") == F.col("best")).alias("kept"))
    firsts = store.written(firsts, "firsts")
    gone = store.written(members.where(~first).select("key", "hash").unionByName(firsts.where(~F.col("kept")).select("key", "hash")).distinct(), "dropped")
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_key, own_text = F.col(f"c{names.index(key)}").cast("long"), F.col(f"c{names.index(text)}")

    def same(keys: DataFrame):
        return own_key.eqNullSafe(keys["key"]) & (F.xxhash64(own_text) == keys["hash"])

    out = rows.join(store.held(gone), same(gone), "left_anti")
    twice = store.written(firsts.where("kept").groupBy("key", "hash").count().where("count > 1").select("key", "hash"), "twice")
    if twice.limit(1).count():
        one = Window.partitionBy(own_key, F.xxhash64(own_text)).orderBy(F.lit(1))
        again = out.join(store.held(twice), same(twice), "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
        out = out.join(store.held(twice), same(twice), "left_anti").unionByName(again)
    return out.toDF(*names)
