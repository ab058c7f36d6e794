"""Benchmark decontamination over a distributed positional inverted index.

The index holds one posting (document, position, term) for each word of the corpus that any test
item uses; it is written where the documents' tasks run, so nothing is shuffled to build it. Each
window of consecutive item words is looked up from its rarest term in the corpus: that term's
postings, less the term's place in the item, give the diagonals (document, item, offset) on which
the window can lie. The list of the second-rarest term is intersected first, which leaves few
diagonals, then the lists of all others on those alone; what is consecutive there is an exact
phrase; with a slop, a proximity match.

DataFrame operations only: no Python runs on the executors.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lower-cased.
An item of fewer words than a window is one window; an item without words none.

Edge cases: a null text has no words; null document ids are kept as null; rows with equal id and
text share one result, rows with equal id and different texts have their own; items with equal
words are one text with several ids, an item without id marks words but is not counted; an empty
benchmark marks nothing; other columns of either table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

_CLASS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_BREAK = f"[{_CLASS}]+"
_LEADING = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in their own case; the last element may be empty, no other."""
    return F.split(F.ltrim(F.coalesce(text, F.lit("")), F.lit(_LEADING)), _BREAK)


def n_words(text: Column) -> Column:
    w = words(text)
    return (F.size(w) - F.when(F.element_at(w, -1) == "", 1).otherwise(0)).cast("long")


def lowered(word: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def document_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, hash, text): what tells rows apart, without nulls."""
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(0)).alias("doc"), F.xxhash64(docs[text], docs[key].isNull()).alias("hash"), docs[key].alias("key"), docs[text].alias("text"))


@dataclass
class Index:
    """items: (tid, ip, term_id, size): the words of each distinct item text; ids: (tid, item_id);
    postings: (doc, hash, pos, term_id)."""

    items: DataFrame
    ids: DataFrame
    postings: DataFrame


def build(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> Index:
    """Write the item words and the postings of their terms."""
    listed = items.select(items[item_key].alias("item_id"), words(items[item_text]).alias("w"))
    listed = listed.select("item_id", F.transform(F.filter("w", lambda x: x != ""), lowered).alias("w")).where(F.size("w") > 0)
    listed = store.written(listed.withColumn("tid", F.md5(F.concat_ws(" ", "w"))), "test-items")
    ids = listed.where(F.col("item_id").isNotNull()).select("tid", "item_id").distinct()
    placed = listed.dropDuplicates(["tid"]).select("tid", F.size("w").alias("size"), F.posexplode("w").alias("ip", "term"))
    terms = store.written(placed.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "test-terms")
    terms = store.held(terms)
    placed = store.written(placed.join(terms, "term").select("tid", "ip", "term_id", "size"), "test-words")
    rows = document_key(docs, key, text).select("doc", "hash", F.posexplode(words(F.col("text"))).alias("pos", "word")).where("word <> ''")
    postings = rows.withColumn("term", lowered(F.col("word"))).join(terms, "term").select("doc", "hash", "pos", "term_id")
    return Index(placed, ids, store.written(postings, "postings"))


def diagonals(index: Index, n: int, *, slop: int = 0) -> DataFrame:
    """(doc, hash, tid, diag): where the rarest term of any window of an item occurs with the window's
    second-rarest term in its place, each give or take ``slop`` positions."""
    frequency = store.written(index.postings.groupBy("term_id").agg(F.count("*").alias("freq")), "term-counts")
    known = index.items.join(frequency, "term_id", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    ahead = Window.partitionBy("tid").orderBy("ip").rowsBetween(0, n - 1)
    starts = known.withColumn("o", F.array_sort(F.collect_list(F.struct("freq", "ip", "term_id")).over(ahead))).where(F.col("ip") <= F.greatest(F.col("size") - n, F.lit(0)))
    rare = starts.select("tid", F.get("o", F.lit(0)).alias("one"), F.get("o", F.lit(1)).alias("two")).where("one.freq > 0")
    rare = store.written(rare.select("tid", "one.ip", "one.term_id", (F.col("two.ip") - F.col("one.ip")).alias("gap"), F.col("two.term_id").alias("term2")).distinct(), "rare-terms")
    found = index.postings.join(store.held(rare), "term_id").select("doc", "hash", "tid", (F.col("pos") - F.col("ip")).alias("diag"), (F.col("pos") + F.col("gap")).alias("pos"), F.col("term2").alias("term_id"))
    if slop:  # the rarest term may itself be off the diagonal
        off = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
        found = found.withColumn("off", off).select("doc", "hash", "tid", (F.col("diag") + F.col("off")).alias("diag"), (F.col("pos") + F.col("off")).alias("pos"), "term_id")
        found = found.withColumn("pos", F.explode_outer(F.when(F.col("pos").isNotNull(), F.expr(f"sequence(pos - {slop}, pos + {slop})"))))
    next_terms = store.held(store.written(rare.select(F.col("term2").alias("term_id")).where("term_id is not null").distinct(), "next-terms"))
    second = index.postings.join(next_terms, "term_id", "left_semi")
    both = found.where("term_id is not null").join(second, ["doc", "hash", "pos", "term_id"], "left_semi")
    alone = found.where("term_id is null")  # an item of one word
    keys = ["doc", "hash", "tid", "diag"]
    return store.written(both.select(*keys).unionByName(alone.select(*keys)).distinct(), "diagonals")


def matches(index: Index, n: int, *, slop: int = 0) -> DataFrame:
    """(doc, hash, tid, diag, n, starts, at): item places at which a window begins all of whose terms
    lie on the diagonal, no more than ``slop`` positions off it, and the item places of those terms."""
    found = diagonals(index, n, slop=slop)
    docs = store.held(store.written(found.select("doc", "hash").distinct(), "candidates"))
    near = index.postings.join(docs, ["doc", "hash"], "left_semi")
    wanted = found.join(store.held(index.items), "tid").select("doc", "hash", "tid", "diag", "ip", "term_id", "size", (F.col("diag") + F.col("ip")).alias("pos"))
    if slop:
        wanted = wanted.withColumn("pos", F.explode(F.expr(f"sequence(pos - {slop}, pos + {slop})")))
    hit = wanted.join(near, ["doc", "hash", "pos", "term_id"])
    lists = hit.groupBy("doc", "hash", "tid", "diag").agg(F.array_sort(F.collect_set("ip")).alias("at"), F.least(F.lit(n), F.first("size")).alias("n"))
    lists = lists.withColumn("starts", F.expr("filter(at, (p, i) -> i + n <= size(at) and get(at, i + n - 1) - p = n - 1)"))
    return lists.where(F.size("starts") > 0)


def _found(docs: DataFrame, items: DataFrame, n: int, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """((doc, hash, n_hit), (doc, hash, ids)): words inside windows, and sorted ids of the items, as strings."""
    index = build(docs, items, key=key, text=text, item_key=item_key, item_text=item_text)
    exact = matches(index, n).select("doc", "hash", "tid", F.expr("array_distinct(flatten(transform(starts, s -> sequence(s + diag, s + diag + n - 1))))").alias("hits"))
    exact = store.written(exact, "phrases")
    store.discard(index.postings)
    hits = exact.groupBy("doc", "hash").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"))
    named = exact.select("doc", "hash", "tid").distinct().join(store.held(store.written(index.ids, "item-ids")), "tid")
    return hits, named.groupBy("doc", "hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))


def report(docs: DataFrame, items: DataFrame, *, n: int = 8, at_least: int = 2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of each row: its words, those inside
    any occurrence of a window, and the items with occurring windows."""
    hits, named = _found(docs, items, n, key, text, item_key, item_text)
    rows = document_key(docs, key, text).select("doc", "hash", "key", n_words(F.col("text")).alias("n_words"))
    both = rows.join(hits.join(named, ["doc", "hash"], "left"), ["doc", "hash"], "left")
    count = F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).cast("long")
    return both.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        count.alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        (count >= at_least).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, n: int = 8, at_least: int = 2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    named = _found(docs, items, n, key, text, item_key, item_text)[1]
    bad = store.written(named.where(F.size("ids") >= at_least).select("doc", "hash"), "contaminated")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_key, own_text = F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}")
    same = (F.coalesce(own_key.cast("long"), F.lit(0)) == bad["doc"]) & (F.xxhash64(own_text, own_key.isNull()) == bad["hash"])
    return rows.join(store.held(bad), same, "left_anti").toDF(*names)
