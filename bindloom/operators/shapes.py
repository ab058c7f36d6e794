"""Structural fingerprints of definitions and what follows from them over generations.

Only edges at the definition itself count, so its neighbourhood is a rooted star: two are the same
shape exactly if their kinds, their loops and the multisets of (neighbour's kind, sorted labelled
directions) agree. A row of numbers a pair and a grouped sort write that down; its hash is the fingerprint. Names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

KEY = ["qualified_name", "file_path"]


def counted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, from_kind, to_id, to_kind, edge_type, k): equal edges once, so a hub's million equal edges to one
    neighbour are one number, with the kinds of both ends."""
    e = edges.groupBy("from_id", "to_id", "edge_type").agg(F.count("*").alias("k"))
    for end in ("from", "to"):
        e = e.join(nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("node_type").alias(f"{end}_kind")), f"{end}_id")
    return e


def pairs(edges: DataFrame) -> DataFrame:
    """(one, one_kind, other, other_kind, an `<type>>` and a `<type><` a type): two neighbours as one row, however many edges of
    whichever direction join them: '>' counts those from ``one``, the lesser id, '<' those to it. One shuffle of each edge,
    and numbers alone are summed."""
    ahead = F.col("from_id") <= F.col("to_id")
    e = edges.select(F.least("from_id", "to_id").alias("one"), F.when(ahead, F.col("from_kind")).otherwise(F.col("to_kind")).alias("one_kind"), F.greatest("from_id", "to_id").alias("other"), F.when(ahead, F.col("to_kind")).otherwise(F.col("from_kind")).alias("other_kind"), F.concat("edge_type", F.when(ahead, ">").otherwise("<")).alias("label"), "k")
    sums = [F.sum(F.when(F.col("label") == t + d, F.col("k")).otherwise(0)).alias(t + d) for t in names.SHAPE_EDGES for d in "<>"]
    return e.repartition("one", "other").groupBy("one", "one_kind", "other", "other_kind").agg(*sums)


def rays(pair: DataFrame) -> DataFrame:
    """(node_id, other_kind, labels, k, named): what each end sees of a pair, its labelled directions in their order as text;
    a loop is seen once."""

    def seen(node: str, kind: Column, turned: dict[str, str]) -> Column:
        labels = [F.when(F.col(f"`{t}{turned[d]}`") > 0, F.concat(F.lit(t + d), F.col(f"`{t}{turned[d]}`").cast("string"))) for t in sorted(names.SHAPE_EDGES) for d in "<>"]
        return F.struct(F.col(node).alias("node_id"), kind.alias("other_kind"), F.concat_ws(";", *labels).alias("labels"))

    def total(types: tuple[str, ...]) -> Column:
        return sum((F.col(f"`{t}{d}`") for t in types for d in "<>"), F.lit(0))

    here, there = {"<": "<", ">": ">"}, {"<": ">", ">": "<"}
    loop = F.col("one") == F.col("other")
    ends = F.when(loop, F.array(seen("one", F.lit("self"), here))).otherwise(F.array(seen("one", F.col("other_kind"), here), seen("other", F.col("one_kind"), there)))
    return pair.select(total(names.SHAPE_EDGES).alias("k"), total(names.NAME_EDGES).alias("named"), F.explode(ends).alias("end")).select("end.*", "k", "named")


def fingerprints(nodes: DataFrame, bound: DataFrame, contains: DataFrame) -> DataFrame:
    """(qualified_name, file_path, node_type, hash, edge_count, name_edge_count). Definitions that share a
    key are one row: their hashes as a sorted multiset, counts added, kinds joined by '+'. ``bound`` are references
    or what they link (``resolve.links``), which is counted already. Ids of ``nodes`` are unique, types of edges are SHAPE_EDGES."""
    e = bound.where((F.col("to_id") != "") & F.col("edge_type").isin(*names.SHAPE_EDGES))
    e = e if {"k", "from_kind", "to_kind"} <= set(bound.columns) else counted(e, nodes)
    e = e.select("from_id", "from_kind", "to_id", "to_kind", "edge_type", "k").unionByName(counted(contains, nodes))
    star = rays(pairs(e))
    ray = star.groupBy("node_id", "other_kind", "labels").agg(F.count("*").alias("times"), F.sum("k").alias("k"), F.sum("named").alias("named"))
    shape = ray.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "other_kind", "labels", F.col("times").cast("string")))), "|").alias("shape"), F.sum("k").alias("edge_count"), F.sum("named").alias("name_edge_count"))
    centre = nodes.where("node_type not in ('import', 'macro_call')").select("node_id", "node_type", *KEY).join(shape, "node_id", "left")
    centre = centre.select(*KEY, "node_type", F.unhex(F.md5(F.concat_ws("#", "node_type", F.coalesce("shape", F.lit(""))))).alias("h"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("name_edge_count", F.lit(0)).alias("name_edge_count"))
    many = centre.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list("h")), lambda h: F.lower(F.hex(h))).alias("hs"), F.array_join(F.array_sort(F.collect_set("node_type")), "+").alias("node_type"), F.sum("edge_count").alias("edge_count"), F.sum("name_edge_count").alias("name_edge_count"))
    whole = F.when(F.size("hs") == 1, F.element_at("hs", 1)).otherwise(F.md5(F.concat(F.size("hs").cast("string"), F.lit(":"), F.array_join("hs", ","))))
    return many.select(*KEY, "node_type", whole.alias("hash"), "edge_count", "name_edge_count")


def next_generation(stored: DataFrame, current: DataFrame, generation: int) -> DataFrame:
    """Shift: current shapes with the stored ones as previous. What is gone stays one generation as a
    tombstone (hash null) and leaves with the next."""
    old = stored.select(*KEY, F.col("hash").alias("prev_hash"), F.col("generation").alias("prev_generation"), F.col("node_type").alias("old_type"))
    both = current.join(old, KEY, "full_outer").where(F.col("hash").isNotNull() | F.col("prev_hash").isNotNull())
    return both.select(*KEY, F.coalesce("node_type", "old_type").alias("node_type"), "hash", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"), F.coalesce("name_edge_count", F.lit(0)).cast("long").alias("name_edge_count"), F.lit(generation).cast("long").alias("generation"), "prev_hash", "prev_generation")


def renames(shifted: DataFrame) -> DataFrame:
    """(hash, from_name, to_name, ...): a shape gone under one key and come under one other, alone on
    both sides."""
    new = shifted.where("hash is not null and prev_hash is null").groupBy("hash").agg(F.count("*").alias("n"), F.first("qualified_name").alias("to_name"), F.first("file_path").alias("to_file")).where("n = 1")
    old = shifted.where("hash is null and prev_hash is not null").groupBy(F.col("prev_hash").alias("hash")).agg(F.count("*").alias("m"), F.first("qualified_name").alias("from_name"), F.first("file_path").alias("from_file")).where("m = 1")
    return new.join(old, "hash").select("hash", "from_name", "from_file", "to_name", "to_file")


def delta(shifted: DataFrame) -> DataFrame:
    """(qualified_name, file_path, state, renamed_from): preserved, changed, added or removed."""
    pairs = renames(shifted)
    state = F.when(F.col("hash").isNull(), "removed").when(F.col("prev_hash").isNull(), "added").when(F.col("hash") == F.col("prev_hash"), "preserved").otherwise("changed")
    rows = shifted.select(*KEY, state.alias("state"))
    came = pairs.select(F.col("to_name").alias("qualified_name"), F.col("to_file").alias("file_path"), F.col("from_name").alias("renamed_from"))
    went = pairs.select(F.col("from_name").alias("qualified_name"), F.col("from_file").alias("file_path"))
    gone = rows.join(went.withColumn("moved", F.lit(True)), KEY, "left").where("not (state = 'removed' and coalesce(moved, false))").drop("moved")
    out = gone.join(came, KEY, "left")
    return out.select(*KEY, F.when(F.col("renamed_from").isNotNull(), "preserved").otherwise(F.col("state")).alias("state"), "renamed_from")


def stats(shifted: DataFrame) -> DataFrame:
    """One row: symbols that have a shape, how many of them changed or were added, how many are gone, generation."""
    new, old = F.col("hash").isNotNull(), F.col("prev_hash").isNotNull()
    return shifted.agg(F.count_if(new).alias("symbols"), F.count_if(new & old & (F.col("hash") != F.col("prev_hash"))).alias("changed"), F.count_if(new & ~old).alias("added"), F.count_if(~new & old).alias("removed"), F.max("generation").alias("generation"))
