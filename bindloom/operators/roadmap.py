"""A roadmap as a hypergraph over code: items are hyperedges, touches their incidences.

planes: plane_id, title, status, horizon, ordinal. items: item_id, plane_id, title, kind, status,
depends_on (array), ordinal. touches: item_id, ordinal, selector (file, symbol, glob), raw.
bound touches: the touches' columns with to_id, confidence, reason, indexed, n_candidates; one row a
match, so that collisions and walks are plain joins on to_id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import names
from . import traverse

TOUCH = ["item_id", "ordinal", "selector", "raw"]
BOUND = [*TOUCH, "to_id", "confidence", "reason", "indexed", "n_candidates"]


def _verdict(rows: DataFrame, to_id, confidence, reason, indexed, n) -> DataFrame:
    return rows.select(*TOUCH, to_id.alias("to_id"), confidence.alias("confidence"), reason.alias("reason"), indexed.alias("indexed"), n.cast("long").alias("n_candidates"))


def _none(kind: str):
    return F.lit(None).cast(kind)


def known_files(nodes: DataFrame, disk: DataFrame | None = None) -> DataFrame:
    """(file_path, indexed): files with definitions, and those of the working tree."""
    own = nodes.select("file_path", F.lit(True).alias("indexed"))
    if disk is not None:
        own = own.unionByName(disk.select("file_path", F.lit(False).alias("indexed")))
    return own.groupBy("file_path").agg(F.max("indexed").alias("indexed"))


def matched_globs(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(pattern, file_path, indexed) of each match. Patterns meet only files below their literal
    leading folders: an equi-join on a folder, then the pattern's regular expression."""

    @F.pandas_udf("stem string, rule string")
    def compiled(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"stem": [names.glob_stem(p) for p in s], "rule": [names.plan_glob(p) for p in s]})

    p = patterns.select("pattern").distinct().withColumn("g", compiled("pattern")).select("pattern", "g.stem", "g.rule")
    parts = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    f = files.select("file_path", "indexed", F.explode(folders).alias("stem"))
    return p.join(f, "stem").where(F.rlike("file_path", F.col("rule"))).select("pattern", "file_path", "indexed")


def symbol_pool(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type not in ('import', 'module')").select("node_id", "name", "qualified_name")


def bind_touches(touches: DataFrame, nodes: DataFrame, disk: DataFrame | None = None) -> DataFrame:
    """Bind each touch: a file to its path, a symbol to the only definition of its qualified or else
    bare name, a glob to each file that it matches. Never a guess: several are AMBIGUOUS."""
    files = known_files(nodes, disk)
    t = touches.select(*TOUCH)
    by_file = t.where("selector = 'file'").withColumn("path", names.repo_path(F.col("raw"))).join(files.withColumnRenamed("file_path", "path"), "path", "left")
    there = F.col("indexed").isNotNull()
    file_rows = _verdict(by_file, F.when(there, F.col("path")), F.when(there, "RESOLVED").otherwise("UNRESOLVED"), F.when(~there, "no_such_file"), F.col("indexed"), there.cast("int"))

    pool = symbol_pool(nodes)
    whole = pool.groupBy(F.col("qualified_name").alias("norm")).agg(F.count("*").alias("nq"), F.min("node_id").alias("tq"))
    tail = pool.groupBy(F.col("name").alias("bare")).agg(F.count("*").alias("nb"), F.min("node_id").alias("tb"))
    s = t.where("selector = 'symbol'").withColumn("norm", names.normalized(F.col("raw")))
    s = s.withColumn("bare", names.bare(F.col("norm"))).join(whole, "norm", "left").join(tail, "bare", "left")
    exact = F.contains("norm", F.lit("::")) & F.col("nq").isNotNull()
    n = F.when(exact, F.col("nq")).otherwise(F.coalesce("nb", F.lit(0)))
    only = F.when(exact, F.col("tq")).otherwise(F.col("tb"))
    state = F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    symbol_rows = _verdict(s, F.when(n == 1, only), state, F.when(n == 0, "no_such_symbol").when(n > 1, "ambiguous_candidates"), _none("boolean"), n)

    g = t.where("selector = 'glob'").withColumn("pattern", names.repo_path(F.col("raw")))
    g = g.join(matched_globs(g, files), "pattern", "left")
    found = F.col("file_path").isNotNull()
    glob_rows = _verdict(g, F.col("file_path"), F.when(found, "RESOLVED").otherwise("UNRESOLVED"), F.when(~found, "no_glob_match"), F.col("indexed"), found.cast("int"))
    return file_rows.unionByName(symbol_rows).unionByName(glob_rows)


def candidates(bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, ordinal, candidate) of ambiguous symbol touches."""
    pool = symbol_pool(nodes)
    a = bound.where("confidence = 'AMBIGUOUS'").select("item_id", "ordinal", names.normalized(F.col("raw")).alias("norm"))
    whole = a.join(pool.withColumnRenamed("qualified_name", "norm"), "norm").where(F.contains("norm", F.lit("::"))).select("item_id", "ordinal", F.col("node_id").alias("candidate"))
    rest = a.join(whole.select("item_id", "ordinal").distinct(), ["item_id", "ordinal"], "left_anti").withColumn("name", names.bare(F.col("norm")))
    return whole.unionByName(rest.join(pool, "name").select("item_id", "ordinal", F.col("node_id").alias("candidate")))


def tallies(items: DataFrame, bound: DataFrame) -> DataFrame:
    """Per item: rows, resolved, ambiguous, unresolved, selectors, unindexed; items without touches too."""
    per = bound.groupBy("item_id").agg(
        F.count("*").alias("touch_count"),
        *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("RESOLVED", "AMBIGUOUS", "UNRESOLVED")],
        F.count_distinct("ordinal").alias("selector_count"),
        F.count_if(~F.col("indexed")).alias("unindexed"),
    )
    counts = [c for c in per.columns if c != "item_id"]
    return items.select("item_id", "plane_id", "status").join(per, "item_id", "left").na.fill(0, counts)


def reasons(bound: DataFrame) -> DataFrame:
    """(reason, n) of unresolved touches, most first."""
    bad = bound.where("confidence = 'UNRESOLVED'")
    return bad.groupBy(F.coalesce("reason", F.lit("unrecorded")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def listed(planes: DataFrame, items: DataFrame, *, plane: str | None = None, status: str | None = None, horizon: str | None = None) -> DataFrame:
    """(plane_id, title, horizon, item_id, item_status): planes that fit, with their items that fit; a
    plane stays when none does."""
    p = planes.where(F.col("plane_id") == plane) if plane else planes
    p = p.where(F.col("horizon") == horizon) if horizon else p
    i = items.where(F.col("status") == status) if status else items
    i = i.select("plane_id", "item_id", F.col("status").alias("item_status"))
    return p.select("plane_id", "title", "horizon").join(i, "plane_id", "left")


def blocks(items: DataFrame) -> DataFrame:
    """(item_id, blocked): what waits for each item."""
    return items.select(F.explode("depends_on").alias("on"), F.col("item_id").alias("blocked")).join(items.select(F.col("item_id").alias("on")), "on").select(F.col("on").alias("item_id"), "blocked").distinct()


def touching(bound: DataFrame, nodes: DataFrame, target: str, disk: DataFrame | None = None) -> DataFrame:
    """(item_id, ordinal, selector, raw, matched_by): touches of a path or symbol: bound to it, with it among
    the candidates, or only spelled like it."""
    spark = bound.sparkSession
    one = spark.createDataFrame([("", 0, "symbol", target)], "item_id string, ordinal long, selector string, raw string")
    as_symbol = bind_touches(one, nodes, disk)
    may = as_symbol.where("to_id is not null").select("to_id").unionByName(candidates(as_symbol, nodes).select(F.col("candidate").alias("to_id")))
    path = names.repo_path(F.lit(target))
    may = may.unionByName(known_files(nodes, disk).where(F.col("file_path") == path).select(F.col("file_path").alias("to_id"))).distinct()
    hit = bound.where("confidence = 'RESOLVED'").join(may, "to_id", "left_semi").select(*TOUCH, F.lit(1).alias("k"))
    cand = candidates(bound, nodes).join(may.withColumnRenamed("to_id", "candidate"), "candidate", "left_semi").select("item_id", "ordinal").distinct()
    near = bound.select(*TOUCH).join(cand, ["item_id", "ordinal"]).withColumn("k", F.lit(2))
    same = bound.where((F.col("raw") == target) | (names.repo_path(F.col("raw")) == path)).select(*TOUCH, F.lit(3).alias("k"))
    best = hit.unionByName(near).unionByName(same).groupBy(*TOUCH).agg(F.min("k").alias("k"))
    return best.select(*TOUCH, F.when(F.col("k") == 1, "bound").when(F.col("k") == 2, "candidate").otherwise("literal").alias("matched_by"))


def shared_members(items: DataFrame, bound: DataFrame, status: str = "active") -> DataFrame:
    """(to_id, item_id): each item of a status at each target that it shares with another, by touches of any
    selector. All pairs of ``collisions`` and their counts follow from it; it grows with the touches."""
    live = items.where(F.col("status") == status).select("item_id")
    t = bound.where("confidence = 'RESOLVED'").join(live, "item_id", "left_semi").select("to_id", "item_id").distinct()
    return t.join(shared_targets(items, bound, status).select("to_id"), "to_id", "left_semi")


def shared_targets(items: DataFrame, bound: DataFrame, status: str = "active") -> DataFrame:
    """(to_id, n_items, first_item, last_item): what several items of a status touch. Grows with the touches."""
    live = items.where(F.col("status") == status).select("item_id")
    t = bound.where("confidence = 'RESOLVED'").join(live, "item_id", "left_semi").select("to_id", "item_id").distinct()
    return t.groupBy("to_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item")).where("n_items > 1")


#: Pairs that one task of ``collisions`` counts, about; items of a target that are one list, at most about.
PAIRS, LISTED = 4_000_000, 10_000


def collisions(items: DataFrame, bound: DataFrame, status: str = "active", selectors: tuple[str, ...] = ("file", "symbol", "glob")) -> DataFrame:
    """(item_a, item_b, n_shared): pairs of items of a status that touch the same; the pairs are the answer,
    so they grow with the square of what shares a target: ``shared_targets`` is the linear form.

    Pairs are never shuffled. Items are dealt to tasks by their number of pairs, targets go to all tasks with their
    items as lists, and a task counts the pairs of its own items. Lists too large to be sent come in shares of the
    items, each small enough; the pairs of an item are in one share."""
    live = items.where(F.col("status") == status).select("item_id")
    t = bound.where((F.col("confidence") == "RESOLVED") & F.col("selector").isin(*selectors)).join(live, "item_id", "left_semi").select("to_id", "item_id").distinct()
    t = storage.snapshot(t, "touched")
    sizes = t.groupBy("to_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("item_id") + 16).alias("size"))
    sizes = storage.snapshot(sizes.where("n > 1"), "shared")
    n_pairs, size = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum(F.col("size") + F.octet_length("to_id") + storage.ROW_BYTES)).first()
    t = t.join(sizes.select("to_id", F.ceil(F.col("n") / LISTED).alias("parts")), "to_id")
    shares = max(1, -(-2 * (size or 0) // storage.BROADCAST_BYTES))
    dealt = t.select("to_id", "item_id", F.pmod(F.xxhash64("item_id"), F.lit(shares)).alias("share"), F.pmod(F.xxhash64("item_id", "to_id"), F.col("parts")).alias("part"))
    lists = storage.snapshot(dealt.groupBy("share", "to_id", "part").agg(F.collect_list("item_id").alias("others")), "shared-lists")
    own = t.select("to_id", F.col("item_id").alias("item_a")).repartition(max(1, int(n_pairs or 0) // PAIRS // shares, _tasks(t)), "item_a")
    out = None
    for k in range(shares):
        met = own.join(F.broadcast(lists.where(F.col("share") == k).select("to_id", "others")), "to_id")
        pairs = met.select("item_a", F.explode("others").alias("item_b")).where("item_a < item_b").groupBy("item_a", "item_b").agg(F.count("*").alias("n_shared"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stale(items: DataFrame, bound: DataFrame) -> DataFrame:
    """(item_id, status, n_unresolved, reasons) of planned and active items that touch what is not there."""
    open_items = items.where("status in ('planned', 'active')").select("item_id", "status")
    per = bound.where("confidence = 'UNRESOLVED'").groupBy("item_id").agg(F.count("*").alias("n_unresolved"), F.array_join(F.array_sort(F.collect_set(F.coalesce("reason", F.lit("unrecorded")))), ",").alias("reasons"))
    return open_items.join(per, "item_id")


def blast_seeds(bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root_id, node_id): item and each definition that it touches, itself or by its file."""
    ok = bound.where("confidence = 'RESOLVED' and coalesce(indexed, true)").select("item_id", "selector", "to_id")
    own = ok.where("selector = 'symbol'").join(nodes.select(F.col("node_id").alias("to_id")), "to_id", "left_semi").select(F.col("item_id").alias("root_id"), F.col("to_id").alias("node_id"))
    inside = ok.where("selector <> 'symbol'").join(nodes.select(F.col("file_path").alias("to_id"), "node_id"), "to_id").select(F.col("item_id").alias("root_id"), "node_id")
    return own.unionByName(inside).distinct()


def blast(bound: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(item_id, node_id, depth, name, file_path): what depends on what items touch, at its least depth,
    without the touched themselves. One walk for all items of ``bound``."""
    seeds = blast_seeds(bound, nodes)
    found = traverse.reach(seeds, traverse.reversed_links(traverse.links(edges)), depth).where("depth > 0")
    found = found.join(seeds, ["root_id", "node_id"], "left_anti")
    return found.join(nodes.select("node_id", "name", "file_path"), "node_id").select(F.col("root_id").alias("item_id"), "node_id", "depth", "name", "file_path")
