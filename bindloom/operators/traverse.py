"""Bounded walks over bound references, for many roots at once.

Depths are small constants, so a walk is that many joins, declared at once: the definitions at the
end of a walk of k steps, then the least k of each. Walks do not carry paths, and their ends are
made distinct at each step, so a cycle costs nothing. Roots are a column, not a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import names
from . import resolve


def links(bound: DataFrame, kinds: tuple[str, ...] = names.NAME_EDGES) -> DataFrame:
    """(src, dst) of bound references of some kinds; walks make their ends distinct, so links need not be."""
    e = bound.where((F.col("confidence") == "RESOLVED") & (F.col("to_id") != "") & F.col("edge_type").isin(*kinds))
    return e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def reversed_links(step: DataFrame) -> DataFrame:
    return step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(roots: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """(root_id, node_id, depth): what can be reached from ``roots`` (root_id, node_id) in at most
    ``depth`` steps, at its least depth; roots at 0. Each step's ends are written and counted: few of them go to
    the links instead of a shuffle of all links, and a walk without ends is over."""
    front, n = storage.counted_lookup(roots.select("root_id", "node_id").distinct(), "front")
    every = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        if not n:
            break
        ends = front.join(step, front["node_id"] == step["src"]).select("root_id", F.col("dst").alias("node_id")).distinct()
        front, n = storage.counted_lookup(ends, "front")
        every = every.unionByName(front.withColumn("depth", F.lit(d)))
    return every.groupBy("root_id", "node_id").agg(F.min("depth").alias("depth"))


def nearest(roots: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """(node_id, root_id, label, depth): as ``reach`` from ``roots`` (root_id, node_id, label), but only enough
    roots of each end and length of walk to tell the nearest root, and the nearest other than the end itself, of
    equally near ones the least by label. Two roots do: each step keeps the two least, and whatever is least at
    the end of a walk is among the two least at every place before."""
    front, n = storage.counted_lookup(roots.select("root_id", "node_id", "label").distinct(), "front")
    every = front.withColumn("depth", F.lit(0))
    order = Window.partitionBy("node_id").orderBy("label", "root_id")
    for d in range(1, depth + 1):
        if not n:
            break
        ends = front.join(step, front["node_id"] == step["src"]).select("root_id", F.col("dst").alias("node_id"), "label").distinct()
        ends = ends.withColumn("place", F.row_number().over(order)).where("place <= 2").drop("place")
        front, n = storage.counted_lookup(ends, "front")
        every = every.unionByName(front.withColumn("depth", F.lit(d)))
    return every


def named_roots(nodes: DataFrame, name: str, functions_only: bool = False) -> DataFrame:
    """Definitions of exactly that name: functions for call chains, all but imports elsewhere."""
    hit = nodes.where(F.col("name") == name)
    hit = hit.where("node_type = 'function'") if functions_only else hit.where("node_type <> 'import'")
    return hit.select(F.col("node_id").alias("root_id"), "node_id")


def described(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """What was reached beyond the roots, with its attributes."""
    what = nodes.select("node_id", "name", "qualified_name", "node_type", "file_path")
    return found.where("depth > 0").join(what, "node_id")


def credited(found: DataFrame, step: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root_id, caller_id, node_id, depth): each reached definition with the least caller, by file,
    qualified name and id, among those one step before."""
    at = found.select("root_id", F.col("node_id").alias("caller_id"), (F.col("depth") + 1).alias("depth"))
    via = at.join(step, at["caller_id"] == step["src"]).select("root_id", "caller_id", F.col("dst").alias("node_id"), "depth")
    via = found.where("depth > 0").join(via, ["root_id", "node_id", "depth"])
    who = nodes.select(F.col("node_id").alias("caller_id"), F.col("file_path").alias("cf"), F.col("qualified_name").alias("cq"))
    best = via.join(who, "caller_id").groupBy("root_id", "node_id", "depth").agg(F.min(F.struct("cf", "cq", "caller_id")).alias("c"))
    return best.select("root_id", F.col("c.caller_id").alias("caller_id"), "node_id", "depth")


def call_chain(bound: DataFrame, nodes: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """Calls that functions of a name lead to, each callee once, from its least caller."""
    step = links(bound, ("calls",))
    found = reach(named_roots(nodes, name, functions_only=True), step, depth)
    c = credited(found, step, nodes)
    a, b = (nodes.select(F.col("node_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("file_path").alias(f"{p}_file")) for p in ("caller", "callee"))
    return c.withColumnRenamed("node_id", "callee_id").join(a, "caller_id").join(b, "callee_id").select("root_id", "depth", "caller_id", "caller_name", "caller_file", "callee_id", "callee_name", "callee_file")


def ambiguous_calls(bound: DataFrame, nodes: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """Ambiguous calls of what functions of a name lead to, one step deeper than their source."""
    found = reach(named_roots(nodes, name, functions_only=True), links(bound, ("calls",)), depth)
    return ambiguous_of(found, bound, depth, ("calls",))


def dependencies(bound: DataFrame, nodes: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """What definitions of a name depend on."""
    return described(reach(named_roots(nodes, name), links(bound), depth), nodes)


def dependents(bound: DataFrame, nodes: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """What depends on definitions of a name."""
    return described(reach(named_roots(nodes, name), reversed_links(links(bound)), depth), nodes)


def unresolved_of_roots(bound: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The roots' own references that nothing answers."""
    own = bound.where(F.col("edge_type").isin(*names.NAME_EDGES) & (F.col("confidence") == "UNRESOLVED"))
    return own.join(named_roots(nodes, name).select("root_id", F.col("node_id").alias("from_id")), "from_id").select("root_id", "to_name", "to_type", "edge_type")


def ambiguous_of(found: DataFrame, bound: DataFrame, depth: int, kinds: tuple[str, ...] = names.NAME_EDGES) -> DataFrame:
    """Ambiguous references of what was reached before the last step, one step deeper."""
    own = bound.where(F.col("edge_type").isin(*kinds) & (F.col("confidence") == "AMBIGUOUS")).select("edge_id", "from_id", "to_name", "to_type", "n_candidates")
    inner = found.where(F.col("depth") < depth).select("root_id", F.col("node_id").alias("from_id"), (F.col("depth") + 1).alias("depth"))
    return own.join(inner, "from_id").select("root_id", "edge_id", "from_id", "to_name", "to_type", "n_candidates", "depth")


def ambiguous_into(found: DataFrame, bound: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Ambiguous references that may mean what was reached, by their candidates. What was reached meets its
    classes first, so that pairs come to be in the last step alone."""
    inner = found.where(F.col("depth") < depth).select("root_id", "node_id", (F.col("depth") + 1).alias("depth"))
    wanted = nodes.join(inner.select("node_id").distinct(), "node_id", "left_semi")
    may = storage.lookup(inner.join(resolve.classes_of(wanted), "node_id").withColumnRenamed("node_id", "candidate"), "reached-classes")
    e = resolve.classed(bound.where(F.col("edge_type").isin(*names.NAME_EDGES)).select("edge_id", "from_id", "to_name", "to_type", "confidence"), nodes, wanted)
    return e.join(may, resolve.CLASS).select("root_id", "candidate", "edge_id", "from_id", "to_name", "to_type", "depth")


def live_definitions(nodes: DataFrame, queried: DataFrame) -> DataFrame:
    """(queried, n_live): definitions but imports of each queried bare name."""
    live = nodes.where("node_type <> 'import'").groupBy(F.col("name").alias("queried")).agg(F.count("*").alias("n_live"))
    return queried.select("queried").distinct().join(live, "queried", "left").na.fill(0, ["n_live"])


def stale(bound: DataFrame, nodes: DataFrame, queried: DataFrame) -> DataFrame:
    """Unresolved references that a change of the queried names (column ``queried``) may have broken.

    Without a live definition: those that end in the name, or have it as a receiver. With one: those
    that end in it and agree with a live definition in type and family and, if qualified, in suffix."""
    asked = storage.lookup(queried.select(names.bare(names.normalized(F.col("queried"))).alias("queried")).distinct(), "queried")
    counted = storage.lookup(live_definitions(nodes, asked), "live")
    keys = ["queried", "edge_id", "from_id", "from_name", "from_file", "to_name", "to_type"]
    e = bound.where((F.col("confidence") == "UNRESOLVED") & F.col("edge_type").isin(*names.NAME_EDGES)).select("edge_id", "from_id", "to_name", "to_type", names.normalized(F.col("to_name")).alias("norm"))
    e = e.withColumn("segments", F.split("norm", "::"))
    e = e.withColumn("queried", F.explode(F.array_distinct("segments"))).join(counted, "queried")
    e = e.withColumn("ends", F.element_at("segments", -1) == F.col("queried")).where("n_live = 0 or ends")
    src = nodes.select(F.col("node_id").alias("from_id"), F.col("name").alias("from_name"), F.col("file_path").alias("from_file"), names.family(F.col("language")).alias("family"))
    e = e.join(src, "from_id")
    # a live name that is its reference's end: the key of what must be there, '' for a bare name
    e = e.withColumn("tail", F.when(F.size("segments") > 1, F.col("norm")).otherwise(""))
    live = nodes.where("node_type <> 'import'").join(counted.where("n_live > 0"), F.col("name") == F.col("queried"), "left_semi")
    live = resolve.classes_of(live).select(F.col("bare").alias("queried"), "to_type", "family", "tail").distinct()
    agree = e.where("n_live > 0").join(storage.lookup(live, "live-classes"), ["queried", "to_type", "family", "tail"], "left_semi")
    return e.where("n_live = 0").select(*keys).unionByName(agree.select(*keys))


def reverse_paths(bound: DataFrame, nodes: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """(root_id, node_id, depth, hops): a shortest path to each dependent, as node ids from the root
    out; of equal ones the least by file, qualified name and id at each step back."""
    step = reversed_links(links(bound))
    found = reach(named_roots(nodes, name), step, depth)
    via = credited(found, step, nodes)
    paths = found.where("depth = 0").select("root_id", "node_id", F.array("node_id").alias("hops"))
    every = None
    for d in range(1, depth + 1):
        at = via.where(F.col("depth") == d).select("root_id", "caller_id", F.col("node_id").alias("next"))
        paths = paths.withColumnRenamed("node_id", "caller_id").join(at, ["root_id", "caller_id"]).select("root_id", F.col("next").alias("node_id"), F.concat("hops", F.array("next")).alias("hops"))
        layer = paths.select("root_id", "node_id", F.lit(d).alias("depth"), F.array_join("hops", ">").alias("hops"))
        every = layer if every is None else every.unionByName(layer)
    return every
