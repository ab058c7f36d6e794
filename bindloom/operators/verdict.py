"""Impact verdicts and what changes between two snapshots of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import names
from . import resolve, traverse

KEYS = ["name", "qualified_name", "node_type", "file_path"]
DEPTH = 3


def impact(bound: DataFrame, nodes: DataFrame, queried: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(section, of_name, node_id, name, qualified_name, file_path, to_name, depth): the verdict on a change of
    the queried names (column ``queried``), all at once. Sections: symbol (definitions of the name),
    dependent, ambiguous, stale. A dependent reached from several names is listed once, by its least depth
    and name; ambiguous and stale references once by file, name and what they name."""
    live = nodes.where("node_type <> 'import'")
    q = queried.select(F.col("queried").alias("name")).distinct()
    roots = live.join(q, "name", "left_semi").select(F.col("node_id").alias("root_id"), "node_id", "name")
    what = nodes.select("node_id", "name", "qualified_name", "file_path")
    symbols = roots.select("node_id", F.col("name").alias("of_name")).join(what, "node_id").select(F.lit("symbol").alias("section"), "of_name", "node_id", "name", "qualified_name", "file_path", F.lit(None).cast("string").alias("to_name"), F.lit(0).alias("depth"))
    found = traverse.nearest(roots.withColumnRenamed("name", "label"), traverse.reversed_links(traverse.links(bound)), depth)
    dep = found.where("depth > 0 and root_id <> node_id").groupBy("node_id").agg(F.min(F.struct("depth", F.col("label").alias("of_name"))).alias("m"))
    dep = dep.join(what, "node_id").select(F.lit("dependent").alias("section"), F.col("m.of_name").alias("of_name"), "node_id", "name", "qualified_name", "file_path", F.lit(None).cast("string").alias("to_name"), F.col("m.depth").alias("depth"))
    # the nearest of what a class may mean stands for all of it: no pairs of references and definitions
    inner = found.where(F.col("depth") < depth).groupBy("node_id").agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), F.col("label").alias("of_name"))).alias("near"))
    inner = nodes.join(inner, "node_id")
    near = resolve.classes_of(inner, "near").groupBy(*resolve.CLASS).agg(F.min("near").alias("near"))
    amb = resolve.classed(bound.where(F.col("edge_type").isin(*names.NAME_EDGES)).select("from_id", "to_name", "to_type", "confidence"), nodes, inner)
    amb = amb.join(storage.lookup(near, "near-classes"), resolve.CLASS).groupBy("from_id", "to_name").agg(F.min("near").alias("near"))
    amb = amb.join(what.withColumnRenamed("node_id", "from_id"), "from_id")
    amb = amb.groupBy("file_path", "name", "to_name").agg(F.min(F.struct("near.depth", "near.of_name", "from_id", "qualified_name")).alias("m"))
    amb = amb.select(F.lit("ambiguous").alias("section"), F.col("m.of_name").alias("of_name"), F.col("m.from_id").alias("node_id"), "name", F.col("m.qualified_name").alias("qualified_name"), "file_path", "to_name", F.col("m.depth").alias("depth"))
    old = traverse.stale(bound, nodes, queried).groupBy(F.col("from_file").alias("file_path"), F.col("from_name").alias("name"), "to_name").agg(F.min(F.struct("queried", "from_id")).alias("m"))
    old = old.select(F.lit("stale").alias("section"), F.col("m.queried").alias("of_name"), F.col("m.from_id").alias("node_id"), "name", F.lit(None).cast("string").alias("qualified_name"), "file_path", "to_name", F.lit(0).alias("depth"))
    return symbols.unionByName(dep).unionByName(amb).unionByName(old)


def touched_names(nodes: DataFrame, paths: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """(queried): names defined in the files (column ``file_path``), and those deleted from them."""
    own = nodes.where("node_type <> 'import' and name <> ''").join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("name").alias("queried"))
    if deletions is not None:
        own = own.unionByName(deletions.join(paths.select("file_path").distinct(), "file_path", "left_semi").where("name <> ''").select(F.col("name").alias("queried")))
    return own.distinct()


def summary(verdict: DataFrame) -> DataFrame:
    """One row: rows of each section, and whether the change is clean: no ambiguous, no stale reference."""
    counts = [F.count_if(F.col("section") == s).alias(f"n_{s}") for s in ("symbol", "dependent", "ambiguous", "stale")]
    return verdict.agg(*counts).withColumn("clean", F.col("n_ambiguous") + F.col("n_stale") == 0)


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, change): added, modified, unchanged or deleted, by content hashes of two listings
    (file_path, content_hash) with exact relative paths."""
    old = before.select("file_path", F.col("content_hash").alias("old_hash"))
    both = old.join(after.select("file_path", F.col("content_hash").alias("new_hash")), "file_path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return both.select("file_path", change.alias("change"))


def deleted_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, qualified_name, node_type, file_path) of definitions but imports that are in no row of
    ``after`` under their qualified name and file."""
    gone = before.where("node_type <> 'import'").join(after.where("node_type <> 'import'").select("qualified_name", "file_path"), ["qualified_name", "file_path"], "left_anti")
    return gone.select(*KEYS).distinct()


def healed(deletions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Recorded deletions but those defined again in the same file."""
    live = nodes.where("node_type <> 'import'").select("qualified_name", "file_path")
    return deletions.join(live, ["qualified_name", "file_path"], "left_anti").select(*KEYS)


def recorded(deletions: DataFrame, before: DataFrame, after: DataFrame, *, force: bool = False) -> DataFrame:
    """The deletions to keep after a run: the healed old ones and the new ones; none after a forced run."""
    if force:
        return deletions.select(*KEYS).limit(0)
    return healed(deletions, after).unionByName(deleted_symbols(before, after)).distinct()


def receivers(bound: DataFrame, queried: str) -> DataFrame:
    """References that have the name as a receiver: a segment before the last."""
    return bound.where(names.receiver_of(names.normalized(F.col("to_name")), queried))
