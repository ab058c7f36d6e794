"""Search, summaries, degrees, coupling, mutual cycles, clones: grouped counts and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .resolve import located


def search(nodes: DataFrame, text: str, node_type: str | None = None, limit: int = 20) -> DataFrame:
    """Definitions whose name has ``text`` in it; imports only when their type is asked for."""
    hit = nodes.where(F.contains("name", F.lit(text)))
    hit = hit.where(F.col("node_type") == node_type) if node_type else hit.where("node_type <> 'import'")
    return hit.select("node_id", "name", "node_type", "file_path", "start_line", "qualified_name").orderBy("file_path", "start_line", "node_id").limit(limit)


def tally(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def edge_types(edges: DataFrame, contains: DataFrame, file_refs: DataFrame) -> DataFrame:
    """Edges of all kinds by type, derived ones too."""
    every = edges.select("edge_type").unionByName(contains.select("edge_type")).unionByName(file_refs.select(F.lit("file_ref").alias("edge_type")))
    return tally(every, "edge_type")


def scoped(nodes: DataFrame, edges: DataFrame, wanted: str) -> DataFrame:
    """(section, key, n) of the nodes whose file matches, and of the edges that come from them; with
    files in all and matched, and the three first as samples."""
    hit = nodes.where(names.file_filter(F.col("file_path"), wanted))
    from_hit = edges.join(hit.select(F.col("node_id").alias("from_id")), "from_id", "left_semi")

    def part(name: str, rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")

    files = nodes.agg(F.count_distinct("file_path").alias("n")).select(F.lit("files").alias("section"), F.lit("total").alias("key"), "n")
    own = hit.agg(F.count_distinct("file_path").alias("n")).select(F.lit("files").alias("section"), F.lit("matched").alias("key"), "n")
    first = hit.select("file_path").distinct().orderBy("file_path").limit(3).select(F.lit("sample").alias("section"), F.col("file_path").alias("key"), F.lit(1).cast("long").alias("n"))
    return part("type", hit, "node_type").unionByName(part("language", hit, "language")).unionByName(part("edge", from_hit, "edge_type")).unionByName(files).unionByName(own).unionByName(first)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every definition but imports with its degrees: references to its verbatim name and type, of
    whatever confidence, and references from it."""
    into = edges.where("to_name is not null").groupBy(F.col("to_name").alias("name"), F.col("to_type").alias("node_type")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("from_id").alias("node_id")).agg(F.count("*").alias("out_degree"))
    own = nodes.where("node_type <> 'import'").join(into, ["name", "node_type"], "left").join(out, "node_id", "left")
    own = own.na.fill(0, ["in_degree", "out_degree"])
    return own.select("node_id", "name", "node_type", "file_path", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("total"), "file_path", "name", "node_id").limit(limit)


def coupling(nodes: DataFrame, edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """Per file: references into it from other files and out of it, a verbatim name standing for the
    least path that defines it, instability, definitions."""
    known = nodes.where("node_type <> 'import'")
    at = known.groupBy(F.col("name").alias("to_name"), F.col("node_type").alias("to_type")).agg(F.min("file_path").alias("to_file"))
    pairs = edges.join(nodes.select(F.col("node_id").alias("from_id"), F.col("file_path").alias("from_file")), "from_id").groupBy("from_file", "to_name", "to_type").agg(F.count("*").alias("n"))
    pairs = pairs.join(at, ["to_name", "to_type"]).where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.sum("n").alias("n"))
    into = pairs.groupBy(F.col("to_file").alias("file_path")).agg(F.sum("n").alias("afferent"))
    out = pairs.groupBy(F.col("from_file").alias("file_path")).agg(F.sum("n").alias("efferent"))
    own = known.groupBy("file_path").agg(F.count("*").alias("node_count"))
    every = own.join(into, "file_path", "left").join(out, "file_path", "left").na.fill(0, ["afferent", "efferent"])
    every = every.withColumn("instability", names.instability(F.col("afferent"), F.col("efferent"), 0.0)).withColumn("total", F.col("afferent") + F.col("efferent"))
    return every.orderBy(F.desc("total"), "file_path").limit(limit) if limit else every


def mutual_pairs(bound: DataFrame, nodes: DataFrame, file_refs: DataFrame | None = None) -> DataFrame:
    """Pairs of files a < b that refer to each other: references both ways and their kinds. Derived
    file references count none; a pair that has only those is 'file_ref'."""
    pairs = located(bound, nodes).where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count("*").alias("n"), F.collect_set("edge_type").alias("via"))
    if file_refs is not None:
        rest = file_refs.join(pairs, ["from_file", "to_file"], "left_anti").select("from_file", "to_file", F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("via"))
        pairs = pairs.unionByName(rest)
    back = pairs.select(F.col("to_file").alias("from_file"), F.col("from_file").alias("to_file"), F.col("n").alias("m"), F.col("via").alias("also"))
    both = pairs.where("from_file < to_file").join(back, ["from_file", "to_file"])
    kinds = F.array_sort(F.array_union("via", "also"))
    kinds = F.when(F.size(kinds) == 0, F.array(F.lit("file_ref"))).otherwise(kinds)
    return both.select(F.col("from_file").alias("file_a"), F.col("to_file").alias("file_b"), F.col("n").alias("a_to_b"), F.col("m").alias("b_to_a"), (F.col("n") + F.col("m")).alias("total"), F.array_join(kinds, ",").alias("via"))


def clone_members(prints: DataFrame, nodes: DataFrame, min_edges: int = 3) -> DataFrame:
    """Members of each group of equal shapes: big enough, with a reference by name, not alone. Shown
    with the first definition by line of each member's key."""
    fit = prints.where(F.col("hash").isNotNull() & (F.col("edge_count") >= min_edges) & (F.col("name_edge_count") > 0))
    groups = fit.groupBy("hash").agg(F.count("*").alias("group_size")).where("group_size >= 2")
    line = F.struct(F.coalesce("start_line", F.lit(2**31 - 1)).alias("l"), F.col("node_id"))
    shown = nodes.where("node_type not in ('import', 'macro_call')").groupBy("qualified_name", "file_path").agg(F.min_by(F.struct("name", "node_type", "start_line"), line).alias("d"))
    return fit.join(groups, "hash").join(shown, ["qualified_name", "file_path"], "left").select("hash", "group_size", "file_path", "d.start_line", "qualified_name", "d.name", "edge_count")


def live_stats(**tables: DataFrame) -> DataFrame:
    """(table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
