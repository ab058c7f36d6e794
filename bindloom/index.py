"""A project as tables: what extraction, binding and derivation leave behind, full or step by step.

Tables lie below a folder, one Parquet table each, below it a folder a project and a run. A run writes its
tables anew, each beside the one before, and then one small file that names the run of every table. Readers
follow the latest such file, so they see all of a run or nothing of it; a run that fails changes nothing. The
run before stays readable until the next one ends.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .operators import resolve, shapes, verdict
from .sources import files

TABLES = ("nodes", "edges", "contains", "file_metadata", "deletions", "fingerprints", "registry")
_COLUMNS = ["edge_id", "from_id", "to_name", "to_type", "edge_type"]


@dataclass
class Project:
    """One project's tables in a folder."""

    spark: SparkSession
    folder: str
    project_id: str

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder.rstrip("/"), *parts])

    def _pointers(self) -> list[str]:
        """Names of the project's pointer files, oldest first."""
        p, fs = storage._file_system(self.spark, self._path("current", self.project_id))
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _current(self) -> tuple[str, dict[str, str]]:
        """(mark, run of each table); ('', {}) before the first run. A file that is still being written is passed over."""
        for name in reversed(self._pointers()):
            body = storage.read_text(self.spark, self._path("current", self.project_id, name))
            if body.endswith("}"):
                return name, json.loads(body)
        return "", {}

    def stored(self, table: str) -> bool:
        return table in self._current()[1]

    def has(self, table: str = "registry") -> bool:
        return self.stored(table) and not self.table(table).isEmpty()

    def table(self, name: str) -> DataFrame:
        runs = self._current()[1]
        if name not in runs:
            raise LookupError(f"{self.project_id} has no table {name} yet")
        return self.spark.read.parquet(self._path(name, f"project_id={self.project_id}", f"run={runs[name]}")).drop("project_id", "run")

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Write tables as one run and then make it the current one of each."""
        mark, runs = self._current()
        run = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(self._path(name, f"project_id={self.project_id}", f"run={run}"))
        new = f"{int(mark.partition('-')[0] or 0) + 1:012d}-{run}"
        storage.write_text(self.spark, self._path("current", self.project_id, new), json.dumps(runs | dict.fromkeys(tables, run)))
        self._tidy(runs, set(tables))

    def _tidy(self, before: dict[str, str], names: set[str]) -> None:
        """Remove pointers and runs that are neither current nor the ones before."""
        now = self._current()[1]
        for old in self._pointers()[:-2]:
            storage.remove(self.spark, self._path("current", self.project_id, old))
        for name in names:
            p, fs = storage._file_system(self.spark, self._path(name, f"project_id={self.project_id}"))
            for x in fs.listStatus(p):
                if x.getPath().getName() not in (f"run={now[name]}", f"run={before.get(name)}"):
                    fs.delete(x.getPath(), True)

    def index(self, tree: DataFrame, *, tier: str = "balanced", force: bool = False) -> dict:
        """Bring the tables up to ``tree`` (as ``files.read_tree`` gives it). Unchanged files keep their rows;
        references are bound again where a change can touch them. ``force`` starts anew: everything is
        parsed and bound, deletion and fingerprint history begin afresh."""
        fresh = force or not self.has()
        listed = storage.snapshot(tree.select("file_path", "language", "content_hash", "file_size"), "listing")
        if fresh:
            changes = listed.select("file_path", F.lit("added").alias("change"))
            generation = 1
        else:
            changes = verdict.file_changes(self.table("file_metadata"), listed)
            generation = (self.table("registry").agg(F.max("generation")).first()[0] or 0) + 1
        changes = storage.snapshot(changes, "changes")
        moved = changes.where("change in ('added', 'modified')").select("file_path")
        rows = storage.snapshot(files.parsed(tree.join(moved, "file_path", "left_semi"), self.project_id, tier), "parsed")
        new_nodes, new_edges = files.nodes_of(rows).drop("project_id"), files.edges_of(rows).drop("project_id")
        if fresh:
            before, nodes, kept, contains = None, new_nodes, None, new_edges.where("to_id <> ''")
        else:
            gone = changes.where("change in ('modified', 'deleted')").select("file_path")
            before = storage.snapshot(self.table("nodes"), "before")
            nodes = before.join(gone, "file_path", "left_anti").unionByName(new_nodes)
            stays = before.join(gone, "file_path", "left_anti").select(F.col("node_id").alias("from_id"))
            kept = self.table("edges").join(stays, "from_id", "left_semi")
            contains = self.table("contains").join(stays, "from_id", "left_semi").unionByName(new_edges.where("to_id <> ''").select("from_id", "to_id", "edge_type"))
        nodes = storage.snapshot(nodes, "nodes")
        named = new_edges.where("to_id = ''").select(*_COLUMNS)
        if fresh:
            bound = resolve.bindings(named, nodes).withColumn("resolution_gen", F.lit(generation))
        else:
            unbound = named.select("*", *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns if c not in _COLUMNS])
            changed = changes.where("change <> 'unchanged'").select("file_path")
            bound = resolve.incremental(kept.unionByName(unbound), nodes, changed, resolve.delta_names(before, nodes), generation)
        bound = storage.snapshot(bound, "bound")
        contains = contains.select("from_id", "to_id", "edge_type")
        prints = shapes.fingerprints(nodes, bound, contains)
        if fresh:
            prints = prints.withColumn("generation", F.lit(generation).cast("long")).withColumn("prev_hash", F.lit(None).cast("string")).withColumn("prev_generation", F.lit(None).cast("long"))
            deletions = verdict.deleted_symbols(nodes, nodes).limit(0)
        else:
            prints = shapes.next_generation(self.table("fingerprints"), prints, generation)
            deletions = verdict.recorded(self.table("deletions"), before, nodes)
        counts = nodes.groupBy("file_path").agg(F.count("*").alias("node_count"))
        stats = resolve.stats(bound, nodes).first().asDict()
        stats |= {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}  # four kinds of change
        stats |= {"generation": generation, "failed": files.failures(rows).count(), "nodes": nodes.count()}
        registry = self.spark.createDataFrame([(generation, stats["nodes"], stats["considered"])], "generation long, node_count long, edge_count long")
        self.write(
            {
                "fingerprints": prints,
                "deletions": deletions,
                "nodes": nodes,
                "edges": bound,
                "contains": contains,
                "file_metadata": listed.join(counts, "file_path", "left").na.fill(0, ["node_count"]),
                "registry": registry.withColumn("last_indexed_at", F.current_timestamp()),
            }
        )
        return stats

    def mark(self) -> str:
        """Changes with each run: what caches are keyed by."""
        return self._current()[0]
