"""Source trees as DataFrames: which files count, their content hashes, what they define and refer to."""

from __future__ import annotations

import json
import os
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from . import extract

SKIPPED = ("node_modules", "target", "build", "dist", "vendor", "__pycache__")
NODE = "project_id string, node_id string, name string, node_type string, language string, file_path string, start_line int, end_line int, content string, metadata map<string,string>, qualified_name string"
EDGE = "edge_id string, project_id string, from_id string, to_id string, to_name string, to_type string, edge_type string, confidence string, occurrence int"


def skipped(path: str) -> bool:
    return any(p in SKIPPED or p.startswith(".") for p in path.split("/"))


def discover(root: str, every_type: bool = False) -> list[str]:
    """Paths below a local root: what git lists, tracked or not ignored; without an answer from git a walk
    that skips hidden and generated folders and does not follow links."""
    try:
        got = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True, timeout=60).stdout.decode()
        found = [p for p in dict.fromkeys(got.split("\0")) if p]
    except (OSError, subprocess.SubprocessError):
        found = []
    if not found:
        found = [os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files]
    keep = [p for p in found if not skipped(p) and os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p))]
    return sorted(p for p in keep if every_type or p.rsplit(".", 1)[-1].lower() in names.EXTENSIONS)


def read_tree(spark: SparkSession, root: str, languages: list[str] | None = None, listed: list[str] | None = None) -> DataFrame:
    """(file_path, language, content_hash, file_size, text) of the source files below ``root``, read by the
    cluster from any store. ``listed``: relative paths that count, as ``discover`` gives them.

    Files are chosen by path while they are listed, so nothing of skipped folders or other types is opened."""
    base = root.rstrip("/")
    suffixes = "{" + ",".join(sorted({x for e in names.EXTENSIONS for x in (e, e.upper())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffixes}").load(base)
    place = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(place, f"^.*?{_literal(base.partition(':')[2].lstrip('/') if ':' in base else base.lstrip('/'))}/", "")
    hidden = path.rlike(rf"(^|/)({'|'.join(SKIPPED)}|\.[^/]*)(/|$)")
    files = files.where(~hidden).withColumn("file_path", path).withColumn("language", names.language_of(F.col("file_path"))).where("language is not null")
    if listed is not None:
        known = spark.createDataFrame([(p,) for p in listed], "file_path string")
        files = files.join(F.broadcast(known) if len(listed) < 100_000 else known, "file_path", "left_semi")
    if languages:
        files = files.where(F.col("language").isin([x.lower() for x in languages]))
    return files.select("file_path", "language", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("file_size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r".+^$()[]{}|\?*" else c for c in text)


def parsed(files: DataFrame, project: str, tier: str = "balanced") -> DataFrame:
    """(kind, body): each node and edge of ``files`` as JSON, and 'failed' with the path of what could not be
    read. One narrow pass; ``nodes_of`` and ``edges_of`` read a written copy of it."""
    rows = files.select("file_path", "language", "text")

    def run(batches):
        for b in batches:
            kinds, bodies = [], []
            for path, language, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                try:
                    nodes, edges = extract.extract(project, path, language, text or "", tier)
                except (SyntaxError, ValueError, RecursionError):
                    kinds.append("failed")
                    bodies.append(json.dumps({"file_path": path}))
                    continue
                kinds += ["node"] * len(nodes) + ["edge"] * len(edges)
                bodies += [json.dumps(x) for x in [*nodes, *edges]]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(bodies, pa.string())], names=["kind", "body"])

    return rows.mapInArrow(run, "kind string, body string")


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'node'").select(F.from_json("body", NODE).alias("r")).select("r.*")


def edges_of(rows: DataFrame) -> DataFrame:
    """Edges, each reference as often as it is written; equal ones are told apart by their number."""
    e = rows.where("kind = 'edge'").select(F.from_json("body", EDGE.removeprefix("edge_id string, ")).alias("r")).select("r.*")
    again = F.when(F.col("occurrence") > 0, F.col("occurrence").cast("string"))
    key = F.md5(F.concat_ws("|", "from_id", F.coalesce("to_name", F.col("to_id")), F.coalesce("to_type", F.lit("")), "edge_type", again))
    return e.select(key.alias("edge_id"), *[c for c in e.columns if c != "occurrence"])


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'failed'").select(F.get_json_object("body", "$.file_path").alias("file_path"))
