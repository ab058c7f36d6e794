"""Landscape and roadmap as text: markdown, mermaid, DOT, JSON, and a short brief.

Renderers take frames that are small by what they are (a row a subsystem, a subsystem edge or an item)
and cap what they show; how much is left out is said.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Caps of what is shown: edges of a subsystem, items and links of a map; lines of a brief.
EDGES, ITEMS, LINKS, BRIEF = 6, 12, 2, 20


def label(text: str) -> str:
    """Safe inside a mermaid or DOT label."""
    return re.sub(r'["\\\[\]{}|<>]', " ", text).strip()


def heaviest(edges: DataFrame, k: int = EDGES) -> DataFrame:
    """The ``k`` edges of most channels out of each subsystem."""
    w = Window.partitionBy("from_sub").orderBy(F.desc("channels"), "to_sub")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def mermaid(metrics: DataFrame, edges: DataFrame) -> str:
    names = {r["subsystem"]: f"s{i}" for i, r in enumerate(_rows(metrics, "subsystem"))}
    out = ["flowchart LR"] + [f'  {n}["{label(s)}"]' for s, n in names.items()]
    out += [f"  {names[e['from_sub']]} -->|{e['channels']}| {names[e['to_sub']]}" for e in _rows(heaviest(edges), "from_sub", "to_sub")]
    return "\n".join(out) + "\n"


def dot(metrics: DataFrame, edges: DataFrame) -> str:
    out = ["digraph landscape {"] + [f'  "{label(r["subsystem"])}" [label="{label(r["subsystem"])}\\n{r["files"]} files"];' for r in _rows(metrics, "subsystem")]
    for e in _rows(heaviest(edges), "from_sub", "to_sub"):
        width = round(min(5.0, 1 + e["channels"] ** 0.5 / 3), 2)
        out.append(f'  "{label(e["from_sub"])}" -> "{label(e["to_sub"])}" [label="{e["channels"]}", penwidth={width}];')
    return "\n".join(out) + "\n}\n"


def markdown(metrics: DataFrame, edges: DataFrame, cycles: DataFrame, items: DataFrame | None = None) -> str:
    out = ["# Landscape", "", "| subsystem | files | nodes | internal | in | out | instability |", "|-|-|-|-|-|-|-|"]
    for r in _rows(metrics, "subsystem"):
        rate = "-" if r["instability"] is None else f"{r['instability']:.2f}"
        out.append(f"| {label(r['subsystem'])} | {r['files']} | {r['nodes']} | {r['internal']} | {r['afferent']} | {r['efferent']} | {rate} |")
    out += ["", "## Edges", ""] + [f"- {e['from_sub']} -> {e['to_sub']}: {e['channels']} channels, {e['refs']} references ({e['via']})" for e in _rows(edges, "from_sub", "to_sub")]
    found = _rows(cycles, "sub_a", "sub_b")
    out += ["", "## Cycles", ""] + ([f"- {c['sub_a']} <-> {c['sub_b']} ({c['a_to_b']}, {c['b_to_a']})" for c in found] or ["none"])
    if items is not None:
        shown = _rows(items.where("status in ('planned', 'active')").limit(ITEMS + 1), "item_id")
        out += ["", "## In flight", ""] + [f"- {i['item_id']} [{i['status']}]" for i in shown[:ITEMS]] + (["- and more"] if len(shown) > ITEMS else [])
    return "\n".join(out) + "\n"


def as_json(**frames: DataFrame) -> str:
    """Small frames as one JSON document, rows in a fixed order."""
    return json.dumps({k: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True, default=str)) for k, df in frames.items()}, sort_keys=True, default=str)


def brief(placement: DataFrame, items: DataFrame) -> str:
    """Which open items lie in which subsystem, at most BRIEF subsystems and LINKS items of each."""
    live = items.where("status in ('planned', 'active')").select("item_id")
    per = placement.where("subsystem is not null").join(live, "item_id", "left_semi").select("subsystem", "item_id").distinct()
    w = Window.partitionBy("subsystem").orderBy("item_id")
    top = per.withColumn("k", F.row_number().over(w)).groupBy("subsystem").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= LINKS, F.col("item_id")))).alias("ids"))
    rows = top.orderBy(F.desc("n"), "subsystem").limit(BRIEF).collect()
    return "\n".join(f"{r['subsystem']}: {', '.join(r['ids'])}" + (f" and {r['n'] - LINKS} more" if r["n"] > LINKS else "") for r in rows) + "\n"


def truncated(text: str, limit: int) -> str:
    """At most ``limit`` characters, the last one a sign of what is left out."""
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "\u2026"


def demoted(markdown_text: str, by: int = 1) -> str:
    """Headings ``by`` levels deeper, at most six; code blocks stay."""
    out, code = [], False
    for line in markdown_text.split("\n"):
        code ^= line.lstrip().startswith("```")
        head = re.match(r"#+(?= )", line)
        out.append("#" * (min(6, len(head[0]) + by) - len(head[0])) + line if head and not code else line)
    return "\n".join(out)


def dot_escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"')


#: Caps of the index of paths: files, items of each, characters of a title.
INDEX_FILES, INDEX_ITEMS, INDEX_CHARS = 20, 6, 60


def path_index(bound: DataFrame, items: DataFrame, nodes: DataFrame) -> str:
    """Files that open items touch, those of most items first."""
    live = items.where("status in ('planned', 'active')").select("item_id")
    t = bound.where("confidence = 'RESOLVED'").join(live, "item_id", "left_semi")
    own = t.where("selector <> 'symbol'").select("item_id", F.col("to_id").alias("file_path"))
    at = t.where("selector = 'symbol'").join(nodes.select(F.col("node_id").alias("to_id"), "file_path"), "to_id").select("item_id", "file_path")
    w = Window.partitionBy("file_path").orderBy("item_id")
    per = own.unionByName(at).distinct().withColumn("k", F.row_number().over(w))
    top = per.groupBy("file_path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= INDEX_ITEMS, F.col("item_id")))).alias("ids"))
    rows = top.orderBy(F.desc("n"), "file_path").limit(INDEX_FILES + 1).collect()
    out = [f"- {truncated(r['file_path'], INDEX_CHARS)}: {', '.join(r['ids'])}" + (f" and {r['n'] - INDEX_ITEMS} more" if r["n"] > INDEX_ITEMS else "") for r in rows[:INDEX_FILES]]
    return "\n".join(out + (["- and more"] if len(rows) > INDEX_FILES else [])) + "\n"


def context(project: str, parts: dict[str, DataFrame], placement: DataFrame | None = None, bound: DataFrame | None = None, items: DataFrame | None = None, nodes: DataFrame | None = None) -> str:
    """One document for who comes new to a project: its subsystems, what runs between them, hubs, and open work."""
    body = markdown(parts["metrics"], parts["edges"], parts["cycles"])
    out = [f"# {label(project)}", "", demoted(body).strip(), "", "## Hubs", ""]
    out += [f"- {label(r['subsystem'])}: {label(r['name'])} in {r['file_path']} ({r['total']})" for r in _rows(parts["hubs"], "subsystem", "place")] or ["none"]
    if placement is not None and items is not None:
        out += ["", "## Open work by subsystem", "", brief(placement, items).strip() or "none"]
    if bound is not None and items is not None and nodes is not None:
        out += ["", "## Open work by file", "", path_index(bound, items, nodes).strip() or "none"]
    return "\n".join(out) + "\n"
