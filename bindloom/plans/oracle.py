"""SQL for the checks: the same answers from plain candidate lists, written independently of the
operators. Common table expressions that queries build on, and the queries' own SQL."""

from __future__ import annotations

from ..sources import projection

_FAMILY = "CASE {0} WHEN 'c' THEN 'c-cpp' WHEN 'cpp' THEN 'c-cpp' ELSE {0} END"

NODES = f"nodes AS ({projection.NODES})"
REFS = f"refs AS (SELECT md5(from_id || '|' || to_name || '|' || to_type || '|' || edge_type) AS edge_id, * FROM ({projection.REFERENCES}))"
CONTAINS = f"contains_e AS ({projection.CONTAINS})"
GRAPH = f"{NODES}, {REFS}, {CONTAINS}"
FACTS = "facts AS (SELECT DISTINCT file_path, regexp_extract(name, 'use crate::(.*)::\\*;', 1) AS path FROM nodes WHERE node_type = 'import' AND language = 'rust')"

BOUND = f"""{GRAPH}, {FACTS},
e0 AS (SELECT r.*, n.language AS sl, n.file_path AS sf, {_FAMILY.format("n.language")} AS fam, replace(replace(to_name, '.', '::'), '/', '::') AS norm FROM refs r LEFT JOIN nodes n ON n.node_id = r.from_id),
e1 AS (SELECT *, string_split(norm, '::')[-1] AS bare, contains(norm, '::') AS q, regexp_replace(norm, '^((crate|self|super)::)+', '') AS rel FROM e0),
pool AS (SELECT e1.*, n.node_id AS tid,
    n.qualified_name = norm AS h1, ends_with(n.qualified_name, '::' || norm) AS h2,
    sl = 'rust' AND rel <> norm AND (n.qualified_name = rel OR ends_with(n.qualified_name, '::' || rel)) AS hm,
    n.file_path = sf AS h3,
    EXISTS (SELECT 1 FROM facts f WHERE f.file_path = sf AND starts_with(n.qualified_name, f.path || '::') AND NOT contains(substr(n.qualified_name, length(f.path) + 3), '::')) AS h4
  FROM e1 LEFT JOIN nodes n ON n.name = bare AND n.node_type = to_type AND {_FAMILY.format("n.language")} = fam),
agg AS (SELECT edge_id, count(tid) AS np, {", ".join(f"count(*) FILTER (WHERE tid IS NOT NULL AND h{k}) AS n{k}, min(tid) FILTER (WHERE h{k}) AS t{k}" for k in "12m34")}, min(tid) AS t5 FROM pool GROUP BY edge_id),
rule AS (SELECT e1.*, a.* EXCLUDE (edge_id), imp IS NOT NULL AS hf,
    CASE WHEN sl IS NULL THEN 'r6' WHEN q AND n1 = 1 THEN 'r1' WHEN q AND n2 = 1 THEN 'r2' WHEN q AND sl = 'rust' AND rel <> norm AND nm = 1 THEN 'r2m' WHEN q THEN 'r6'
         WHEN n3 = 1 THEN 'r3' WHEN imp IS NOT NULL AND n4 = 1 THEN 'r4' WHEN np = 1 THEN 'r5' ELSE 'r6' END AS rb,
    CASE WHEN q THEN n1 + n2 ELSE np END AS ne
  FROM e1 JOIN agg a USING (edge_id) LEFT JOIN (SELECT DISTINCT file_path AS imp FROM facts) fi ON fi.imp = e1.sf),
bound AS (SELECT edge_id, from_id, to_name, to_type, edge_type, sl, fam, norm, bare, q, n1, n2, nm, n3, n4, np, hf, rel,
    coalesce(CASE rb WHEN 'r1' THEN t1 WHEN 'r2' THEN t2 WHEN 'r2m' THEN tm WHEN 'r3' THEN t3 WHEN 'r4' THEN t4 WHEN 'r5' THEN t5 END, '') AS to_id, rb AS resolved_by,
    CASE WHEN sl IS NULL THEN 'orphan_source' WHEN rb <> 'r6' THEN 'bound' WHEN ne > 1 THEN 'ambiguous' WHEN np = 0 THEN 'no_candidates' ELSE 'no_rule_matched' END AS outcome,
    CASE WHEN sl IS NULL THEN 'UNRESOLVED' WHEN rb <> 'r6' THEN 'RESOLVED' WHEN ne > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS confidence,
    CASE WHEN sl IS NOT NULL AND rb = 'r6' AND ne > 1 THEN ne ELSE 0 END AS n_candidates
  FROM rule)"""

LOCATED = f"{BOUND}, located AS (SELECT b.*, s.file_path AS from_file, t.file_path AS to_file FROM bound b JOIN nodes s ON s.node_id = b.from_id JOIN nodes t ON t.node_id = b.to_id WHERE confidence = 'RESOLVED')"
AMBIGUOUS = f"{BOUND}, cand AS (SELECT p.edge_id, p.tid AS candidate FROM pool p JOIN bound b USING (edge_id) WHERE b.confidence = 'AMBIGUOUS' AND p.tid IS NOT NULL AND (NOT p.q OR p.h1 OR p.h2))"
LINKS = f"{BOUND}, links AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM bound WHERE confidence = 'RESOLVED' AND edge_type IN ('calls', 'member_of', 'implements'))"


def walk(name: str, depth: int, back: bool, functions: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    kind = "node_type = 'function'" if functions else "node_type <> 'import'"
    return f"walk(root_id, node_id, depth) AS (SELECT node_id, node_id, 0 FROM nodes WHERE name = '{name}' AND {kind} UNION SELECT root_id, {b}, depth + 1 FROM walk JOIN links ON {a} = node_id WHERE depth < {depth}), reached AS (SELECT root_id, node_id, min(depth) AS depth FROM walk GROUP BY 1, 2)"


def recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def plain(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


#: Shapes from bound and contained edges, as the operator writes them down.
SHAPES = f"""{BOUND},
ends AS (SELECT from_id, to_id, edge_type FROM bound WHERE to_id <> '' UNION ALL SELECT from_id, to_id, 'contains' FROM contains_e),
sides AS (SELECT from_id AS node_id, to_id AS other, CASE WHEN from_id = to_id THEN 'self' ELSE t.node_type END AS ok, edge_type || '>' AS label, edge_type <> 'contains' AS nm FROM ends JOIN nodes f ON f.node_id = from_id JOIN nodes t ON t.node_id = to_id
  UNION ALL SELECT to_id, from_id, f.node_type, edge_type || '<', edge_type <> 'contains' FROM ends JOIN nodes f ON f.node_id = from_id JOIN nodes t ON t.node_id = to_id WHERE from_id <> to_id),
pairs AS (SELECT node_id, other, ok, label, count(*) AS k, sum(CASE WHEN nm THEN 1 ELSE 0 END) AS m FROM sides GROUP BY ALL),
star AS (SELECT node_id, other, ok, string_agg(label || CAST(k AS VARCHAR), ';' ORDER BY label || CAST(k AS VARCHAR)) AS labels, sum(k) AS k, sum(m) AS m FROM pairs GROUP BY 1, 2, 3),
ray AS (SELECT node_id, ok || '=' || labels || '=' || CAST(count(*) AS VARCHAR) AS r, sum(k) AS k, sum(m) AS m FROM star GROUP BY node_id, ok, labels),
shape AS (SELECT node_id, string_agg(r, '|' ORDER BY r) AS shape, sum(k) AS k, sum(m) AS m FROM ray GROUP BY 1),
centre AS (SELECT qualified_name, file_path, node_type, md5(node_type || '#' || coalesce(shape, '')) AS h, coalesce(k, 0) AS k, coalesce(m, 0) AS m FROM nodes LEFT JOIN shape USING (node_id) WHERE node_type NOT IN ('import', 'macro_call')),
prints AS (SELECT qualified_name, file_path, string_agg(DISTINCT node_type, '+' ORDER BY node_type) AS node_type,
  CASE WHEN count(*) = 1 THEN min(h) ELSE md5(CAST(count(*) AS VARCHAR) || ':' || string_agg(h, ',' ORDER BY h)) END AS hash, CAST(sum(k) AS BIGINT) AS edge_count, CAST(sum(m) AS BIGINT) AS name_edge_count FROM centre GROUP BY 1, 2)"""
