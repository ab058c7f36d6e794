"""Registry of the graph engine's queries over the projected graph, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import metrics, resolve, shapes, traverse
from ..sources import projection
from . import oracle as o

NAME, DEPTH, SCOPE = "small_ring", 3, "src/promo/**"
_registry: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Graph:
    """The projected graph of a folder of tables, bound once: its tables are snapshots that all queries
    of a session read, until a file of the folder changes."""

    _known: dict[tuple, tuple[str, dict[str, DataFrame]]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        key = (spark.sparkContext.applicationId, sf_dir)
        mark = storage.watermark(spark, *[f"{sf_dir}/{t}.parquet" for t in projection.TABLES])
        known = self._known.get(key)
        if known is None or known[0] != mark:
            known = self._known[key] = (mark, {})
        self._tables = known[1]

    def held(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is written the first time that it is asked for."""
        if name not in self._tables:
            self._tables[name] = storage.snapshot(make(), name)
        return self._tables[name]

    @property
    def nodes(self) -> DataFrame:
        return self.held("nodes", lambda: projection.nodes(self.spark, self.sf_dir))

    @property
    def refs(self) -> DataFrame:
        return self.held("references", lambda: projection.references(self.spark, self.sf_dir))

    @property
    def contains(self) -> DataFrame:
        return self.held("contains", lambda: projection.contains(self.spark, self.sf_dir))

    @property
    def bound(self) -> DataFrame:
        return self.held("bound", lambda: resolve.bindings(self.refs, self.nodes))

    @property
    def asking(self) -> DataFrame:
        """References of names that can be bound at all, in this generation or the next."""
        return self.held("asking", lambda: resolve.bindable(self._tables.get("references") or projection.edges(self.spark, self.sf_dir), self.nodes, self.later).select("from_id", "to_name", "to_type", "edge_type"))

    @property
    def links(self) -> DataFrame:
        """What bound references link, for whom neither unbound ones nor rules matter: those never get a table."""
        return self.held("links", lambda: resolve.links(self.asking, self.nodes))

    @property
    def later(self) -> DataFrame:
        """Definitions of the next generation."""
        return self.held("later-nodes", lambda: _later(self.nodes))

    @property
    def later_links(self) -> DataFrame:
        return self.held("later-links", lambda: resolve.links(self.asking, self.later))

    @property
    def prints(self) -> DataFrame:
        return self.held("prints", lambda: shapes.fingerprints(self.nodes, self.links, self.contains))

    @property
    def shifted(self) -> DataFrame:
        """Fingerprints of both generations: one row a key, which is read several times."""
        return self.held("shifted", lambda: shapes.next_generation(self.prints.withColumn("generation", F.lit(1)), shapes.fingerprints(self.later, self.later_links, self.contains), 2))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        _registry[f.__name__] = (lambda spark, sf_dir: f(Graph(spark, sf_dir)), sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import evidence, planning  # noqa: F401  these register their queries

    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    from . import evidence, planning  # noqa: F401

    return {k: s for k, (_, s) in _registry.items() if s}


# -- search, summaries, metrics --------------------------------------------------------------------


@query(o.plain(o.NODES, "SELECT node_id, name, node_type, file_path, start_line, qualified_name FROM nodes WHERE contains(name, 'ring') AND node_type <> 'import' ORDER BY file_path, start_line, node_id LIMIT 20"))
def search_nodes(g: Graph) -> DataFrame:
    return metrics.search(g.nodes, "ring")


@query(o.plain(o.NODES, "SELECT node_type AS key, count(*) AS n FROM nodes GROUP BY 1"))
def project_summary_types(g: Graph) -> DataFrame:
    return metrics.tally(g.nodes, "node_type")


@query(o.plain(o.NODES, "SELECT language AS key, count(*) AS n FROM nodes GROUP BY 1"))
def project_summary_languages(g: Graph) -> DataFrame:
    return metrics.tally(g.nodes, "language")


@query(o.plain(o.LOCATED, "SELECT edge_type AS key, count(*) AS n FROM (SELECT edge_type FROM refs UNION ALL SELECT 'contains' FROM contains_e UNION ALL SELECT 'file_ref' FROM (SELECT DISTINCT from_file, to_file FROM located WHERE from_file <> to_file)) GROUP BY 1"))
def project_summary_edges(g: Graph) -> DataFrame:
    return metrics.edge_types(g.refs, g.contains, resolve.file_refs(g.bound, g.nodes))


_HIT = "hit AS (SELECT * FROM nodes WHERE file_path LIKE 'src/promo/%')"


@query(
    o.plain(
        f"{o.GRAPH}, {_HIT}",
        """SELECT 'type' AS section, node_type AS key, count(*) AS n FROM hit GROUP BY node_type UNION ALL SELECT 'language', language, count(*) FROM hit GROUP BY language
UNION ALL SELECT 'edge', edge_type, count(*) FROM refs WHERE from_id IN (SELECT node_id FROM hit) GROUP BY edge_type
UNION ALL SELECT 'files', 'total', count(DISTINCT file_path) FROM nodes UNION ALL SELECT 'files', 'matched', count(DISTINCT file_path) FROM hit
UNION ALL SELECT 'sample', file_path, 1 FROM (SELECT DISTINCT file_path FROM hit ORDER BY 1 LIMIT 3)""",
    )
)
def scoped_summary(g: Graph) -> DataFrame:
    return metrics.scoped(g.nodes, g.refs, SCOPE)


_DEGREES = """deg AS (SELECT n.node_id, n.name, n.node_type, n.file_path, coalesce(i.c, 0) AS in_degree, coalesce(x.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(x.c, 0) AS total
FROM nodes n LEFT JOIN (SELECT to_name, to_type, count(*) AS c FROM refs GROUP BY 1, 2) i ON i.to_name = n.name AND i.to_type = n.node_type
LEFT JOIN (SELECT from_id, count(*) AS c FROM refs GROUP BY 1) x ON x.from_id = n.node_id WHERE n.node_type <> 'import')"""


@query(o.plain(f"{o.GRAPH}, {_DEGREES}", "SELECT * FROM deg ORDER BY total DESC, file_path, name, node_id LIMIT 20"))
def hub_nodes(g: Graph) -> DataFrame:
    return metrics.hubs(g.nodes, g.refs)


_COUPLING = """home AS (SELECT name, node_type, min(file_path) AS f FROM nodes WHERE node_type <> 'import' GROUP BY 1, 2),
x AS (SELECT n.file_path AS a, home.f AS b FROM refs r JOIN nodes n ON n.node_id = r.from_id JOIN home ON home.name = r.to_name AND home.node_type = r.to_type WHERE n.file_path <> home.f),
coupled AS (SELECT f.file_path, f.node_count, coalesce(i.c, 0) AS afferent, coalesce(u.c, 0) AS efferent FROM (SELECT file_path, count(*) AS node_count FROM nodes WHERE node_type <> 'import' GROUP BY 1) f
LEFT JOIN (SELECT b, count(*) AS c FROM x GROUP BY 1) i ON i.b = f.file_path LEFT JOIN (SELECT a, count(*) AS c FROM x GROUP BY 1) u ON u.a = f.file_path)"""


@query(o.plain(f"{o.GRAPH}, {_COUPLING}", "SELECT *, CASE WHEN afferent + efferent > 0 THEN CAST(efferent AS DOUBLE) / (afferent + efferent) ELSE 0.0 END AS instability, afferent + efferent AS total FROM coupled ORDER BY total DESC, file_path LIMIT 20"))
def file_coupling(g: Graph) -> DataFrame:
    return metrics.coupling(g.nodes, g.refs)


@query(o.plain(o.GRAPH, "SELECT 'nodes' AS table_name, count(*) AS n FROM nodes UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'contains', count(*) FROM contains_e"))
def live_stats(g: Graph) -> DataFrame:
    return metrics.live_stats(nodes=g.nodes, references=g.refs, contains=g.contains)


# -- binding ---------------------------------------------------------------------------------------

_T = "CASE WHEN {0} = 1 THEN 'bound' WHEN {0} = 0 THEN 'no_match' ELSE 'not_unique' END"
_TRACE = f"""CASE WHEN sl IS NULL THEN '' WHEN q THEN 'r1:' || {_T.format("n1")} || CASE WHEN resolved_by = 'r1' THEN '' ELSE ',r2:' || {_T.format("n2")} || CASE WHEN resolved_by = 'r2' THEN '' ELSE
 ',r2m:' || CASE WHEN sl = 'rust' AND rel <> norm THEN {_T.format("nm")} ELSE 'skipped' END || CASE WHEN resolved_by = 'r2m' THEN '' WHEN n1 + n2 = 0 THEN ',r6:no_match' ELSE ',r6:not_unique' END END END
 ELSE 'r3:' || {_T.format("n3")} || CASE WHEN resolved_by = 'r3' THEN '' ELSE ',r4:' || CASE WHEN hf THEN {_T.format("n4")} ELSE 'skipped' END || CASE WHEN resolved_by = 'r4' THEN '' WHEN np = 1 THEN ',r5:bound' WHEN np = 0 THEN ',r6:no_match' ELSE ',r6:not_unique' END END END"""


@query(o.plain(o.BOUND, f"SELECT edge_id, from_id, to_name, to_type, edge_type, to_id, confidence, resolved_by, outcome, {_TRACE} AS attempts, n_candidates FROM bound"))
def resolve_bindings(g: Graph) -> DataFrame:
    return g.bound


@query(o.plain(o.LOCATED, "SELECT count(*) AS considered, count(*) FILTER (WHERE confidence = 'RESOLVED') AS resolved, count(*) FILTER (WHERE confidence = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE confidence = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM (SELECT DISTINCT from_file, to_file FROM located WHERE from_file <> to_file)) AS file_refs FROM bound"))
def resolve_stats(g: Graph) -> DataFrame:
    return resolve.stats(g.bound, g.nodes)


@query(o.plain(o.AMBIGUOUS, "SELECT edge_id, candidate FROM cand"))
def ambiguous_candidates(g: Graph) -> DataFrame:
    return resolve.candidates(g.bound, g.nodes)


@query(o.plain(f"{o.NODES}, {o.FACTS}", "SELECT file_path, path, true AS glob FROM facts"))
def import_facts(g: Graph) -> DataFrame:
    return resolve.import_facts(g.nodes)


@query(o.plain(o.LOCATED, "SELECT DISTINCT from_file, to_file FROM located WHERE from_file <> to_file"))
def file_ref(g: Graph) -> DataFrame:
    return resolve.file_refs(g.bound, g.nodes)


@query(
    o.plain(
        f"{o.LOCATED}, p AS (SELECT from_file, to_file, count(*) AS n FROM located WHERE from_file <> to_file GROUP BY 1, 2), v AS (SELECT least(from_file, to_file) AS a, greatest(from_file, to_file) AS b, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS via FROM located WHERE from_file <> to_file GROUP BY 1, 2)",
        "SELECT x.from_file AS file_a, x.to_file AS file_b, x.n AS a_to_b, y.n AS b_to_a, x.n + y.n AS total, via FROM p x JOIN p y ON x.from_file = y.to_file AND x.to_file = y.from_file JOIN v ON v.a = x.from_file AND v.b = x.to_file WHERE x.from_file < x.to_file",
    )
)
def mutual_cycles(g: Graph) -> DataFrame:
    return metrics.mutual_pairs(g.bound, g.nodes)


# -- walks -----------------------------------------------------------------------------------------

_WHAT = "SELECT root_id, r.node_id, depth, name, qualified_name, node_type, file_path FROM reached r JOIN nodes n USING (node_id) WHERE depth > 0"
_CREDIT = """credit AS (SELECT r.root_id, r.node_id, r.depth, arg_min(p.node_id, n.file_path || chr(1) || n.qualified_name || chr(1) || n.node_id) AS caller_id FROM reached r JOIN links ON {dst} = r.node_id JOIN reached p ON p.root_id = r.root_id AND p.node_id = {src} AND p.depth = r.depth - 1 JOIN nodes n ON n.node_id = p.node_id WHERE r.depth > 0 GROUP BY 1, 2, 3)"""


@query(
    o.recursive(
        f"{o.LINKS.replace(chr(39) + 'calls' + chr(39) + ', ' + chr(39) + 'member_of' + chr(39) + ', ' + chr(39) + 'implements' + chr(39), chr(39) + 'calls' + chr(39))}, {o.walk(NAME, DEPTH, False, True)}, {_CREDIT.format(src='src', dst='dst')}",
        "SELECT root_id, depth, caller_id, a.name AS caller_name, a.file_path AS caller_file, c.node_id AS callee_id, b.name AS callee_name, b.file_path AS callee_file FROM credit c JOIN nodes a ON a.node_id = caller_id JOIN nodes b ON b.node_id = c.node_id",
    )
)
def call_chain(g: Graph) -> DataFrame:
    return traverse.call_chain(g.bound, g.nodes, NAME, DEPTH)


@query(o.recursive(f"{o.LINKS}, {o.walk(NAME, DEPTH, False)}", _WHAT))
def deps_forward(g: Graph) -> DataFrame:
    return traverse.dependencies(g.bound, g.nodes, NAME, DEPTH)


@query(o.plain(o.BOUND, f"SELECT b.from_id AS root_id, to_name, to_type, edge_type FROM bound b JOIN nodes n ON n.node_id = b.from_id WHERE n.name = '{NAME}' AND n.node_type <> 'import' AND confidence = 'UNRESOLVED'"))
def deps_unresolved_root(g: Graph) -> DataFrame:
    return traverse.unresolved_of_roots(g.bound, g.nodes, NAME)


@query(o.recursive(f"{o.LINKS}, {o.walk(NAME, DEPTH, False)}", f"SELECT root_id, edge_id, from_id, to_name, to_type, n_candidates, depth + 1 AS depth FROM bound JOIN reached ON node_id = from_id WHERE confidence = 'AMBIGUOUS' AND depth < {DEPTH}"))
def deps_ambiguous(g: Graph) -> DataFrame:
    bound = g.bound
    return traverse.ambiguous_of(traverse.reach(traverse.named_roots(g.nodes, NAME), traverse.links(bound), DEPTH), bound, DEPTH)


@query(o.recursive(f"{o.LINKS}, {o.walk(NAME, DEPTH, True)}", _WHAT))
def rdeps(g: Graph) -> DataFrame:
    return traverse.dependents(g.bound, g.nodes, NAME, DEPTH)


@query(o.recursive(f"{o.AMBIGUOUS}, {o.LINKS.removeprefix(o.BOUND + ', ')}, {o.walk(NAME, 1, True)}", "SELECT root_id, candidate, edge_id, from_id, to_name, to_type, depth + 1 AS depth FROM cand JOIN reached ON node_id = candidate JOIN bound USING (edge_id) WHERE depth < 1"))
def rdeps_ambiguous(g: Graph) -> DataFrame:
    bound = g.bound
    found = traverse.reach(traverse.named_roots(g.nodes, NAME), traverse.reversed_links(traverse.links(bound)), 1)
    return traverse.ambiguous_into(found, bound, g.nodes, 1)


#: A live name, a name without definition, a receiver.
QUERIED = (NAME, "ghost_small_ring", "std", "Supplier_000000001")
_STALE = f"""qd(queried) AS (VALUES {", ".join(f"('{n}')" for n in QUERIED)}),
live AS (SELECT queried, n.* FROM qd JOIN nodes n ON n.name = queried AND n.node_type <> 'import'),
counted AS (SELECT queried, count(node_id) AS n_live FROM qd LEFT JOIN live USING (queried) GROUP BY 1),
stale AS (SELECT queried, edge_id, from_id, n.name AS from_name, n.file_path AS from_file, to_name, b.to_type FROM bound b JOIN nodes n ON n.node_id = b.from_id, counted
WHERE confidence = 'UNRESOLVED' AND CASE WHEN bare <> queried THEN n_live = 0 AND list_contains(string_split(norm, '::')[:-2], queried) WHEN n_live = 0 THEN true
ELSE EXISTS (SELECT 1 FROM live l WHERE l.queried = counted.queried AND l.node_type = b.to_type AND {o._FAMILY.format("l.language")} = fam AND (NOT q OR l.qualified_name = norm OR ends_with(l.qualified_name, '::' || norm))) END)"""


def _queried(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(n,) for n in QUERIED], "queried string")


@query(o.plain(f"{o.BOUND}, {_STALE}", "SELECT * FROM stale"))
def stale_references(g: Graph) -> DataFrame:
    return traverse.stale(g.bound, g.nodes, _queried(g))


@query(o.plain(f"{o.BOUND}, {_STALE}", "SELECT queried, n_live FROM counted"))
def live_definitions(g: Graph) -> DataFrame:
    return traverse.live_definitions(g.nodes, _queried(g))


@query(
    o.recursive(
        f"{o.LINKS}, {o.walk(NAME, 2, True)}, {_CREDIT.format(src='dst', dst='src')}, path(root_id, node_id, depth, hops) AS (SELECT root_id, node_id, 0, node_id FROM reached WHERE depth = 0 UNION ALL SELECT c.root_id, c.node_id, c.depth, hops || '>' || c.node_id FROM path p JOIN credit c ON c.root_id = p.root_id AND c.caller_id = p.node_id AND c.depth = p.depth + 1)",
        "SELECT root_id, node_id, depth, hops FROM path WHERE depth > 0",
    )
)
def reverse_paths(g: Graph) -> DataFrame:
    return traverse.reverse_paths(g.bound, g.nodes, NAME, 2)


# -- shapes ----------------------------------------------------------------------------------------


@query(o.plain(o.SHAPES, "SELECT * FROM prints"))
def fingerprints(g: Graph) -> DataFrame:
    return g.prints


@query(
    o.plain(
        f"{o.SHAPES}, fit AS (SELECT *, count(*) OVER (PARTITION BY hash) AS group_size FROM prints WHERE edge_count >= 3 AND name_edge_count > 0), d AS (SELECT qualified_name, file_path, name, start_line FROM nodes WHERE node_type NOT IN ('import', 'macro_call') QUALIFY row_number() OVER (PARTITION BY qualified_name, file_path ORDER BY start_line, node_id) = 1)",
        "SELECT hash, group_size, file_path, start_line, qualified_name, name, edge_count FROM fit JOIN d USING (qualified_name, file_path) WHERE group_size >= 2",
    )
)
def clone_groups(g: Graph) -> DataFrame:
    return metrics.clone_members(g.prints, g.nodes)


def _later(nodes: DataFrame) -> DataFrame:
    """The next generation: every 17th part is gone, every 19th has a new name, every tenth supplier has
    moved to another module."""
    part, supplier = F.col("node_id").startswith("P"), F.col("node_id").startswith("S")
    k = F.try_to_number(F.substring("node_id", 2, 20), F.lit("9999999999")).cast("long")
    new, moved = part & (k % 19 == 0), supplier & (k % 10 == 3)
    nodes = nodes.where(~(part & (k % 17 == 0)) | ~part)
    where = F.when(new, F.concat("qualified_name", F.lit("_v2"))).when(moved, F.concat(F.lit("moved::"), F.col("name"))).otherwise(F.col("qualified_name"))
    return nodes.withColumn("qualified_name", where).withColumn("name", F.when(new, F.concat("name", F.lit("_v2"))).otherwise(F.col("name")))


_LATER = """nodes2 AS (SELECT node_id, CASE WHEN p % 19 = 0 THEN name || '_v2' ELSE name END AS name, node_type, language, file_path, start_line, CASE WHEN p % 19 = 0 THEN qualified_name || '_v2' WHEN s % 10 = 3 THEN 'moved::' || name ELSE qualified_name END AS qualified_name
FROM (SELECT *, CASE WHEN starts_with(node_id, 'P') THEN CAST(substr(node_id, 2) AS BIGINT) END AS p, CASE WHEN starts_with(node_id, 'S') THEN CAST(substr(node_id, 2) AS BIGINT) END AS s FROM nodes) WHERE p IS NULL OR p % 17 <> 0)"""


def _doubled(first: str) -> str:
    """CTEs that begin with the graph, for both generations: all tables of the second under names of
    their own; what is quoted is a value and stays."""
    import re

    second = first[len(o.GRAPH) :]
    own = re.findall(r"(?:^|[,\n]\s*)(\w+) AS \(", second)
    for name in {*own, "facts", "nodes"}:
        second = re.sub(rf"(?<!')\b{name}\b(?!\.\w+ AS)(?!\(|')", f"{name}2", second)
    return f"{first}, {_LATER}{second}"


def _twice() -> str:
    return _doubled(o.SHAPES)


_SHIFT = "shifted AS (SELECT coalesce(b.qualified_name, a.qualified_name) AS qualified_name, coalesce(b.file_path, a.file_path) AS file_path, coalesce(b.node_type, a.node_type) AS node_type, b.hash, coalesce(b.edge_count, 0) AS edge_count, coalesce(b.name_edge_count, 0) AS name_edge_count, CAST(2 AS BIGINT) AS generation, a.hash AS prev_hash, CASE WHEN a.hash IS NOT NULL THEN 1 END AS prev_generation FROM prints a FULL JOIN prints2 b ON a.qualified_name = b.qualified_name AND a.file_path = b.file_path)"
_RENAMES = "ren AS (SELECT n.hash, o.qualified_name AS from_name, o.file_path AS from_file, n.qualified_name AS to_name, n.file_path AS to_file FROM (SELECT * FROM shifted WHERE prev_hash IS NULL QUALIFY count(*) OVER (PARTITION BY hash) = 1) n JOIN (SELECT * FROM shifted WHERE hash IS NULL QUALIFY count(*) OVER (PARTITION BY prev_hash) = 1) o ON o.prev_hash = n.hash)"


@query(o.plain(f"{_twice()}, {_SHIFT}", "SELECT * FROM shifted"))
def fingerprint_generations(g: Graph) -> DataFrame:
    return g.shifted


@query(o.plain(f"{_twice()}, {_SHIFT}, {_RENAMES}", "SELECT * FROM ren"))
def rename_pairs(g: Graph) -> DataFrame:
    return shapes.renames(g.shifted)


@query(
    o.plain(
        f"{_twice()}, {_SHIFT}, {_RENAMES}",
        "SELECT s.qualified_name, s.file_path, CASE WHEN r.hash IS NOT NULL THEN 'preserved' WHEN s.hash IS NULL THEN 'removed' WHEN prev_hash IS NULL THEN 'added' WHEN s.hash = prev_hash THEN 'preserved' ELSE 'changed' END AS state, r.from_name AS renamed_from FROM shifted s LEFT JOIN ren r ON r.to_name = s.qualified_name AND r.to_file = s.file_path WHERE NOT (s.hash IS NULL AND EXISTS (SELECT 1 FROM ren x WHERE x.from_name = s.qualified_name AND x.from_file = s.file_path))",
    )
)
def structural_delta(g: Graph) -> DataFrame:
    return shapes.delta(g.shifted)


@query(o.plain(f"{_twice()}, {_SHIFT}", "SELECT count(hash) AS symbols, count(*) FILTER (WHERE hash <> prev_hash) AS changed, count(*) FILTER (WHERE hash IS NOT NULL AND prev_hash IS NULL) AS added, count(*) FILTER (WHERE hash IS NULL AND prev_hash IS NOT NULL) AS removed, max(generation) AS generation FROM shifted"))
def fingerprint_stats(g: Graph) -> DataFrame:
    return shapes.stats(g.shifted)


@query(o.recursive(f"{o.LINKS.replace(chr(39) + 'calls' + chr(39) + ', ' + chr(39) + 'member_of' + chr(39) + ', ' + chr(39) + 'implements' + chr(39), chr(39) + 'calls' + chr(39))}, {o.walk(NAME, DEPTH, False, True)}", f"SELECT root_id, edge_id, from_id, to_name, to_type, n_candidates, depth + 1 AS depth FROM bound JOIN reached ON node_id = from_id WHERE confidence = 'AMBIGUOUS' AND edge_type = 'calls' AND depth < {DEPTH}"))
def call_chain_ambiguous(g: Graph) -> DataFrame:
    return traverse.ambiguous_calls(g.bound, g.nodes, NAME, DEPTH)
