"""Roadmap and landscape queries, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import landscape, metrics, resolve, roadmap
from ..sources import roadmap as source
from . import oracle as o
from .catalog import _COUPLING, _DEGREES, Graph, query

ITEM_FILE, ITEM_SYMBOL = "src/promo/b10.x", "small_ring"
#: Items whose walk is asked for: a range, so that one query walks from many roots at once.
BLAST_ITEMS = ("C1", "C10", "C100")


class Plan:
    def __init__(self, g: Graph):
        self.g = g
        self.planes, self.items, self.touches = source.projected(g.spark, g.sf_dir)

    @property
    def bound(self) -> DataFrame:
        return self.g.held("bound-touches", lambda: roadmap.bind_touches(self.touches, self.g.nodes))


_TOUCHES = source.TOUCHES.replace("c.n / 10", "c.n // 10")
_PLAN = f"""{o.NODES}, planes AS ({source.PLANES}), items AS ({source.ITEMS}), touches AS ({_TOUCHES}),
files AS (SELECT DISTINCT file_path FROM nodes), syms AS (SELECT * FROM nodes WHERE node_type NOT IN ('import', 'module')),
tf AS (SELECT t.*, f.file_path AS to_id FROM touches t LEFT JOIN files f ON f.file_path = regexp_replace(raw, '^\\./', '') WHERE selector = 'file'),
ts0 AS (SELECT *, replace(replace(raw, '.', '::'), '/', '::') AS norm FROM touches WHERE selector = 'symbol'),
ts1 AS (SELECT t.*, contains(norm, '::') AND EXISTS (SELECT 1 FROM syms s WHERE s.qualified_name = norm) AS ex FROM ts0 t),
tc AS (SELECT t.item_id, t.ordinal, s.node_id AS candidate FROM ts1 t JOIN syms s ON ex AND s.qualified_name = norm UNION ALL SELECT t.item_id, t.ordinal, s.node_id FROM ts1 t JOIN syms s ON NOT ex AND s.name = string_split(norm, '::')[-1]),
tn AS (SELECT item_id, ordinal, count(*) AS n, min(candidate) AS sole FROM tc GROUP BY 1, 2),
tg AS (SELECT t.*, f.file_path AS to_id FROM touches t LEFT JOIN files f ON regexp_full_match(f.file_path, replace(replace(replace(raw, '.', '\\.'), '**', '.*'), '1*', '1[^/]*')) WHERE selector = 'glob'),
bt AS (SELECT item_id, ordinal, selector, raw, to_id, CASE WHEN to_id IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS confidence, CASE WHEN to_id IS NULL THEN 'no_such_file' END AS reason, CASE WHEN to_id IS NOT NULL THEN true END AS indexed, CASE WHEN to_id IS NULL THEN 0 ELSE 1 END AS n_candidates FROM tf
UNION ALL SELECT item_id, ordinal, selector, raw, to_id, CASE WHEN to_id IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END, CASE WHEN to_id IS NULL THEN 'no_glob_match' END, CASE WHEN to_id IS NOT NULL THEN true END, CASE WHEN to_id IS NULL THEN 0 ELSE 1 END FROM tg
UNION ALL SELECT t.item_id, t.ordinal, selector, raw, CASE WHEN n = 1 THEN sole END, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END, CASE WHEN n IS NULL THEN 'no_such_symbol' WHEN n > 1 THEN 'ambiguous_candidates' END, NULL, coalesce(n, 0) FROM ts1 t LEFT JOIN tn USING (item_id, ordinal))"""


@query(o.plain(_PLAN, "SELECT * FROM bt"))
def touch_binding(g: Graph) -> DataFrame:
    return Plan(g).bound


@query(o.plain(_PLAN, "SELECT i.item_id, plane_id, status, count(b.item_id) AS touch_count, count(*) FILTER (WHERE confidence = 'RESOLVED') AS resolved, count(*) FILTER (WHERE confidence = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE confidence = 'UNRESOLVED') AS unresolved, count(DISTINCT b.ordinal) AS selector_count, count(*) FILTER (WHERE NOT indexed) AS unindexed FROM items i LEFT JOIN bt b USING (item_id) GROUP BY ALL"))
def touch_tallies(g: Graph) -> DataFrame:
    p = Plan(g)
    return roadmap.tallies(p.items, p.bound)


@query(o.plain(_PLAN, "SELECT reason, count(*) AS n FROM bt WHERE confidence = 'UNRESOLVED' GROUP BY 1"))
def reason_tally(g: Graph) -> DataFrame:
    return roadmap.reasons(Plan(g).bound)


@query(o.plain(_PLAN, "SELECT p.plane_id, p.title, horizon, item_id, i.status AS item_status FROM planes p LEFT JOIN (SELECT * FROM items WHERE status = 'active') i USING (plane_id) WHERE horizon = 'now'"))
def plan_list(g: Graph) -> DataFrame:
    p = Plan(g)
    return roadmap.listed(p.planes, p.items, status="active", horizon="now")


@query(o.plain(_PLAN, "SELECT i.item_id, w.item_id AS blocked FROM items w JOIN items i ON i.item_id = w.waits_for"))
def plan_blocks(g: Graph) -> DataFrame:
    return roadmap.blocks(Plan(g).items)


def _touching_sql(target: str) -> str:
    return f"""{_PLAN}, ids AS (SELECT file_path AS id FROM files WHERE file_path = '{target}' UNION SELECT node_id FROM syms WHERE name = '{target}'),
hit AS (SELECT item_id, ordinal, selector, raw, min(CASE WHEN confidence = 'RESOLVED' AND to_id IN (SELECT id FROM ids) THEN 1 WHEN confidence = 'AMBIGUOUS' AND EXISTS (SELECT 1 FROM tc WHERE tc.item_id = bt.item_id AND tc.ordinal = bt.ordinal AND candidate IN (SELECT id FROM ids)) THEN 2 WHEN regexp_replace(raw, '^\\./', '') = '{target}' THEN 3 END) AS k FROM bt GROUP BY ALL)"""


_MATCHED = "SELECT item_id, ordinal, selector, raw, CASE k WHEN 1 THEN 'bound' WHEN 2 THEN 'candidate' ELSE 'literal' END AS matched_by FROM hit WHERE k IS NOT NULL"


@query(o.plain(_touching_sql(ITEM_FILE), _MATCHED))
def plan_touching(g: Graph) -> DataFrame:
    return roadmap.touching(Plan(g).bound, g.nodes, ITEM_FILE)


@query(o.plain(_touching_sql(ITEM_SYMBOL), _MATCHED))
def plan_touching_symbol(g: Graph) -> DataFrame:
    return roadmap.touching(Plan(g).bound, g.nodes, ITEM_SYMBOL)


_LIVE = "live AS (SELECT DISTINCT to_id, item_id, selector = 'glob' AS wide FROM bt JOIN items USING (item_id) WHERE status = 'active' AND confidence = 'RESOLVED')"


@query(o.plain(f"{_PLAN}, {_LIVE}", "SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_shared FROM live a JOIN live b USING (to_id) WHERE NOT a.wide AND NOT b.wide AND a.item_id < b.item_id GROUP BY 1, 2"))
def plan_collisions(g: Graph) -> DataFrame:
    p = Plan(g)
    own = p.touches.where("selector in ('file', 'symbol')").join(p.items.where("status = 'active'"), "item_id", "left_semi")
    return roadmap.collisions(p.items, roadmap.bind_touches(own, g.nodes), selectors=("file", "symbol"))


@query(o.plain(f"{_PLAN}, {_LIVE}", "SELECT DISTINCT to_id, item_id FROM live WHERE to_id IN (SELECT to_id FROM live GROUP BY 1 HAVING count(DISTINCT item_id) > 1)"))
def plan_collision_members(g: Graph) -> DataFrame:
    p = Plan(g)
    return roadmap.shared_members(p.items, p.bound)


@query(o.plain(f"{_PLAN}, {_LIVE}", "SELECT to_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(item_id) AS last_item FROM live GROUP BY 1 HAVING count(DISTINCT item_id) > 1"))
def plan_shared_targets(g: Graph) -> DataFrame:
    p = Plan(g)
    return roadmap.shared_targets(p.items, p.bound)


@query(o.plain(_PLAN, "SELECT item_id, status, count(*) AS n_unresolved, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM bt JOIN items USING (item_id) WHERE confidence = 'UNRESOLVED' AND status IN ('planned', 'active') GROUP BY 1, 2"))
def plan_stale(g: Graph) -> DataFrame:
    p = Plan(g)
    return roadmap.stale(p.items, p.bound)


_BLAST = ", ".join(f"'{i}'" for i in BLAST_ITEMS)


@query(
    o.recursive(
        f"{_PLAN}, {o.LINKS.removeprefix(o.NODES + ', ')}, seeds AS (SELECT DISTINCT item_id AS root_id, node_id FROM bt JOIN nodes n ON (selector = 'symbol' AND n.node_id = to_id) OR (selector <> 'symbol' AND n.file_path = to_id) WHERE confidence = 'RESOLVED' AND item_id IN ({_BLAST})), walk(root_id, node_id, depth) AS (SELECT root_id, node_id, 0 FROM seeds UNION SELECT root_id, src, depth + 1 FROM walk JOIN links ON dst = node_id WHERE depth < 3)",
        "SELECT w.root_id AS item_id, w.node_id, min(depth) AS depth, name, file_path FROM walk w JOIN nodes n USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.root_id = w.root_id AND s.node_id = w.node_id) GROUP BY ALL",
    )
)
def plan_blast(g: Graph) -> DataFrame:
    p = Plan(g)
    return roadmap.blast(roadmap.bind_touches(p.touches.where(p.touches["item_id"].isin(*BLAST_ITEMS)), g.nodes), g.nodes, g.links)


# -- landscape -------------------------------------------------------------------------------------


def _owner(g: Graph) -> DataFrame:
    return g.held("subsystems", lambda: landscape.partition(g.nodes.select("file_path")))


def _split_round(k: int) -> str:
    return f"""b{k} AS (SELECT s FROM p{k - 1} GROUP BY s HAVING count(*) > 0.25 * (SELECT count(*) FROM p0) AND s <> '.' AND len(string_split(s, '/')) < 3 AND max(len(d)) > len(string_split(s, '/'))),
p{k} AS (SELECT f, d, CASE WHEN s IN (SELECT s FROM b{k}) AND len(d) > len(string_split(s, '/')) THEN array_to_string(d[1 : len(string_split(s, '/')) + 1], '/') ELSE s END AS s FROM p{k - 1})"""


def _fold(k: int, depth: int) -> str:
    return f"""q{k} AS (SELECT s FROM p{k - 1} GROUP BY s HAVING count(*) < 2 AND s <> '.' AND len(string_split(s, '/')) = {depth}),
p{k} AS (SELECT f, d, CASE WHEN s IN (SELECT s FROM q{k}) AND regexp_replace(s, '/[^/]*$', '') IN (SELECT s FROM p{k - 1}) THEN regexp_replace(s, '/[^/]*$', '') ELSE s END AS s FROM p{k - 1})"""


_PART = f"""p0 AS (SELECT f, d, CASE WHEN len(d) = 0 THEN '.' ELSE d[1] END AS s FROM (SELECT f, string_split(f, '/')[1 : len(string_split(f, '/')) - 1] AS d FROM (SELECT DISTINCT file_path AS f FROM nodes))),
{_split_round(1)}, {_split_round(2)}, {_split_round(3)}, {_fold(4, 3)}, {_fold(5, 2)}, owner AS (SELECT f AS file_path, s AS subsystem FROM p5)"""
_SUBS = f"""{o.LOCATED}, {_PART}, across AS (SELECT a.subsystem AS x, b.subsystem AS y, from_file, to_file, edge_type FROM located JOIN owner a ON a.file_path = from_file JOIN owner b ON b.file_path = to_file WHERE from_file <> to_file),
chan AS (SELECT x, y, count(DISTINCT from_file || '|' || to_file) AS channels, count(*) AS refs, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS via FROM across GROUP BY 1, 2)"""


@query(o.plain(f"{o.NODES}, {_PART}", "SELECT * FROM owner"))
def subsystem_partition(g: Graph) -> DataFrame:
    return _owner(g)


@query(o.plain(_SUBS, "SELECT x AS from_sub, y AS to_sub, channels, refs, via FROM chan WHERE x <> y"))
def subsystem_edges(g: Graph) -> DataFrame:
    return landscape.edges(g.bound, g.nodes, _owner(g))


@query(
    o.plain(
        f"{_SUBS}, m AS (SELECT subsystem, count(*) AS files, sum(k) AS nodes FROM owner JOIN (SELECT file_path, count(*) FILTER (WHERE node_type <> 'import') AS k FROM nodes GROUP BY 1) USING (file_path) GROUP BY 1), n AS (SELECT m.*, coalesce((SELECT channels FROM chan WHERE x = subsystem AND y = subsystem), 0) AS internal, coalesce((SELECT sum(channels) FROM chan WHERE y = subsystem AND x <> y), 0) AS afferent, coalesce((SELECT sum(channels) FROM chan WHERE x = subsystem AND x <> y), 0) AS efferent FROM m)",
        "SELECT subsystem, files, CAST(nodes AS BIGINT) AS nodes, internal, CAST(afferent AS BIGINT) AS afferent, CAST(efferent AS BIGINT) AS efferent, CASE WHEN afferent + efferent > 0 THEN CAST(efferent AS DOUBLE) / CAST(afferent + efferent AS DOUBLE) END AS instability FROM n",
    )
)
def subsystem_metrics(g: Graph) -> DataFrame:
    return landscape.metrics(g.bound, g.nodes, _owner(g))


@query(o.plain(_SUBS, "SELECT a.x AS sub_a, a.y AS sub_b, a.channels AS a_to_b, b.channels AS b_to_a FROM chan a JOIN chan b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y"))
def subsystem_cycles(g: Graph) -> DataFrame:
    return landscape.cycles(landscape.edges(g.bound, g.nodes, _owner(g)))


@query(o.plain(_SUBS, "SELECT DISTINCT a.x AS sub_a, a.y AS sub_b, a.from_file AS file_a, a.to_file AS file_b FROM across a JOIN across b ON b.from_file = a.to_file AND b.to_file = a.from_file WHERE a.x < a.y"))
def subsystem_cycle_files(g: Graph) -> DataFrame:
    return landscape.cycle_files(g.links, g.nodes, _owner(g))


@query(o.plain(f"{o.GRAPH}, {_DEGREES}, {_PART}", "SELECT subsystem, row_number() OVER (PARTITION BY subsystem ORDER BY total DESC, name, file_path, node_id) AS place, node_id, name, file_path, total FROM deg JOIN owner USING (file_path) WHERE total > 0 QUALIFY place <= 3"))
def hubs_per_subsystem(g: Graph) -> DataFrame:
    return landscape.top_hubs(metrics.degrees(g.nodes, g.refs), _owner(g))


@query(o.plain(f"{o.GRAPH}, {_COUPLING}, {_PART}", "SELECT subsystem, file_path, CAST(afferent + efferent AS BIGINT) AS total FROM coupled JOIN owner USING (file_path) WHERE afferent + efferent > 0 QUALIFY row_number() OVER (PARTITION BY subsystem ORDER BY afferent + efferent DESC, file_path) = 1"))
def most_coupled_file(g: Graph) -> DataFrame:
    return landscape.most_coupled(metrics.coupling(g.nodes, g.refs, limit=None), _owner(g))


_PLACED = f"""{_PLAN}, {_PART}, lies AS (SELECT item_id, ordinal, selector, raw, regexp_replace(raw, '^\\./', '') AS path FROM touches WHERE selector = 'file' UNION ALL SELECT item_id, ordinal, selector, raw, to_id FROM tg WHERE to_id IS NOT NULL
UNION ALL SELECT item_id, ordinal, selector, raw, n.file_path FROM touches t JOIN nodes n ON n.node_type <> 'import' AND n.name = string_split(raw, '::')[-1] AND (NOT contains(raw, '::') OR n.qualified_name = raw OR ends_with(n.qualified_name, '::' || raw)) WHERE selector = 'symbol'),
placed AS (SELECT DISTINCT item_id, ordinal, selector, raw, coalesce(w.subsystem, (SELECT arg_max(subsystem, length(subsystem)) FROM owner v WHERE starts_with(path, v.subsystem || '/'))) AS subsystem FROM lies LEFT JOIN owner w ON w.file_path = path)"""


@query(
    o.plain(
        _PLACED,
        "SELECT item_id, ordinal, selector, raw, p.subsystem, CASE WHEN p.subsystem IS NULL THEN CASE selector WHEN 'symbol' THEN 'no_definition' ELSE 'not_on_disk' END END AS cause FROM touches LEFT JOIN (SELECT * FROM placed WHERE subsystem IS NOT NULL) p USING (item_id, ordinal, selector, raw)",
    )
)
def touch_placement(g: Graph) -> DataFrame:
    return landscape.place_touches(source.projected(g.spark, g.sf_dir)[2], g.nodes, _owner(g))


#: Part of the tree whose files count as on disk but not indexed, for the query below.
OUTSIDE = "src/promo/"


def _inside(g: Graph) -> DataFrame:
    return g.nodes.where(~g.nodes["file_path"].startswith(OUTSIDE))


@query(
    o.plain(
        _PLACED.replace("FROM nodes))", f"FROM nodes WHERE NOT starts_with(file_path, '{OUTSIDE}')))").replace("JOIN nodes n ON n.node_type <> 'import' AND n.name", f"JOIN nodes n ON n.node_type <> 'import' AND NOT starts_with(n.file_path, '{OUTSIDE}') AND n.name").replace("FROM tg WHERE to_id IS NOT NULL", f"FROM tg WHERE to_id IS NOT NULL AND NOT starts_with(to_id, '{OUTSIDE}')"),
        f"SELECT item_id, ordinal, selector, raw, p.subsystem, CASE WHEN p.subsystem IS NULL THEN CASE WHEN selector = 'symbol' THEN 'no_definition' WHEN EXISTS (SELECT 1 FROM bt WHERE bt.item_id = t.item_id AND bt.ordinal = t.ordinal AND bt.selector = t.selector AND bt.raw = t.raw AND bt.to_id IS NOT NULL) THEN 'outside_indexed_tree' ELSE 'not_on_disk' END END AS cause FROM touches t LEFT JOIN (SELECT * FROM placed WHERE subsystem IS NOT NULL) p USING (item_id, ordinal, selector, raw)",
    )
)
def touch_placement_outside(g: Graph) -> DataFrame:
    """As if the files of OUTSIDE were on disk and not indexed."""
    nodes = _inside(g)
    return landscape.place_touches(source.projected(g.spark, g.sf_dir)[2], nodes, landscape.partition(nodes.select("file_path")), g.nodes.select("file_path").distinct())


@query(o.plain(_PLACED, "SELECT p.subsystem, p.item_id, i.status, count(*) AS touches FROM placed p JOIN items i USING (item_id) WHERE p.subsystem IS NOT NULL GROUP BY ALL"))
def subsystem_overlay(g: Graph) -> DataFrame:
    p = Plan(g)
    return landscape.overlay(landscape.place_touches(p.touches, g.nodes, _owner(g)), p.items)
