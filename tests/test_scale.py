"""Plans that grow with their input: what is shuffled, and where pairs come to be."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from bindloom.operators import explain, landscape, resolve, roadmap, shapes, traverse, verdict
from bindloom.plans.catalog import Graph
from bindloom.sources import projection
from bindloom.sources import roadmap as source


@pytest.fixture(scope="module")
def g(spark, sf_dir):
    return Graph(spark, sf_dir)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df, column: str) -> int:
    """Shuffles and sorts by a column of the name."""
    return len(re.findall(rf"(?:Exchange hashpartitioning|Sort)\W[^\n]*\b{column}#", plan(df)))


def test_references_look_names_up_without_a_shuffle_of_their_own(g):
    assert shuffles(resolve.bindings(g.refs, g.nodes), "norm") == 0


def test_references_that_bind_nowhere_leave_before_they_are_shuffled(g):
    said = plan(resolve.bindable(projection.edges(g.spark, g.sf_dir), g.nodes, g.later))
    assert 0 < said.index("Exchange hashpartitioning(from_id") < said.index("LeftSemi")


@pytest.mark.parametrize("nodes", ["nodes", "later"])
def test_links_are_what_all_references_are_bound_to(g, nodes):
    kind, here = {r["node_id"]: r["node_type"] for r in g.nodes.collect()}, getattr(g, nodes)
    rows = resolve.bindings(g.refs, here).where("confidence = 'RESOLVED'").groupBy("from_id", "to_id", "edge_type").count().collect()
    want = {(r["from_id"], kind[r["from_id"]], r["to_id"], kind[r["to_id"]], r["edge_type"], r["count"]) for r in rows}
    got = g.links if nodes == "nodes" else g.later_links
    assert want == {tuple(r) for r in got.select("from_id", "from_kind", "to_id", "to_kind", "edge_type", "k").collect()} and len(want) > 100


def test_links_by_every_rule_outlive_the_references_that_bind_nowhere(spark):
    made = [("a", "f", "rust", "x/1.rs", "m::f"), ("b", "f", "rust", "x/2.rs", "n::f"), ("c", "g", "rust", "x/2.rs", "n::g"), ("d", "h", "go", "x/3.go", "o::h"), ("e", "h", "go", "x/3.go", "o::h"), ("i", "use crate::n::*;", "rust", "x/4.rs", "p::use"), ("j", "k", "rust", "x/4.rs", "p::k")]
    nodes = spark.createDataFrame([(i, n, "import" if i == "i" else "function", lang, f, 1, q) for i, n, lang, f, q in made], "node_id string, name string, node_type string, language string, file_path string, start_line int, qualified_name string")
    named = [("a", "m::f"), ("a", "crate::n::f"), ("a", "self::super::m::f"), ("a", "f"), ("b", "f"), ("j", "f"), ("a", "g"), ("a", "x.g"), ("d", "h"), ("d", "o.h"), ("d", "g"), ("z", "g"), ("a", None)]
    edges = spark.createDataFrame([(a, n, "function", "calls") for a, n in named], "from_id string, to_name string, to_type string, edge_type string")
    bound = resolve.bindings(edges, nodes).where("confidence = 'RESOLVED'")
    want = {tuple(r) for r in bound.groupBy("from_id", "to_id").count().collect()}
    kept = resolve.bindable(edges, nodes)
    assert want == {tuple(r) for r in resolve.links(kept, nodes).select("from_id", "to_id", "k").collect()} == {("a", "a", 3), ("a", "b", 1), ("b", "b", 1), ("j", "b", 1), ("a", "c", 1)}
    assert not kept.where("to_name in ('h', 'o.h', 'x.g')").count()


def test_pairs_of_neighbours_are_shuffled_once(g):
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*\bother#", plan(shapes.fingerprints(g.nodes, g.links, g.contains)))) == 1


def test_both_ends_of_a_pair_are_written_down_from_one_row_of_numbers(g):
    said = plan(shapes.fingerprints(g.nodes, g.links, g.contains))
    assert not re.findall(r"(?:ObjectHash|Sort)Aggregate\(keys=\[[^\]]*\bother#", said) and not re.search(r"Exchange hashpartitioning\([^\n]*\blabel#", said)


def test_shapes_of_loops_and_of_edges_in_both_directions_are_as_defined(spark):
    kind = {"a": "function", "b": "struct", "c": "module", "d": "function"}
    links = [("a", "a", "calls", 2), ("a", "b", "member_of", 1), ("b", "a", "calls", 12), ("b", "a", "implements", 1), ("c", "a", "calls", 3), ("d", "b", "calls", 1), ("b", "d", "calls", 1)]
    holds = [("c", "a"), ("c", "d"), ("c", "d")]
    seen = {n: {} for n in kind}
    for f, t, e, k in [*links, *((f, t, "contains", 1) for f, t in holds)]:
        for node, other, label in [(f, t, f"{e}>"), *([(t, f, f"{e}<")] if f != t else [])]:
            star = seen[node].setdefault((other, "self" if f == t else kind[other]), {})
            star[label] = star.get(label, 0) + k
    want = {}
    for n, stars in seen.items():
        rays = [f"{k}={';'.join(sorted(f'{x}{c}' for x, c in star.items()))}" for (_, k), star in stars.items()]
        shape = "|".join(sorted(f"{r}={rays.count(r)}" for r in set(rays)))
        every = [(x, c) for star in stars.values() for x, c in star.items()]
        want[n] = (hashlib.md5(f"{kind[n]}#{shape}".encode()).hexdigest(), sum(c for _, c in every), sum(c for x, c in every if not x.startswith("contains")))
    nodes = spark.createDataFrame([(n, k, f"q::{n}", "f") for n, k in kind.items()], "node_id string, node_type string, qualified_name string, file_path string")
    bound = spark.createDataFrame([(f, kind[f], t, kind[t], e, k) for f, t, e, k in links], "from_id string, from_kind string, to_id string, to_kind string, edge_type string, k long")
    contains = spark.createDataFrame([(f, t, "contains") for f, t in holds], "from_id string, to_id string, edge_type string")
    got = {r["qualified_name"][3:]: (r["hash"], r["edge_count"], r["name_edge_count"]) for r in shapes.fingerprints(nodes, bound, contains).collect()}
    assert got == want


def test_a_verdict_never_lists_pairs_of_references_and_definitions(g):
    said = verdict.impact(g.bound, g.nodes, g.spark.createDataFrame([("small_ring",)], "queried string"))
    assert shuffles(said, "candidate") == 0 and "candidate#" not in plan(said)


def test_nearest_other_root_through_cycles_and_ties(spark):
    roots = spark.createDataFrame([("a", "a", "y"), ("b", "b", "x"), ("c", "c", "x")], "root_id string, node_id string, label string")
    step = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "d"), ("d", "e"), ("c", "e"), ("e", "c")], "src string, dst string")
    whole = traverse.reach(roots.select("root_id", "node_id"), step, 3).where("depth > 0").join(roots.select("root_id", "label"), "root_id").collect()
    want = {n: min((r["depth"], r["label"]) for r in whole if r["node_id"] == n) for n in {r["node_id"] for r in whole}}
    got = {}
    for r in traverse.nearest(roots, step, 3).where("depth > 0 and root_id <> node_id").collect():
        got[r["node_id"]] = min((r["depth"], r["label"]), got.get(r["node_id"], (9, "")))
    assert got == want and len(want) == 5


def test_only_references_that_may_be_stale_meet_their_source(g):
    asked = g.spark.createDataFrame([("std",)], "queried string")
    assert shuffles(traverse.stale(g.bound, g.nodes, asked), "queried") == 0


def test_few_ends_of_a_walk_do_not_shuffle_the_links(g):
    assert shuffles(traverse.dependents(g.bound, g.nodes, "small_ring"), "to_id") == 0


def test_touches_meet_subsystems_not_paths(g):
    touches = source.projected(g.spark, g.sf_dir)[2]
    said = plan(landscape.place_touches(touches, g.nodes, landscape.partition(g.nodes.select("file_path"))))
    assert "path#" not in said.replace("file_path#", "")


def test_steps_that_share_a_pool_look_it_up_without_a_shuffle(g):
    steps = g.bound.select(F.concat_ws("|", "to_name", "to_type", F.lit("rust")).alias("subject"))
    assert shuffles(explain._pooled(steps, g.nodes), "subject") == 0


def test_the_step_that_sees_every_reference_is_compiled(g):
    """The JVM never compiles methods of more than 8,000 bytes."""
    conf, own = g.spark.conf, {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: conf.get(k) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        mode = g.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        said = resolve.bindings(g.refs, g.nodes)._jdf.queryExecution().explainString(mode)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", said)]
    assert sizes and max(sizes) < 7000


def test_pairs_of_colliding_items_are_not_shuffled_and_shares_lose_none(spark, monkeypatch):
    rows = [(f"i{k}", k, "file", "f", f"t{k * j % 5}", "RESOLVED") for k in range(40) for j in (1, 2, 3)]
    bound = spark.createDataFrame(rows, "item_id string, ordinal long, selector string, raw string, to_id string, confidence string")
    items = spark.createDataFrame([(f"i{k}", "done" if k % 9 == 0 else "active") for k in range(40)], "item_id string, status string")
    at = {}
    for item, _, _, _, to, _ in rows:
        if int(item[1:]) % 9:
            at.setdefault(item, set()).add(to)
    want = {(a, b, len(at[a] & at[b])) for a in at for b in at if a < b and at[a] & at[b]}
    whole = roadmap.collisions(items, bound)
    assert shuffles(whole, "item_b") == 0 and {tuple(r) for r in whole.collect()} == want
    monkeypatch.setattr("bindloom.storage.BROADCAST_BYTES", 1500)
    monkeypatch.setattr(roadmap, "LISTED", 3)
    shared = roadmap.collisions(items, bound)
    assert plan(shared).count("BroadcastExchange") > 2 and sorted(map(tuple, shared.collect())) == sorted(want)
