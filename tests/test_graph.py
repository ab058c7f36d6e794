"""Operators on small graphs made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from bindloom.operators import explain, landscape, metrics, resolve, roadmap, shapes, traverse, verdict

NODE = "node_id string, name string, node_type string, language string, file_path string, start_line int, qualified_name string"
REF = "edge_id string, from_id string, to_name string, to_type string, edge_type string"


@pytest.fixture(scope="module")
def make(spark):
    def nodes(*rows):
        full = [(i, n, t, lang, f, k, q) for k, (i, n, t, lang, f, q) in enumerate(rows)]
        return spark.createDataFrame(full, NODE)

    def refs(*rows):
        return spark.createDataFrame([(f"e{k}", a, n, r[0] if r else "function", r[1] if len(r) > 1 else "calls") for k, (a, n, *r) in enumerate(rows)], REF)

    return nodes, refs


def rust(i, name, file, q, kind="function"):
    return (i, name, kind, "rust", file, q)


@pytest.fixture(scope="module")
def small(make):
    nodes, refs = make
    n = nodes(
        rust("a", "main", "src/a.rs", "a::main"),
        rust("b", "helper", "src/b.rs", "b::helper"),
        rust("c", "helper", "src/c.rs", "c::helper"),
        rust("d", "local", "src/a.rs", "a::local"),
        rust("e", "only", "src/e.rs", "x::e::only"),
        ("p", "only", "function", "python", "src/p.py", "p::only"),
        rust("i", "use crate::c::*;", "src/a.rs", "a::use", "import"),
    )
    r = refs(("a", "b::helper"), ("a", "e::only"), ("a", "crate::b::helper"), ("a", "local"), ("a", "helper"), ("b", "only"), ("b", "helper2"), ("b", "local::ghost"), ("d", "std.helper"), ("e", "helper"), ("zz", "local"), ("a", None))
    return n, r, resolve.bindings(r, n).cache()


def test_each_rule_binds_what_it_should(small):
    got = {r["edge_id"]: (r["to_id"], r["confidence"], r["resolved_by"], r["outcome"]) for r in small[2].collect()}
    assert got["e0"] == ("b", "RESOLVED", "r1", "bound")
    assert got["e1"] == ("e", "RESOLVED", "r2", "bound")
    assert got["e2"] == ("b", "RESOLVED", "r2m", "bound")
    assert got["e3"] == ("d", "RESOLVED", "r3", "bound")
    assert got["e4"] == ("c", "RESOLVED", "r4", "bound")
    assert got["e5"] == ("e", "RESOLVED", "r5", "bound")  # the other family's twin does not count
    assert got["e6"] == ("", "UNRESOLVED", "r6", "no_candidates")
    assert got["e7"] == ("", "UNRESOLVED", "r6", "no_candidates")
    assert got["e8"] == ("", "UNRESOLVED", "r6", "no_rule_matched")  # a qualified name never falls back to its tail
    assert got["e9"] == ("", "AMBIGUOUS", "r6", "ambiguous")
    assert got["e10"] == ("", "UNRESOLVED", "r6", "orphan_source")
    assert got["e11"][1] == "UNRESOLVED"


def test_attempts_stop_at_the_rule_that_binds(small):
    got = {r["edge_id"]: r["attempts"] for r in small[2].collect()}
    assert got["e0"] == "r1:bound" and got["e1"] == "r1:no_match,r2:bound"
    assert got["e4"] == "r3:no_match,r4:bound" and got["e9"] == "r3:no_match,r4:skipped,r6:not_unique" and got["e10"] == ""


def test_candidates_and_stats(small):
    n, _, bound = small
    assert {(r["edge_id"], r["candidate"]) for r in resolve.candidates(bound, n).collect()} == {("e9", "b"), ("e9", "c")}
    s = resolve.stats(bound, n).first()
    assert (s["considered"], s["resolved"], s["ambiguous"], s["unresolved"], s["file_refs"]) == (12, 6, 1, 5, 4)


def test_binding_does_not_depend_on_the_order_of_rows(small, spark):
    n, r, bound = small
    rows, defs = r.collect(), n.collect()
    random.Random(5).shuffle(rows)
    random.Random(6).shuffle(defs)
    again = resolve.bindings(spark.createDataFrame(rows, REF).repartition(3), spark.createDataFrame(defs, NODE).repartition(3))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, bound.collect()))


def test_incremental_is_the_same_as_full(small, make):
    n, r, bound = small
    later = n.where("node_id <> 'c'").union(make[0](rust("n", "helper2", "src/b.rs", "b::helper2")))
    changed = n.sparkSession.createDataFrame([("src/c.rs",), ("src/b.rs",)], "file_path string")
    step = resolve.incremental(bound.withColumn("resolution_gen", F.lit(1)), later, changed, resolve.delta_names(n, later), 2)
    full = resolve.bindings(r, later)
    cols = ["edge_id", "to_id", "confidence", "resolved_by", "outcome", "attempts"]
    assert sorted(map(repr, step.select(*cols).collect())) == sorted(map(repr, full.select(*cols).collect()))
    gens = {x["edge_id"]: x["resolution_gen"] for x in step.collect()}
    assert gens["e3"] == 1 and gens["e6"] == 2 and gens["e4"] == 2


@pytest.fixture(scope="module")
def ring(make):
    """a -> b -> c -> a, d -> c, and an ambiguous reference from d."""
    nodes, refs = make
    n = nodes(*[rust(x, f"f{x}", f"src/{x}.rs", f"{x}::f{x}") for x in "abcd"], rust("t1", "twin", "src/t1.rs", "t1::twin"), rust("t2", "twin", "src/t2.rs", "t2::twin"))
    r = refs(("a", "fb"), ("b", "fc"), ("c", "fa"), ("d", "fc"), ("b", "fa"), ("d", "twin"), ("a", "gone"), ("a", "old::gone"))
    return n, r, resolve.bindings(r, n).cache()


def test_walks_stop_at_depth_and_survive_cycles(ring):
    n, _, bound = ring
    got = {(r["node_id"], r["depth"]) for r in traverse.dependents(bound, n, "fc", 5).collect()}
    assert got == {("b", 1), ("d", 1), ("a", 2)}
    assert {(r["node_id"], r["depth"]) for r in traverse.dependencies(bound, n, "fa", 1).collect()} == {("b", 1)}
    assert {r["hops"] for r in traverse.reverse_paths(bound, n, "fc", 3).collect()} == {"c>b", "c>d", "c>b>a"}
    assert {(r["caller_name"], r["callee_name"], r["depth"]) for r in traverse.call_chain(bound, n, "fa", 3).collect()} == {("fa", "fb", 1), ("fb", "fc", 2)}


def test_stale_and_ambiguous_findings(ring, spark):
    n, _, bound = ring
    ask = lambda *q: spark.createDataFrame([(x,) for x in q], "queried string")
    assert {(r["queried"], r["to_name"]) for r in traverse.stale(bound, n, ask("gone", "old", "fc")).collect()} == {("gone", "gone"), ("gone", "old::gone"), ("old", "old::gone")}
    v = verdict.impact(bound, n, ask("twin"))
    assert [(r["section"], r["node_id"]) for r in v.where("section = 'ambiguous'").collect()] == [("ambiguous", "d")]
    s = verdict.summary(verdict.impact(bound, n, ask("fc"))).first()
    assert s["clean"] and s["n_dependent"] == 3 - 0 and s["n_symbol"] == 1


def test_mutual_pairs_are_pairs_only(ring):
    n, _, bound = ring
    got = [(r["file_a"], r["file_b"], r["total"], r["via"]) for r in metrics.mutual_pairs(bound, n).collect()]
    assert got == [("src/a.rs", "src/b.rs", 2, "calls")]


def test_chains_hold_until_the_graph_or_the_chain_changes(ring, spark, make):
    n, r, bound = ring
    ask = spark.createDataFrame([("fc",), ("gone",), ("twin",)], "queried string")
    steps = explain.chains(bound, n, ask, 2).cache()
    assert {x["kind"] for x in steps.select("kind").distinct().collect()} == {"stale_reference", "ambiguous_refusal", "dependent"}
    assert explain.verdicts(explain.verify(steps, bound, n)).where("not ok").count() == 0
    forged = steps.withColumn("payload", F.when(F.col("fact") == "cascade_outcome", "bound").otherwise(F.col("payload")))
    assert explain.verify(forged, bound, n).where("not ok").select("fact").distinct().collect()[0]["fact"] == "cascade_outcome"
    less = n.where("node_id <> 't2'")
    bad = explain.verdicts(explain.verify(steps, resolve.bindings(r, less), less)).where("not ok")
    assert {x["chain_id"][0] for x in bad.collect()} == {"A"}
    assert explain.verify(steps, bound, n, version=1).count() == 0


def test_shapes_ignore_names_and_see_edges(spark, make):
    nodes, refs = make
    contains = spark.createDataFrame([], "from_id string, to_id string, edge_type string")

    def prints(*names, extra=()):
        n = nodes(*[rust(x, f"f{x}", f"src/{x}.rs", f"{x}::f{x}") for x in names])
        a, b, c = names
        r = refs((a, f"f{b}"), (a, f"f{c}"), *extra)
        return {x["qualified_name"]: x["hash"] for x in shapes.fingerprints(n, resolve.bindings(r, n), contains).collect()}

    one, two = prints("a", "b", "c"), prints("x", "y", "z")
    assert one["a::fa"] == two["x::fx"] and one["b::fb"] == two["z::fz"] and one["a::fa"] != one["b::fb"]
    assert prints("a", "b", "c", extra=[("b", "fc")])["b::fb"] != one["b::fb"]
    assert prints("a", "b", "c", extra=[("b", "nothing")])["b::fb"] == one["b::fb"]


def test_delta_pairs_a_rename_and_refuses_twins(spark):
    cols = "qualified_name string, file_path string, node_type string, hash string, edge_count long, name_edge_count long"
    old = spark.createDataFrame([("a", "f", "function", "h1", 1, 1), ("b", "f", "function", "h2", 1, 1), ("c", "f", "function", "h3", 1, 1), ("d", "f", "function", "h3", 1, 1)], cols).withColumn("generation", F.lit(1))
    new = spark.createDataFrame([("a2", "f", "function", "h1", 1, 1), ("b", "f", "function", "h9", 1, 1), ("c2", "f", "function", "h3", 1, 1), ("d2", "f", "function", "h3", 1, 1)], cols)
    shifted = shapes.next_generation(old, new, 2)
    got = {(r["qualified_name"], r["state"], r["renamed_from"]) for r in shapes.delta(shifted).collect()}
    assert got == {("a2", "preserved", "a"), ("b", "changed", None), ("c2", "added", None), ("d2", "added", None), ("c", "removed", None), ("d", "removed", None)}
    assert shapes.next_generation(shifted, new, 3).where("hash is null").count() == 0  # a tombstone lasts one generation


def test_deletions_heal(make, spark):
    nodes, _ = make
    before, after = nodes(rust("a", "fa", "src/a.rs", "a::fa"), rust("b", "fb", "src/a.rs", "a::fb")), nodes(rust("a", "fa", "src/a.rs", "a::fa"))
    gone = verdict.deleted_symbols(before, after)
    assert [r["name"] for r in gone.collect()] == ["fb"]
    assert verdict.healed(gone, before).count() == 0 and verdict.recorded(gone, before, after, force=True).count() == 0
    listing = lambda *r: spark.createDataFrame(list(r), "file_path string, content_hash string")
    got = verdict.file_changes(listing(("a", "1"), ("b", "1"), ("c", "1")), listing(("a", "1"), ("b", "2"), ("d", "1")))
    assert {tuple(r) for r in got.collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_partition_splits_folds_and_ends(spark):
    def cut(*paths):
        return {r["file_path"]: r["subsystem"] for r in landscape.partition(spark.createDataFrame([(p,) for p in paths], "file_path string")).collect()}

    assert cut("README.md") == {"README.md": "."}
    assert set(cut("src/a.rs", "src/b.rs").values()) == {"src"}  # nothing deeper: no split
    got = cut("src/x/a", "src/x/b", "src/y/a", "src/y/b", "src/m", "src/n", "docs/a", "t/a")
    assert got["src/x/a"] == "src/x" and got["src/m"] == "src" and got["docs/a"] == "docs"
    assert cut("src/x/a", "src/y/a", "src/y/b", "src/m")["src/x/a"] == "src"  # one file folds into its parent
    assert cut() == {}


def test_roadmap_operators(make, spark):
    nodes, _ = make
    n = nodes(rust("a", "fa", "src/a.rs", "a::fa"), rust("b", "twin", "src/b.rs", "b::twin"), rust("c", "twin", "src/sub/c.rs", "sub::c::twin"), rust("m", "a", "src/a.rs", "a", "module"))
    t = [("one", 0, "file", "./src/a.rs"), ("one", 1, "file", "README.md"), ("one", 2, "symbol", "twin"), ("two", 0, "symbol", "b.twin"), ("two", 1, "glob", "src/**"), ("two", 2, "glob", "no/*"), ("two", 3, "symbol", "zero"), ("two", 4, "symbol", "a"), ("two", 5, "symbol", None)]
    touches = spark.createDataFrame(t, "item_id string, ordinal long, selector string, raw string")
    disk = spark.createDataFrame([("README.md",)], "file_path string")
    bound = roadmap.bind_touches(touches, n, disk).cache()
    got = {}
    for r in bound.collect():
        got.setdefault((r["item_id"], r["ordinal"]), []).append((r["to_id"], r["confidence"], r["reason"], r["indexed"]))
    assert got[("one", 0)] == [("src/a.rs", "RESOLVED", None, True)] and got[("one", 1)] == [("README.md", "RESOLVED", None, False)]
    assert got[("one", 2)] == [(None, "AMBIGUOUS", "ambiguous_candidates", None)] and got[("two", 0)] == [("b", "RESOLVED", None, None)]
    assert len(got[("two", 1)]) == 3 and got[("two", 2)][0][2] == "no_glob_match"
    assert got[("two", 3)][0][2] == got[("two", 4)][0][2] == got[("two", 5)][0][2] == "no_such_symbol"
    items = spark.createDataFrame([("one", "p", "active", ["two"]), ("two", "p", "active", [])], "item_id string, plane_id string, status string, depends_on array<string>")
    assert [tuple(r) for r in roadmap.collisions(items, bound).collect()] == [("one", "two", 1)]
    assert [tuple(r) for r in roadmap.blocks(items).collect()] == [("two", "one")]
    assert {(r["item_id"], r["matched_by"]) for r in roadmap.touching(bound, n, "twin").collect()} == {("one", "candidate"), ("two", "bound")}
    tally = {r["item_id"]: r for r in roadmap.tallies(items, bound).collect()}
    assert tally["one"]["unindexed"] == 1 and tally["two"]["selector_count"] == 6 and tally["two"]["unresolved"] == 4


def test_registered_members_hold_collisions_by_globs_too(spark, sf_dir):
    from bindloom.plans import catalog, planning

    def pairs(df):
        return {tuple(r) for r in df.collect()}

    t = catalog.queries()["plan_collision_members"](spark, sf_dir)
    a, b = t.withColumnRenamed("item_id", "item_a"), t.withColumnRenamed("item_id", "item_b")
    got = pairs(a.join(b, "to_id").where("item_a < item_b").groupBy("item_a", "item_b").count())
    p = planning.Plan(catalog.Graph(spark, sf_dir))
    assert got == pairs(roadmap.collisions(p.items, p.bound))
    assert got > set() and {x[:2] for x in got} > {x[:2] for x in pairs(catalog.queries()["plan_collisions"](spark, sf_dir))}


def test_evidence_fails_when_an_inner_definition_is_replaced(ring, spark):
    n, r, bound = ring
    like = n.where("node_id = 't2'").drop("node_id")
    n = n.unionByName(like.withColumn("node_id", F.lit("t1m"))).unionByName(like.withColumn("node_id", F.lit("t9")))
    ask = spark.createDataFrame([("twin",)], "queried string")
    bound = resolve.bindings(r, n).cache()
    steps = explain.chains(bound, n, ask, 1).cache()
    assert explain.verify(steps, bound, n).where("not ok").count() == 0
    other = n.withColumn("node_id", F.when(F.col("node_id") == "t2", "t5").otherwise(F.col("node_id")))
    failed = explain.verify(steps, resolve.bindings(r, other).cache(), other).where("not ok")
    assert {"candidate_pool", "rule_application"} <= {x["fact"] for x in failed.collect()}
    live = spark.createDataFrame([("S", "stale_reference", 1, "live_definitions", "twin")], "chain_id string, kind string, step int, fact string, subject string")
    live = live.join(explain._derived(bound, n, live), ["fact", "subject"])
    assert [x["ok"] for g in (n, other) for x in explain.verify(live, bound, g).collect()] == [True, False]
