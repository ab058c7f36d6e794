import pytest

from bindloom.config import doctor, read, settings
from bindloom.functions import names
from bindloom.operators.resolve import use_tree
from bindloom.sources import roadmap
from bindloom.sources.extract import body_end, extract, module_path


def shape(language, text, path="src/m/x.rs", tier="balanced"):
    nodes, edges = extract("p", path, language, text, tier)
    ids = {n["node_id"]: n["name"] for n in nodes}
    return {(n["node_type"], n["qualified_name"]) for n in nodes}, {(ids[e["from_id"]], e["edge_type"], e["to_name"] or ids[e["to_id"]]) for e in edges}


def test_rust_shapes():
    text = 'use crate::util::{a, b::*};\npub struct P { x: i32 }\ntrait T { fn go(&self); }\nimpl T for P { fn go(&self) { helper(); util::run(1); println!("x()"); } }\nfn helper() {}\n'
    nodes, edges = shape("rust", text, tier="full")
    assert ("struct", "m::x::P") in nodes and ("impl", "m::x::P") in nodes and ("function", "m::x::P::go") in nodes
    assert {("P", "implements", "T"), ("P", "contains", "go"), ("go", "calls", "helper"), ("go", "calls", "util::run"), ("go", "calls", "println")} <= edges


def test_go_method_in_another_file_is_a_member():
    nodes, edges = shape("go", "package m\nfunc (o *Other) Go() { help() }\ntype S struct{}\nfunc (s S) Run() {}\nfunc help() {}\n", "m/x.go")
    assert {("Go", "member_of", "Other"), ("S", "contains", "Run"), ("Go", "calls", "help")} <= edges
    assert ("function", "m::S::Run") in nodes


def test_typescript_java_c_and_python():
    assert ("f", "calls", "g") in shape("typescript", "export const f = (x) => g(x);\nfunction g(x) { return x }\ng(1);\n", "a/x.ts")[1]
    assert ("x", "calls", "g") in shape("typescript", "function g(x) { return x }\ng(1);\n", "a/x.ts")[1]
    assert {("run", "calls", "go"), ("A", "contains", "run")} <= shape("java", "class A { void run() { this.go(); } int go() { return 1; } }", "a/A.java")[1]
    assert ("main", "calls", "add") in shape("c", "static int add(int a) {\n return a;\n}\nint main(void) { add(1); }\n", "a/x.c")[1]
    nodes, edges = shape("python", "class A:\n    def go(self): os.path.join('a')\ndef _p(): pass\n", "a/__init__.py")
    assert nodes == {("class", "a::A"), ("function", "a::A::go")} and ("go", "calls", "os.path.join") in edges


def test_text_in_comments_and_literals_is_no_code():
    assert shape("rust", '// fn a() {}\n/* fn b() {} */\nfn c() { let s = "fn d() {}"; }\n')[0] == {("function", "m::x::c")}
    assert body_end("a { b { } } c", 0) == 11 and body_end("a;", 0) == 2 and body_end("a { b", 0) == 5


def test_unreadable_text_raises_and_unknown_tier_is_refused():
    with pytest.raises(SyntaxError):
        extract("p", "a.py", "python", "def (", "balanced")
    with pytest.raises(ValueError):
        extract("p", "a.py", "python", "", "slow")


def test_module_paths():
    assert module_path("src/a/mod.rs", "rust") == ["a"] and module_path("src/a/b.rs", "rust") == ["a", "b"]
    assert module_path("a/b.go", "go") == ["a"] and module_path("a/b.ts", "typescript") == ["a", "b"] and module_path("a/__init__.py", "python") == ["a"]


def test_use_trees():
    assert use_tree("use crate::a::{b, c::{self, d as e}, f::*};") == [("a::b", False), ("a::c", False), ("a::c::d", False), ("a::f", True)]
    assert use_tree("pub(crate) use x::y;") == [("x::y", False)] and use_tree("use crate::*;") == [("", True)]


@pytest.mark.parametrize(
    ("rule", "pattern", "yes", "no"),
    [
        (names.plan_glob, "src/**/x.rs", ["src/x.rs", "src/a/b/x.rs"], ["src/x.rss", "x.rs"]),
        (names.plan_glob, "docs/**", ["docs/a", "docs/a/b"], ["doc/a"]),
        (names.plan_glob, "src/*.rs", ["src/a.rs"], ["src/a/b.rs"]),
        (names.tree_glob, "a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
        (names.tree_glob, "a?c", ["abc"], ["a/c"]),
    ],
)
def test_globs(rule, pattern, yes, no):
    import re

    assert all(re.match(rule(pattern), p) for p in yes) and not any(re.match(rule(pattern), p) for p in no)


GOOD = """
version: 1
planes:
  - id: core
    title: Core
    horizon: now
    items:
      - {id: one, title: One, kind: fix, status: active, touches: [{file: src/a.rs}, {symbol: a::b}]}
      - {id: two, title: Two, depends_on: [one], touches: [{glob: "src/**"}]}
"""


def test_roadmap_is_checked():
    assert len(roadmap.parse(GOOD)["planes"]) == 1

    def codes(text):
        with pytest.raises(roadmap.RoadmapError) as e:
            roadmap.parse(text)
        return {c for c, _ in e.value.found}

    assert codes("planes: []") == {"missing_version"} and codes("version: x") == {"non_numeric_version"} and codes("version: 2") == {"unsupported_version"}
    assert codes(GOOD.replace("depends_on: [one]", "depends_on: [zero]")) == {"dangling_dependency"}
    assert codes(GOOD.replace("depends_on: [one]", "depends_on: [two]")) == {"self_dependency"}
    assert codes(GOOD.replace("{id: one,", "{id: one, depends_on: [two],")) == {"dependency_cycle"}
    assert codes(GOOD.replace("id: two", "id: one").replace("depends_on: [one], ", "")) == {"duplicate_item_id"}
    assert codes(GOOD.replace("id: two", "id: T wo")) == {"invalid_id"}
    assert codes(GOOD.replace('[{glob: "src/**"}]', "[]")) == {"empty_touches"} and codes(GOOD.replace('glob: "src/**"', "glob: ''")) == {"empty_touch_value"}
    assert codes(GOOD.replace("horizon: now", "horizon: soon")) == {"unknown_horizon"} and codes(GOOD.replace("glob:", "path:")) == {"unknown_selector"}
    assert codes(GOOD.replace("kind: fix", "kind: x")) == {"unknown_kind"} and codes(GOOD.replace("status: active", "status: x")) == {"unknown_status"}


def test_settings_ladder(tmp_path, monkeypatch):
    (tmp_path / "bindloom.conf").write_text('tier = "full" # all\nproject_id = "from file"\n')
    assert read(str(tmp_path / "bindloom.conf")) == {"tier": "full", "project_id": "from file"}
    assert settings(str(tmp_path)).project_id == "from_file" and settings(str(tmp_path), project_id="x").project_id == "x"
    monkeypatch.setenv("BINDLOOM_PROJECT_ID", "env")
    assert settings(str(tmp_path)).project_id == "env" and settings(str(tmp_path)).tier == "full"
    assert all(fine for _, fine, _ in doctor(str(tmp_path)))


def meta(language, text, name, path="src/m/x.rs"):
    return next(n["metadata"] for n in extract("p", path, language, text, "balanced")[0] if n["name"] == name)


def test_metadata_of_definitions():
    rust = "#[derive(Debug, Clone)]\npub struct P<T> { pub x: i32, y: Vec<T> }\npub async fn go<T: Ord>(a: &T, b: (u8, u8)) -> Result<T, E> where T: Copy { a }\nenum E { A, B(i32), C { z: u8 } }\nunsafe fn raw(p: *mut u8) {}\n"
    assert meta("rust", rust, "P")["derives"] == "Debug, Clone" and meta("rust", rust, "P")["generics"] == "T" and meta("rust", rust, "P")["fields"] == "x, y"
    go = meta("rust", rust, "go")
    assert go["parameters"] == "a: &T, b: (u8, u8)" and go["return_type"] == "Result<T, E>" and go["generics"] == "T: Ord" and go["async"] == "true" and go["visibility"] == "pub"
    assert meta("rust", rust, "E")["variants"] == "A, B, C" and meta("rust", rust, "raw")["unsafe"] == "true"
    ts = "export class A<T> extends B<T> implements C, D { x: number; run(a: string): void { } }\nexport async function f(a: number, b?: string): Promise<number> { return a }\nenum K { One, Two = 2 }\n"
    assert meta("typescript", ts, "A", "a/x.ts")["extends"] == "B<T>" and meta("typescript", ts, "A", "a/x.ts")["implements"] == "C, D" and meta("typescript", ts, "A", "a/x.ts")["fields"] == "x"
    f = meta("typescript", ts, "f", "a/x.ts")
    assert f["parameters"] == "a: number, b?: string" and f["return_type"] == "Promise<number>" and f["async"] == "true"
    assert meta("typescript", ts, "K", "a/x.ts")["variants"] == "One, Two"
    gofile = "package m\ntype S struct {\n\tName string\n\tAge  int\n}\ntype I interface {\n\tRun(x int) error\n}\nfunc (s *S) Go(a int, b string) (int, error) {\n\treturn 1, nil\n}\n"
    assert meta("go", gofile, "S", "m/x.go")["fields"] == "Name, Age" and meta("go", gofile, "I", "m/x.go")["methods"] == "Run"
    assert meta("go", gofile, "Go", "m/x.go")["parameters"] == "a int, b string" and meta("go", gofile, "Go", "m/x.go")["return_type"] == "(int, error)"
    java = "public class A extends B implements C, D {\n  public static final int MAX = 3;\n  private String name;\n  public List<String> run(int a, String b) throws E { return null; }\n}\nenum K { ONE, TWO; }\n"
    a = meta("java", java, "A", "a/A.java")
    assert a["extends"] == "B" and a["implements"] == "C, D" and a["constants"] == "MAX" and "name" in a["fields"]
    run = meta("java", java, "run", "a/A.java")
    assert run["parameters"] == "int a, String b" and run["return_type"] == "List<String>" and meta("java", java, "K", "a/A.java")["variants"] == "ONE, TWO"
    c = "struct P {\n  int x;\n  char *y;\n};\nenum K { A, B = 2 };\nstatic const char *add(int a, int b) {\n return 0;\n}\n"
    assert meta("c", c, "P", "a/x.c")["fields"] == "x, y" and meta("c", c, "K", "a/x.c")["variants"] == "A, B"
    assert meta("c", c, "add", "a/x.c")["parameters"] == "int a, int b" and meta("c", c, "add", "a/x.c")["return_type"] == "const char *"
    assert meta("cpp", "class A : public B, private C {\n int x;\n};\n", "A", "a/x.cpp")["bases"] == "public B, private C"


def test_repeated_calls_are_edges_of_their_own():
    edges = [e for e in extract("p", "src/a.rs", "rust", "fn a() { b(); b(); c(); }\nfn b() {}\n", "balanced")[1] if e["edge_type"] == "calls"]
    assert [(e["to_name"], e["occurrence"]) for e in edges] == [("b", 0), ("b", 1), ("c", 0)]


def test_fnv_of_known_texts():
    assert [f"{names.fnv1a64(t):016x}" for t in (b"", b"a", b"foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_init_lays_down_and_keeps(tmp_path):
    from bindloom.config import init

    assert init(str(tmp_path), project_id="demo") == [("bindloom.conf", "written"), ("roadmap.yaml", "written"), (".gitignore", "written")]
    assert init(str(tmp_path), project_id="other") == [("bindloom.conf", "kept"), ("roadmap.yaml", "kept"), (".gitignore", "kept")]
    assert settings(str(tmp_path)).project_id == "demo" and dict((c, f) for c, f, _ in doctor(str(tmp_path)))["roadmap"]
    (tmp_path / "roadmap.yaml").write_text("version: 9\n")
    report = {c: (f, said) for c, f, said in doctor(str(tmp_path))}
    assert report["roadmap"][0] is False and report["next"] == (False, "mend roadmap.yaml")


def test_text_helpers_of_renderers():
    from bindloom.sinks import render

    assert render.truncated("abcdef", 4) == "abc\u2026" and render.truncated("abc", 4) == "abc"
    assert render.demoted("# A\n```\n# code\n```\n###### F") == "## A\n```\n# code\n```\n###### F"
    assert render.dot_escaped('a"b\\c') == 'a\\"b\\\\c' and render.label("a[b]|c") == "a b  c"
