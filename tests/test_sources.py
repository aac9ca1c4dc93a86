import pytest

from lodegraph.names.analyse import analyse, fact_cache, fact_tables
from lodegraph.rustlex.items import read_file
from lodegraph.rustlex.lexer import tokens
from lodegraph.schemas import InvalidArgument
from lodegraph.sources import discover, gitio, layout

LIB = '''//! Root.
pub mod store;
mod util;
pub use crate::store::Keeper;

use std::fmt as format;
use store::{self, memory::{Mem as Memory, *}};

pub enum State { On, Off(u32) }

pub struct Shop { pub mem: Memory, name: String }

impl Shop {
    pub fn new(name: &str) -> Self { Shop { mem: Memory::default(), name: name.to_string() } }
    pub fn sell(&self, n: u32) -> Result<u32, String> {
        let held = self.mem.load(n)?;
        let other = Shop::new("x");
        other.restock();
        util::log(n);
        println!("{}", util::log(held));
        let s = State::Off(n);
        Ok(held)
    }
    fn restock(&self) { self.mem.save(1); }
}

fn generic<K: Keeper>(k: &K) { k.load(3); }

fn loops(all: Vec<Memory>) { for m in all { m.load(1); } }

fn closures() { let f = |x: u32| x; f(1); (pick())(2); }

fn pick() -> fn(u32) -> u32 { unimplemented() }

#[cfg(test)]
mod tests {
    use super::*;

    #[test]
    fn sells() {
        let shop = Shop::new("a");
        assert_eq!(shop.sell(2), Ok(2));
        <Memory as Keeper>::load(&shop.mem, 1);
    }
}
'''
STORE = '''pub mod memory;

pub trait Keeper {
    fn load(&self, n: u32) -> Result<u32, String>;
    fn twice(&self, n: u32) -> u32 { self.load(n).unwrap() + self.load(n).unwrap() }
}
'''
MEMORY = '''use super::Keeper;

#[derive(Default)]
pub struct Mem;

impl Keeper for Mem {
    fn load(&self, n: u32) -> Result<u32, String> { Ok(n) }
}

impl Mem {
    pub fn save(&self, n: u32) { crate::util::log(n); crate::util::gone(n); }
}

impl crate::Shop {
    pub fn far(&self) {}
}
'''
FILES = {"Cargo.toml": '[package]\nname = "my-shop"\n[dependencies]\nserde = "1"\n', "src/lib.rs": LIB, "src/store/mod.rs": STORE, "src/store/memory.rs": MEMORY, "src/util.rs": "pub fn log(n: u32) -> u32 { n }\n", "tests/all.rs": "use my_shop::Shop;\n#[test]\nfn whole() { Shop::new(\"b\").far(); }\n", "src/unused.rs": "pub fn nobody() {}\n"}


def test_tokens():
    t = tokens("fn f<'a>() { /* a /* b */ { */ let c = '{'; r#\"}\"#; \"\\\"}\" } // }\n}")
    assert t.errors == 1 and t.text.count("{") == 1 and t.text.count("}") == 2
    assert tokens("").text == [] and tokens("(((").errors == 3
    assert tokens("\n\nx").line == [3]


def test_facts_of_a_file():
    f = read_file(LIB, "src/lib.rs", "my_shop")
    ids = {s.id: s for s in f.symbols}
    assert {"mod:my_shop", "enum:my_shop::State", "struct:my_shop::Shop", "method:my_shop::Shop::sell", "fn:my_shop::generic", "mod:my_shop::tests", "fn:my_shop::tests::sells"} <= set(ids)
    assert ids["fn:my_shop::tests::sells"].is_test and not ids["method:my_shop::Shop::sell"].is_test
    assert ids["method:my_shop::Shop::sell"].parent == "struct:my_shop::Shop" and ids["method:my_shop::Shop::sell"].start_line == 15
    assert f.modules == [([], "store", None), ([], "util", None)]
    paths = {(tuple(i.path), i.alias, i.glob) for i in f.imports}
    assert {(("std", "fmt"), "format", False), (("store",), None, False), (("store", "memory", "Mem"), "Memory", False), (("store", "memory"), None, True), (("super",), None, True)} <= paths
    again = read_file(LIB.replace("util::log(n);", "util::log( n ) ; // same"), "src/lib.rs", "my_shop")
    assert [s.fingerprint for s in again.symbols] == [s.fingerprint for s in f.symbols]


def test_resolution():
    r = analyse(FILES, "shop")
    edges = {(e.source, e.target, e.relation) for e in r.edges}
    calls = {(a, b) for a, b, rel in edges if rel == "CALLS"}
    sell, load = "method:my_shop::Shop::sell", "method:my_shop::store::memory::<Mem as Keeper>::load"
    assert {(sell, load), (sell, "method:my_shop::Shop::new"), (sell, "method:my_shop::Shop::restock"), (sell, "fn:my_shop::util::log"), ("method:my_shop::Shop::restock", "method:my_shop::store::memory::Mem::save"),
            ("fn:my_shop::tests::sells", sell), ("fn:my_shop::tests::sells", load), ("fn:all::whole", "method:my_shop::Shop::new"), ("fn:all::whole", "method:my_shop::Shop::far"), ("method:my_shop::store::Keeper::twice", "method:my_shop::store::Keeper::load")} <= calls
    assert ("struct:my_shop::store::memory::Mem", "trait:my_shop::store::Keeper", "IMPLEMENTS") in edges and (load, "method:my_shop::store::Keeper::load", "IMPLEMENTS") in edges
    assert ("mod:my_shop", "trait:my_shop::store::Keeper", "IMPORTS") in edges
    assert {(a[0], a[1], a[2]) for a in r.ambiguous} == {("fn:my_shop::generic", "k.load", "generic_parameter"), ("fn:my_shop::loops", "m.load", "receiver_type_unknown")}
    assert {(u[0], u[1], u[2]) for u in r.unresolved} == {("fn:my_shop::closures", "(pick())", "dynamic_call"), ("method:my_shop::store::memory::Mem::save", "crate::util::gone", "path_segment_not_found")}
    assert next(e for e in r.edges if (e.source, e.target) == (sell, "fn:my_shop::util::log")).lines == [19, 20]
    assert not any("unused" in s.id for s in r.symbols)


def test_cyclic_globs_end():
    files = {"src/lib.rs": "pub mod a; pub mod b; fn f() { g(); }\nuse a::*;\n", "src/a.rs": "pub use crate::b::*;\n", "src/b.rs": "pub use crate::a::*;\npub fn g() {}\n"}
    assert ("fn:r::f", "fn:r::b::g") in {(e.source, e.target) for e in analyse(files, "r").edges if e.relation == "CALLS"}


def test_fact_tables(spark):
    rows = [("r", p, t) for p, t in FILES.items()] + [("q", "src/lib.rs", "fn broken( {"), ("n", "a.rs", None), (None, "a.rs", "fn x() {}")]
    tables = fact_tables(spark.createDataFrame(rows, "repo_id string, path string, text string"))
    assert tables["edges"].where("repo_id = 'r' and relation = 'CALLS'").count() >= 10
    assert {r["repo_id"] for r in tables["symbols"].select("repo_id").distinct().collect()} == {"r", "q"}
    assert tables["ambiguous_calls"].where("candidate_count >= 2").count() == 2


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    cache = fact_cache(spark, str(tmp_path / "facts"))
    made = lambda files: spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_id string, path string, text string")
    edges = lambda tables: sorted(map(str, tables["edges"].collect()))
    assert edges(fact_tables(made(FILES), cache)) == edges(fact_tables(made(FILES)))
    before = cache.marker()["tables"]
    fact_tables(made(FILES), cache)
    assert cache.marker()["tables"] == before
    changed = FILES | {"src/util.rs": "pub fn log(n: u32) -> u32 { other(n) }\nfn other(n: u32) -> u32 { n }\n"}
    assert edges(fact_tables(made(changed), cache)) == edges(fact_tables(made(changed)))
    assert [t["rows"] for t in cache.marker()["tables"]["facts"]][-1] == 1


def test_layout():
    assert layout.parse_manifest("[package]\nname='a'\n[[bin]]\nname='t'\npath='x.rs'") == ("a", [("bin", "t", "x.rs")]) and layout.parse_manifest("nonsense[") is None
    assert layout.dependency_names("[dev-dependencies]\na-b='1'\n[target.'cfg(x)'.dependencies]\nc='1'\n[workspace.dependencies]\nd='1'") == ["a_b", "c", "d"]
    assert layout.owner("a/b/c.rs", ["", "a", "a/bc"]) == "a"
    found = layout.targets("r", {"Cargo.toml": "[package]\nname='r-x'", "sub/Cargo.toml": "[package]\nname='s'"}, ["src/lib.rs", "src/main.rs", "tests/t.rs", "tests/common/mod.rs", "sub/src/lib.rs", "examples/e/main.rs"])
    assert [(t.kind, t.name, t.root) for t in found] == [("lib", "r_x", "src/lib.rs"), ("lib", "s", "sub/src/lib.rs"), ("bin", "r_x", "src/main.rs"), ("test", "t", "tests/t.rs"), ("example", "e", "examples/e/main.rs")]
    assert layout.child_file("src/a.rs", False, ["in"], "b", None, {"src/a/in/b.rs"}) == "src/a/in/b.rs"
    assert layout.child_file("src/a.rs", False, [], "b", "../x.rs", {"x.rs"}) == "x.rs"


def test_git_output():
    assert gitio.parse_name_status("M\0a.rs\0R090\0old.rs\0new.rs\0A\0ü.rs\0X\0z\0") == [gitio.FileChange("modified", "a.rs"), gitio.FileChange("renamed", "new.rs", "old.rs"), gitio.FileChange("added", "ü.rs")]
    diff = '--- a/x.rs\n+++ b/x.rs\n@@ -3 +3,2 @@ fn\n@@ -9,2 +10,0 @@\n--- "a/\\303\\274.rs"\n+++ /dev/null\n@@ -1,4 +0,0 @@\n'
    assert gitio.parse_hunks(diff) == [gitio.Hunk("x.rs", 3, 1, 3, 2), gitio.Hunk("x.rs", 9, 2, 10, 0), gitio.Hunk("ü.rs", 1, 4, 0, 0)]
    assert gitio.is_remote("https://x/y") and gitio.is_remote("git@h:x/y.git") and not gitio.is_remote("/tmp")
    assert gitio.repository_id("https://u:p@h/x", "/a") == gitio.repository_id("https://h/x", "/b") != gitio.repository_id("https://h/x", "/b", "sub")
    with pytest.raises(InvalidArgument):
        gitio.resolve_commit("/tmp", "--upload-pack=x")


def test_discovery(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}\n\n", "target/x.rs": b"fn x() {}", "b.pb.go": b"package b", "bad.py": b"\xff\xfe", "notes.txt": b"x", "gen.js": b"// Code generated by x\n", ".hidden/h.rs": b"fn h() {}", "big.go": b"x" * (discover.TOO_LARGE + 1), "U.RS": b"fn u() {}"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r["path"]: (r["language"], r["skipped"]) for r in discover.scan(spark, str(tmp_path), "r").collect()}
    assert got == {"src/a.rs": ("rust", None), "U.RS": ("rust", None), "big.go": ("go", "too_large"), "b.pb.go": ("go", None), "bad.py": ("python", "not_utf8"), "gen.js": ("javascript", "generated")}
    facts = discover.file_facts(discover.scan(spark, str(tmp_path), "r")).collect()
    assert {(r["path"], r["loc"]) for r in facts} == {("src/a.rs", 1), ("U.RS", 1), ("b.pb.go", 1)}


def test_streams(spark, tmp_path):
    from lodegraph.streaming.events import sessions, windowed

    df = spark.createDataFrame([(1, "2025-01-01 00:10:00", "a", 1.0), (1, "2025-01-01 00:20:00", "a", 2.0), (1, "2025-01-01 02:00:00", "b", 3.0)], "user_id bigint, t string, event_type string, value double").selectExpr("user_id", "cast(t as timestamp) ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    key = lambda d: sorted((str(r["start"]), r["event_type"], r["n"], r["total"]) for r in d.collect())
    assert key(spark.table("w")) == key(windowed(df)) and len(key(windowed(df))) == 2
    assert sorted(r["n"] for r in sessions(df).collect()) == [1, 2]


def test_every_rust_text_gives_its_module(spark):
    texts = {
        "src/a/b.rs": "pub fn f() {}", "src/a.rs": "pub mod b;\nfn g() { b::f(); }", "src/c/mod.rs": "struct C;", "crates/x-y/src/order.rs": "fn o() {}", "crates/x-y/Cargo.toml": '[package]\nname = "x-y"',
        "build.rs": "fn main() {}", "tests/api.rs": "fn t() {}", "tests/deep/one.rs": "fn u() {}", "loose.rs": "fn l() {}", "cut.rs": "fn cut() { call(|a, b",
    }
    tables = fact_tables(spark.createDataFrame([("my-repo", p, t) for p, t in texts.items()], "repo_id string, path string, text string"))
    parents = {r["id"]: r["parent"] for r in tables["symbols"].where("kind = 'module'").collect()}
    assert parents == {
        "mod:my_repo::a": None, "mod:my_repo::a::b": "mod:my_repo::a", "mod:my_repo::c": None, "mod:x_y::order": None, "mod:my_repo_build": None, "mod:api": None, "mod:deep::one": None, "mod:my_repo::loose": None, "mod:my_repo::cut": None,
    }
    assert [(r["from_id"], r["to_id"]) for r in tables["edges"].where("relation = 'CALLS'").collect()] == [("fn:my_repo::a::g", "fn:my_repo::a::b::f")]


def test_mod_items_override_paths():
    manifests = {"Cargo.toml": '[package]\nname = "p"\n[[bin]]\nname = "tool"\npath = "cmd/tool.rs"\n'}
    texts = {"src/lib.rs": '#[path = "odd/name.rs"]\nmod given;', "src/odd/name.rs": "", "src/main.rs": "", "src/alone.rs": "fn a() {}", "cmd/tool.rs": "", "cmd/part.rs": ""}
    assert {f: m for f, (_, m) in layout.by_path("r", manifests, list(texts)).items()} == {"src/lib.rs": "p", "src/odd/name.rs": "p::odd::name", "src/main.rs": "p_bin", "src/alone.rs": "p::alone", "cmd/tool.rs": "tool", "cmd/part.rs": "tool::part"}
    ids = {s.id for s in analyse(manifests | texts, "r", unreached=True).symbols}
    assert {"mod:p::given", "mod:p::alone", "fn:p::alone::a", "mod:tool::part"} <= ids and "mod:p::odd::name" not in ids


def test_names_that_lead_to_each_other_end():
    files = {"src/a.rs": "use crate::b::{x, y};\nfn f() { x::go(); y(); }\n", "src/b.rs": "pub use crate::a::{x, y};\n", "src/lib.rs": "pub mod a; pub mod b;\npub use a::x; use b::y;\n"}
    r = analyse(files, "r")
    assert not [e for e in r.edges if e.relation == "CALLS"] and sum(r.outcomes.values()) == 2


def test_ambiguous_calls_give_candidate_edges(spark):
    text = "".join(f"struct S{n}; impl S{n} {{ fn go(&self) {{}} }}\n" for n in range(30)) + "fn f(all: Vec<S0>) {\n for x in all {\n x.go();\n x.go(); }\n for y in all { y.go(); } }\n"
    tables = fact_tables(spark.createDataFrame([("r", "src/a.rs", text)], "repo_id string, path string, text string"))
    found = tables["edges"].where("relation = 'CALLS_CANDIDATE'").collect()
    assert {r["to_id"] for r in found} == {f"method:r::a::S{n}::go" for n in range(30)}
    assert {(r["repo_id"], r["from_id"], r["resolution"], tuple(r["lines"])) for r in found} == {("r", "fn:r::a::f", None, (33, 34, 35))}
    assert len(found) == 30 and tables["ambiguous_calls"].count() == 3
