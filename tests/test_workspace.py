import json

import pyarrow as pa
import pytest

from weftgraph.plans.check import check
from weftgraph.sources import rust_text, workspace
from weftgraph.sources.rust_text import scan
from weftgraph.sources.workspace import Workspace, WorkspaceOptions


def make(tmp_path, crates, deps=(), features=None):
    """crates: name -> {file: text}; deps: (from, to, kind). Writes sources and a metadata document."""
    packages, nodes = [], []
    for name, files in crates.items():
        for file, text in files.items():
            p = tmp_path / name / "src" / file
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
        targets = [{"kind": ["lib"], "name": name, "src_path": str(tmp_path / name / "src/lib.rs")}] if "lib.rs" in files else []
        if "main.rs" in files:
            targets.append({"kind": ["bin"], "name": name, "src_path": str(tmp_path / name / "src/main.rs")})
        packages.append({"name": name, "version": "0.1.0", "id": f"id-{name}", "source": None, "features": (features or {}).get(name, {}), "targets": targets})
    packages += [{"name": "serde", "version": "1.0.0", "id": "id-serde", "source": "registry", "features": {}, "targets": []}]
    for name in [*crates, "serde"]:
        mine = [{"name": b.replace("-", "_"), "pkg": f"id-{b}", "dep_kinds": [{"kind": k}]} for a, b, k in deps if a == name]
        nodes.append({"id": f"id-{name}", "deps": mine})
    doc = tmp_path / "metadata.json"
    doc.write_text(json.dumps({"packages": packages, "workspace_members": [f"id-{c}" for c in crates], "workspace_root": str(tmp_path), "resolve": {"nodes": nodes}}))
    return str(doc), str(tmp_path)


def arcs(graph, kind="module_dep"):
    name = {r["node_id"]: r["qualified_name"] for r in graph.nodes.collect()}
    return {(name[r["src"]], name[r["dst"]]): sorted({s for x in r["locations"] for s in x["symbols"]}) for r in graph.edges.where(f"edge_type = '{kind}'").collect()}


def test_scan():
    text = '''
    // use not::this;
    /* mod nor_this; */
    #[cfg(test)] mod checks;
    #[cfg(not(test))] mod real;
    #[path = "other.rs"] mod moved;
    pub(crate) use crate::a::{self, b::C as D, e::*};
    pub struct S<'a> { x: &'a str }
    const T: &str = "use fake::path;";
    mod inner { use super::x::Y; pub fn f() { let v = Vec::<u8>::new(); let c = 'x'; std::mem::swap(a, b); } }
    macro_rules! m { () => { hidden::path() } }
    fn g() { println!("{}", other::path); raw(r#"use q::r;"#) }
    '''
    rows = scan(text)
    assert [(r["name"], r["is_test"], r["detail"]) for r in rows if r["fact"] == "mod"] == [("checks", True, None), ("real", False, None), ("moved", False, "other.rs")]
    uses = [("::".join(r["segments"]), r["alias"], r["visibility"], r["inline"]) for r in rows if r["fact"] == "use"]
    assert uses == [("crate::a", None, "pub(crate)", []), ("crate::a::b::C", "D", "pub(crate)", []), ("crate::a::e::*", None, "pub(crate)", []), ("super::x::Y", None, "", ["inner"])]
    assert [(r["name"], r["detail"]) for r in rows if r["fact"] == "def"] == [("S", "struct"), ("T", "const"), ("f", "fn"), ("g", "fn")]
    assert ["::".join(r["segments"]) for r in rows if r["fact"] == "path"] == ["Vec::new", "std::mem::swap"]


def test_two_crates(spark, tmp_path):
    doc, root = make(tmp_path, {
        "crate-a": {"lib.rs": "pub mod alpha; mod beta; #[cfg(test)] mod test_utils;", "alpha.rs": "use crate_b::gamma::Gauge;\nuse crate::beta;\nfn f() { beta::run(); }", "beta/mod.rs": "use super::alpha::Alpha; use serde::Serialize;", "test_utils.rs": "use crate::alpha::X;"},
        "crate_b": {"lib.rs": "pub mod gamma;", "gamma.rs": "pub struct Gauge;"},
    }, [("crate-a", "crate_b", None), ("crate-a", "serde", None)])
    g = Workspace(spark, doc, root, WorkspaceOptions(externals=True)).graph()
    assert sorted(r["qualified_name"] for r in g.nodes.collect()) == ["crate-a", "crate-a::alpha", "crate-a::beta", "crate_b", "crate_b::gamma", "serde"]
    got = arcs(g)
    assert got[("crate-a::alpha", "crate_b::gamma")] == ["Gauge"]
    assert got[("crate-a::alpha", "crate-a::beta")] == ["run"]
    assert got[("crate-a::beta", "crate-a::alpha")] == ["Alpha"] and ("crate-a::beta", "serde") in got
    assert set(arcs(g, "crate_dep")) == {("crate-a", "crate_b"), ("crate-a", "serde")}
    (tmp_path / "crate-a/tests/deep").mkdir(parents=True)
    (tmp_path / "crate-a/tests/flow.rs").write_text("use crate_a::alpha::Alpha;")
    (tmp_path / "crate-a/tests/deep/skip.rs").write_text("use crate_a::beta::B;")
    tests = Workspace(spark, doc, root, WorkspaceOptions(include_tests=True)).graph()
    got = arcs(tests)
    assert ("crate-a::test_utils", "crate-a::alpha") in got and ("crate-a::tests::flow", "crate-a::alpha") in got
    assert {r["ctx_sub_kind"] for r in tests.edges.where("ctx_kind = 'test' and edge_type = 'module_dep'").collect()} == {"unit", "integration"}


def test_reexports(spark, tmp_path):
    doc, root = make(tmp_path, {"app": {
        "lib.rs": "pub mod parent; mod sibling; mod glob_user;",
        "parent.rs": "mod child; pub use super::sibling::Panel; pub use child::*;",
        "parent/child.rs": "use super::Panel;\npub struct Kid;",
        "sibling.rs": "pub struct Panel; pub struct Extra; struct Hidden;",
        "glob_user.rs": "use super::sibling::*; use crate::parent::Kid;",
    }})
    got = arcs(Workspace(spark, doc, root).graph())
    assert ("app::parent::child", "app::sibling") in got and ("app::parent::child", "app::parent") not in got
    assert got[("app::glob_user", "app::sibling")] == ["Extra", "Panel"]
    assert got[("app::glob_user", "app::parent::child")] == ["Kid"]


def test_references_of_one_text_are_resolved_once(spark, tmp_path, monkeypatch):
    """Many modules that use the same names: only distinct texts are looked up, and private uses of modules that nobody refers to not at all."""
    seen, plain = [], workspace.absolute
    monkeypatch.setattr(workspace, "absolute", lambda rows, *more: seen.append(rows.count()) or plain(rows, *more))
    mods = [f"m{i}" for i in range(30)]
    doc, root = make(tmp_path, {"app": {
        "lib.rs": "pub mod port; pub mod near;" + "".join(f"mod {m};" for m in mods), "port.rs": "pub struct Port;", "near.rs": "mod port; use port::Other; use self::port::Other as Third; use crate::port::Port;", "near/port.rs": "pub struct Other;",
        **{f"{m}.rs": "use crate::port::Port;\nfn f() { Port::new(); }" for m in mods},
    }})
    got = {(r["module"], r["target_module"], r["item"]) for r in Workspace(spark, doc, root).refs.collect()}
    assert got == {(f"app::{m}", "app::port", "Port") for m in [*mods, "near"]} | {("app::near", "app::near::port", "Other")}
    assert sum(seen) < 10  # before: 33 uses and 30 paths, the uses twice


CYCLIC = {"app": {
    "lib.rs": "mod alpha; mod beta; mod gamma; mod delta;",
    "alpha.rs": "pub use crate::beta::B; pub struct A;", "beta.rs": "pub use crate::alpha::A; pub struct B;",
    "gamma.rs": "use crate::delta::D; pub struct G;", "delta.rs": "use crate::gamma::G; pub struct D;",
}}


def test_check_without_rules_reports_cycles(spark, tmp_path):
    doc, root = make(tmp_path, CYCLIC)
    g = Workspace(spark, doc, root).graph()
    text, code = check(g, None)
    assert code == 1 and "gamma" in text and "alpha" not in text
    text, code = check(g, None, include_reexports=True)
    assert code == 1 and "gamma" in text and "alpha" in text


def test_check_with_rules(spark, tmp_path):
    doc, root = make(tmp_path, {
        "domain": {"lib.rs": "pub mod m;", "m.rs": "use infra::db::Db; use application::svc::Svc;"},
        "application": {"lib.rs": "pub mod svc;", "svc.rs": "use domain::m::M;"},
        "infra": {"lib.rs": "pub mod db;", "db.rs": "pub struct Db;"},
    })
    g = Workspace(spark, doc, root).graph()
    rules = tmp_path / "rules.toml"
    rules.write_text('[config]\nversion = 1\n[[rules]]\ntype = "forbidden-dependency"\nname = "no infra"\nfrom = "domain::**"\nto = "infra::**"\n[[rules]]\ntype = "layers"\nname = "layers"\nlayers = ["domain::**", "application::**", "infra::**"]\nseverity = "warn"\n')
    text, code = check(g, str(rules))
    assert code == 1
    assert "error[forbidden-dependency]: no infra" in text and "domain::m → infra::db" in text
    assert "warning[layers]: layers" in text and "application::svc → domain::m" in text
    assert text.rstrip().endswith("error: 1 error(s), 1 warning(s)")
    (tmp_path / "bad.toml").write_text("[[rules\n")
    assert check(g, str(tmp_path / "bad.toml"))[1] == 2
    assert check(g, str(tmp_path / "none.toml"), explicit=True)[1] == 2


def test_features(spark, tmp_path):
    crates = {n: {"lib.rs": ""} for n in ("core", "web", "server", "tool")}
    doc, root = make(tmp_path, crates, [("web", "core", None), ("server", "core", "dev")], {"web": {"http": []}, "server": {"tcp": []}})
    pick = lambda **o: sorted(r["name"] for r in Workspace(spark, doc, root, WorkspaceOptions(**o)).crates.collect())
    assert pick(features=("http",)) == ["core", "web"]
    assert pick(features=("server/tcp",)) == ["server"]
    assert pick(features=("http",), all_features=True) == sorted(crates)


def test_metadata_without_resolve_fails(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"packages": []}')
    with pytest.raises(ValueError, match="resolve"):
        Workspace(spark, str(tmp_path / "m.json"), str(tmp_path))


def test_a_long_files_facts_go_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: run)  # the function that a task runs
    run = rust_text.facts(spark.createDataFrame([], "crate string, file string, text string"))
    n = 3 * rust_text.BATCH
    texts = ["".join(f"mod c{i};\n" for i in range(n)), "mod a;\n" * rust_text.LONG + "#[path = ]", None]
    parts = list(run([pa.RecordBatch.from_pydict({"crate": [""] * 3, "file": ["long", "bad", "none"], "text": pa.array(texts, pa.string())})]))
    assert max(map(len, parts)) == rust_text.BATCH
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [(r["file"], r["name"], r["line"]) for r in rows if r["fact"] == "mod"] == [("long", f"c{i}", i + 1) for i in range(n)]
    assert [r["file"] for r in rows if r["fact"] != "mod"] == ["bad"]


def test_exports_resolve_no_private_use(spark, tmp_path):
    doc, root = make(tmp_path, {"app": {"lib.rs": "pub mod a; pub use a::T; use a::U;", "a.rs": "pub struct T; pub struct U;"}})
    w = Workspace(spark, doc, root)
    assert [tuple(r) for r in w.exports["reexports"].collect()] == [("app", "T", "app::a", "T")]
    assert set(w.exports) == {"reexports"}
    assert [tuple(r) for r in w.exports["private_uses"].collect()] == [("app", "U", "app::a", "U")]


def test_plain_lines_are_split_in_one_call(monkeypatch):
    asked = []

    class Counted:
        def finditer(self, *a):
            for m in token.finditer(*a):
                asked.append(m.group())
                yield m

    token = rust_text.TOKEN
    monkeypatch.setattr(rust_text, "TOKEN", Counted())
    text = 'use a::b;\nmod r#x; // mod y;\nuse c::{d, e as f};\nconst S: &str = r"\nmod z;\n"; use g::h;\n/* use\n*/ use i;\r\n\tuse é9::9k::j;\n' + "use k;\n" * 50
    found = rust_text.tokens(text)
    words = [w for w, _ in found if w.isalpha()]
    assert words == ["use", "a", "b", "mod", "x", "use", "c", "d", "e", "as", "f", "const", "S", "str", "use", "g", "h", "use", "i", "use", "j"] + ["use", "k"] * 50
    assert [line for w, line in found if w == "use"] == [1, 3, 6, 8, 9, *range(10, 60)]
    assert sum(map(len, asked)) < 90 < len(text)  # before: the whole text
    monkeypatch.setattr(rust_text, "LONG", 16)
    assert rust_text.tokens(text) == found
    plain = []  # what the pattern alone finds
    line = 1
    for m in token.finditer(text):
        if m.lastgroup in ("word", "sign", "str", "raw"):
            plain.append((m.group().removeprefix("r#"), line))
        line += m.group().count("\n")
    assert plain == found


def test_facts_keep_their_columns(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: run)
    run = rust_text.facts(spark.createDataFrame([], "crate string, file string, text string"))
    texts = ["pub use a::self as b;\nmod t { use super::{x::self, y::*}; fn f() { use z; p::q(); } }", "", None, "#[path = ]"]
    rows = pa.Table.from_batches(run([pa.RecordBatch.from_pydict({"crate": ["c", "", None, "d"], "file": list("abcd"), "text": pa.array(texts, pa.string())})])).to_pylist()
    assert [tuple(r[c] for c in ("crate", "file", "fact", "name", "segments", "alias", "line", "visibility", "inline", "detail")) for r in rows] == [
        ("c", "a", "use", None, ["a"], "b", 1, "pub", [], "item"),
        ("c", "a", "use", None, ["super", "x"], None, 2, "", ["t"], "item"), ("c", "a", "use", None, ["super", "y", "*"], None, 2, "", ["t"], "item"),
        ("c", "a", "def", "f", [], None, 2, "", ["t"], "fn"), ("c", "a", "use", None, ["z"], None, 2, "", ["t"], "body"), ("c", "a", "path", None, ["p", "q"], None, 2, "", ["t"], None),
        ("d", "d", "error", None, [], None, None, None, [], "list index out of range"),
    ]
