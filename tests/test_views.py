import pytest
from pyspark.sql import functions as F
from test_sinks import PATHS, edge
from test_workspace import CYCLIC, make

from weftgraph.__main__ import run
from weftgraph.functions import columns as C
from weftgraph.operators import layout, lookup, order, views
from weftgraph.operators.hierarchy import visible_by_flag, with_paths
from weftgraph.plans.sinks import diagram_json, read_diagram
from weftgraph.schema import EDGES
from weftgraph.sources.history import HistoryNotFound, change_log
from weftgraph.sources.workspace import Workspace


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(0, "crate", "app", None, None), (1, "module", "net", 0, 0), (2, "module", "tcp", 0, 1), (3, "module", "udp", 0, 1), (4, "module", "ui", 0, 0), (5, "crate", "util", None, None), (6, "module", "net", 5, 5)]
    return with_paths(spark.createDataFrame(rows, PATHS)).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([edge(2, 3, 2), edge(4, 1, 1), edge(4, 2, 3), edge(6, 2, 1)], EDGES).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_arrows_and_shadows(spark):
    points = one(spark, C.arrow_points(F.lit(10.0), F.lit(20.0), F.lit(1.0)))
    assert points == "18.0,16.0 10.0,20.0 18.0,24.0"
    assert tuple(one(spark, C.arrow_tip(F.lit(points)))) == (10.0, 20.0)
    assert one(spark, C.arrow_tip(F.lit("1,2"))) is None and one(spark, C.arrow_tip(F.lit("1,2 a,b 3,4"))) is None
    assert one(spark, C.arrow_scale(F.lit(3.0))) == 2.0 and one(spark, C.highlight_width(F.lit(2.0))) == 2.6
    assert tuple(one(spark, C.shadow(F.lit(2.0), F.lit(100.0)))) == (8.0, 3.0, 94.0, -3.0)
    assert one(spark, C.shadow(F.lit(2.0), F.lit(5.0)))["visible"] == 0


def test_qualified_parts(nodes):
    got = {r["node_id"]: tuple(r["x"]) for r in nodes.select("node_id", C.qualified_parts(F.col("path"), F.col("kind")).alias("x")).collect()}
    assert got[0] == (None, "app") and got[2] == ("app", "net::tcp") and got[6] == ("util", "net")


def test_search_marks_matches_and_what_hides_them(nodes, edges):
    visible = visible_by_flag(nodes.withColumn("collapsed", F.col("node_id") == 1))
    found = {r["node_id"]: r["match"] for r in views.search(nodes, edges, visible, "TCP").collect()}
    assert found == {1: "inside"}
    assert {r["node_id"]: r["match"] for r in views.search(nodes, edges, visible, "s2", "symbol").collect()} == {4: "direct", 1: "inside"}
    assert {r["node_id"] for r in views.search(nodes, edges, visible, "net", "module").collect()} == {1, 6}
    assert views.search(nodes, edges, visible, "  ").count() == 0
    arcs = views.touching_arcs(edges, nodes.where("node_id = 6").select("node_id")).collect()
    assert [(r["src"], r["dst"]) for r in arcs] == [(6, 2)]


def test_pinned_group(nodes, edges):
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(views.pinned_group(edges, nodes, 1)) == [1] and ids(views.pinned_group(edges, nodes, 0)) == [0]
    linked = edges.union(edges.sparkSession.createDataFrame([edge(1, 2, 1)], EDGES))
    assert ids(views.pinned_group(linked, nodes, 1)) == [1, 2, 3]


def test_panels(nodes, edges):
    groups = views.edge_panel(edges, 4, 2)
    assert [(r["symbol"], r["n"]) for r in groups.collect()] == [("S0", 1), ("S1", 1), ("S2", 1)]
    assert tuple(views.panel_totals(groups).first()) == (3, 3)
    both = views.merged_groups(groups.unionByName(views.edge_panel(edges, 2, 3)))
    assert {r["symbol"]: len(r["locations"]) for r in both.collect()} == {"S0": 1, "S1": 1, "S2": 1}
    rows = views.node_panel(edges, nodes, 2).collect()
    assert [(r["direction"], r["other"], r["weight"]) for r in rows] == [("in", 4, 3), ("in", 6, 1), ("out", 3, 2)]
    assert {(r["direction"], r["other"], r["symbol"]) for r in views.node_usage(edges, 2).collect()} == {("in", 4, "S0"), ("in", 4, "S1"), ("in", 4, "S2"), ("in", 6, "S0"), ("out", 3, "S0"), ("out", 3, "S1")}


def test_cluster_panel(spark):
    names = spark.createDataFrame([(0, 1, "app::net::tcp"), (0, 2, "app::web::tcp"), (0, 3, "app::ui")], "scc_id long, node_id long, qualified_name string")
    labels = views.short_labels(names)
    assert {r["node_id"]: r["label"] for r in labels.collect()} == {1: "net::tcp", 2: "web::tcp", 3: "ui"}
    blocks = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [1, 2, 3])], "scc_id long, block int, path array<long>")
    weights = spark.createDataFrame([(1, 2, 5), (2, 1, 1), (2, 3, 2), (3, 1, 4)], "src long, dst long, refs long")
    rows = sorted((r["block"], r["i"], r["src"], r["dst"], r["refs"], r["repeated"], r["closing"]) for r in views.cluster_panel(blocks, labels, weights).collect())
    assert rows == [(0, 0, 1, 2, 5, False, False), (0, 1, 2, 1, 1, False, True), (1, 0, 1, 2, 5, True, False), (1, 1, 2, 3, 2, False, False), (1, 2, 3, 1, 4, False, True)]


def test_lookup_in_tiers(spark):
    rows = spark.createDataFrame([(1, "x-y"), (2, "z"), (3, "none")], "id long, key string")
    first = spark.createDataFrame([("z", 8), ("z", 7)], "name string, a long")
    then = spark.createDataFrame([("x_y", 5), ("z", 6)], "name string, b long")
    steps = [(F.col("key"), first, "a"), (C.normalize_crate_name(F.col("key")), then, "b")]
    assert {r["id"]: r["node_id"] for r in lookup.cascade(rows, "key", steps).collect()} == {1: 5, 2: 7, 3: None}
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id long, answer string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "id long, answer string")
    assert {r["id"]: r["answer"] for r in lookup.first_tier([a, b], ["id"]).collect()} == {1: "a", 2: "a", 3: "b"}


def test_canvas(spark):
    items = spark.createDataFrame([("ab", 20, 60, 24), ("abcd", 40, 90, 20)], "name string, x int, y int, height int")
    r = layout.canvas(items).first()
    assert (round(r["label"], 1), round(r["width"], 1), r["height"]) == (28.8, 68.8, 110)


def test_diagram_data_reads_back(spark):
    items = spark.createDataFrame([(1, "a]]>b", None)], "node_id long, name string, version string")
    arcs = spark.createDataFrame([(1, 2, "x")], "src long, dst long, kind string")
    cycles = spark.createDataFrame([(1, 77, [1, 2])], "scc_id long, cycle_id long, path array<long>")
    text = diagram_json(items, arcs, cycles)
    doc = read_diagram(text)
    assert doc["nodes"] == {"1": {"node_id": 1, "name": "a]]>b"}} and doc["cycles"]["77"]["arcs"] == ["1-2", "2-1"]
    svg = "<svg><metadata><![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]></metadata></svg>"
    assert read_diagram(svg) == doc


def test_change_log(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("\x1e2026-01-02T10:00:00+00:00\n\nM\tsrc/a.rs\nA\tREADME.md\nR090\tsrc/old.rs\tsrc/new.RS\n\x1e2026-01-03T10:00:00+00:00\nD\tsrc/a.rs\nbroken\n\n")
    rows = sorted((str(r["commit_ts"].date()), r["file"], r["status"]) for r in change_log(spark, str(path)).collect())
    assert rows == [("2026-01-02", "src/a.rs", "M"), ("2026-01-02", "src/new.RS", "R090"), ("2026-01-03", "src/a.rs", "D")]
    (tmp_path / "empty").write_text("")
    assert change_log(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(HistoryNotFound):
        change_log(spark, str(tmp_path / "none"))


def test_command_line(spark, tmp_path):
    doc, root = make(tmp_path, CYCLIC)
    log = tmp_path / "log"
    log.write_text("\x1e2099-01-02T10:00:00+00:00\n" + "".join(f"M\tapp/src/{n}.rs\n" for n in ["alpha"] * 3 + ["beta"]))
    base = ["--metadata", doc, "--sources", root]
    text, code = run(spark, [*base, "check"])
    assert code == 1 and "gamma" in text and "alpha" not in text
    assert run(spark, [*base, "--include-reexports", "--check"])[1] == 1
    assert run(spark, [*base, "check", "--rules", str(tmp_path / "none.toml")])[1] == 2
    text, code = run(spark, [*base, "--history", str(log), "--json"])
    levels = {n["name"]: (n["changes"], n["level"]) for n in read_diagram(text)["nodes"].values() if "level" in n}
    assert code == 0 and levels["alpha"] == (3, "MEDIUM") and levels["beta"] == (1, "LOW") and levels["gamma"] == (0, "LOW")
    text, code = run(spark, ["--volatility", "--history", str(log)])
    assert code == 0 and "app/src/alpha.rs  3" in text
    assert run(spark, ["--volatility", "--history", str(tmp_path / "none")])[1] == 1


def test_a_module_that_includes_itself_is_read_once(spark, tmp_path):
    doc, root = make(tmp_path, {"app": {"lib.rs": "mod a;", "a.rs": '#[path = "a.rs"] mod again; pub struct A;'}})
    assert sorted(r["module"] for r in Workspace(spark, doc, root).tree.collect()) == ["app", "app::a"]


def test_external_order(spark):
    rows = spark.createDataFrame([(1, "external", "serde"), (2, "external", "anyhow"), (3, "external", "tokio"), (9, "module", "m")], "node_id long, kind string, name string")
    links = spark.createDataFrame([edge(9, 3, 1), edge(8, 3, 1), edge(9, 1, 1)], EDGES)
    assert [r["node_id"] for r in order.external_order(rows, links).orderBy("position").collect()] == [3, 1, 2]
