import datetime
import json

from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators import volatility as vo
from weftgraph.operators.hierarchy import with_paths
from weftgraph.plans.check import cycles_text
from weftgraph.plans.diagram import ViewState, diagram, view, volatility_report
from weftgraph.plans.sinks import read_diagram
from weftgraph.schema import EDGES, PropertyGraph
from weftgraph.streaming.changes import windowed_changes

PATHS = "node_id long, kind string, name string, crate_id long, parent_id long"


def edge(src, dst, n):
    return (src, dst, "module_dep", "production", None, [], [("f.rs", i, [f"S{i}"], "m", False) for i in range(n)])


def graph(spark, edges):
    nodes = [(0, "crate", "app", None, None), (1, "module", "a", 0, 0), (2, "module", "b", 0, 0), (3, "module", "c", 0, 2)]
    return PropertyGraph(with_paths(spark.createDataFrame(nodes, PATHS)).cache(), spark.createDataFrame(edges, EDGES).cache())


def ring_graph(spark, names, weighted):
    nodes = [(0, "crate", "app", None, None)] + [(i, "module", n, 0, 0) for i, n in enumerate(names, 1)]
    edges = [edge(names.index(a) + 1, names.index(b) + 1, n) for a, b, n in weighted]
    return PropertyGraph(with_paths(spark.createDataFrame(nodes, PATHS)).cache(), spark.createDataFrame(edges, EDGES).cache())


def test_cluster_text(spark):
    assert cycles_text(graph(spark, [edge(1, 2, 1), edge(2, 1, 3)])) == (
        "cluster 1/1: app (2 modules, 1 cycle)\n"
        "  cycle: a -> b -> a\n"
        "  fewest symbols: a -> b (1 symbol)\n"
        "\nSummary: 1 cluster, 1 cycle across 1 crate\n"
    )
    assert cycles_text(graph(spark, [edge(1, 2, 1)])) == ""


def test_cluster_text_of_tangles(spark):
    """Blocks by edges to remove: a pair apart, one edge on two cycles, edges of different counts in columns."""
    pair = [("y", "z", 1), ("z", "y", 2)]
    shared = [("p", "qq", 1), ("qq", "r", 1), ("r", "p", 1), ("qq", "s", 1), ("s", "p", 1)]
    tangle = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("b", "d", 1), ("d", "a", 1), ("a", "long", 1), ("long", "a", 2)]
    text = cycles_text(ring_graph(spark, [*"abcd", "long", "p", "qq", "r", "s", "y", "z"], [*tangle, *shared, *pair]))
    assert text == (
        "cluster 1/3: app (2 modules, 1 cycle)\n"
        "  cycle: y -> z -> y\n"
        "  fewest symbols: y -> z (1 symbol)\n"
        "\n"
        "cluster 2/3: app (4 modules, 2 cycles)\n"
        "  edges:\n"
        "    p -> qq (on 2 cycles, 1 symbol)\n"
        "  every cycle contains this edge\n"
        "\n"
        "cluster 3/3: app (5 modules, 3 cycles)\n"
        "  edges, most cycles first:\n"
        "    a -> b    (on 2 cycles, 1 symbol)\n"
        "    a -> long (on 1 cycle, 1 symbol)\n"
        "  every cycle contains at least one of these 2 edges\n"
        "\nSummary: 3 clusters, 6 cycles across 1 crate\n"
    )


def test_cluster_text_of_cycles_that_pair_off(spark):
    text = cycles_text(ring_graph(spark, ["a", "b", "c"], [("a", "b", 1), ("b", "a", 1), ("a", "c", 1), ("c", "a", 1)]))
    assert text == "cluster 1/1: app (3 modules, 2 cycles)\n  edges:\n    a -> b (on 1 cycle, 1 symbol)\n    a -> c (on 1 cycle, 1 symbol)\n\nSummary: 1 cluster, 2 cycles across 1 crate\n"


def test_diagram_and_view(spark):
    g = graph(spark, [edge(1, 2, 1), edge(2, 1, 3), edge(1, 3, 2)])
    data = json.loads(diagram(g, "json"))
    assert set(data["nodes"]) == {"0", "1", "2", "3"} and data["arcs"]["2-1"]["cycle_kind"] == "direct"
    [cycle] = data["cycles"].values()
    assert cycle == {"scc": 1, "nodes": [1, 2], "arcs": ["1-2", "2-1"]}
    [cluster] = data["clusters"]
    assert (cluster["n_nodes"], cluster["n_cycles"], cluster["crate"]) == (2, 1, "app")
    assert cluster["edges"] == [{"arc": "1-2", "cycles": 1, "refs": 1, "feedback": True}, {"arc": "2-1", "cycles": 1, "refs": 3, "feedback": False}]
    assert {(r["provider"], r["scope"]) for r in data["symbol_scopes"]} == {(1, "single_consumer"), (2, "single_consumer"), (3, "single_consumer")}
    svg = diagram(g, expand_level=1)
    assert read_diagram(svg)["cycles"] == data["cycles"]
    assert svg.count("<text") == 3 and svg.count("<path") == 2 and "cyclic" in svg
    arcs = g.edges.select("src", "dst", "edge_type", F.lit(False).alias("reexport"), F.lit(False).alias("cyclic"), F.size("locations").cast("long").alias("usages"), F.lit("downward").alias("direction"))
    nodes, shown, rolled = view(g, arcs, ViewState().toggle(2))
    assert sorted(r[0] for r in nodes.collect()) == [0, 1, 2] and shown.count() == 2
    assert [(r["src"], r["dst"], r["usages"]) for r in rolled.collect()] == [(1, 2, 2)]
    assert ViewState().select(1).select(1).selected is None


def test_clicks_on_arcs_and_rows():
    start = ViewState()
    outside = start.click_arc("1-2")
    assert outside.arc == "1-2" and outside.cluster is None and outside.click_arc("1-2").arc is None
    first = start.hover("3-4").click_arc("3-4", 3)
    assert (first.cluster, first.arc, first.hovered) == (3, None, None)  # the component, as one
    inner = first.click_arc("3-4", 3)
    assert (inner.cluster, inner.arc) == (3, "3-4")
    again = inner.hover("3-4").click_arc("3-4", 3)
    assert (again.cluster, again.arc, again.hovered) == (3, None, None)
    other = inner.hover("3-4").click_arc("7-8", 7)
    assert (other.cluster, other.arc, other.hovered) == (7, None, None)
    away = inner.click_arc("1-2")
    assert (away.cluster, away.arc) == (None, "1-2")
    assert inner.click_empty() == start and inner.select(5).arc is None and inner.select(5).pin("1-2").selected is None
    assert first.click_row("3-4", 3, True, False) == (inner, True)
    assert inner.click_row("3-4", 3, True, False) == (inner, True)  # closed by hand: opens, stays pinned
    assert inner.click_row("3-4", 3, True, True) == (first, False)
    assert inner.click_row("3-4", 3, False, False) == (first, False)


def changes(spark):
    at = datetime.datetime(2024, 5, 1)
    rows = [(at, "a.rs", "M")] * 3 + [(at, "b.rs", "A")] * 11 + [(at, "c.rs", "D"), (datetime.datetime(2020, 1, 1), "c.rs", "M"), (at, "d.rs", "R100")]
    return spark.createDataFrame(rows, "commit_ts timestamp, file string, status string")


def test_volatility(spark):
    now = F.lit(datetime.date(2024, 6, 1))
    text = volatility_report(changes(spark), now=now)
    assert text == "Volatility (last 6 months, 3 files):\n  High: 1  Medium: 1  Low: 1\n\n  b.rs  11  1.00  HIGH\n  a.rs  3  0.27  MEDIUM\n  d.rs  1  0.09  LOW\n"
    none = volatility_report(changes(spark).limit(0), now=now)
    assert none == "No .rs file changes in the last 6 months.\n"
    assert vo.statistics(vo.change_counts(changes(spark).limit(0), now=now)).first().asDict() == dict(files=0, total=0, max=0, min=0, avg=0.0, low=0, medium=0, high=0)


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    changes(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes(spark).schema).parquet(str(tmp_path / "in"))
    q = windowed_changes(stream, late="3000 days").writeStream.outputMode("complete").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["file"], r["changes"], r["level"]) for r in spark.table("changes").collect())
    assert got == sorted((r["file"], r["changes"], r["level"]) for r in windowed_changes(changes(spark)).collect())


def test_columns(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    arr = lambda *xs: F.array(*map(F.lit, xs))
    assert [val(C.volatility_level(F.lit(n))) for n in (0, 2, 3, 10, 11)] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert val(C.resolve_relative(arr("super", "x"), arr("a", "b"))) == ["a", "x"]
    assert val(C.resolve_relative(arr("super", "super", "x"), arr("a", "b"), 1)) == ["a", "x"]
    assert val(C.resolve_relative(arr("super", "super", "super", "x"), arr("a", "b"))) is None
    assert val(C.resolve_relative(arr("self", "x"), arr("a", "b"))) == ["a", "b", "x"]
    assert val(C.elide_cycle(arr("a", "b"))) == "a → b → a"
    assert val(C.elide_cycle(arr("a", "b", "c", "d", "e"))) == "a → b → … → e → a"
    assert val(C.escape_xml(F.lit("<&'"))) == "&lt;&amp;&apos;"
    assert val(C.stroke_width(F.lit(0))) == 0.5 and val(C.stroke_width(F.lit(500))) == 2.5
    assert val(C.is_descendant(F.lit("a::b"), F.lit("a"))) and not val(C.is_descendant(F.lit("ab"), F.lit("a")))
    assert val(C.item_at(arr("a", " {"), F.lit(1))) is None
