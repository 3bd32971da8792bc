"""Text, JSON and SVG of results.  Texts hold one line a violation or diagram item, which a reader can take in."""

from __future__ import annotations

import json
from collections import Counter
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation_block() -> Column:
    """The text of one violation, as a column."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    places = F.array_join(F.transform("locations", lambda x: F.concat(F.lit("  --> "), x["file"], F.lit(":"), x["line"].cast("string"), F.lit("\n"))), "")
    return F.concat(level, F.lit("["), "rule_type", F.lit("]: "), "rule_name", F.lit("\n"), places, F.lit("  = "), "message", F.lit("\n"))


def violations_text(found: DataFrame) -> str:
    rows = found.select("ord", "severity", violation_block().alias("text")).orderBy("ord", "text").collect()
    if not rows:
        return ""
    errors = sum(r["severity"] == "error" for r in rows)
    return "".join(r["text"] + "\n" for r in rows) + f"error: {errors} error(s), {len(rows) - errors} warning(s)\n"


def _count(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def clusters_text(report: DataFrame, edges: DataFrame, nodes: DataFrame) -> str:
    """A block for each tangle, a blank line between blocks, and a summary.  ``edges``: those of all tangles in order (``ranked_edges``).

    A single cycle is a ring with its edge of fewest symbols.  Else the edges to remove stand in columns, most cycles first; a closing
    sentence tells that they meet every cycle, unless edges and cycles pair off.  Names leave out the tangle's crate.
    """
    rows = report.orderBy("position").collect()
    if not rows:
        return ""
    ring_nodes = report.where("n_cycles = 1").select("scc_id", F.posexplode("first_cycle").alias("i", "node_id")).join(nodes.select("node_id", "qualified_name"), "node_id").orderBy("scc_id", "i").collect()
    cuts: dict[int, list] = {}
    for e in edges.where("feedback").orderBy("scc_id", "place").collect():
        cuts.setdefault(e["scc_id"], []).append(e)
    blocks = []
    for k, r in enumerate(rows, 1):
        own = f"{r['crate']}::"
        cut = [(e["src_name"].removeprefix(own), e["dst_name"].removeprefix(own), e["cycles"], _count(e["refs"], "symbol")) for e in cuts.get(r["scc_id"], [])]
        lines = [f"cluster {k}/{len(rows)}: {r['crate']} ({_count(r['n_nodes'], 'module')}, {_count(r['n_cycles'], 'cycle')})"]
        if r["n_cycles"] == 1:
            ring = [m["qualified_name"].removeprefix(own) for m in ring_nodes if m["scc_id"] == r["scc_id"]]
            lines.append(f"  cycle: {' -> '.join([*ring, ring[0]])}")
            lines += [f"  fewest symbols: {a} -> {b} ({symbols})" for a, b, _, symbols in cut[:1]]
        else:
            counts = [n for _, _, n, _ in cut]
            wide = [max((len(str(c[i]).encode()) for c in cut), default=0) for i in range(3)]
            lines.append("  edges, most cycles first:" if len(set(counts)) > 1 else "  edges:")
            lines += [f"    {a.ljust(wide[0])} -> {b.ljust(wide[1])} (on {str(n).rjust(wide[2])} {'cycle' if n == 1 else 'cycles'}, {symbols})" for a, b, n, symbols in cut]
            if len(cut) != r["n_cycles"] or set(counts) != {1}:
                lines.append("  every cycle contains " + ("this edge" if len(cut) == 1 else f"at least one of these {len(cut)} edges"))
        blocks.append("".join(line + "\n" for line in lines))
    crates, cycles = len({r["crate"] for r in rows}), sum(r["n_cycles"] for r in rows)
    return "\n".join(blocks) + f"\nSummary: {_count(len(rows), 'cluster')}, {_count(cycles, 'cycle')} across {_count(crates, 'crate')}\n"


def volatility_text(report: DataFrame, months: int) -> str:
    """A head, how many files are of each level, and the files, most changes first."""
    rows = report.collect()
    if not rows:
        return f"No .rs file changes in the last {months} months.\n"
    level = Counter(r["level"] for r in rows)
    head = f"Volatility (last {months} months, {len(rows)} files):\n  High: {level['HIGH']}  Medium: {level['MEDIUM']}  Low: {level['LOW']}\n\n"
    return head + "".join(f"  {r['file']}  {r['changes']}  {r['score']:.2f}  {r['level']}\n" for r in rows)


def diagram_json(items: DataFrame, edges: DataFrame, cycles: DataFrame | None = None, clusters: DataFrame | None = None, ranked: DataFrame | None = None, scopes: DataFrame | None = None) -> str:
    """Nodes and arcs by id; with ``cycles`` (scc_id, cycle_id, path), ``clusters`` (a cluster report, its edges ``ranked``) and ``scopes`` (consumer scopes) also these.

    Fields without a value are left out.  A diagram is read as a whole, so its rows come together here.
    """
    plain = lambda row: {k: v for k, v in row.asDict(True).items() if v not in (None, [], "")}
    nodes = {str(r["node_id"]): plain(r) for r in items.collect()}
    arcs = {f"{r['src']}-{r['dst']}": plain(r) for r in edges.collect()}
    doc = {"nodes": dict(sorted(nodes.items())), "arcs": dict(sorted(arcs.items()))}
    if cycles is not None:
        rows = cycles.orderBy("scc_id", "path").collect()
        doc["cycles"] = {str(r["cycle_id"]): {"scc": r["scc_id"], "nodes": r["path"], "arcs": [f"{a}-{b}" for a, b in zip(r["path"], r["path"][1:] + r["path"][:1], strict=True)]} for r in rows}
    if clusters is not None:
        own: dict[int, list[dict]] = {}
        for r in ranked.orderBy("scc_id", "place").collect() if ranked is not None else []:
            own.setdefault(r["scc_id"], []).append({"arc": f"{r['src']}-{r['dst']}", "cycles": r["cycles"], "refs": r["refs"], "feedback": r["feedback"]})
        doc["clusters"] = [plain(r) | {"edges": own.get(r["scc_id"], [])} for r in clusters.orderBy("position").collect()]
    if scopes is not None:
        doc["symbol_scopes"] = [plain(r) for r in scopes.orderBy("provider", "symbols").collect()]
    return json.dumps(doc, ensure_ascii=False)


def read_diagram(text: str) -> dict:
    """The data of ``diagram_json``, also out of a drawing that carries it."""
    if text.lstrip().startswith("<svg"):
        text = text[text.index("<![CDATA[") + 9 : text.rindex("]]></metadata>")].replace("]]]]><![CDATA[>", "]]>")
    return json.loads(text)


def diagram_svg(items: DataFrame, edges: DataFrame, *tables: DataFrame) -> str:
    """A static drawing: rows of the tree and the arcs beside them, later layers on top; the data as JSON inside."""
    rows, arcs = items.orderBy("position").collect(), edges.orderBy("z", "src", "dst").collect()
    height = max((r["y"] + r["height"] for r in rows), default=0) + 20
    width = max((r["x"] + 7.2 * len(r["name"].encode()) for r in rows), default=0) + 400
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height}">', "<style>path{fill:none;stroke:#777}path.upward{stroke:#c33}path.cyclic{stroke:#c0c}text{font:12px monospace}</style>"]
    out += [f'<text x="{r["x"]}" y="{r["y"] + r["height"] // 2 + 4}" class={quoteattr(r["kind"])}>{escape(r["name"])}</text>' for r in rows]
    out += [f'<path class="{a["direction"]}{" cyclic" if a["cycle_ids"] else ""}" stroke-width="{a["stroke"]:.2f}" d="{a["path"]}"/>' for a in arcs]
    data = diagram_json(items, edges, *tables).replace("]]>", "]]]]><![CDATA[>")
    return "\n".join([*out, f'<metadata><![CDATA[{data}]]></metadata>', "</svg>\n"])
