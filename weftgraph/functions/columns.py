"""Scalar functions on names, paths, kinds and diagram geometry, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schema import CRATE_DEP, MODULE_DEP, PRODUCTION, TEST

# names and paths


def normalize_crate_name(c: Column) -> Column:
    return F.translate(c, "-", "_")


def join_path(*parts: Column) -> Column:
    """The non-empty parts, with ``::`` between."""
    return F.concat_ws("::", *[F.nullif(p, F.lit("")) for p in parts])


def is_descendant(path: Column, of: Column) -> Column:
    """Equal or below; the empty path is above all."""
    return (of == "") | (path == of) | path.startswith(F.concat(of, F.lit("::")))


def item_at(parts: Column, index: Column) -> Column:
    """The part at a 0-based index without ``{`` and ``;``; null when blank or absent."""
    return F.nullif(F.trim(F.regexp_replace(F.get(parts, index), "[{;]", "")), F.lit(""))


def resolve_relative(parts: Column, base: Column, inline_depth: Column | int = 0) -> Column:
    """Segments of a path that begins with ``super`` or ``self``, seen from module ``base``; null if it leads above the root.

    ``inline_depth``: modules written inside the file, which leading ``super`` leave first.
    """
    depth = F.lit(inline_depth) if isinstance(inline_depth, int) else inline_depth
    supers = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: F.coalesce(F.get(parts, i) != "super", F.lit(True)))), F.lit(0))
    starts_self = F.get(parts, F.lit(0)) == "self"
    up = supers - depth
    rest = F.slice(parts, supers + 1, F.size(parts))
    return (
        F.when(starts_self & (depth == 0), F.concat(base, F.slice(parts, F.lit(2), F.size(parts))))
        .when((supers > 0) & (up > 0) & (up <= F.size(base)), F.concat(F.slice(base, F.lit(1), F.size(base) - up), rest))
    )


def strip_crate(name: Column) -> Column:
    return F.regexp_replace(name, "^crate::", "")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))


def node_label(name: Column, version: Column) -> Column:
    return F.when(F.coalesce(version, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" v"), version))


def scope_label(scope: Column, node: Column, n: Column) -> Column:
    return F.when(scope == "single_consumer", F.concat(F.lit("only used by "), node)).when(scope == "common_ancestor", F.concat(F.lit("used under "), node)).otherwise(F.concat(F.lit("widely used ("), plural(n, "module"), F.lit(")")))


def elide_cycle(labels: Column) -> Column:
    """A closed cycle's label: all of up to four members, else its two first and its last; one less if that is long."""
    n = F.size(labels)
    arrow = " → "
    head, second, tail = F.get(labels, F.lit(0)), F.get(labels, F.lit(1)), F.get(labels, n - 1)
    whole = F.array_join(F.concat(labels, F.array(head)), arrow)
    long = F.concat_ws(arrow, head, second, F.lit("…"), tail, head)
    return F.when(n <= 4, whole).when(F.length(long) <= 48, long).otherwise(F.concat_ws(arrow, head, F.lit("…"), tail, head))


def escape_xml(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


# edges


def is_production_module_dep() -> Column:
    return (F.col("edge_type") == MODULE_DEP) & (F.col("ctx_kind") == PRODUCTION)


def is_production_crate_dep() -> Column:
    return (F.col("edge_type") == CRATE_DEP) & (F.col("ctx_kind") == PRODUCTION)


def is_test_crate_dep() -> Column:
    return (F.col("edge_type") == CRATE_DEP) & (F.col("ctx_kind") == TEST)


def is_pure_reexport() -> Column:
    """A production module dependency all of whose locations (one at least) are re-exports."""
    return is_production_module_dep() & (F.size("locations") > 0) & F.forall("locations", lambda x: x["via_reexport"])


def symbol_weight(locations: Column) -> Column:
    """Distinct symbols, and one more if some location names none."""
    unnamed = F.exists(locations, lambda x: F.size(x["symbols"]) == 0)
    return F.size(F.array_distinct(F.flatten(F.transform(locations, lambda x: x["symbols"])))) + F.coalesce(unnamed, F.lit(False)).cast("int")


def z_order(ctx_kind: Column, cyclic: Column, downward: Column) -> Column:
    return F.when(ctx_kind != PRODUCTION, 0).when(cyclic, 3).when(downward, 1).otherwise(2)


# volatility


def volatility_level(count: Column, low: int = 2, high: int = 10) -> Column:
    return F.when(count <= low, "LOW").when(count <= high, "MEDIUM").otherwise("HIGH")


# geometry (fixed values of the diagram)

CHAR_WIDTH, ROW_HEIGHT, MARGIN, INDENT, TOOLBAR = 7.2, 30, 20, 20, 40
MIN_STROKE, STROKE_RANGE, MOST_LOCATIONS = 0.5, 2.0, 50
ARC_BASE, ARC_STEP = 20, 15
ARROW_LENGTH, ARROW_HALF_WIDTH, BASE_STROKE = 8, 4, 1.5
HIGHLIGHT_SCALE, SHADOW_MULTIPLIER = 1.3, 4


def text_width(c: Column, per_char: float = CHAR_WIDTH) -> Column:
    return F.octet_length(c) * per_char


def stroke_width(n: Column) -> Column:
    inner = F.least(n, F.lit(MOST_LOCATIONS)).cast("double")
    return F.when(n <= 0, MIN_STROKE).otherwise(MIN_STROKE + STROKE_RANGE * F.ln(inner) / math.log(MOST_LOCATIONS))


def arc_offset(y1: Column, y2: Column) -> Column:
    return ARC_BASE + ARC_STEP * F.greatest(F.lit(1), F.round(F.abs(y2 - y1) / ROW_HEIGHT)).cast("int")


def arc_path(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Two quadratic curves that meet at the outermost point."""
    far, mid = F.greatest(x1, x2) + arc_offset(y1, y2), (y1 + y2) / 2
    return F.format_string("M %.1f,%.1f Q %.1f,%.1f %.1f,%.1f Q %.1f,%.1f %.1f,%.1f", *[v.cast("double") for v in (x1, y1, far, y1, far, mid, far, y2, x2, y2)])


def arc_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Estimate: the chords through the control points' halves."""
    far = F.greatest(x1, x2) + arc_offset(y1, y2)
    half = F.abs(y2 - y1) / 2
    return F.sqrt((far - x1) ** 2 + half**2) + F.sqrt((far - x2) ** 2 + half**2)


def arrow_scale(stroke: Column) -> Column:
    return stroke / BASE_STROKE


def arrow_points(x: Column, y: Column, scale: Column) -> Column:
    """Polygon of an arrow head that points left, its tip at (x, y)."""
    length, half = ARROW_LENGTH * scale, ARROW_HALF_WIDTH * scale
    return F.format_string("%.1f,%.1f %.1f,%.1f %.1f,%.1f", *[v.cast("double") for v in (x + length, y - half, x, y, x + length, y + half)])


def arrow_tip(points: Column) -> Column:
    """(x, y) of a polygon's tip, its second point; null if there is none or it is no pair of numbers."""
    pair = F.split(F.get(F.split(points, " "), F.lit(1)), ",")
    x, y = (F.get(pair, F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def highlight_width(stroke: Column) -> Column:
    return stroke * HIGHLIGHT_SCALE


def shadow(stroke: Column, length: Column) -> Column:
    """(width, overhang, visible, offset) of an arc's shadow: wider than the arc, shortened at both ends by what it is wider."""
    width = stroke * SHADOW_MULTIPLIER
    overhang = (width - stroke) / 2
    return F.struct(width.alias("width"), overhang.alias("overhang"), F.greatest(F.lit(0.0), length - overhang * 2).alias("visible"), (-overhang).alias("offset"))


def qualified_parts(path: Column, kind: Column) -> Column:
    """(crate, path) of a node by its names from the root on: inside a crate the path is relative to it; a crate's own is its name."""
    inside = (F.size(path) > 1) & (kind != "crate")
    return F.struct(F.when(inside, F.get(path, F.lit(0))).alias("crate"), F.array_join(F.when(inside, F.slice(path, F.lit(2), F.size(path))).otherwise(path), "::").alias("path"))


def hierarchy_direction(src: Column, dst: Column, ancestors: Column) -> Column:
    """Of an arc whose ends' places don't matter: upward to the node itself or one that holds it, else downward; ``ancestors`` of ``src``."""
    return F.when((src == dst) | F.array_contains(ancestors, dst), "upward").otherwise("downward")
