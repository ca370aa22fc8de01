"""Plane geometry as Column expressions.

A point is a struct<x, y>, a segment a struct<a, b> of two points, an entity a struct with the fields of schema.ENTITY.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from conformix.schema import CIRCLE_VERTICES

EPS = 1e-9


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def lit(v: float) -> Column:
    return F.lit(float(v))


def orient(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def dist(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def tol(*pts: Column) -> Column:
    return lit(EPS) * F.greatest(lit(1), *[F.abs(p[c] - pts[0][c]) for p in pts for c in ("x", "y")])


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    l2 = dx * dx + dy * dy
    t = F.least(lit(1), F.greatest(lit(0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(l2 > 0, l2)))
    return F.when(l2 > 0, point(a["x"] + t * dx, a["y"] + t * dy)).otherwise(point(a["x"], a["y"]))


def point_segment_distance(p: Column, a: Column, b: Column) -> Column:
    return dist(p, closest_on_segment(p, a, b))


def _on(a: Column, b: Column, p: Column, t: Column) -> Column:
    return (p["x"] >= F.least(a["x"], b["x"]) - t) & (p["x"] <= F.greatest(a["x"], b["x"]) + t) & (p["y"] >= F.least(a["y"], b["y"]) - t) & (p["y"] <= F.greatest(a["y"], b["y"]) + t)


def segments_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Touching counts; orientations are compared with a tolerance that grows with coordinates and lengths."""
    t = tol(a, b, c, d)
    wide = t * F.greatest(lit(1), dist(a, b), dist(c, d))
    o1, o2, o3, o4 = orient(a, b, c), orient(a, b, d), orient(c, d, a), orient(c, d, b)

    def across(o, p):
        return ((o > wide) & (p < -wide)) | ((o < -wide) & (p > wide))

    touch = ((F.abs(o1) <= wide) & _on(a, b, c, t)) | ((F.abs(o2) <= wide) & _on(a, b, d, t)) | ((F.abs(o3) <= wide) & _on(c, d, a, t)) | ((F.abs(o4) <= wide) & _on(c, d, b, t))
    return (across(o1, o2) & across(o3, o4)) | touch


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    den = rx * sy - ry * sx
    t = ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / F.when(F.abs(den) >= 1e-15, den)
    return F.when(t.isNotNull(), point(a["x"] + t * rx, a["y"] + t * ry))




def shared_point(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A point of two segments that touch: where their lines meet; of parallel ones the first of c, d, a, b that lies on the other segment, else a."""
    near = tol(a, b, c, d) * 10
    on = lambda p, u, v: F.when(point_segment_distance(p, u, v) <= near, p)
    return F.coalesce(line_intersection(a, b, c, d), on(c, a, b), on(d, a, b), on(a, c, d), on(b, c, d), a)


def polygon_edges(poly: Column) -> Column:
    """Consecutive vertices and the closing edge."""
    return F.zip_with(poly, F.concat(F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def point_in_polygon(p: Column, poly: Column) -> Column:
    """The boundary is inside; otherwise the parity of crossings of a ray to the right."""
    edges = polygon_edges(poly)
    rim = F.exists(edges, lambda e: point_segment_distance(p, e["a"], e["b"]) <= tol(p, e["a"], e["b"]) * 10)

    def crosses(e):
        a, b = e["b"], e["a"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
    return (F.size(poly) >= 3) & (rim | odd)




def bbox_distance(a: Column, b: Column) -> Column:
    dx = F.greatest(lit(0), F.greatest(a["minx"], b["minx"]) - F.least(a["maxx"], b["maxx"]))
    dy = F.greatest(lit(0), F.greatest(a["miny"], b["miny"]) - F.least(a["maxy"], b["maxy"]))
    return F.hypot(dx, dy)


def bbox_reach(a: Column, b: Column) -> Column:
    """No two points of entities in these boxes are farther apart."""
    return F.hypot(F.greatest(a["maxx"], b["maxx"]) - F.least(a["minx"], b["minx"]), F.greatest(a["maxy"], b["maxy"]) - F.least(a["miny"], b["miny"]))


def line_to_circle(s: Column, t: Column) -> Column:
    """Distance of an open two-point line and a circle, either way round, where the line stays outside the circle; null for all else."""

    def one(line: Column, ring: Column) -> Column:
        a, b, c = F.get(line["points"], F.lit(0)), F.get(line["points"], F.lit(1)), point(ring["cx"], ring["cy"])
        d = dist(c, closest_on_segment(c, a, b)) - ring["radius"]
        plain = (line["kind"] == "polyline") & (F.size(line["points"]) == 2) & ~F.coalesce(line["closed"], F.lit(False)) & (ring["kind"] == "circle")
        return F.when(plain & (d >= 0), d)

    return F.coalesce(one(s, t), one(t, s))


def bbox_overlaps(a: Column, b: Column, by=0.0) -> Column:
    return (a["minx"] - by <= b["maxx"]) & (b["minx"] <= a["maxx"] + by) & (a["miny"] - by <= b["maxy"]) & (b["miny"] <= a["maxy"] + by)


def center(e: Column) -> Column:
    return point((e["minx"] + e["maxx"]) / 2, (e["miny"] + e["maxy"]) / 2)


def midpoint(p: Column, q: Column) -> Column:
    return point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)


def circle_polygon(e: Column) -> Column:
    step = 2 * math.pi
    return F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_VERTICES - 1)), lambda i: point(e["cx"] + e["radius"] * F.cos(lit(step) * i / lit(CIRCLE_VERTICES)), e["cy"] + e["radius"] * F.sin(lit(step) * i / lit(CIRCLE_VERTICES))))


def vertices(e: Column) -> Column:
    return F.when(e["kind"] == "polyline", e["points"]).when(e["kind"] == "circle", circle_polygon(e)).otherwise(F.array(point(e["cx"], e["cy"])))


def is_closed(e: Column) -> Column:
    return (e["kind"] == "circle") | F.coalesce(e["closed"], F.lit(False))


def segments_of(points: Column, closed: Column) -> Column:
    """Consecutive pairs, the closing edge of a closed shape, and a degenerate one for a single point."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    chain = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    differs = (first["x"] != last["x"]) | (first["y"] != last["y"])
    closing = F.when(closed & (F.size(points) > 2) & differs, F.array(F.struct(last.alias("a"), first.alias("b")))).otherwise(F.slice(chain, 1, 0))
    return F.when(F.size(points) == 1, F.array(F.struct(first.alias("a"), first.alias("b")))).otherwise(F.concat(chain, closing))


def segments(e: Column) -> Column:
    return segments_of(vertices(e), is_closed(e))


def length(e: Column) -> Column:
    path = F.aggregate(segments_of(e["points"], F.coalesce(e["closed"], F.lit(False))), lit(0), lambda acc, s: acc + dist(s["a"], s["b"]))
    return F.when(e["kind"] == "circle", lit(2 * math.pi) * e["radius"]).when(e["kind"] == "text", lit(0)).otherwise(path)


def segment_angle(s: Column) -> Column:
    """Direction in [0, 180)."""
    angle = F.pmod(F.degrees(F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"])), lit(180))
    return F.when(F.abs(angle - 180) < 1e-9, lit(0)).otherwise(angle)


def off_axis(angle: Column) -> Column:
    m = F.pmod(angle, lit(90))
    return F.least(m, lit(90) - m)


def principal_angle(e: Column) -> Column:
    """Direction of the longest segment, the first on a tie; none for circles and points."""
    # each step's value is worked out once: what names an expression works it out anew
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    segs = F.filter(segments_of(e["points"], F.coalesce(e["closed"], F.lit(False))), lambda s: (s["a"]["x"] != s["b"]["x"]) | (s["a"]["y"] != s["b"]["y"]))
    longest = let(segs, lambda g: F.aggregate(g, F.get(g, F.lit(0)), lambda best, s: F.when(dist(s["a"], s["b"]) > dist(best["a"], best["b"]), s).otherwise(best)))
    return F.when(e["kind"] == "polyline", let(longest, segment_angle))


def max_off_axis(e: Column) -> Column:
    segs = F.filter(segments_of(e["points"], F.coalesce(e["closed"], F.lit(False))), lambda s: dist(s["a"], s["b"]) > 1e-9)
    return F.when((e["kind"] == "polyline") & (F.size(segs) > 0), F.array_max(F.transform(segs, lambda s: off_axis(segment_angle(s)))))








def z_interval(e: Column) -> Column:
    return F.when(F.coalesce(e["z_known"], F.lit(False)), F.struct(F.coalesce(e["z_min"], lit(0)).alias("lo"), (F.coalesce(e["z_max"], lit(0)) + F.coalesce(e["height"], lit(0))).alias("hi")))


def text_box(x: Column, y: Column, text: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    h = F.when(F.abs(height) == 0, lit(1)).otherwise(F.abs(height))
    return x, y, x + F.greatest(F.length(text), F.lit(1)) * h * lit(0.6), y + h


def with_bbox(df):
    """minx, miny, maxx, maxy of polylines, circles (exact) and texts."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    kind, r = F.col("kind"), F.col("radius")
    box = text_box(F.col("cx"), F.col("cy"), F.col("text"), F.col("text_height"))
    low = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
    round_ = [F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r]
    return df.withColumns({n: F.when(kind == "polyline", a).when(kind == "circle", b).otherwise(c) for n, a, b, c in zip(("minx", "miny", "maxx", "maxy"), low, round_, box)})
