"""Plane geometry as column expressions with the shapes as literals, so that all of it stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.sources.scene import Points


def _edges(points: Points, closed: bool) -> list[tuple[float, float, float, float]]:
    pairs = zip([points[-1], *points[:-1]], points, strict=True) if closed else zip(points[:-1], points[1:], strict=True)
    return [(*a, *b) for a, b in pairs]


def _nearest(x: Column, y: Column, edge: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """The point of a segment that is nearest to x, y."""
    ax, ay, bx, by = edge
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    if square == 0:
        return F.lit(ax), F.lit(ay)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square))
    return F.lit(ax) + u * dx, F.lit(ay) + u * dy


def _square(x: Column, y: Column, q: tuple[Column, Column]) -> Column:
    return (x - q[0]) * (x - q[0]) + (y - q[1]) * (y - q[1])


def inside(x: Column, y: Column, polygon: Points, margin: float = 0.0) -> Column:
    """Even-odd membership of a point, or with a margin also a distance of that much at most to the outline.

    A polygon of less than three points holds nothing.
    """
    if len(polygon) < 3:
        return F.lit(False)
    xs, ys = zip(*polygon, strict=True)
    near = x.between(min(xs) - margin, max(xs) + margin) & y.between(min(ys) - margin, max(ys) + margin)
    edges = _edges(polygon, closed=True)
    crossed = [((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay + 1e-12) + ax) for ax, ay, bx, by in edges]
    odd = reduce(lambda a, b: a != b, crossed)
    return near & (odd if margin <= 0 else odd | _close(x, y, edges, margin))


def _close(x: Column, y: Column, edges: list[tuple[float, float, float, float]], margin: float) -> Column:
    """Whether the point lies at most margin from one of the segments.

    Few points come to this test, as those outside the polygon's box and those inside the polygon don't. So it goes over an array of
    segments, with little code: all segments spelled out make a method too long to be compiled.
    """
    items = ", ".join(f"named_struct('ax', {ax!r}D, 'ay', {ay!r}D, 'dx', {bx - ax!r}D, 'dy', {by - ay!r}D, 'square', {(bx - ax) ** 2 + (by - ay) ** 2!r}D)" for ax, ay, bx, by in (map(float, e) for e in edges))

    def near(e):
        along = ((x - e["ax"]) * e["dx"] + (y - e["ay"]) * e["dy"]) / F.when(e["square"] > 0, e["square"]).otherwise(1.0)
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        qx, qy = e["ax"] + u * e["dx"], e["ay"] + u * e["dy"]
        return (x - qx) * (x - qx) + (y - qy) * (y - qy) <= margin * margin

    return F.exists(F.expr(f"array({items})"), near)


def first_of(x: Column, y: Column, shapes: dict[str, Points], margin: float = 0.0) -> Column:
    """The first shape, in order, that holds the point; null if none does."""
    return F.coalesce(*(F.when(inside(x, y, p, margin), F.lit(name)) for name, p in shapes.items())) if shapes else F.lit(None).cast("string")


def _closest(x: Column, y: Column, line: Points, values) -> Column:
    """values(edge, q) of the line's segment nearest to the point; of equally near ones, the first."""
    best = None
    for i, edge in enumerate(_edges(line, closed=False)):
        q = _nearest(x, y, edge)
        item = F.struct(_square(x, y, q).alias("d"), F.lit(i).alias("i"), *(v.alias(f"v{k}") for k, v in enumerate(values(edge, q))))
        best = item if best is None else F.least(best, item)
    return best


def signed_along(x: Column, y: Column, line: Points, direction: tuple[float, float]) -> Column:
    """How far the point lies beyond the line, measured from its nearest point along a direction."""
    norm = max((direction[0] ** 2 + direction[1] ** 2) ** 0.5, 1e-9)
    best = _closest(x, y, line, lambda edge, q: ((x - q[0]) * (direction[0] / norm) + (y - q[1]) * (direction[1] / norm),))
    return best["v0"] if len(line) > 1 else F.lit(None).cast("double")


def signed_side(x: Column, y: Column, line: Points) -> Column:
    """The distance to the line, negative on the left of its nearest segment's direction (y grows downwards)."""
    best = _closest(x, y, line, lambda e, q: (F.lit(e[2] - e[0]) * (y - q[1]) - F.lit(e[3] - e[1]) * (x - q[0]),))
    return F.signum(best["v0"]) * F.sqrt(best["d"]) if len(line) > 1 else F.lit(None).cast("double")


def side_and_distance(x: Column, y: Column, line: Points) -> Column:
    """A struct of the perpendicular offset from the nearest segment's line (side) and the distance to the segment."""
    solid = [p for i, p in enumerate(line) if not i or p != line[i - 1]]

    def offset(e, q):
        length = ((e[2] - e[0]) ** 2 + (e[3] - e[1]) ** 2) ** 0.5
        return ((F.lit(e[2] - e[0]) * (y - e[1]) - F.lit(e[3] - e[1]) * (x - e[0])) / length,)

    best = _closest(x, y, solid, offset)
    return F.struct(best["v0"].alias("side"), F.sqrt(best["d"]).alias("distance"))


def line_side(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    return F.signum(F.lit(b[0] - a[0]) * (y - a[1]) - F.lit(b[1] - a[1]) * (x - a[0]))


def homography(x: Column, y: Column, h: list[float]) -> Column:
    """The point under a 3 x 3 projective map, row by row."""
    w = F.lit(h[6]) * x + F.lit(h[7]) * y + F.lit(h[8])
    return F.struct(((F.lit(h[0]) * x + F.lit(h[1]) * y + F.lit(h[2])) / w).alias("x"), ((F.lit(h[3]) * x + F.lit(h[4]) * y + F.lit(h[5])) / w).alias("y"))


def homography_shift(x: Column, y: Column, h: list[float]) -> Column:
    """How far a 3 x 3 projective map moves the point."""
    to = homography(x, y, h)
    return F.hypot(to["x"] - x, to["y"] - y)


def box_overlap(a: str, b: str) -> Column:
    """Overlap of two boxes as a share of the smaller one, areas being 1 at least; a and b prefix their columns."""
    c = lambda p, n: F.col(f"{p}{n}")
    wide = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    high = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: F.greatest(F.lit(1.0), (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1")))
    return wide * high / F.least(area(a), area(b))


def far_lane(x: Column, y: Column, dashed: dict[str, Points], direction: tuple[float, float]) -> Column:
    """far_through_k by how many of three lane boundaries lie below the point, across the direction; else null."""
    levels = []
    for name, pts in dashed.items():
        if name.startswith("far_lane_") and pts:
            v = sorted(direction[0] * py - direction[1] * px for px, py in pts)
            n = len(v)
            levels.append((v[(n - 1) // 2] + v[n // 2]) / 2)
    if len(levels) != 3:
        return F.lit(None).cast("string")
    lateral = F.lit(direction[0]) * y - F.lit(direction[1]) * x
    below = sum(F.when(lateral > level, 1).otherwise(0) for level in sorted(levels))
    return F.concat(F.lit("far_through_"), (below + 1).cast("string"))
