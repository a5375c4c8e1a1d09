"""Boxes and regions of interest as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def unletterbox(b: Box, scale: Column, pad_x: Column, pad_y: Column) -> Box:
    return (b[0] - pad_x) / scale, (b[1] - pad_y) / scale, (b[2] - pad_x) / scale, (b[3] - pad_y) / scale


def padded(b: Box, share: float, width: Column, height: Column) -> Box:
    """Grown by a share of each side, clipped to the frame."""
    px, py = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return F.greatest(F.lit(0.0), b[0] - px), F.greatest(F.lit(0.0), b[1] - py), F.least(width, b[2] + px), F.least(height, b[3] + py)


def in_rectangle(x: Column, y: Column, points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return x.between(F.array_min(xs), F.array_max(xs)) & y.between(F.array_min(ys), F.array_max(ys))


def in_circle(x: Column, y: Column, points: Column) -> Column:
    """The first point is the centre, the second lies on the circle."""
    c, e = F.get(points, 0), F.get(points, 1)
    return F.pow(x - c[0], 2) + F.pow(y - c[1], 2) <= F.pow(e[0] - c[0], 2) + F.pow(e[1] - c[1], 2)


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over the closed polygon."""
    edges = F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p[1] > y) != (q[1] > y)
        return F.when(spans, x < (q[0] - p[0]) * (y - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]).otherwise(False)

    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))


def in_shape(x: Column, y: Column, kind: Column, points: Column) -> Column:
    """Whether a point lies in a shape; shapes that can't be drawn hold no point."""
    n = F.size(points)
    return (
        F.when((kind == "rectangle") & (n >= 2), in_rectangle(x, y, points))
        .when((kind == "circle") & (n >= 2), in_circle(x, y, points))
        .when((kind == "polygon") & (n >= 3), in_polygon(x, y, points))
        .otherwise(False)
    )


def drawable(kind: Column, points: Column) -> Column:
    return ((kind.isin("rectangle", "circle")) & (F.size(points) >= 2)) | ((kind == "polygon") & (F.size(points) >= 3))


def in_any_shape(x: Column, y: Column, shapes: Column) -> Column:
    """Union of the shapes; every point is inside where none can be drawn."""
    able = F.filter(shapes, lambda s: drawable(s["shape_type"], s["points"]))
    return (F.size(able) == 0) | F.exists(able, lambda s: in_shape(x, y, s["shape_type"], s["points"]))
