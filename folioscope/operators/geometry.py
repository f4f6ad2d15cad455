"""Relations of the vector geometry of a page: pairs, circles, boxes, components, measures.

Segments are (page, idx, x1, y1, x2, y2). Whatever lies near meets in cells of a grid, each
thing filed under every cell of its box widened by the reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import kernels as K

# Of pairs the largest angle in degrees, the least and largest offset and the
# least overlap; of circles the largest distance of centres and the least difference of radii;
# the reach of neighbours; operations that make a page a drawing or a scan; a point in mm.
ANGLE, OFFSET, OVERLAP = 2.0, (1.0, 48.0), 4.0
CENTRES, RADII = 2.0, 0.5
REACH = 12.0
VECTOR, RASTER = 40, 10
MM = 25.4 / 72


def confidence(distance: Column, tolerance: float) -> Column:
    """100 at no distance, 0 at the tolerance."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / tolerance)) * 100 + 0.5).cast("int")


def page_class(path_ops: Column, image_ops: Column, spans: Column) -> Column:
    return (
        F.when(path_ops >= VECTOR, F.when(image_ops > 0, "mixed").otherwise("vector"))
        .when((path_ops < RASTER) & (image_ops > 0), "raster").when(spans > 0, "text").otherwise("mixed")
    )


def image_coverage(area: Column, width: Column, height: Column) -> Column:
    page = width * height
    return F.when((page > 0) & (area > 0), F.least(area / page, F.lit(1.0))).otherwise(0.0)


def _cells(low: Column, high: Column, reach: float, cell: float) -> Column:
    return F.explode(F.sequence(F.floor((low - reach) / cell), F.floor((high + reach) / cell)))


def pairs(segments: DataFrame, cell: float = 96.0) -> DataFrame:
    """(page, a, b, distance, angle, overlap, confidence): parallel segments side by side.

    Each segment of four points or more takes the nearest on either side (of equals the first)
    that is within two degrees, 1 to 48 points off and beside it for four points; of what both
    say of each other the larger overlap stays, the first of equals.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    edges = segments.withColumns({"length": F.sqrt(dx * dx + dy * dy), "direction": F.atan2(dy, dx)}).where(F.col("length") >= OVERLAP)

    def filed(reach: float) -> DataFrame:
        out = edges.withColumn("cx", _cells(F.least("x1", "x2"), F.greatest("x1", "x2"), reach, cell))
        return out.withColumn("cy", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), reach, cell))

    a, b = filed(OFFSET[1]).alias("a"), filed(0.0).alias("b")
    near = a.join(b, F.expr("a.page = b.page AND a.cx = b.cx AND a.cy = b.cy AND a.idx <> b.idx"))
    turn = F.abs(F.expr("a.direction - b.direction")) % F.pi()
    angle = F.when(turn > F.pi() / 2, F.pi() - turn).otherwise(turn) * 180 / F.pi()
    ux, uy = F.cos("a.direction"), F.sin("a.direction")
    along = lambda x, y: (F.expr(f"{x} - a.x1") * ux) + (F.expr(f"{y} - a.y1") * uy)
    across = lambda x, y: (F.expr(f"{x} - a.x1") * -uy) + (F.expr(f"{y} - a.y1") * ux)
    ends = {s: (along(f"{s}.x1", f"{s}.y1"), along(f"{s}.x2", f"{s}.y2")) for s in "ab"}
    overlap = F.least(F.greatest(*ends["a"]), F.greatest(*ends["b"])) - F.greatest(F.least(*ends["a"]), F.least(*ends["b"]))
    signed = (across("b.x1", "b.y1") + across("b.x2", "b.y2")) / 2
    told = near.select(
        F.col("a.page").alias("page"), F.col("a.idx").alias("own"), F.col("b.idx").alias("other"), F.round(angle, 6).alias("angle"),
        F.round(signed, 6).alias("signed"), F.round(F.greatest(overlap, F.lit(0.0)), 6).alias("overlap"),
    )
    fit = told.where((F.col("angle") <= ANGLE) & F.abs("signed").between(*OFFSET) & (F.col("overlap") >= OVERLAP)).distinct()
    best = fit.groupBy("page", "own", (F.col("signed") >= 0).alias("side")).agg(F.min(F.struct(F.abs("signed").alias("distance"), "other", "angle", "overlap")).alias("m"))
    both = best.select("page", "own", "m.*").withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    kept = both.groupBy("page", "a", "b").agg(F.min(F.struct((-F.col("overlap")).alias("k"), "own", "distance", "angle", "overlap")).alias("m"))
    return kept.select("page", "a", "b", "m.distance", "m.angle", "m.overlap").withColumn("confidence", confidence(F.col("angle"), ANGLE))


def concentric(circles: DataFrame) -> DataFrame:
    """(page, a, b, distance, confidence) of circles (page, idx, cx, cy, radius) whose centres are
    within two points and whose radii differ by half a point; distance: that difference."""
    at = lambda c, reach: F.explode(F.sequence(F.floor((F.col(c) - reach) / CENTRES), F.floor((F.col(c) + reach) / CENTRES)))
    a = circles.withColumn("gx", at("cx", CENTRES)).withColumn("gy", at("cy", CENTRES)).alias("a")
    b = circles.withColumn("gx", F.floor(F.col("cx") / CENTRES)).withColumn("gy", F.floor(F.col("cy") / CENTRES)).alias("b")
    met = a.join(b, F.expr("a.page = b.page AND a.gx = b.gx AND a.gy = b.gy AND a.idx < b.idx"))
    dx, dy = F.expr("a.cx - b.cx"), F.expr("a.cy - b.cy")
    told = met.select(F.col("a.page").alias("page"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("apart"), F.round(F.abs(F.expr("a.radius - b.radius")), 6).alias("distance"))
    kept = told.where((F.col("apart") <= CENTRES) & (F.col("distance") >= RADII))
    return kept.withColumn("confidence", confidence(F.col("apart"), CENTRES)).drop("apart")


def box_relations(boxes: DataFrame, cell: float = 64.0) -> DataFrame:
    """(page, kind, a, b, distance, confidence) of boxes (page, idx, bx0, by0, bx1, by1): b lies
    inside a ('contains'), or the two are 12 points apart at most ('adjacent', a before b).

    Distance: between the borders, so 0 where they cross; ties by the lower cell don't matter, a
    pair is told once, in the cell of the upper left corner of what both widened boxes share.
    """
    filed = boxes.withColumn("cx", _cells(F.col("bx0"), F.col("bx1"), REACH / 2, cell)).withColumn("cy", _cells(F.col("by0"), F.col("by1"), REACH / 2, cell))
    a, b = filed.alias("a"), filed.alias("b")
    corner = lambda c: F.floor((F.greatest(f"a.b{c}0", f"b.b{c}0") - REACH / 2) / cell)
    met = a.join(b, F.expr("a.page = b.page AND a.cx = b.cx AND a.cy = b.cy AND a.idx < b.idx")).where((corner("x") == F.col("a.cx")) & (corner("y") == F.col("a.cy")))
    inside = lambda p, q: F.expr(f"{q}.bx0 > {p}.bx0 AND {q}.bx1 < {p}.bx1 AND {q}.by0 > {p}.by0 AND {q}.by1 < {p}.by1")
    gap = lambda c: F.greatest(F.lit(0.0), F.expr(f"a.b{c}0 - b.b{c}1"), F.expr(f"b.b{c}0 - a.b{c}1"))
    apart = F.round(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")), 6)
    kind = F.when(inside("a", "b") | inside("b", "a"), "contains").otherwise("adjacent")
    swap = inside("b", "a")
    told = met.select(
        F.col("a.page").alias("page"), kind.alias("kind"), F.when(swap, F.col("b.idx")).otherwise(F.col("a.idx")).alias("a"),
        F.when(swap, F.col("a.idx")).otherwise(F.col("b.idx")).alias("b"), F.when(kind == "contains", 0.0).otherwise(apart).alias("distance"),
    )
    return told.where(F.col("distance") <= REACH).withColumn("confidence", confidence(F.col("distance"), REACH))


def point_in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a ray to the right crosses the polygon's edges an odd number of times."""
    n = F.size(xs)
    at = lambda c, k: F.get(c, (k + n) % n)
    crosses = lambda k: (
        ((at(ys, k) > y) != (at(ys, k - 1) > y)) & (x < (at(xs, k - 1) - at(xs, k)) * (y - at(ys, k)) / (at(ys, k - 1) - at(ys, k)) + at(xs, k))
    )
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda odd, k: odd != F.coalesce(crosses(k), F.lit(False)))


def ring_area(xs: Column, ys: Column) -> Column:
    """Area of a closed ring, whichever way it runs."""
    n = F.size(xs)
    turn = lambda k: F.get(xs, k) * F.get(ys, (k + 1) % n) - F.get(xs, (k + 1) % n) * F.get(ys, k)
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + turn(k))) / 2


def path_length(xs: Column, ys: Column, closed: bool) -> Column:
    """Sum of the legs; of a closed path also that back to its start."""
    n = F.size(xs)
    leg = lambda k: F.sqrt(F.pow(F.get(xs, (k + 1) % n) - F.get(xs, k), 2) + F.pow(F.get(ys, (k + 1) % n) - F.get(ys, k), 2))
    return F.aggregate(F.sequence(F.lit(0), n - (1 if closed else 2)), F.lit(0.0), lambda s, k: s + leg(k))


def measure(shapes: DataFrame, scale: float) -> DataFrame:
    """Of shapes (page, idx, xs, ys, holes: arrays of (xs, ys)) in points: distance along the
    points, perimeter with the holes', area without them (0 at least), on paper in mm, and the
    real ones by the scale."""
    holes = lambda f: F.aggregate("holes", F.lit(0.0), lambda s, h: s + f(h["xs"], h["ys"]))
    out = shapes.select(
        "page", "idx", (path_length(F.col("xs"), F.col("ys"), False) * MM).alias("distance_mm"),
        ((path_length(F.col("xs"), F.col("ys"), True) + holes(lambda x, y: path_length(x, y, True))) * MM).alias("perimeter_mm"),
        (F.greatest(F.lit(0.0), ring_area(F.col("xs"), F.col("ys")) - holes(ring_area)) * (MM * MM)).alias("area_mm2"),
    )
    return out.withColumns({"real_distance_mm": F.col("distance_mm") * scale, "real_area_mm2": F.col("area_mm2") * (scale * scale)})


def vertex_components(edges: DataFrame) -> DataFrame:
    """(page, vertex, component): the smallest vertex that each vertex of a page is joined to.
    ``edges``: (page, u, v)."""
    return K.components(edges)


def preview_polylines(polylines: DataFrame, most: int = 0, least: float = 0.01, box=None) -> DataFrame:
    """(page, idx, length): the longest polylines (page, idx, xs, ys) of each page with a point in
    ``box``, ties by index; ``most`` 0: 1,000, which is the largest number."""
    cap = min(most or 1000, 1000)
    out = polylines.withColumn("length", path_length(F.col("xs"), F.col("ys"), False)).where(F.col("length") >= max(least, 0.01))
    if box:
        x0, y0, x1, y1 = box
        out = out.where(F.exists(F.arrays_zip("xs", "ys"), lambda p: p["xs"].between(x0, x1) & p["ys"].between(y0, y1)))
    place = F.row_number().over(W.partitionBy("page").orderBy(F.desc(F.round("length", 9)), "idx"))
    return out.withColumn("place", place).where(F.col("place") <= cap).select("page", "idx", "length")


def axis_lines(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """(page, level, run_start, run_end, n): level strokes of one height merged where the gap
    between them is ``gap`` at most. ``segments``: (page, level, run_start, run_end)."""
    order = W.partitionBy("page", "level").orderBy("run_start", "run_end")
    reach = F.max("run_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    told = segments.withColumn("new", F.coalesce((F.col("run_start") > reach + gap).cast("int"), F.lit(0)))
    runs = told.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("page", "level", "run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.count("*").alias("n")).drop("run")
