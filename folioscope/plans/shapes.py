"""Queries of the geometry operators over shapes made from ``lineitem``, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import geometry as G
from folioscope.plans.registry import query
from folioscope.sources import typeset as S

SEGMENTS = "WITH " + S.SEGMENTS_SQL.strip()


def segments(spark, d):
    return S.segments(S.read(spark, d, "lineitem"))


@query(f"""{SEGMENTS}, c AS (SELECT page, count(*) AS n, sum((idx % 7 = 0)::INT) AS p, sum((page % 3 = 0 AND idx % 9 = 0)::INT) AS i, sum((page % 4 > 0)::INT) AS t FROM segments GROUP BY page)
SELECT page, CASE WHEN n - 30 * (page % 7) >= 40 THEN (CASE WHEN i > 0 THEN 'mixed' ELSE 'vector' END) WHEN n - 30 * (page % 7) < 10 AND i > 0 THEN 'raster' WHEN t > 0 THEN 'text' ELSE 'mixed' END AS class FROM c""")
def classify(spark, d):
    c = segments(spark, d).groupBy("page").agg(F.count("*").alias("n"), F.expr("sum(cast(page % 3 = 0 AND idx % 9 = 0 as int))").alias("i"), F.expr("sum(cast(page % 4 > 0 as int))").alias("t"))
    return c.select("page", G.page_class(F.expr("n - 30 * (page % 7)"), F.col("i"), F.col("t")).alias("class"))


@query(f"""{SEGMENTS} SELECT page, CASE WHEN sum(abs(x2 - x1) * (page % 5)) > 0 AND page % 11 > 0 THEN least(sum(abs(x2 - x1) * (page % 5)) / (page % 11 * 1500), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS coverage FROM segments GROUP BY page""")
def image_coverage(spark, d):
    area = segments(spark, d).groupBy("page").agg(F.expr("sum(abs(x2 - x1) * (page % 5))").alias("area"))
    return area.select("page", G.image_coverage(F.col("area"), F.expr("CAST(page % 11 * 15 AS DOUBLE)"), F.lit(100.0)).alias("coverage"))


@query(f"""{SEGMENTS}, e AS (SELECT *, atan2(y2 - y1, x2 - x1) AS dir FROM segments WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 4),
n AS (SELECT a.page, a.idx AS own, b.idx AS other, abs(a.dir - b.dir) % pi() AS turn, cos(a.dir) AS ux, sin(a.dir) AS uy, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM e a JOIN e b ON a.page = b.page AND a.idx <> b.idx AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 48 AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) - 48 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 48 AND greatest(b.y1, b.y2) >= least(a.y1, a.y2) - 48),
m AS (SELECT page, own, other, round(CASE WHEN turn > pi() / 2 THEN pi() - turn ELSE turn END * 180 / pi(), 6) AS angle, round((((bx1 - ax1) * -uy + (by1 - ay1) * ux) + ((bx2 - ax1) * -uy + (by2 - ay1) * ux)) / 2, 6) AS signed,
  0.0::DOUBLE AS a1, (ax2 - ax1) * ux + (ay2 - ay1) * uy AS a2, (bx1 - ax1) * ux + (by1 - ay1) * uy AS b1, (bx2 - ax1) * ux + (by2 - ay1) * uy AS b2 FROM n),
f AS (SELECT *, round(greatest(least(greatest(a1, a2), greatest(b1, b2)) - greatest(least(a1, a2), least(b1, b2)), 0), 6) AS overlap FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY page, own, signed >= 0 ORDER BY abs(signed), other) AS k FROM f WHERE angle <= 2 AND abs(signed) BETWEEN 1 AND 48 AND overlap >= 4),
h AS (SELECT *, row_number() OVER (PARTITION BY page, least(own, other), greatest(own, other) ORDER BY overlap DESC, own) AS r FROM g WHERE k = 1)
SELECT page, least(own, other) AS a, greatest(own, other) AS b, abs(signed) AS distance, angle, overlap, floor((1 - angle / 2) * 100 + 0.5)::INT AS confidence FROM h WHERE r = 1""")
def detect_pairs(spark, d):
    return G.pairs(segments(spark, d))


CIRCLES = "circles AS (SELECT page, idx, x1 + idx % 3 * 0.7::DOUBLE AS cx, floor(y1 / 20) * 20 + idx % 5 * 0.6::DOUBLE AS cy, 5 + idx % 13 * 0.25::DOUBLE AS radius FROM segments)"


@query(f"""{SEGMENTS}, {CIRCLES}, m AS (SELECT a.page, a.idx AS a, b.idx AS b, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 6) AS apart, round(abs(a.radius - b.radius), 6) AS distance FROM circles a JOIN circles b ON a.page = b.page AND a.idx < b.idx)
SELECT page, a, b, distance, floor((1 - apart / 2) * 100 + 0.5)::INT AS confidence FROM m WHERE apart <= 2 AND distance >= 0.5""")
def detect_concentric(spark, d):
    made = segments(spark, d).selectExpr("page", "idx", "x1 + idx % 3 * 0.7D AS cx", "floor(y1 / 20) * 20 + idx % 5 * 0.6D AS cy", "5 + idx % 13 * 0.25D AS radius")
    return G.concentric(made)


@query(f"""{SEGMENTS}, boxes AS (SELECT page, idx, x1 AS bx0, y1 AS by0, x1 + 8 + idx % 17 * 4 AS bx1, y1 + 6 + idx % 11 * 5 AS by1 FROM segments),
m AS (SELECT a.page, a.idx AS ai, b.idx AS bi, b.bx0 > a.bx0 AND b.bx1 < a.bx1 AND b.by0 > a.by0 AND b.by1 < a.by1 AS ab, a.bx0 > b.bx0 AND a.bx1 < b.bx1 AND a.by0 > b.by0 AND a.by1 < b.by1 AS ba,
  greatest(0, a.bx0 - b.bx1, b.bx0 - a.bx1) AS gx, greatest(0, a.by0 - b.by1, b.by0 - a.by1) AS gy FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx),
r AS (SELECT page, CASE WHEN ab OR ba THEN 'contains' ELSE 'adjacent' END AS kind, CASE WHEN ba THEN bi ELSE ai END AS a, CASE WHEN ba THEN ai ELSE bi END AS b, CASE WHEN ab OR ba THEN 0.0::DOUBLE ELSE round(sqrt(gx * gx + gy * gy), 6) END AS distance FROM m)
SELECT *, floor((1 - distance / 12) * 100 + 0.5)::INT AS confidence FROM r WHERE distance <= 12""")
def detect_regions(spark, d):
    return G.box_relations(segments(spark, d).selectExpr("page", "idx", "x1 AS bx0", "y1 AS by0", "x1 + 8 + idx % 17 * 4 AS bx1", "y1 + 6 + idx % 11 * 5 AS by1"))


RING = ("x1, x1 + 40 + idx % 7, x1 + 30, x1 + 12 + idx % 5", "y1, y1 + idx % 3, y1 + 35, y1 + 20")
HOLE = ("x1 + 10, x1 + 14 + idx % 4, x1 + 12", "y1 + 4, y1 + 5, y1 + 9")


def shapes(spark, d):
    ring = [f"array({', '.join(f'CAST({e} AS DOUBLE)' for e in c.split(', '))})" for c in RING]
    hole = [f"array({', '.join(f'CAST({e} AS DOUBLE)' for e in c.split(', '))})" for c in HOLE]
    return segments(spark, d).selectExpr("page", "idx", "x1", "y1", f"{ring[0]} AS xs", f"{ring[1]} AS ys", f"array(named_struct('xs', {hole[0]}, 'ys', {hole[1]})) AS holes")


def _legs(x: str, y: str, closed: bool) -> str:
    """Sum of the legs of a path in SQL."""
    xs, ys = x.split(", "), y.split(", ")
    n = len(xs)
    return " + ".join(f"sqrt((({xs[(k + 1) % n]}) - ({xs[k]})) ** 2 + (({ys[(k + 1) % n]}) - ({ys[k]})) ** 2)" for k in range(n if closed else n - 1))


def _area(x: str, y: str) -> str:
    xs, ys = x.split(", "), y.split(", ")
    n = len(xs)
    return "abs(" + " + ".join(f"(({xs[k]}) * ({ys[(k + 1) % n]}) - ({xs[(k + 1) % n]}) * ({ys[k]}))" for k in range(n)) + ") / 2"


@query(f"""{SEGMENTS}, m AS (SELECT page, idx, ({_legs(*RING, False)}) * 25.4::DOUBLE / 72 AS distance_mm, ({_legs(*RING, True)} + {_legs(*HOLE, True)}) * 25.4::DOUBLE / 72 AS perimeter_mm,
  greatest(0, {_area(*RING)} - {_area(*HOLE)}) * (25.4::DOUBLE / 72) ** 2 AS area_mm2 FROM segments)
SELECT page, idx, round(distance_mm, 6) AS distance_mm, round(perimeter_mm, 6) AS perimeter_mm, round(area_mm2, 6) AS area_mm2, round(distance_mm * 100, 4) AS real_distance_mm, round(area_mm2 * 10000, 3) AS real_area_mm2 FROM m""")
def measure_page(spark, d):
    out = G.measure(shapes(spark, d), 100.0)
    return out.select("page", "idx", *(F.round(c, n).alias(c) for c, n in (("distance_mm", 6), ("perimeter_mm", 6), ("area_mm2", 6), ("real_distance_mm", 4), ("real_area_mm2", 3))))


def _inside(px: str, py: str) -> str:
    xs, ys = (c.split(", ") for c in RING)
    one = [
        f"(CASE WHEN ((({ys[k]}) > {py}) <> (({ys[k - 1]}) > {py})) AND {px} < (({xs[k - 1]}) - ({xs[k]})) * ({py} - ({ys[k]})) / (({ys[k - 1]}) - ({ys[k]}))::DOUBLE + ({xs[k]}) THEN 1 ELSE 0 END)"
        for k in range(len(xs))
    ]
    return f"({' + '.join(one)}) % 2 = 1"


@query(f"{SEGMENTS} SELECT page, idx, {_inside('(x1 + idx % 40 + 0.5)', '(y1 + idx % 33 + 0.5)')} AS inside FROM segments")
def point_in_polygon(spark, d):
    return shapes(spark, d).select("page", "idx", G.point_in_polygon(F.expr("x1 + idx % 40 + 0.5D"), F.expr("y1 + idx % 33 + 0.5D"), F.col("xs"), F.col("ys")).alias("inside"))


#: Edges between vertices of a page: chains of up to eight, and some that join them.
EDGES = "edges AS (SELECT page, idx AS u, CASE WHEN idx % 8 < 7 THEN idx + 1 WHEN page % 2 = 0 AND idx % 24 = 7 THEN idx + 16 ELSE idx END AS v FROM segments WHERE idx % 8 > 0 OR idx % 3 = 0)"


@query(f"""WITH RECURSIVE {SEGMENTS.removeprefix('WITH ')}, {EDGES}, near AS (SELECT page, u AS a, v AS b FROM edges UNION SELECT page, v, u FROM edges),
walk(page, vertex, here) AS (SELECT DISTINCT page, a, a FROM near UNION SELECT w.page, w.vertex, n.b FROM walk w JOIN near n ON n.page = w.page AND n.a = w.here)
SELECT page, vertex, min(here) AS component FROM walk GROUP BY page, vertex""")
def union_find(spark, d):
    made = segments(spark, d).where("idx % 8 > 0 OR idx % 3 = 0").selectExpr("page", "idx AS u", "CASE WHEN idx % 8 < 7 THEN idx + 1 WHEN page % 2 = 0 AND idx % 24 = 7 THEN idx + 16 ELSE idx END AS v")
    return G.vertex_components(made)


@query(f"""{SEGMENTS}, p AS (SELECT page, idx, ({_legs(*RING, False)})::DOUBLE AS length, ({' OR '.join(f'(({x}) BETWEEN 50 AND 300 AND ({y}) BETWEEN 20 AND 350)' for x, y in zip(RING[0].split(', '), RING[1].split(', '), strict=True))}) AS meets FROM segments),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(length, 9) DESC, idx) AS k FROM p WHERE meets AND length >= 5) SELECT page, idx, round(length, 6) AS length FROM r WHERE k <= 20""")
def filter_page_polylines(spark, d):
    out = G.preview_polylines(shapes(spark, d), 20, 5.0, (50, 20, 300, 350))
    return out.select("page", "idx", F.round("length", 6).alias("length"))


@query(f"""{SEGMENTS}, s AS (SELECT page, floor(y1 / 25)::BIGINT AS level, least(x1, x2) AS run_start, greatest(x1, x2) AS run_end FROM segments),
w AS (SELECT *, coalesce(run_start > max(run_end) OVER (PARTITION BY page, level ORDER BY run_start, run_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2, false) AS new FROM s),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY page, level ORDER BY run_start, run_end ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT page, level, min(run_start) AS run_start, max(run_end) AS run_end, count(*) AS n FROM r GROUP BY page, level, run""")
def merge_axis_lines(spark, d):
    made = segments(spark, d).select("page", F.floor(F.col("y1") / 25).alias("level"), F.least("x1", "x2").alias("run_start"), F.greatest("x1", "x2").alias("run_end"))
    return G.axis_lines(made)
