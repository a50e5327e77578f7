"""Geometry and spatial statistics on unit squares, one a nation, in a grid of five by five."""

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import spatial as S
from ..operators.adapters import detections, table
from .q_detections import DET
from .q_rates import ANNUAL, annual
from .q_rates import R
from .registry import out, query


def squares(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("unit_id"), G.square(F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)).alias("polygon"))


def zones(spark, d):
    """Five strips of width 1.25, which cut the squares unevenly."""
    r = table(spark, d, "region")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    x0, x1 = F.col("r_regionkey") * 1.25, F.col("r_regionkey") * 1.25 + 1.25
    return r.select(F.col("r_regionkey").alias("zone_id"), F.array(F.array(p(x0, 0), p(x1, 0), p(x1, 5), p(x0, 5), p(x0, 0))).alias("polygon"))


OVER = "o AS (SELECT CAST(n_nationkey AS BIGINT) AS unit_id, CAST(r_regionkey AS BIGINT) AS zone_id, least(n_nationkey % 5 + 1, r_regionkey * 1.25 + 1.25) - greatest(n_nationkey % 5, r_regionkey * 1.25) AS area FROM nation, region)"
EDGE = "e AS (SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1)"


@query("q_queen_edges", f"WITH {EDGE} SELECT * FROM e")
def queen(spark, d):
    return out(G.queen_edges(squares(spark, d)))


@query("q_row_weights", f"WITH {EDGE} SELECT i, j, round(1.0 / count(*) OVER (PARTITION BY i), 6) AS w FROM e")
def weights(spark, d):
    return out(S.row_standardised(G.queen_edges(squares(spark, d))))


@query("q_point_in_cell", f"WITH {DET}, c AS (SELECT event_id, x, y, floor(x) AS cx, floor(y) AS cy FROM det) SELECT event_id, CASE WHEN x <= 5 AND y <= 5 THEN CAST(greatest(cy - CASE WHEN y = cy AND cy > 0 THEN 1 ELSE 0 END, 0) * 5 + greatest(cx - CASE WHEN x = cx AND cx > 0 THEN 1 ELSE 0 END, 0) AS BIGINT) END AS cell_id FROM c")
def point_in_cell(spark, d):
    pts = detections(spark, d).select("event_id", "x", "y")
    return out(G.points_in_units(pts, squares(spark, d).withColumnRenamed("unit_id", "cell_id"), "event_id", "cell_id").select("event_id", "cell_id"))


def odd_shapes(spark, d):
    """The squares with a hole in the middle (even ids), or without their upper right quarter (odd ids)."""
    n = F.col("n_nationkey")
    x, y = n % 5, F.floor(n / 5)
    p = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    hole = F.array(p(0.25, 0.25), p(0.75, 0.25), p(0.75, 0.75), p(0.25, 0.75), p(0.25, 0.25))
    corner = F.array(F.array(p(0, 0), p(1, 0), p(1, 0.5), p(0.5, 0.5), p(0.5, 1), p(0, 1), p(0, 0)))
    return table(spark, d, "nation").select(n.alias("cell_id"), F.when(n % 2 == 0, F.concat(G.square(x, y), F.array(hole))).otherwise(corner).alias("polygon"))


ODD = f"""WITH {DET}, c AS (SELECT CAST(n_nationkey AS BIGINT) AS cell_id, n_nationkey % 2 AS odd, n_nationkey % 5 AS cx, n_nationkey // 5 AS cy FROM nation),
h AS (SELECT event_id, min(cell_id) AS cell_id FROM det JOIN c ON x BETWEEN cx AND cx + 1 AND y BETWEEN cy AND cy + 1 WHERE CASE WHEN odd = 1 THEN NOT (x > cx + 0.5 AND y > cy + 0.5) ELSE NOT (x > cx + 0.25 AND x < cx + 0.75 AND y > cy + 0.25 AND y < cy + 0.75) END GROUP BY 1)
SELECT event_id, h.cell_id FROM det LEFT JOIN h USING (event_id)"""


@query("q_point_in_odd_shape", ODD)
def point_in_odd_shape(spark, d):
    pts = detections(spark, d).select("event_id", "x", "y")
    return out(G.points_in_units(pts, odd_shapes(spark, d), "event_id", "cell_id").select("event_id", "cell_id"))


@query("q_point_in_odd_shape_by_cell", ODD)
def point_in_odd_shape_by_cell(spark, d):
    """The same by the join of cells, which units beyond the bound take."""
    pts = detections(spark, d).select("event_id", "x", "y")
    return out(G.points_in_units(pts, odd_shapes(spark, d), "event_id", "cell_id", most_vertices=0).select("event_id", "cell_id"))


@query("q_odd_overlay", "SELECT CAST(a.n_nationkey AS BIGINT) AS unit_id, CAST(a.n_nationkey AS BIGINT) AS cell_id, 0.75::DOUBLE AS area FROM nation a")
def odd_overlay(spark, d):
    o = G.overlay(squares(spark, d), odd_shapes(spark, d), "unit_id", "cell_id")
    return out(o.select("unit_id", "cell_id", "area"))


@query("q_land_mask", f"WITH {DET} SELECT x BETWEEN 0 AND 2.5 AND y BETWEEN 0 AND 5 AS in_mask, count(*) AS n FROM det GROUP BY 1")
def mask(spark, d):
    pts = detections(spark, d).select("event_id", "x", "y")
    return out(G.split_by_mask(pts, zones(spark, d).where("zone_id < 2").select("polygon"), "event_id").groupBy("in_mask").agg(F.count(F.lit(1)).alias("n")))


@query("q_overlay", f"WITH {OVER} SELECT unit_id, zone_id, round(area, 6) AS area, round(area, 6) AS share FROM o WHERE area > 0")
def overlay(spark, d):
    return out(G.overlay(squares(spark, d), zones(spark, d), "unit_id", "zone_id"))


@query("q_overlap_assign", f"WITH {OVER}, p AS (SELECT *, max(area) OVER (PARTITION BY unit_id) AS top FROM o WHERE area > 0), t AS (SELECT * FROM p WHERE area >= top - 1e-12) SELECT unit_id, min(zone_id) AS zone_id, round(max(area), 6) AS share, count(*) AS ties, count(*) > 1 AS tie, 'max_share' AS method FROM t GROUP BY unit_id")
def assign(spark, d):
    s = squares(spark, d)
    return out(G.assign_by_share(G.overlay(s, zones(spark, d), "unit_id", "zone_id"), s, "unit_id", "zone_id"))


@query("q_dense_rank", f"WITH {OVER} SELECT unit_id, zone_id, dense_rank() OVER (PARTITION BY unit_id ORDER BY round(area, 9) DESC) AS share_rank FROM o WHERE area > 0")
def ranks(spark, d):
    o = G.overlay(squares(spark, d), zones(spark, d), "unit_id", "zone_id").withColumn("share", F.round("share", 9))
    return out(G.share_ranks(o, "unit_id").select("unit_id", "zone_id", "share_rank"))


@query("q_sliver_hist", f"WITH {OVER}, c AS (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS cut) SELECT cut, count(*) FILTER (area <= cut + 1e-9) AS n FROM o, c WHERE area > 0 GROUP BY cut")
def sliver(spark, d):
    o = G.overlay(squares(spark, d), zones(spark, d), "unit_id", "zone_id").withColumn("share", F.round("share", 9))
    return out(G.slivers(o, [0.1, 0.25, 0.5, 0.75, 1.0]))


@query("q_overlap_closure", f"WITH {OVER} SELECT unit_id, CAST(1 AS DOUBLE) AS full, round(sum(area), 6) AS covered, round(greatest(1 - sum(area), 0), 6) AS gap, round(greatest(1 - sum(area), 0), 6) AS gap_fraction FROM o WHERE area > 0 AND zone_id < 4 GROUP BY unit_id")
def closed(spark, d):
    s = squares(spark, d)
    full = s.select("unit_id", G.polygon_area(F.col("polygon")).alias("full"))
    o = G.overlay(s, zones(spark, d).where("zone_id < 4"), "unit_id", "zone_id")
    return out(G.closure(o, full, "unit_id"))


@query("q_clip", f"WITH {OVER} SELECT unit_id, round(coalesce(sum(area) FILTER (area > 0 AND zone_id < 3), 0), 6) AS area_inside FROM o GROUP BY unit_id")
def clip(spark, d):
    return out(G.clip_to(squares(spark, d), zones(spark, d).where("zone_id < 3").select("polygon")))


@query("q_anchors", "SELECT CAST(n_nationkey AS BIGINT) AS unit_id, n_nationkey % 5 + 0.5::DOUBLE AS x, n_nationkey // 5 + 0.5::DOUBLE AS y, row_number() OVER (ORDER BY n_nationkey) AS location_id FROM nation")
def anchored(spark, d):
    return out(G.anchors(squares(spark, d)))


@query("q_area_bounds", "SELECT CAST(n_nationkey AS BIGINT) AS unit_id, 1e-6::DOUBLE AS km2, CAST(n_nationkey % 5 AS DOUBLE) AS x0, CAST(n_nationkey // 5 AS DOUBLE) AS y0, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS x1, CAST(n_nationkey // 5 + 1 AS DOUBLE) AS y1, CAST(32631 AS BIGINT) AS epsg FROM nation")
def areas(spark, d):
    from ..functions.scalars import utm_epsg

    b = G.bounds(F.col("polygon"))
    return out(squares(spark, d).select("unit_id", G.in_area(F.col("polygon"), "km2").alias("km2"), *[v.alias(k) for k, v in b.items()], utm_epsg(b["x0"], b["y0"], b["x1"], b["y1"]).alias("epsg")))


VAL = ANNUAL + f", {EDGE}, v AS (SELECT unit_id, mean_annual_rate AS x FROM u), z AS (SELECT unit_id, x - avg(x) OVER () AS d, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM v), w AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM e)"


def rates(spark, d):
    return R.unit_summary(annual(spark, d), ["unit_id"]).select("unit_id", F.col("mean_annual_rate").alias("x"))


@query("q_moran_global", VAL + " SELECT (SELECT count(*) FROM z) AS n, round(sum(w), 6) AS s0, round((SELECT count(*) FROM z) / sum(w) * sum(w * a.d * b.d) / (SELECT sum(d * d) FROM z), 6) AS moran_i, round(-1.0 / ((SELECT count(*) FROM z) - 1), 6) AS expected FROM w JOIN z a ON i = a.unit_id JOIN z b ON j = b.unit_id")
def moran(spark, d):
    return out(S.global_moran(rates(spark, d), S.row_standardised(G.queen_edges(squares(spark, d))), "unit_id", "x"))


LOC = VAL + ", l AS (SELECT i AS unit_id, sum(w * b.z) AS lag FROM w JOIN z b ON j = b.unit_id GROUP BY i), lm AS (SELECT z.unit_id, z, lag, z * lag AS local_i, CASE WHEN z > 0 THEN 'H' ELSE 'L' END || CASE WHEN lag > 0 THEN 'H' ELSE 'L' END AS quadrant FROM z JOIN l USING (unit_id))"


@query("q_moran_local", LOC + " SELECT unit_id, round(z, 6) AS z, round(lag, 6) AS lag, round(local_i, 6) AS local_i, quadrant FROM lm")
def local(spark, d):
    return out(S.local_moran(rates(spark, d), S.row_standardised(G.queen_edges(squares(spark, d))), "unit_id", "x"))


@query("q_lisa_class", LOC + ", pv AS (SELECT *, ((unit_id * 7 + 3) % 25 + 1) / 250.0 AS raw_p FROM lm), rk AS (SELECT *, row_number() OVER (ORDER BY raw_p, unit_id) AS r FROM pv), q AS (SELECT *, least(min(raw_p * (SELECT count(*) FROM pv) / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1) AS bh_q FROM rk) SELECT unit_id, round(bh_q, 6) AS bh_q, CASE WHEN bh_q <= 0.05 THEN quadrant ELSE 'NS' END AS class FROM q")
def lisa(spark, d):
    loc = S.local_moran(rates(spark, d), S.row_standardised(G.queen_edges(squares(spark, d))), "unit_id", "x")
    given = loc.withColumn("raw_p", ((F.col("unit_id") * 7 + 3) % 25 + 1) / F.lit(250.0))
    return out(S.lisa_class(given).select("unit_id", "bh_q", "class"))


@query("q_moran_perm")
def moran_perm(spark, d):
    edges = G.queen_edges(squares(spark, d))
    return out(S.local_moran_permutation(rates(spark, d), edges, "unit_id", "x"))
