"""Polygon kernels: point in polygon, areas, clipping, contact, centroids, projections.

A polygon is an array of rings, each an array of (x, y) structs; the first ring
is the outer one. Unit tables are dimensions; where points meet them, grid cells
give an equality join, so neither side is broadcast or crossed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
POLYGON = T.ArrayType(RING)
#: WGS 84.
A, INV_F = 6378137.0, 298.257223563


# --- native expressions ---------------------------------------------------------------------------


def square(x, y, side: float = 1.0) -> Column:
    """An axis-parallel square as a polygon."""
    p = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return F.array(F.array(p(0, 0), p(side, 0), p(side, side), p(0, side), p(0, 0)))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a closed or open ring."""
    nxt = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1))), F.slice(r, 1, 1))
    parts = F.zip_with(ring, nxt(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2


def polygon_area(poly: Column) -> Column:
    """Outer ring less the holes."""
    each = F.transform(poly, lambda r: F.abs(ring_area(r)))
    return 2 * each[0] - F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def bounds(poly: Column) -> dict[str, Column]:
    xs, ys = F.transform(poly[0], lambda p: p["x"]), F.transform(poly[0], lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def in_area(poly: Column, units: str = "m2") -> Column:
    """Area in m2 or km2 of a polygon in metres."""
    return polygon_area(poly) / (1e6 if units == "km2" else 1.0)


# --- numpy kernels --------------------------------------------------------------------------------


def _ring(r) -> np.ndarray:
    a = np.array([(p["x"], p["y"]) for p in r], float)
    return a if len(a) and (a[0] == a[-1]).all() else np.vstack([a, a[:1]])


def locate(poly, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, by even-odd ray casting with an exact boundary test."""
    inside, on = np.zeros(len(xs), bool), np.zeros(len(xs), bool)
    for r in poly:
        ring = _ring(r)
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            cross = (bx - ax) * (ys - ay) - (by - ay) * (xs - ax)
            on |= (cross == 0) & (np.minimum(ax, bx) <= xs) & (xs <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= ys) & (ys <= np.maximum(ay, by))
            if ay != by:
                hit = ((ay > ys) != (by > ys)) & (xs < (bx - ax) * (ys - ay) / (by - ay) + ax)
                inside ^= hit
    return np.where(on, 0, np.where(inside, 1, -1))


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: the part of a polygon inside a convex one; empty if none."""
    def turned(r):
        r = r[:-1] if (r[0] == r[-1]).all() else r
        return r if np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]) > 0 else r[::-1]

    out, window = turned(subject), turned(window)
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                t = side[i] / (side[i] - side[j])
                kept.append(out[i] + t * (out[j] - out[i]))
        out = np.array(kept).reshape(-1, 2)
    return out


def is_convex(ring: np.ndarray) -> bool:
    r = ring[:-1] if (ring[0] == ring[-1]).all() else ring
    d = np.roll(r, -1, axis=0) - r
    c = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    return bool((c >= 0).all() or (c <= 0).all())


def _triangles(ring: np.ndarray) -> list[np.ndarray]:
    """Ear clipping of a simple ring, so that a concave one is a sum of convex ones."""
    p = ring[:-1] if (ring[0] == ring[-1]).all() else ring
    if np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]) < 0:
        p = p[::-1]
    idx, out = list(range(len(p))), []
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(idx) > 3:
        for k in range(len(idx)):
            a, b, c = p[idx[k - 1]], p[idx[k]], p[idx[(k + 1) % len(idx)]]
            if cross(a, b, c) <= 0:
                continue
            rest = [p[i] for i in idx if i not in (idx[k - 1], idx[k], idx[(k + 1) % len(idx)])]
            if any(cross(a, b, q) >= 0 and cross(b, c, q) >= 0 and cross(c, a, q) >= 0 for q in rest):
                continue
            out.append(np.array([a, b, c]))
            del idx[k]
            break
        else:
            del idx[0]  # only collinear corners are left
    out.append(p[idx])
    return out


def overlap_area(a, b) -> float:
    """Area that two polygons (lists of rings) share; holes are taken off."""
    def pieces(poly):
        for n, r in enumerate(poly):
            ring = _ring(r)
            for t in [ring] if is_convex(ring) else _triangles(ring):
                yield (1 if n == 0 else -1), t

    total = 0.0
    for sa, ta in pieces(a):
        for sb, tb in pieces(b):
            got = clip_convex(ta, tb)
            if len(got) > 2:
                total += sa * sb * abs(np.sum(got[:, 0] * np.roll(got[:, 1], -1) - np.roll(got[:, 0], -1) * got[:, 1])) / 2
    return total


def touches(a, b, tol: float = 0.0) -> bool:
    """Whether two polygons share boundary points but no interior."""
    ra, rb = _ring(a[0]), _ring(b[0])
    near = (locate(b, ra[:, 0], ra[:, 1]) == 0).any() or (locate(a, rb[:, 0], rb[:, 1]) == 0).any()
    return bool(near and overlap_area(a, b) <= tol)


def centroid(poly) -> tuple[float, float]:
    """Area-weighted centre of the outer ring."""
    r = _ring(poly[0])
    c = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
    s = c.sum()
    return float(((r[:-1, 0] + r[1:, 0]) * c).sum() / (3 * s)), float(((r[:-1, 1] + r[1:, 1]) * c).sum() / (3 * s))


def anchor(poly) -> tuple[float, float]:
    """The centroid if the polygon covers it, else the middle of the longest chord at its height."""
    x, y = centroid(poly)
    if locate(poly, np.array([x]), np.array([y]))[0] >= 0:
        return x, y
    ys = np.concatenate([_ring(r)[:, 1] for r in poly])
    mid = (ys.min() + ys.max()) / 2
    mid += 1e-9 * (ys.max() - ys.min()) * (mid == ys).any()
    cuts = sorted(ax + (mid - ay) * (bx - ax) / (by - ay) for r in poly for (ax, ay), (bx, by) in zip(_ring(r), _ring(r)[1:], strict=False) if (ay > mid) != (by > mid))
    pairs = list(zip(cuts[::2], cuts[1::2], strict=False))
    a, b = max(pairs, key=lambda p: p[1] - p[0])
    return (a + b) / 2, float(mid)


def utm(lon, lat, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by the Krueger series to the fourth order."""
    f = 1 / INV_F
    n = f / (2 - f)
    big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    phi, lam = np.radians(lat), np.radians(np.asarray(lon) - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(al, 1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(al, 1))
    return 500000 + 0.9996 * big * east, 0.9996 * big * north + (10_000_000 if south else 0)


def equal_area(lon, lat, lon0: float = 0.0, lat0: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal-area coordinates: cylindrical (standard parallel 30) without ``lat0``, else azimuthal on the authalic sphere."""
    e2 = 2 / INV_F - 1 / INV_F**2
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
    lam, s = np.radians(np.asarray(lon) - lon0), np.sin(np.radians(lat))
    if lat0 is None:
        k = math.cos(math.radians(30)) / math.sqrt(1 - e2 * math.sin(math.radians(30)) ** 2)
        return A * k * lam, A * q(s) / (2 * k)
    qp = q(1.0)
    r, beta, b0 = A * math.sqrt(qp / 2), np.arcsin(np.clip(q(s) / qp, -1, 1)), math.asin(q(math.sin(math.radians(lat0))) / qp)
    k = np.sqrt(2 / (1 + math.sin(b0) * np.sin(beta) + math.cos(b0) * np.cos(beta) * np.cos(lam)))
    return r * k * np.cos(beta) * np.sin(lam), r * k * (math.cos(b0) * np.sin(beta) - math.sin(b0) * np.cos(beta) * np.cos(lam))


def geodesic_area(poly, steps: int = 64) -> float:
    """Area in m2 on the ellipsoid of a polygon in degrees: edges cut into ``steps`` and mapped by an equal-area projection."""
    total = 0.0
    for n, r in enumerate(poly):
        ring = _ring(r)
        t = np.linspace(0, 1, steps, endpoint=False)[:, None]
        fine = np.vstack([a + t * (b - a) for a, b in zip(ring, ring[1:], strict=False)])
        x, y = equal_area(fine[:, 0], fine[:, 1])
        total += (1 if n == 0 else -1) * abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2
    return float(total)


# --- joins ----------------------------------------------------------------------------------------


def _cells(df: DataFrame, box: dict[str, Column], size: float) -> DataFrame:
    """The grid cells that a box meets, one row each."""
    f = lambda c: F.floor(c / size)
    out = df.withColumn("_cx", F.explode(F.sequence(f(box["x0"]), f(box["x1"]))))
    return out.withColumn("_cy", F.explode(F.sequence(f(box["y0"]), f(box["y1"]))))


class UnitIndex:
    """Polygons in cells of about their mean extent; those over ``most_cells`` cells are tested for every point."""

    def __init__(self, rows: list, most_cells: int = 256):
        self.polys = [r["polygon"] for r in rows]  # in the order in which they win: by area, then by id
        boxes = np.array([[r["x0"], r["y0"], r["x1"], r["y1"]] for r in rows], float).reshape(-1, 4)
        self.boxes = boxes
        extent = np.concatenate([boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]])
        self.cell = float(extent.mean()) if len(extent) and extent.mean() > 0 else 1.0
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.large: list[int] = []
        for k, (x0, y0, x1, y1) in enumerate(np.floor(boxes / self.cell).astype(np.int64).tolist()):
            if (x1 - x0 + 1) * (y1 - y0 + 1) > most_cells:
                self.large.append(k)
            else:
                for at in ((x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)):
                    self.cells.setdefault(at, []).append(k)

    def find(self, xs: np.ndarray, ys: np.ndarray, within: bool) -> np.ndarray:
        """The place of the polygon that holds each point, -1 if none."""
        out = np.full(len(xs), -1, np.int64)
        fine = np.flatnonzero(np.isfinite(xs) & np.isfinite(ys))
        cx, cy = (np.floor(v[fine] / self.cell).astype(np.int64) for v in (xs, ys))
        order = np.lexsort((cy, cx))
        fine, cx, cy = fine[order], cx[order], cy[order]
        cuts = [0, *(np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1).tolist(), len(fine)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            left = fine[s:e]
            for k in sorted([*self.cells.get((int(cx[s]), int(cy[s])), ()), *self.large]):
                x0, y0, x1, y1 = self.boxes[k]
                near = left[(xs[left] >= x0) & (xs[left] <= x1) & (ys[left] >= y0) & (ys[left] <= y1)]
                if len(near):
                    at = locate(self.polys[k], xs[near], ys[near])
                    hit = near[at > 0 if within else at >= 0]
                    out[hit] = k
                    left = left[out[left] < 0]
        return out


def points_in_units(points: DataFrame, units: DataFrame, id_col: str, unit_col: str = "unit_id", cell: float = 1.0, within: bool = False, most_vertices: int = 1_000_000) -> DataFrame:
    """Left join of points (x, y) to the polygon that holds them: adds ``unit_col``, NULL if none.

    Boundaries count unless ``within``. Of several the smallest area wins, then
    the smallest id. Units with ``most_vertices`` corners at most in all, which a
    count shows, go to every task, and the points are not moved at all: only x
    and y go to Python. Beyond that, points and polygons meet by grid cell.
    """
    area = polygon_area(F.col("polygon"))
    corners = F.aggregate("polygon", F.lit(0).cast("long"), lambda n, r: n + F.size(r))
    if (units.agg(F.sum(corners)).first()[0] or 0) > most_vertices:
        return _points_by_cell(points, units, id_col, unit_col, cell, within)
    rows = units.select(F.col(unit_col).alias("unit"), "polygon", area.alias("area"), *[v.alias(k) for k, v in bounds(F.col("polygon")).items()]).orderBy("area", "unit").collect()
    kind = units.schema[unit_col].dataType
    shared = points.sparkSession.sparkContext.broadcast((UnitIndex(rows), pa.array([r["unit"] for r in rows], to_arrow_type(kind))))

    @F.arrow_udf(kind)
    def holder(x: pa.Array, y: pa.Array) -> pa.Array:
        index, names = shared.value
        at = index.find(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), within)
        return names.take(pa.array(at, mask=at < 0))

    return points.withColumn(unit_col, holder(F.col("x").cast("double"), F.col("y").cast("double")))


def _points_by_cell(points: DataFrame, units: DataFrame, id_col: str, unit_col: str, cell: float, within: bool) -> DataFrame:
    """Grid cells make it an equality join; boxes prune before the exact test, which runs on Arrow batches."""
    polys = units.select(F.col(unit_col).alias("_unit"), F.col("polygon").alias("_poly"), polygon_area(F.col("polygon")).alias("_area"))
    box = bounds(F.col("_poly"))
    polys = _cells(polys.withColumns({f"_{k}": v for k, v in box.items()}), {k: F.col(f"_{k}") for k in box}, cell)
    cand = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}).join(polys, ["_cx", "_cy"]).where("x between _x0 and _x1 and y between _y0 and _y1")
    kinds = dict(cand.dtypes)

    def test(batches):
        for b in batches:
            keep = []
            for _, rows in b.groupby("_unit", sort=False):
                at = locate(rows["_poly"].iloc[0], rows["x"].to_numpy(), rows["y"].to_numpy())
                keep.append(rows.loc[at > 0 if within else at >= 0, ["_id", "_unit", "_area"]])
            if keep:
                yield pd.concat(keep)

    hits = cand.select(F.col(id_col).alias("_id"), "x", "y", "_unit", "_poly", "_area").mapInPandas(test, f"_id {kinds[id_col]}, _unit {kinds['_unit']}, _area double")
    best = hits.groupBy("_id").agg(F.min_by("_unit", F.struct("_area", "_unit")).alias(unit_col)).withColumnRenamed("_id", id_col)
    return points.join(best, id_col, "left")


def split_by_mask(points: DataFrame, mask: DataFrame, id_col: str, cell: float = 1.0) -> DataFrame:
    """Adds ``in_mask``: whether any polygon of the mask holds the point."""
    return points_in_units(points, mask, id_col, "_mask_id", cell).withColumn("in_mask", F.col("_mask_id").isNotNull()).drop("_mask_id") if "_mask_id" in mask.columns else split_by_mask(points, mask.withColumn("_mask_id", F.xxhash64(F.to_json("polygon"))), id_col, cell)


def overlay(fine: DataFrame, coarse: DataFrame, fine_id: str, coarse_id: str, cell: float = 1.0) -> DataFrame:
    """(fine_id, coarse_id, area, share): all intersections of positive area; share is of the fine polygon's area."""
    a = fine.select(F.col(fine_id), F.col("polygon").alias("_pa"), polygon_area(F.col("polygon")).alias("_full"))
    b = coarse.select(F.col(coarse_id), F.col("polygon").alias("_pb"))
    ca = _cells(a.withColumns({f"_a{k}": v for k, v in bounds(F.col("_pa")).items()}), bounds(F.col("_pa")), cell)
    cb = _cells(b.withColumns({f"_b{k}": v for k, v in bounds(F.col("_pb")).items()}), bounds(F.col("_pb")), cell)
    pairs = ca.join(cb, ["_cx", "_cy"]).where("_ax0 < _bx1 and _bx0 < _ax1 and _ay0 < _by1 and _by0 < _ay1").dropDuplicates([fine_id, coarse_id])

    @F.pandas_udf(T.DoubleType())
    def shared(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([overlap_area(x, y) for x, y in zip(p, q, strict=True)])

    got = pairs.select(fine_id, coarse_id, "_full", shared("_pa", "_pb").alias("area")).where("area > 0")
    return got.select(fine_id, coarse_id, "area", (F.col("area") / F.col("_full")).alias("share"))


def assign_by_share(overlaps: DataFrame, fine_ids: DataFrame, fine_id: str, coarse_id: str, tolerance: float = 1e-12) -> DataFrame:
    """The coarse unit of the largest share for each fine one; within the tolerance the smallest id; without overlap an explicit status and share 0."""
    top = F.max("share").over(Window.partitionBy(fine_id))
    tied = overlaps.withColumn("_top", top).where(F.col("share") >= F.col("_top") - tolerance)
    w = Window.partitionBy(fine_id)
    pick = tied.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(coarse_id))}).where("_r = 1")
    out = fine_ids.select(fine_id).join(pick, fine_id, "left")
    return out.select(fine_id, coarse_id, F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("_n", F.lit(0)).alias("ties"), (F.coalesce("_n", F.lit(0)) > 1).alias("tie"), F.when(F.col(coarse_id).isNull(), "unassigned_no_overlap").otherwise("max_share").alias("method"))


def share_ranks(overlaps: DataFrame, fine_id: str) -> DataFrame:
    return overlaps.withColumn("share_rank", F.dense_rank().over(Window.partitionBy(fine_id).orderBy(F.desc("share"))))


def closure(overlaps: DataFrame, areas: DataFrame, fine_id: str) -> DataFrame:
    """Sum of intersections, the gap to the full area (never negative) and its fraction."""
    s = overlaps.groupBy(fine_id).agg(F.sum("area").alias("covered"))
    out = areas.join(s, fine_id, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    gap = F.greatest(F.col("full") - F.col("covered"), F.lit(0.0))
    return out.withColumns({"gap": gap, "gap_fraction": F.try_divide(gap, F.col("full"))})


def slivers(overlaps: DataFrame, cuts: list[float], value: str = "share") -> DataFrame:
    """How many overlaps lie at or below each cut."""
    one = overlaps.agg(*[F.count_if(F.col(value) <= c).alias(f"c{i}") for i, c in enumerate(cuts)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"c{i}").alias("n")) for i, c in enumerate(cuts)])).alias("r")).select("r.*")


def queen_edges(units: DataFrame, unit_col: str = "unit_id", cell: float = 1.0) -> DataFrame:
    """(i, j) both ways of units that touch by an edge or a corner; islands have no row."""
    u = units.select(F.col(unit_col).alias("u"), F.col("polygon").alias("p"))
    c = _cells(u.withColumns(bounds(F.col("p"))), bounds(F.col("p")), cell)
    a, b = c.select(*[F.col(k).alias(f"a_{k}") for k in ("u", "p", "x0", "y0", "x1", "y1")], "_cx", "_cy"), c.select(*[F.col(k).alias(f"b_{k}") for k in ("u", "p", "x0", "y0", "x1", "y1")], "_cx", "_cy")
    pairs = a.join(b, ["_cx", "_cy"]).where("a_u < b_u and a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1").dropDuplicates(["a_u", "b_u"])

    @F.pandas_udf(T.BooleanType())
    def touch(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([touches(x, y) for x, y in zip(p, q, strict=True)])

    half = pairs.where(touch("a_p", "b_p")).select(F.col("a_u").alias("i"), F.col("b_u").alias("j"))
    return half.union(half.select("j", "i"))


def anchors(units: DataFrame, unit_col: str = "unit_id") -> DataFrame:
    """(location_id, unit, x, y): an inner point of each polygon; ids count from 1 by unit."""
    kind = dict(units.dtypes)[unit_col]

    def run(batches):
        for b in batches:
            xy = [anchor(p) for p in b["polygon"]]
            yield pd.DataFrame({"u": b["u"], "x": [p[0] for p in xy], "y": [p[1] for p in xy]})

    got = units.select(F.col(unit_col).alias("u"), "polygon").mapInPandas(run, f"u {kind}, x double, y double")
    return got.withColumn("location_id", F.row_number().over(Window.orderBy("u"))).withColumnRenamed("u", unit_col)


def clip_to(units: DataFrame, window: DataFrame, unit_col: str = "unit_id") -> DataFrame:
    """Area of each unit inside the dissolved window; the window's polygons must not overlap each other."""
    w = window.withColumn("_w", F.xxhash64(F.to_json("polygon")))
    got = overlay(units, w, unit_col, "_w").groupBy(unit_col).agg(F.sum("area").alias("area_inside"))
    return units.select(unit_col).join(got, unit_col, "left").withColumn("area_inside", F.coalesce("area_inside", F.lit(0.0)))


def reproject(points: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """Adds east and north (UTM) to lon and lat."""
    schema = T.StructType([*points.schema.fields, T.StructField("east", T.DoubleType()), T.StructField("north", T.DoubleType())])

    def run(batches):
        for b in batches:
            e, n = utm(b["lon"].to_numpy(), b["lat"].to_numpy(), zone, south)
            yield b.assign(east=e, north=n)

    return points.mapInPandas(run, schema)
