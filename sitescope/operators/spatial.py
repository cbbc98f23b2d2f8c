"""Planar spatial operators: tiles, distances, joins by grid cell, areas.

Predicates and measures on axis-parallel rectangles and points are column
expressions, unions of rectangles too.  Polygons of any shape go through one Arrow kernel, a sweep over
vertical slabs, that gives the area of a polygon covered by a union of others
(holes and self-crossing rings by the even-odd rule).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.plans.lineage import cut

EARTH_M = 6_371_000.0
MAX_LAT = 85.05112878
MERCATOR_R = 6378137.0


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(a)) * (2 * EARTH_M)


def flat_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres on a plane at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * 111_320.0
    return F.hypot(dx, (lat2 - lat1) * 110_540.0)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    lat = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    return F.floor((1.0 - F.ln(F.tan(lat) + 1.0 / F.cos(lat)) / F.lit(np.pi)) / 2.0 * float(1 << zoom)).cast("long")


def tiles(df: DataFrame, west: str, south: str, east: str, north: str, zoom: int) -> DataFrame:
    """A row for each tile that a box touches; boxes that aren't on the globe
    have none."""
    n = 1 << zoom
    ok = F.lit(True)
    for c, most in ((west, 180.0), (east, 180.0), (south, 90.0), (north, 90.0)):
        ok = ok & F.col(c).between(-most, most)
    df = df.where(ok)
    def clip(c):
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), c))
    df = df.withColumn("tx", F.explode(F.sequence(clip(tile_x(F.col(west), zoom)), clip(tile_x(F.col(east), zoom)))))
    return df.withColumn("ty", F.explode(F.sequence(clip(tile_y(F.col(north), zoom)), clip(tile_y(F.col(south), zoom)))))


def mercator_cell(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    x = F.radians(lon) * MERCATOR_R
    y = F.asinh(F.tan(F.radians(lat))) * MERCATOR_R
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def cell_corner(cx: Column, cy: Column, size: float) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's lower left corner."""
    return F.degrees(cx * size / MERCATOR_R), F.degrees(F.atan(F.sinh(cy * size / MERCATOR_R)))


def with_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """A row for each grid cell that a box overlaps."""
    def cell(c):
        return F.floor(c / size).cast("long")
    return df.withColumn("_gx", F.explode(F.sequence(cell(x0), cell(x1)))).withColumn("_gy", F.explode(F.sequence(cell(y0), cell(y1))))


def box_join(left: DataFrame, right: DataFrame, lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str], size: float) -> DataFrame:
    """Pairs of overlapping boxes (closed), each once: an equi-join on grid
    cells; a pair counts in the cell of its common lower left corner alone."""
    a = with_cells(left, *[F.col(c) for c in lbox], size)
    b = with_cells(right, *[F.col(c) for c in rbox], size)
    j = a.join(b, ["_gx", "_gy"])
    lx, ly = F.greatest(F.col(lbox[0]), F.col(rbox[0])), F.greatest(F.col(lbox[1]), F.col(rbox[1]))
    hx, hy = F.least(F.col(lbox[2]), F.col(rbox[2])), F.least(F.col(lbox[3]), F.col(rbox[3]))
    return j.where((lx <= hx) & (ly <= hy) & (F.floor(lx / size) == F.col("_gx")) & (F.floor(ly / size) == F.col("_gy"))).drop("_gx", "_gy")


def radius_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float) -> DataFrame:
    """Point pairs within a distance: each left point looks at 3 x 3 cells."""
    a = with_cells(left, F.col(lx) - radius, F.col(ly) - radius, F.col(lx) + radius, F.col(ly) + radius, radius)
    b = right.withColumn("_gx", F.floor(F.col(rx) / radius).cast("long")).withColumn("_gy", F.floor(F.col(ry) / radius).cast("long"))
    d = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    return a.join(b, ["_gx", "_gy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_gx", "_gy")


def nearest(left: DataFrame, right: DataFrame, key: str, lx: str, ly: str, rkey: str, rx: str, ry: str, radius: float) -> DataFrame:
    """The nearest right point of each left one: (key, rkey, distance).

    Rounds with a growing radius; a point leaves when it has found one, so
    the last rounds are few points against coarse cells.  A point without
    coordinates has no nearest one: nulls.
    """
    placed = F.col(lx).isNotNull() & F.col(ly).isNotNull()
    open_, found = left.select(key, lx, ly).where(placed), None
    r = right.select(rkey, rx, ry)
    n_open = open_.count()
    for step in range(24):
        pairs = radius_join(open_, r, lx, ly, rx, ry, radius * 2**step)
        best = pairs.groupBy(key).agg(F.min(F.struct("distance", rkey)).alias("m")).select(key, F.col(f"m.{rkey}").alias(rkey), F.col("m.distance").alias("distance"))
        best = cut(best)
        found = best if found is None else found.unionByName(best)
        n_open -= best.count()
        if n_open <= 0 or right.isEmpty():
            break
        open_ = cut(open_.join(best, key, "left_anti"))
    nowhere = left.where(~placed).select(key, F.lit(None).cast(right.schema[rkey].dataType).alias(rkey), F.lit(None).cast("double").alias("distance"))
    return found.unionByName(nowhere)


def _boxes_area(boxes: Column) -> Column:
    """Area of the union of boxes (y0, y1, x0, x1), none of them flat: a sweep
    over the slabs between their distinct x, merging intervals of y in order."""
    in_order = F.sort_array(boxes)
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"]))))

    def height(lo: Column, hi: Column) -> Column:
        def take(acc: Column, b: Column) -> Column:
            more = F.greatest(b["y1"] - F.greatest(acc["top"], b["y0"]), b["y0"] - b["y0"])
            grown = F.struct((acc["sum"] + more).alias("sum"), F.greatest(acc["top"], b["y1"]).alias("top"))
            return F.when((b["x0"] <= lo) & (b["x1"] >= hi), grown).otherwise(acc)
        y = in_order[0]["y0"]
        return F.aggregate(in_order, F.struct((y - y).alias("sum"), y.alias("top")), take, lambda acc: acc["sum"])

    slabs = F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda lo, hi: ((hi - lo) * height(lo, hi)).cast("double"))
    return F.aggregate(slabs, F.lit(0.0), lambda acc, v: acc + v)


def outermost(boxes: DataFrame, box: tuple[str, str, str, str], by: list[str]) -> DataFrame:
    """Distinct boxes of each ``by`` that lie in no other one with the same
    lower left corner; their union is that of all."""
    x0, y0, x1, y1 = box
    tallest = boxes.groupBy(*by, x0, y0, x1).agg(F.max(y1).alias(y1))
    wider = Window.partitionBy(*by, x0, y0).orderBy(F.col(x1).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = tallest.withColumn("_top", F.max(y1).over(wider))
    return out.where(F.col("_top").isNull() | (F.col(y1) > F.col("_top"))).drop("_top")


def union_area(pairs: DataFrame, base: tuple[str, str, str, str], box: tuple[str, str, str, str], keys: list[str], out: str = "covered") -> DataFrame:
    """``keys`` and the area of box ``base`` (in ``keys``) that the union of the
    boxes paired with it covers; bases of which nothing is covered are left out."""
    x0, y0 = (F.greatest(base[i], box[i]) for i in (0, 1))
    x1, y1 = (F.least(base[i], box[i]) for i in (2, 3))
    clipped = F.struct(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))
    g = pairs.where((x0 < x1) & (y0 < y1)).groupBy(*keys).agg(F.collect_set(clipped).alias("_boxes"))
    area = ((F.col(base[2]) - F.col(base[0])) * (F.col(base[3]) - F.col(base[1]))).cast("double")
    one = F.col("_boxes")[0]
    whole = F.exists("_boxes", lambda b: (b["x0"] == F.col(base[0])) & (b["x1"] == F.col(base[2])) & (b["y0"] == F.col(base[1])) & (b["y1"] == F.col(base[3])))
    covered = F.when(whole, area).when(F.size("_boxes") == 1, ((one["x1"] - one["x0"]) * (one["y1"] - one["y0"])).cast("double")).otherwise(_boxes_area(F.col("_boxes")))
    return g.withColumn(out, covered).drop("_boxes")


# ---------------------------------------------------------------- polygons

def slab_area(base: list[np.ndarray], others: list[list[np.ndarray]]) -> float:
    """Area of ``base`` (rings) that the union of ``others`` covers."""
    def edges(rings: list[np.ndarray]) -> np.ndarray:
        out = []
        for r in rings:
            r = np.asarray(r, float)
            if len(r) and not np.array_equal(r[0], r[-1]):
                r = np.vstack([r, r[:1]])
            out += [np.hstack([r[:-1], r[1:]])]
        e = np.vstack(out) if out else np.zeros((0, 4))
        e = e[e[:, 0] != e[:, 2]]
        flip = e[:, 0] > e[:, 2]
        e[flip] = e[flip][:, [2, 3, 0, 1]]
        return e

    sets = [edges(base), *[edges(o) for o in others]]
    every = np.vstack(sets)
    owner = np.concatenate([np.full(len(e), i) for i, e in enumerate(sets)])
    if not len(every) or not len(sets[0]):
        return 0.0
    xs = [every[:, 0], every[:, 2]]
    slope = (every[:, 3] - every[:, 1]) / (every[:, 2] - every[:, 0])
    at0 = every[:, 1] - slope * every[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (at0[None, :] - at0[:, None]) / (slope[:, None] - slope[None, :])
    lo, hi = np.maximum(every[:, None, 0], every[None, :, 0]), np.minimum(every[:, None, 2], every[None, :, 2])
    xs.append(cross[np.isfinite(cross) & (cross > lo) & (cross < hi)])
    cuts = np.unique(np.concatenate(xs))
    area = 0.0
    for a, b in zip(cuts, cuts[1:], strict=False):
        mid = (a + b) / 2
        live = (every[:, 0] <= a) & (every[:, 2] >= b)
        y = slope[live] * mid + at0[live]
        order = np.argsort(y, kind="stable")
        inside: dict[int, bool] = {}
        last = None
        for k in order:
            if last is not None and inside.get(0) and any(v for o, v in inside.items() if o):
                area += (y[k] - last) * (b - a)
            o = int(owner[live][k])
            inside[o] = not inside.get(o, False)
            last = y[k]
    return float(area)


def ring_area(ring: np.ndarray) -> float:
    r = np.asarray(ring, float)
    x, y = r[:, 0], r[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def representative_point(rings: list[np.ndarray]) -> tuple[float, float] | None:
    """A point inside: the middle of the widest stretch of a line at mid-height."""
    pts = np.vstack([np.asarray(r, float) for r in rings]) if rings else np.zeros((0, 2))
    if not len(pts):
        return None
    ys = np.unique(pts[:, 1])
    if len(ys) < 2:
        return float(pts[:, 0].mean()), float(pts[:, 1].mean())
    mid = (ys[0] + ys[-1]) / 2
    below, above = ys[ys <= mid], ys[ys > mid]
    y = (below[-1] + above[0]) / 2
    xs = []
    for r in rings:
        r = np.asarray(r, float)
        nxt = np.roll(r, -1, axis=0)
        hit = (r[:, 1] > y) != (nxt[:, 1] > y)
        a, b = r[hit], nxt[hit]
        xs += (a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).tolist()
    xs.sort()
    spans = list(zip(xs[::2], xs[1::2], strict=False))
    a, b = max(spans, key=lambda s: s[1] - s[0])
    return (a + b) / 2, float(y)


def disc(x: float, y: float, radius: float, sides: int = 64) -> np.ndarray:
    t = np.arange(sides) * (2 * np.pi / sides)
    return np.stack([x + radius * np.cos(t), y - radius * np.sin(t)], axis=1)


_RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))


def covered_area(df: DataFrame, base: str, others: str, out: str = "covered") -> DataFrame:
    """Adds the area of polygon ``base`` (rings of points) covered by the
    union of the polygons in array ``others``."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(df.schema.fields)).add(out, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x, o = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (base, others))
            got = [None if p is None else slab_area([np.array(r) for r in p], [[np.array(r) for r in q] for q in qs or []]) for p, qs in zip(x, o, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    def pt(x, y):
        return F.array(x.cast("double"), y.cast("double"))
    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)))


def coverage_state(coverage: Column) -> Column:
    c = F.when(F.abs(coverage - 1) <= 1e-9, 1.0).otherwise(coverage)
    return F.when(c <= 0, "unknown").when(c == 1, "known").otherwise("partial")


# ---------------------------------------------------------------- projection

def transverse_mercator(lon: Column, lat: Column, central: float, scale: float = 1.0, false_east: float = 500_000.0) -> tuple[Column, Column]:
    """Easting and northing on GRS80 by the Krueger series to the third order."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = (f * (2 - f)) ** 0.5
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, c in enumerate(alpha, 1):
        north = north + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * c
        east = east + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * c
    return east * (scale * a) + false_east, north * (scale * a)
