"""Points near other points or inside regions, by hashed grid cells and an exact test."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motespark.common import need, present

EARTH_KM = 6371.0088


def _cells(df: DataFrame, size: float, radius: float) -> tuple[DataFrame, DataFrame]:
    """(home, spread): each point once in its own cell; and in that cell and those forward cells within ``radius``.

    Forward cells are right, and the three above; with the own cell they meet every pair of neighbours once.
    """
    cx, cy = F.floor(F.col("px") / F.lit(size)).cast("bigint"), F.floor(F.col("py") / F.lit(size)).cast("bigint")
    home = df.withColumns({"cx": cx, "cy": cy})
    r = F.lit(radius * (1 + 1e-9) + 1e-9)
    right = (F.col("cx") + 1) * F.lit(size) - F.col("px") <= r
    left = F.col("px") - F.col("cx") * F.lit(size) <= r
    up = (F.col("cy") + 1) * F.lit(size) - F.col("py") <= r
    at = lambda dx, dy: F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"))
    targets = F.array(
        at(0, 0), F.when(right, at(1, 0)), F.when(up, at(0, 1)), F.when(up & right, at(1, 1)), F.when(up & left, at(-1, 1))
    )
    spread = home.withColumn("_c", F.explode(F.filter(targets, lambda t: t.isNotNull())))
    spread = spread.withColumns({"own": (F.col("_c.cx") == F.col("cx")) & (F.col("_c.cy") == F.col("cy"))}).withColumns({"cx": F.col("_c.cx"), "cy": F.col("_c.cy")}).drop("_c")
    return home, spread


def near_pairs(df: DataFrame, groups: Sequence[str], ident: str, x: str, y: str, radius: float, cell: float | None = None) -> DataFrame:
    """All pairs of different idents of one group at a Euclidean distance of at most ``radius``.

    Points are hashed to square cells of side ``cell`` (at least ``radius``; twice it by default). A point visits its
    own cell and those of four forward neighbours whose border is within ``radius``; an equi-join on (groups, cell)
    proposes pairs and the squared distance decides. Cells of a dense group spread over all tasks, and adaptive
    execution splits a crowded one.

    Points with a NULL or NaN coordinate or a NULL ident or group match nothing. Repeated rows (same groups, ident, x
    and y) are one; an ident with several positions is paired by each, its closest distance is kept. Coincident
    points of different idents are a pair at 0. Returns groups, ``id_a`` < ``id_b``, ``distance``.
    """
    groups = list(groups)
    need(df, *groups, ident, x, y)
    if not radius >= 0:
        raise ValueError("radius must be at least 0")
    size = cell or max(2 * radius, 1e-9)
    if size < radius:
        raise ValueError("cell must be at least radius")
    ok = present(x, y) & F.col(ident).isNotNull()
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    gs = [f"g{i}" for i in range(len(groups))]
    pts = df.where(ok).select(*[F.col(g).alias(a) for g, a in zip(groups, gs)], F.col(ident).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    home, spread = _cells(pts, size, radius)
    a = spread.select(*gs, "cx", "cy", "own", F.col("id").alias("ia"), F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = home.select(*gs, "cx", "cy", F.col("id").alias("ib"), F.col("px").alias("bx"), F.col("py").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    d2 = dx * dx + dy * dy
    # never NULL, but compared null-safe, which puts no filter of its own on one side: both sides read one shuffle
    on = F.lit(True)
    for c in [*gs, "cx", "cy"]:
        on = on & a[c].eqNullSafe(b[c])
    pairs = a.join(b, on).drop(*[b[c] for c in (*gs, "cx", "cy")]).where((F.col("ia") != F.col("ib")) & (~F.col("own") | (F.col("ia") < F.col("ib"))) & (d2 <= F.lit(radius * radius)))
    return pairs.select(
        *[F.col(g).alias(n) for g, n in zip(gs, groups)], F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), F.sqrt(d2).alias("distance")
    )


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance in kilometres of points in degrees."""
    p, q = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near_pairs_geo(df: DataFrame, groups: Sequence[str], ident: str, lat: str, lon: str, km: float) -> DataFrame:
    """Pairs of idents of one group within ``km`` kilometres on the sphere.

    The sphere is embedded in three dimensions: a great-circle distance bounds the chord, so cubes of twice the chord
    find every pair in neighbouring cubes within reach, across the date line and at the poles too. The haversine formula decides. Points
    outside -90..90 latitude or with missing coordinates match nothing; longitudes are taken modulo 360.
    """
    groups = list(groups)
    need(df, *groups, ident, lat, lon)
    if not 0 < km <= 20000:
        raise ValueError("km must be in (0, 20000]")
    ok = present(lat, lon) & F.col(lat).between(-90, 90) & F.col(ident).isNotNull()
    gs = [f"g{i}" for i in range(len(groups))]
    chord = 2 * EARTH_KM * math.sin(min(km / EARTH_KM / 2, math.pi / 2)) * (1 + 1e-9) + 1e-9
    p, q = F.radians("lat"), F.radians("lon")
    pts = df.where(ok).select(*[F.col(g).alias(a) for g, a in zip(groups, gs)], F.col(ident).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).distinct()
    axes = {"x": F.cos(p) * F.cos(q), "y": F.cos(p) * F.sin(q), "z": F.sin(p)}
    # cubes of twice the chord: in each axis at most one neighbour is within reach, about three cubes in all
    size = F.lit(2 * chord / EARTH_KM)
    slack = F.lit(chord / EARTH_KM * (1 + 1e-9) + 1e-12)
    home = pts.withColumns(axes).withColumns({f"c{k}": F.floor(F.col(k) / size).cast("bigint") for k in axes})
    visit = home
    for k in axes:
        c, at = F.col(f"c{k}"), F.col(k)
        within = F.array(c, F.when(at - c * size <= slack, c - 1), F.when((c + 1) * size - at <= slack, c + 1))
        visit = visit.withColumn(f"c{k}", F.explode(F.filter(within, lambda v: v.isNotNull())))
    cells = [*gs, "cx", "cy", "cz"]
    a = visit.select(*cells, F.col("id").alias("id_a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = home.select(*cells, F.col("id").alias("id_b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    d = great_circle_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))
    out = a.join(b, cells).where(F.col("id_a") < F.col("id_b")).withColumn("distance", d).where(F.col("distance") <= km)
    return out.select(*[F.col(g).alias(n) for g, n in zip(gs, groups)], "id_a", "id_b", "distance")


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring, an array of structs (x, y); the last vertex joins the first.

    A point on a lower or left edge counts as inside, on an upper or right one as outside, so regions that share a
    border share no point.
    """
    n = F.size(ring)

    def crosses(v: Column, i: Column) -> Column:
        w = F.element_at(ring, F.when(i + 1 < n, i + 2).otherwise(F.lit(1)))
        spans = (v["y"] > py) != (w["y"] > py)
        at = v["x"] + (py - v["y"]) / (w["y"] - v["y"]) * (w["x"] - v["x"])
        return F.when(spans & (px < at), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, c: s + c)
    return hits % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame, groups: Sequence[str], ident: str, x: str, y: str, region: str, ring: str, cell: float) -> DataFrame:
    """The regions (rings of the same group) that contain each point: groups, ident, region.

    A region is entered into every cell of side ``cell`` that its bounding box meets, points are hashed to their cell,
    an equi-join on (groups, cell) proposes and the exact ring test decides. Rings of fewer than three vertices or
    NULL contain nothing; a point in several regions gives several rows, one in none gives none. Repeated rows are
    one.
    """
    groups = list(groups)
    need(points, *groups, ident, x, y)
    need(regions, *groups, region, ring)
    gs = [f"g{i}" for i in range(len(groups))]
    c = lambda v: F.floor(v / F.lit(cell)).cast("bigint")
    r = regions.where(F.size(ring) >= 3).select(*[F.col(g).alias(a) for g, a in zip(groups, gs)], F.col(region).alias("region"), F.col(ring).alias("ring"))
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    r = r.withColumn("cx", F.explode(F.sequence(c(F.array_min(xs)), c(F.array_max(xs))))).withColumn("cy", F.explode(F.sequence(c(F.array_min(ys)), c(F.array_max(ys)))))
    p = points.where(present(x, y)).select(*[F.col(g).alias(a) for g, a in zip(groups, gs)], F.col(ident).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    p = p.withColumns({"cx": c(F.col("px")), "cy": c(F.col("py"))})
    hit = p.join(r, [*gs, "cx", "cy"]).where(in_ring(F.col("px"), F.col("py"), F.col("ring")))
    return hit.select(*[F.col(g).alias(n) for g, n in zip(gs, groups)], F.col("id").alias(ident), "region").distinct()
