"""Static and spatial analysis of features: neighbours, pair correlation, clusters.

Distances are found by hashing points to grid cells and joining cells, in two or three dimensions, always within the
``groups`` (a frame, or a movie's frame). Rows with a missing coordinate take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motespark.common import cut, need, present
from motespark.operators.assignment import neighbours
from motespark.operators.components import connected_components, roots

#: side of a region whose close pairs meet in one task, in separations
TILE = 64.0


def _points(df: DataFrame, groups: Sequence[str], ident: str, pos: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    need(df, *groups, ident, *pos)
    cols = [*groups, F.col(ident).alias("id"), *[F.col(p).cast("double").alias(f"p{i}") for i, p in enumerate(pos)]]
    return df.where(present(*pos) & F.col(ident).isNotNull()).select(*cols, *[v.alias(k) for k, v in (extra or {}).items()])


def pairs_within(pts: DataFrame, groups: Sequence[str], ndim: int, radius: float, ordered: bool = False, keep: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Pairs of a ``_points`` table within ``radius``: groups, a_*, b_*, ``dist``. Ordered pairs come in both orders.

    Cells are twice as wide as the radius; a point visits a neighbouring cell only if that is within reach, about
    2**ndim cells in all.
    """
    size = max(2.0 * radius, 1e-9)
    r = radius * (1 + 1e-9) + 1e-12
    cells = [f"c{i}" for i in range(ndim)]
    home = pts.withColumns({f"c{i}": F.floor(F.col(f"p{i}") / F.lit(size)).cast("bigint") for i in range(ndim)})
    visit = home
    for i in range(ndim):
        c, p = F.col(f"c{i}"), F.col(f"p{i}")
        reach = F.array(c, F.when(p - c * F.lit(size) <= r, c - 1), F.when((c + 1) * F.lit(size) - p <= r, c + 1))
        visit = visit.withColumn(f"c{i}", F.explode(F.filter(reach, lambda v: v.isNotNull())))
    cols = ["id", *[f"p{i}" for i in range(ndim)], *keep]
    a = visit.select(*groups, *cells, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = home.select(*groups, *cells, *[F.col(c).alias(f"b_{c}") for c in cols])
    d2 = sum((F.pow(F.col(f"a_p{i}") - F.col(f"b_p{i}"), 2) for i in range(1, ndim)), F.pow(F.col("a_p0") - F.col("b_p0"), 2))
    which = (F.col("a_id") != F.col("b_id")) if ordered else (F.col("a_id") < F.col("b_id"))
    near = a.join(b, [*groups, *cells]).where(which).withColumn("dist", F.sqrt(d2)).drop(*cells)
    return near.where((F.col("dist") <= radius) if inclusive else (F.col("dist") < radius))


def proximity(df: DataFrame, groups: Sequence[str], ident: str, pos: Sequence[str] = ("x", "y"), cell: float | None = None) -> DataFrame:
    """Distance of every feature to its nearest other one in its group; NULL if it is alone.

    The first pass looks within a radius of twice the group's mean spacing (or ``cell``); features without a neighbour
    there look again within four times as far, and so on. Later passes hold the isolated features only. Coincident
    features have 0.
    """
    groups, ndim = list(groups), len(pos)
    if not groups:
        df, groups = df.withColumn("_all", F.lit(0)), ["_all"]
    pts = _points(df, groups, ident, pos)
    n, extent = F.count(F.lit(1)), [F.greatest(F.max(f"p{i}") - F.min(f"p{i}"), F.lit(1e-6)) for i in range(ndim)]
    volume = extent[0]
    for e in extent[1:]:
        volume = volume * e
    # features along a line have the spacing of its length
    spacing = F.lit(float(cell)) if cell else F.lit(2.0) * F.greatest(F.pow(volume / n, F.lit(1.0 / ndim)), *[e / n for e in extent])
    stats = pts.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.greatest(spacing, F.lit(1e-6)).alias("r"))
    every = cut(pts.join(stats, groups))
    out = every.where("_n = 1").select(*groups, "id", F.lit(None).cast("double").alias("proximity"))
    every = every.where("_n > 1").drop("_n")
    left = every
    while True:
        near = cut(left.join(_nearest(left, every, groups, ndim), [*groups, "id"], "left"))
        out = out.unionByName(near.where("proximity is not null").select(*groups, "id", "proximity"))
        left, every = near.where("proximity is null").drop("proximity").withColumn("r", F.col("r") * 4), every.withColumn("r", F.col("r") * 4)
        if left.isEmpty():
            return out.withColumnRenamed("id", ident).drop("_all")


def _nearest(some: DataFrame, every: DataFrame, groups: list[str], ndim: int) -> DataFrame:
    """Nearest other point within the group's radius ``r``."""
    cells = [f"c{i}" for i in range(ndim)]
    at = lambda d: d.withColumns({f"c{i}": F.floor(F.col(f"p{i}") / F.col("r")).cast("bigint") for i in range(ndim)})
    a = at(some).select(*groups, *cells, "r", F.col("id").alias("a_id"), *[F.col(f"p{i}").alias(f"a{i}") for i in range(ndim)])
    for c in cells:
        a = a.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    b = at(every).select(*groups, *cells, F.col("id").alias("b_id"), *[F.col(f"p{i}").alias(f"b{i}") for i in range(ndim)])
    d2 = sum((F.pow(F.col(f"a{i}") - F.col(f"b{i}"), 2) for i in range(1, ndim)), F.pow(F.col("a0") - F.col("b0"), 2))
    j = a.join(b, [*groups, *cells]).where(F.col("a_id") != F.col("b_id")).withColumn("d", F.sqrt(d2)).where(F.col("d") <= F.col("r"))
    return j.groupBy(*groups, F.col("a_id").alias("id")).agg(F.min("d").alias("proximity"))


def circle_cap_arclen(h: Column, r: Column) -> Column:
    """Arc of a circle of radius r beyond a line at distance h < r from its centre."""
    return 2 * r * F.acos(h / r)


def circle_corner_arclen(h1: Column, h2: Column, r: Column) -> Column:
    """Arc beyond two perpendicular lines at distances h1, h2 with h1² + h2² < r²."""
    return r * (F.acos(h2 / r) - F.asin(h1 / r))


def sphere_cap_area(h: Column, r: Column) -> Column:
    return 2 * math.pi * r * (r - h)


def sphere_edge_area(x: Column, y: Column, r: Column) -> Column:
    """Area of a sphere beyond two perpendicular planes at distances x, y with x² + y² < r²."""
    p = F.sqrt(r * r - x * x - y * y)
    return r * ((r - x - y) * math.pi - 2 * r * F.atan(x * y / (p * r)) + 2 * x * F.atan(y / p) + 2 * y * F.atan(x / p))


def sphere_corner_area(x: Column, y: Column, z: Column, r: Column) -> Column:
    """Area of a sphere beyond three perpendicular planes with x² + y² + z² < r²."""
    root = lambda u, v: F.sqrt(r * r - u * u - v * v)
    pxy, pyz, pxz = root(x, y), root(y, z), root(x, z)
    area = (r - x - y - z) * (math.pi / 2)
    for u, (v, pv), (w, pw) in ((x, (y, pxy), (z, pxz)), (y, (x, pxy), (z, pyz)), (z, (x, pxz), (y, pyz))):
        area = area + u * (F.atan(v / pv) + F.atan(w / pw))
    for u, v, p in ((y, z, pyz), (x, z, pxz), (x, y, pxy)):
        area = area - r * F.atan(u * v / (r * p))
    return area * r


def arclen_2d_bounded(dist: Column, pos: Sequence[Column], box: Sequence[tuple[Column, Column]]) -> Column:
    """Length of the circle of radius dist around pos inside the box; NULL if hardly any."""
    sides = [(p - lo, hi - p) for p, (lo, hi) in zip(pos, box)]
    out = 2 * math.pi * dist
    for h in (h for s in sides for h in s):
        out = out - F.when(h < dist, circle_cap_arclen(h, dist)).otherwise(F.lit(0.0))
    for h1 in sides[0]:
        for h2 in sides[1]:
            out = out + F.when(h1 * h1 + h2 * h2 < dist * dist, circle_corner_arclen(h1, h2, dist)).otherwise(F.lit(0.0))
    return F.when(out >= 1e-5 * dist, out)


def area_3d_bounded(dist: Column, pos: Sequence[Column], box: Sequence[tuple[Column, Column]]) -> Column:
    """Area of the sphere of radius dist around pos inside the box; NULL if hardly any."""
    sides = [(p - lo, hi - p) for p, (lo, hi) in zip(pos, box)]
    flat = [h for s in sides for h in s]

    def total(parts: list[tuple[Column, ...]], area) -> Column:
        # one expression over an array keeps the generated code small
        rows = F.array(*[F.struct(*[h.alias(n) for h, n in zip(hs, "uvw")]) for hs in parts])

        def add(acc: Column, s: Column) -> Column:
            h = [s[n] for n in "uvw"[: len(parts[0])]]
            inside = sum((x * x for x in h[1:]), h[0] * h[0]) < dist * dist
            return acc + F.when(inside, area(*h, dist)).otherwise(F.lit(0.0))

        return F.aggregate(rows, F.lit(0.0), add)

    out = 4 * math.pi * dist * dist
    for h in flat:
        out = out - F.when(h < dist, sphere_cap_area(h, dist)).otherwise(F.lit(0.0))
    out = out + total([(h1, h2) for s, t in combinations(sides, 2) for h1 in s for h2 in t], sphere_edge_area)
    out = out - total(list(product(*sides)), sphere_corner_area)
    out = F.when(F.least(*flat) >= dist, 4 * math.pi * dist * dist).otherwise(out)
    return F.when(out >= 1e-7 * dist * dist, out)


def pair_correlation(
    df: DataFrame, groups: Sequence[str], ident: str, pos: Sequence[str], cutoff: float, dr: float = 0.5, boundary: Sequence[tuple[float, float]] | None = None,
    ndensity: float | None = None, handle_edge: bool = True, fraction: float = 1.0, seed: int = 0, subset: Column | None = None,
) -> DataFrame:
    """Pair correlation function g(r) of every group: groups, ``bin``, ``r`` (left edge), ``g_r``; all bins up to cutoff.

    ``boundary`` (one (low, high) for each axis) drops features outside and defaults to the group's bounding box;
    ``ndensity`` defaults to (n - 1) / its size. Pairs at distance 0 < d < cutoff weigh 1 / (arc or area of the circle
    or sphere inside the boundary), with ``handle_edge``. ``fraction`` or ``subset`` (a condition) limits the features
    that g(r) is measured around. Groups with no extent or one feature give NULL or 0.
    """
    groups, ndim = list(groups), len(pos)
    around = subset if subset is not None else (F.rand(seed) < fraction if fraction < 1 else F.lit(True))
    pts = _points(df, groups, ident, pos, {"ref": around})
    if fraction < 1:
        pts = cut(pts)
    if boundary is not None:
        for i, (lo, hi) in enumerate(boundary):
            pts = pts.where(F.col(f"p{i}").between(lo, hi))
    lim = [f(f"p{i}").alias(f"{k}{i}") for i in range(ndim) for f, k in ((F.min, "lo"), (F.max, "hi"))] if boundary is None else []
    stats = pts.groupBy(*groups).agg(*lim, F.count(F.lit(1)).alias("n"), F.sum(F.col("ref").cast("int")).alias("n_ref"))
    if boundary is not None:
        stats = stats.withColumns({f"{k}{i}": F.lit(float(boundary[i][j])) for i in range(ndim) for j, k in enumerate(("lo", "hi"))})
    volume = F.lit(1.0)
    for i in range(ndim):
        volume = volume * (F.col(f"hi{i}") - F.col(f"lo{i}"))
    nd = F.lit(float(ndensity)) if ndensity is not None else (F.col("n") - 1) / F.when(volume > 0, volume)
    stats = stats.withColumn("nd", nd)
    box_cols = [f"{k}{i}" for i in range(ndim) for k in ("lo", "hi")]
    near = pairs_within(pts, groups, ndim, float(cutoff), ordered=True, keep=["ref"], inclusive=False).where("dist > 0 and a_ref")
    near = near.join(stats.select(*groups, *box_cols), groups) if groups else near.join(F.broadcast(stats.select(*box_cols)))
    at, box = [F.col(f"a_p{i}") for i in range(ndim)], [(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(ndim)]
    d = F.col("dist")
    if handle_edge:
        size = arclen_2d_bounded(d, at, box) if ndim == 2 else area_3d_bounded(d, at, box)
    else:
        size = 2 * math.pi * d if ndim == 2 else 4 * math.pi * d * d
    hist = near.groupBy(*groups, F.floor(d / dr).cast("int").alias("bin")).agg(F.sum(1 / size).alias("w"))
    bins = max(1, math.ceil(cutoff / dr))
    full = stats.select(*groups, "n_ref", "nd").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = full.join(hist, [*groups, "bin"], "left")
    below = F.col("nd") * F.col("n_ref") * F.lit(dr)
    return out.select(*groups, "bin", (F.col("bin") * F.lit(dr)).alias("r"), (F.coalesce("w", F.lit(0.0)) / F.when(below != 0, below)).alias("g_r"))


def pair_correlation_2d(df: DataFrame, groups: Sequence[str], ident: str, cutoff: float, **kw) -> DataFrame:
    """``pair_correlation`` in x and y."""
    return pair_correlation(df, groups, ident, ["x", "y"], cutoff, **kw)


def pair_correlation_3d(df: DataFrame, groups: Sequence[str], ident: str, cutoff: float, pos: Sequence[str] = ("x", "y", "z"), **kw) -> DataFrame:
    """``pair_correlation`` in x, y and z."""
    return pair_correlation(df, groups, ident, list(pos), cutoff, **kw)


def cluster(df: DataFrame, groups: Sequence[str], ident: str, separation: float | Sequence[float], pos: Sequence[str] = ("y", "x")) -> DataFrame:
    """``df`` with ``cluster`` (its least ident) and ``cluster_size``: single linkage within the groups at scaled distance <= 1.

    ``ident`` must be unique. Close pairs are edges of a graph whose components are found in rounds of joins, so a
    frame of any size works. Features with a missing position are clusters of their own.
    """
    pos, groups = list(pos), list(groups)
    sep = list(separation) if hasattr(separation, "__iter__") else [separation] * len(pos)
    pts = _points(df, groups, ident, pos)
    pts = pts.withColumns({f"p{i}": F.col(f"p{i}") / F.lit(float(s)) for i, s in enumerate(sep)})
    tiles = [F.floor(F.col(f"a_p{i}") / F.lit(TILE)).alias(f"tile{i}") for i in range(len(pos))]
    edges = pairs_within(pts, groups, len(pos), 1.0).select(F.xxhash64(*groups, *tiles).alias("tile"), F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"))
    comp = connected_components(edges, near=["tile"])
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    member = comp.join(sizes, "component").select(F.col("id").alias(ident), "component", "_size")
    out = df.join(member, ident, "left")
    return out.select(*df.columns, F.coalesce("component", F.col(ident)).alias("cluster"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("cluster_size"))


def cluster_iter(tables: Iterable[pd.DataFrame], separation: float | Sequence[float], pos: Sequence[str] = ("y", "x")) -> Iterator[pd.DataFrame]:
    """The tables of a stream, one for each frame, with ``cluster`` and ``cluster_size``.

    Clusters are numbered from 0 through the whole stream, by their first row. A missing position is a cluster of its own.
    """
    pos, next_ = list(pos), 0
    for f in tables:
        at = f[pos].to_numpy(dtype=float) / np.asarray(separation, dtype=float)
        ok = np.flatnonzero(np.isfinite(at).all(axis=1))
        a, b, d = neighbours(at[ok], at[ok], 1.0, None)
        near = d <= 1.0
        _, number, size = np.unique(roots(ok[a[near]], ok[b[near]], len(f)), return_inverse=True, return_counts=True)
        yield f.assign(cluster=number + next_, cluster_size=size[number])
        next_ += len(size)


def where_close(df: DataFrame, groups: Sequence[str], ident: str, separation: float | Sequence[float], pos: Sequence[str] = ("y", "x"), intensity: str | None = None) -> DataFrame:
    """Idents to drop: of every pair closer than ``separation`` the dimmer, of equals the one of smaller coordinate sum, then of greater ident."""
    pos, groups = list(pos), list(groups)
    sep = list(separation) if hasattr(separation, "__iter__") else [separation] * len(pos)
    if any(s == 0 for s in sep):
        return df.select(*groups, ident).limit(0)
    pts = _points(df, groups, ident, pos, {"glow": F.col(intensity).cast("double") if intensity else F.lit(0.0)})
    pts = pts.withColumns({f"p{i}": F.col(f"p{i}") / F.lit(float(s)) for i, s in enumerate(sep)})
    near = pairs_within(pts, groups, len(pos), 1 - 1e-7, keep=["glow"])
    total = lambda s: sum((F.col(f"{s}_p{i}") for i in range(1, len(pos))), F.col(f"{s}_p0"))
    glow = F.when(F.col("a_glow") != F.col("b_glow"), F.col("a_glow") < F.col("b_glow"))
    drop_a = F.coalesce(glow, F.when(total("a") != total("b"), total("a") < total("b")), F.lit(False))
    return near.select(*groups, F.when(drop_a, F.col("a_id")).otherwise(F.col("b_id")).alias(ident)).distinct()


def drop_close(df: DataFrame, groups: Sequence[str], ident: str, separation, pos: Sequence[str] = ("y", "x"), intensity: str | None = None) -> DataFrame:
    """``df`` without the features of ``where_close``."""
    return df.join(where_close(df, groups, ident, separation, pos, intensity), [*groups, ident], "left_anti")
