"""Queries on features: neighbours, pair correlation, clusters, uncertainty, with SQL equivalents."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from motespark.common import present, rounded, table
from motespark.operators import plotdata
from motespark.operators import static as s
from motespark.operators.uncertainty import static_error
from motespark.plans.motion_queries import _r
from motespark.plans.sqlutil import OK, r6

G = ["video_id", "frame"]


def features(spark, d, *cols):
    """Detections with a usable position, repeats dropped."""
    return table(spark, d, "features").where(present("x", "y")).select("feature_id", "video_id", "frame", "x", "y", *cols).distinct()


def proximity(spark, d):
    return _r(s.proximity(features(spark, d), G, "feature_id"))


def pair_correlation_2d(spark, d):
    return _r(s.pair_correlation_2d(features(spark, d), G, "feature_id", 20.0, dr=5.0))


def pair_correlation_2d_open(spark, d):
    return _r(s.pair_correlation_2d(features(spark, d), G, "feature_id", 20.0, dr=5.0, handle_edge=False, boundary=[(0.0, 300.0), (0.0, 300.0)]))


def pair_correlation_3d(spark, d):
    f = features(spark, d).withColumn("z", F.col("frame").cast("double"))
    return _r(s.pair_correlation_3d(f, ["video_id"], "feature_id", 12.0, dr=4.0))


def cluster(spark, d):
    return _r(s.cluster(features(spark, d), G, "feature_id", 12.0).select("feature_id", "cluster", "cluster_size"))


def where_close(spark, d):
    return _r(s.where_close(features(spark, d, "mass"), G, "feature_id", 9.0, intensity="mass"))


def drop_close(spark, d):
    return _r(s.drop_close(features(spark, d, "mass"), G, "feature_id", (9.0, 6.0)).select("feature_id", "video_id", "frame"))


def static_error_q(spark, d):
    f = table(spark, d, "features").select("feature_id", "video_id", "frame", "raw_mass").distinct()
    noise = table(spark, d, "frame_noise").distinct().groupBy(*G).agg(F.min("background").alias("background"), F.min("noise").alias("noise"))
    return static_error(f, noise, 7, 1.0, G).select("feature_id", rounded(F.col("ep")).alias("ep"))


def subpx_bias(spark, d):
    return plotdata.subpx_bias(features(spark, d))


def density_profile(spark, d):
    return _r(plotdata.density_profile(features(spark, d), ["video_id"]))


def scatter_mass_size(spark, d):
    return _r(plotdata.mass_size(table(spark, d, "features").select("feature_id", "mass", "size").distinct()))


QUERIES = {f.__name__.removesuffix("_q"): f for f in (proximity, pair_correlation_2d, pair_correlation_2d_open, pair_correlation_3d, cluster, where_close, drop_close, static_error_q, subpx_bias, density_profile, scatter_mass_size)}

FT = f"f AS (SELECT DISTINCT feature_id, video_id, frame, x, y FROM features WHERE {OK})"
FM = f"f AS (SELECT DISTINCT feature_id, video_id, frame, x, y, mass FROM features WHERE {OK})"


def _close(scale_y: float, scale_x: float, limit: str, base: str = FT) -> str:
    return f"""{base}, g AS (SELECT *, floor(x / {scale_x}) AS cx, floor(y / {scale_y}) AS cy FROM f),
h AS (SELECT g.*, cx + i AS jx, cy + j AS jy FROM g, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
p AS (SELECT a.*, b.feature_id AS other, b.x AS ox, b.y AS oy{', b.mass AS omass' if base == FM else ''}, sqrt(((a.x - b.x) / {scale_x}) ** 2 + ((a.y - b.y) / {scale_y}) ** 2) AS dist
      FROM h a JOIN g b ON a.video_id = b.video_id AND a.frame = b.frame AND a.jx = b.cx AND a.jy = b.cy AND a.feature_id <> b.feature_id
      WHERE ((a.x - b.x) / {scale_x}) ** 2 + ((a.y - b.y) / {scale_y}) ** 2 {limit})"""


_CAP = " - ".join(f"(CASE WHEN {h} < d THEN 2 * d * acos({h} / d) ELSE 0 END)" for h in ("hx0", "hx1", "hy0", "hy1"))
_CORNER = " + ".join(f"(CASE WHEN {a} ** 2 + {b} ** 2 < d ** 2 THEN d * (acos({b} / d) - asin({a} / d)) ELSE 0 END)" for a in ("hx0", "hx1") for b in ("hy0", "hy1"))


def _edge(x: str, y: str) -> str:
    p = f"sqrt(d ** 2 - {x} ** 2 - {y} ** 2)"
    return f"(CASE WHEN {x} ** 2 + {y} ** 2 < d ** 2 THEN d * ((d - {x} - {y}) * pi() - 2 * d * atan({x} * {y} / ({p} * d)) + 2 * {x} * atan({y} / {p}) + 2 * {y} * atan({x} / {p})) ELSE 0 END)"


def _corner(x: str, y: str, z: str) -> str:
    a, b, c = f"sqrt(d ** 2 - {x} ** 2 - {y} ** 2)", f"sqrt(d ** 2 - {y} ** 2 - {z} ** 2)", f"sqrt(d ** 2 - {x} ** 2 - {z} ** 2)"
    return f"""(CASE WHEN {x} ** 2 + {y} ** 2 + {z} ** 2 < d ** 2 THEN d * (pi() * (d - {x} - {y} - {z}) / 2
 + {x} * (atan({y} / {a}) + atan({z} / {c})) - d * atan({y} * {z} / (d * {b})) + {y} * (atan({x} / {a}) + atan({z} / {b})) - d * atan({x} * {z} / (d * {c}))
 + {z} * (atan({x} / {c}) + atan({y} / {b})) - d * atan({x} * {y} / (d * {a}))) ELSE 0 END)"""


_X, _Y, _Z = ("hx0", "hx1"), ("hy0", "hy1"), ("hz0", "hz1")
_CAPS3 = " - ".join(f"(CASE WHEN {h} < d THEN 2 * pi() * d * (d - {h}) ELSE 0 END)" for h in (*_X, *_Y, *_Z))
_EDGES3 = " + ".join(_edge(a, b) for s, t in ((_X, _Y), (_X, _Z), (_Y, _Z)) for a in s for b in t)
_CORNERS3 = " - ".join(_corner(a, b, c) for a in _X for b in _Y for c in _Z)
_N7 = sum(1 for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9)
_X2 = sum(i * i for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9)

ORACLES = {
    "proximity": f"""WITH {FT}, n AS (SELECT a.feature_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS p FROM f a JOIN f b ON a.video_id = b.video_id AND a.frame = b.frame AND a.feature_id <> b.feature_id GROUP BY ALL)
SELECT video_id, frame, feature_id, {r6('p', 'proximity')} FROM f LEFT JOIN n USING (feature_id)""",
    "pair_correlation_2d": f"""WITH {FT}, s AS (SELECT video_id, frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT a.video_id, a.frame, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.x - x0 AS hx0, x1 - a.x AS hx1, a.y - y0 AS hy0, y1 - a.y AS hy1
  FROM f a JOIN f b ON a.video_id = b.video_id AND a.frame = b.frame AND a.feature_id <> b.feature_id JOIN s ON a.video_id = s.video_id AND a.frame = s.frame),
q AS (SELECT *, 2 * pi() * d - {_CAP} + {_CORNER} AS arc FROM p WHERE d > 0 AND d < 20),
h AS (SELECT video_id, frame, CAST(floor(d / 5) AS BIGINT) AS bin, sum(1 / CASE WHEN arc >= 1e-5 * d THEN arc END) AS w FROM q GROUP BY ALL),
e AS (SELECT *, unnest(generate_series(0, 3)) AS bin FROM s),
z AS (SELECT e.*, (n - 1) / nullif((x1 - x0) * (y1 - y0), 0) * n * 5.0 AS below, w FROM e LEFT JOIN h USING (video_id, frame, bin))
SELECT video_id, frame, bin, {r6('bin * 5.0', 'r')}, {r6('coalesce(w, 0) / nullif(below, 0)', 'g_r')} FROM z""",
    "pair_correlation_2d_open": f"""WITH {FT.replace('WHERE', 'WHERE x BETWEEN 0 AND 300 AND y BETWEEN 0 AND 300 AND')}, s AS (SELECT video_id, frame, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT a.video_id, a.frame, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM f a JOIN f b ON a.video_id = b.video_id AND a.frame = b.frame AND a.feature_id <> b.feature_id),
h AS (SELECT video_id, frame, CAST(floor(d / 5) AS BIGINT) AS bin, sum(1 / (2 * pi() * d)) AS w FROM p WHERE d > 0 AND d < 20 GROUP BY ALL),
e AS (SELECT *, unnest(generate_series(0, 3)) AS bin FROM s), z AS (SELECT e.*, (n - 1) / 90000.0 * n * 5.0 AS below, w FROM e LEFT JOIN h USING (video_id, frame, bin))
SELECT video_id, frame, bin, {r6('bin * 5.0', 'r')}, {r6('coalesce(w, 0) / nullif(below, 0)', 'g_r')} FROM z""",
    "pair_correlation_3d": f"""WITH {FT}, s AS (SELECT video_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(frame) AS z0, max(frame) AS z1, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT a.video_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.frame - b.frame) ** 2) AS d, a.x - x0 AS hx0, x1 - a.x AS hx1, a.y - y0 AS hy0, y1 - a.y AS hy1, CAST(a.frame - z0 AS DOUBLE) AS hz0, CAST(z1 - a.frame AS DOUBLE) AS hz1
  FROM f a JOIN f b ON a.video_id = b.video_id AND a.feature_id <> b.feature_id AND b.frame BETWEEN a.frame - 12 AND a.frame + 12 AND b.x BETWEEN a.x - 12 AND a.x + 12 JOIN s ON a.video_id = s.video_id),
q AS (SELECT *, 4 * pi() * d ** 2 - {_CAPS3} + {_EDGES3} - {_CORNERS3} AS area FROM p WHERE d > 0 AND d < 12),
h AS (SELECT video_id, CAST(floor(d / 4) AS BIGINT) AS bin, sum(1 / CASE WHEN area >= 1e-7 * d ** 2 THEN area END) AS w FROM q GROUP BY ALL),
e AS (SELECT *, unnest(generate_series(0, 2)) AS bin FROM s),
z AS (SELECT e.*, (n - 1) / nullif((x1 - x0) * (y1 - y0) * (z1 - z0), 0) * n * 4.0 AS below, w FROM e LEFT JOIN h USING (video_id, bin))
SELECT video_id, bin, {r6('bin * 4.0', 'r')}, {r6('coalesce(w, 0) / nullif(below, 0)', 'g_r')} FROM z""",
    "cluster": f"""WITH RECURSIVE {_close(12.0, 12.0, '<= 1.0')}, c(a, b) AS (SELECT feature_id, feature_id FROM f UNION SELECT c.a, p.other FROM c JOIN p ON c.b = p.feature_id),
m AS (SELECT a AS feature_id, min(b) AS cluster FROM c GROUP BY a)
SELECT feature_id, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM m""",
    "where_close": f"""WITH {_close(9.0, 9.0, '<= (1 - 1e-7) ** 2', FM)}
SELECT DISTINCT video_id, frame, feature_id FROM p
WHERE mass < omass OR ((mass = omass OR mass IS NULL OR omass IS NULL) AND (x / 9.0 + y / 9.0 < ox / 9.0 + oy / 9.0 OR (x / 9.0 + y / 9.0 = ox / 9.0 + oy / 9.0 AND feature_id > other)))""",
    "drop_close": f"""WITH {_close(9.0, 6.0, '<= (1 - 1e-7) ** 2')}, d AS (SELECT DISTINCT feature_id FROM p WHERE y / 9.0 + x / 6.0 < oy / 9.0 + ox / 6.0 OR (y / 9.0 + x / 6.0 = oy / 9.0 + ox / 6.0 AND feature_id > other))
SELECT feature_id, video_id, frame FROM f ANTI JOIN d USING (feature_id)""",
    "static_error": f"""WITH f AS (SELECT DISTINCT feature_id, video_id, frame, raw_mass FROM features),
n AS (SELECT video_id, frame, min(background) AS background, min(noise) AS noise FROM frame_noise GROUP BY ALL),
e AS (SELECT feature_id, noise / nullif(raw_mass - {_N7} * background, 0) * {math.sqrt(_X2)!r} AS e FROM f LEFT JOIN n USING (video_id, frame))
SELECT feature_id, {r6('CASE WHEN e >= 0 THEN e END', 'ep')} FROM e""",
    "subpx_bias": f"WITH {FT}, l AS (SELECT 'x' AS axis, x AS v FROM f UNION ALL SELECT 'y', y FROM f) SELECT axis, CAST(floor((v - floor(v)) * 10) AS BIGINT) AS bin, count(*) AS n FROM l GROUP BY ALL",
    "scatter_mass_size": f"SELECT {r6('mass')}, {r6('size')} FROM (SELECT DISTINCT feature_id, mass, size FROM features) WHERE CAST(mass AS VARCHAR) <> 'nan' AND CAST(size AS VARCHAR) <> 'nan'",
    "density_profile": f"""WITH {FT}, n AS (SELECT video_id, count(DISTINCT frame) AS frames FROM f GROUP BY ALL), h AS (SELECT video_id, CAST(floor(y / 32) AS BIGINT) AS strip, count(*) AS n FROM f GROUP BY ALL)
SELECT video_id, strip, {r6('n / frames', 'density')} FROM h JOIN n USING (video_id)""",
}
