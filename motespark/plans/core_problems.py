"""Queries of the general data problems (2, 4, 5, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motespark.common import rounded, small_side, table
from motespark.operators.near import near_pairs, near_pairs_geo, points_in_regions
from motespark.operators.regular_grid import to_regular_grid
from motespark.operators.rolling import rolling
from motespark.operators.spikes import flag_readings
from motespark.plans.sqlutil import OK, r6

#: more videos than this and the small table isn't broadcast
MAX_VIDEOS = 10_000


def _grid(spark: SparkSession, d: str, fill: str = "hold") -> DataFrame:
    videos = small_side(table(spark, d, "videos").select("video_id", F.col("stride").cast("bigint").alias("stride")), MAX_VIDEOS)
    traj = table(spark, d, "traj").select("video_id", "particle", "frame", "x", "y").join(videos, "video_id", "left")
    return to_regular_grid(traj, ["video_id", "particle"], "frame", ["x", "y"], "stride", fill)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "none").where("filled").select("video_id", "particle", "slot")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return g.select("video_id", "particle", "slot", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"), "n_readings", F.col("filled").cast("bigint").alias("filled"), rounded(F.col("coverage")).alias("coverage"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling(table(spark, d, "traj"), ["video_id", "particle"], "frame", ["x", "y"], [7, 30])
    return r.select("video_id", "particle", "frame", *[(rounded(F.col(c)).alias(c) if t == "double" else F.col(c)) for c, t in r.dtypes[3:]])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_pairs(table(spark, d, "features"), ["video_id", "frame"], "feature_id", "x", "y", 3.0)
    return pairs.select(F.col("id_a").alias("feature_id_a"), F.col("id_b").alias("feature_id_b"))


def p5_geo(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 250 km, the field of each movie taken as a map of the globe."""
    v = table(spark, d, "videos").select("video_id", F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    f = table(spark, d, "features").join(small_side(v, MAX_VIDEOS), "video_id").select("video_id", "frame", "feature_id", ((F.col("y") / F.col("h")) * 180 - 90).alias("lat"), ((F.col("x") / F.col("w")) * 360 - 180).alias("lon"))
    pairs = near_pairs_geo(f, ["video_id", "frame"], "feature_id", "lat", "lon", 250.0)
    return pairs.select("video_id", "frame", F.col("id_a").alias("feature_id_a"), F.col("id_b").alias("feature_id_b"), F.round("distance", 3).alias("km"))


def p5_regions(spark: SparkSession, d: str) -> DataFrame:
    """Detections inside the diamond between the middles of their movie's four edges."""
    v = table(spark, d, "videos").select("video_id", F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    w, h, z = F.col("w"), F.col("h"), F.lit(0.0)
    regions = v.select("video_id", F.lit("diamond").alias("name"), F.array(pt(w / 2, z), pt(w, h / 2), pt(w / 2, h), pt(z, h / 2)).alias("ring"))
    hit = points_in_regions(table(spark, d, "features"), regions, ["video_id"], "feature_id", "x", "y", "name", "ring", 256.0)
    return hit.groupBy("video_id", "region").agg(F.countDistinct("feature_id").alias("n_features"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    videos = small_side(table(spark, d, "videos").select("video_id", "width", "height"), MAX_VIDEOS)
    traj = table(spark, d, "traj").select("video_id", "particle", "frame", "x", "y").join(videos, "video_id", "left")
    outside = (F.col("x") < -0.5) | (F.col("x") > F.col("width") - 0.5) | (F.col("y") < -0.5) | (F.col("y") > F.col("height") - 0.5)
    return flag_readings(traj, ["video_id", "particle"], "frame", ["x", "y"], outside)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).where("spike or stuck or outside").select("video_id", "particle", "frame")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Readings beyond the field, by the physical-limit rule alone."""
    return _flags(spark, d).where("outside").select("video_id", "particle", "frame")


QUERIES = {"p2_found": p2_found, "p2_grid": p2_grid, "p4_rolling": p4_rolling, "p5_found": p5_found, "p5_regions": p5_regions, "p5_geo": p5_geo, "p6_found": p6_found, "p6_scores": p6_scores, "p6_limits": p6_limits}


_READ = f"""
r AS (SELECT t.video_id, t.particle, t.frame, any_value(v.stride) AS stride, min(struct_pack(x := t.x, y := t.y)) AS p
      FROM traj t JOIN videos v USING (video_id) WHERE t.particle IS NOT NULL AND {OK} GROUP BY ALL),
s AS (SELECT video_id, particle, frame, stride::BIGINT AS stride, p.x AS x, p.y AS y,
             lead(frame) OVER (PARTITION BY video_id, particle ORDER BY frame) AS nf FROM r)
"""

ORACLES = {
    "p2_found": f"""
WITH r AS (SELECT DISTINCT t.video_id, t.particle, CAST(floor(t.frame / v.stride) AS BIGINT) AS slot
           FROM traj t JOIN videos v USING (video_id) WHERE t.particle IS NOT NULL AND {OK}),
span AS (SELECT video_id, particle, min(slot) AS a, max(slot) AS b FROM r GROUP BY ALL),
cells AS (SELECT video_id, particle, unnest(generate_series(a, b)) AS slot FROM span)
SELECT c.video_id, c.particle, c.slot FROM cells c ANTI JOIN r USING (video_id, particle, slot)""",
    "p2_grid": f"""
WITH {_READ},
p AS (SELECT *, coalesce(nf, frame + 1) AS stop FROM s),
e AS (SELECT *, unnest(generate_series(frame // stride, (stop - 1) // stride)) AS slot FROM p),
q AS (SELECT *, greatest(frame, slot * stride) AS lo, least(stop, (slot + 1) * stride) AS hi FROM e)
SELECT video_id, particle, slot, {r6('sum(x * (hi - lo)) / sum(hi - lo)', 'x')}, {r6('sum(y * (hi - lo)) / sum(hi - lo)', 'y')},
       CAST(sum(CASE WHEN lo = frame THEN 1 ELSE 0 END) AS BIGINT) AS n_readings,
       CAST(sum(CASE WHEN lo = frame THEN 1 ELSE 0 END) = 0 AS BIGINT) AS filled,
       round(sum(greatest(least(hi, frame + stride) - lo, 0)) / CAST(any_value(stride) AS DOUBLE), 6) AS coverage
FROM q GROUP BY video_id, particle, slot""",
    "p4_rolling": """
WITH rows_ AS (SELECT DISTINCT video_id, particle, frame, CASE WHEN CAST(x AS VARCHAR) = 'nan' THEN NULL ELSE x END AS x, CASE WHEN CAST(y AS VARCHAR) = 'nan' THEN NULL ELSE y END AS y
               FROM traj WHERE particle IS NOT NULL),
span AS (SELECT video_id, particle, min(frame) AS a, max(frame) AS b FROM rows_ GROUP BY ALL),
cells AS (SELECT video_id, particle, unnest(generate_series(a, b)) AS frame FROM span),
d AS (SELECT c.video_id, c.particle, c.frame, r.x, r.y FROM cells c LEFT JOIN rows_ r USING (video_id, particle, frame)),
w AS (SELECT video_id, particle, frame,
  """ + ",\n  ".join(
        f"count({v}) OVER w{n} AS n_{v}_{n}, sum({v}) OVER w{n} AS sum_{v}_{n}, avg({v}) OVER w{n} AS avg_{v}_{n}, max({v}) OVER w{n} AS max_{v}_{n}" for n in (7, 30) for v in ("x", "y")
    ) + """
FROM d WINDOW w7 AS (PARTITION BY video_id, particle ORDER BY frame RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
              w30 AS (PARTITION BY video_id, particle ORDER BY frame RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT DISTINCT video_id, particle, frame, """ + ", ".join(
        ", ".join([f"n_{v}_{n}", *(r6(f"{a}_{v}_{n}") for a in ("sum", "avg", "max"))]) for n in (7, 30) for v in ("x", "y")
    ) + " FROM w",
    "p5_found": f"""
WITH p AS (SELECT DISTINCT video_id, frame, feature_id, x, y, floor(x / 6) AS cx, floor(y / 6) AS cy FROM features WHERE {OK}),
q AS (SELECT p.*, cx + dx AS jx, cy + dy AS jy FROM p, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))
SELECT DISTINCT a.feature_id AS feature_id_a, b.feature_id AS feature_id_b FROM q a
JOIN p b ON a.video_id = b.video_id AND a.frame = b.frame AND a.jx = b.cx AND a.jy = b.cy
WHERE a.feature_id < b.feature_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9.0""",
    "p5_geo": f"""
WITH p AS (SELECT DISTINCT video_id, frame, feature_id, radians(y / CAST(height AS DOUBLE) * 180 - 90) AS lat, radians(x / CAST(width AS DOUBLE) * 360 - 180) AS lon
           FROM features JOIN videos USING (video_id) WHERE {OK}),
q AS (SELECT * FROM p WHERE abs(lat) <= radians(90)),
e AS (SELECT a.video_id, a.frame, a.feature_id AS feature_id_a, b.feature_id AS feature_id_b,
             pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2) AS h
      FROM q a JOIN q b ON a.video_id = b.video_id AND a.frame = b.frame AND a.feature_id < b.feature_id)
SELECT video_id, frame, feature_id_a, feature_id_b, round(2 * 6371.0088 * asin(sqrt(least(h, 1.0))), 3) AS km
FROM e WHERE 2 * 6371.0088 * asin(sqrt(least(h, 1.0))) <= 250.0""",
    "p6_limits": f"""
WITH r AS (SELECT t.video_id, t.particle, t.frame, min(struct_pack(x := t.x, y := t.y)) AS p, any_value(v.width) AS w, any_value(v.height) AS h
           FROM traj t JOIN videos v USING (video_id) WHERE t.particle IS NOT NULL AND {OK} GROUP BY ALL)
SELECT video_id, particle, frame FROM r WHERE p.x < -0.5 OR p.x > w - 0.5 OR p.y < -0.5 OR p.y > h - 0.5""",
    "p5_regions": f"""
SELECT video_id, 'diamond' AS region, count(DISTINCT feature_id) AS n_features FROM features JOIN videos USING (video_id)
WHERE {OK} AND abs(x - width / 2) / (width / 2) + abs(y - height / 2) / (height / 2) < 1 GROUP BY video_id""",
}
