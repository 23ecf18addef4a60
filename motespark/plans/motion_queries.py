"""Queries on tracks: motion analysis and filters, with SQL equivalents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motespark.common import clean, present, rounded, table
from motespark.functions.scalar import fit_powerlaw
from motespark.operators import filtering as fl
from motespark.operators import motion as m
from motespark.plans.sqlutil import OK, r6

MPP, FPS, LAGS = 0.25, 24.0, 20
K, G = ["particle"], ["video_id"]
#: 0 / 0 of doubles in the SQL of these queries; the operators' own default is NULL
NAN = float("nan")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Usable readings of tracks, repeats dropped."""
    return table(spark, d, "traj").where(present("x", "y") & F.col("particle").isNotNull()).select("video_id", "particle", "frame", "x", "y").distinct()


def track_features(spark: SparkSession, d: str) -> DataFrame:
    """The usable readings with their detection's mass and size."""
    f = table(spark, d, "features").select("feature_id", "mass", "size").distinct()
    t = table(spark, d, "traj").where(present("x", "y") & F.col("particle").isNotNull()).select("video_id", "particle", "frame", "x", "y", "feature_id").distinct()
    return t.join(f, "feature_id")


def _r(df: DataFrame, **names: str) -> DataFrame:
    """Doubles rounded, ints as BIGINT, columns renamed."""
    cols = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        cols.append((rounded(x) if t == "double" else x.cast("bigint") if t in ("int", "boolean") else x).alias(names.get(c, c)))
    return df.select(*cols)


STAT = {"<x>": "mean_x", "<y>": "mean_y", "<x^2>": "mean_x2", "<y^2>": "mean_y2"}


def msd_detail(spark, d):
    return _r(m.msd(tracks(spark, d), MPP, FPS, LAGS, [*G, *K], undefined=NAN).withColumnRenamed("N", "n_eff"), **STAT)


def imsd(spark, d):
    return _r(m.imsd(tracks(spark, d), MPP, FPS, LAGS, keys=[*G, *K]).drop("lag"))


def emsd(spark, d):
    return _r(m.emsd(tracks(spark, d), MPP, FPS, LAGS, groups=G, undefined=NAN))


def emsd_detail(spark, d):
    return _r(m.emsd(tracks(spark, d), MPP, FPS, LAGS, detail=True, groups=G, undefined=NAN).withColumnRenamed("N", "n_eff"), **STAT)


def emsd_powerlaw(spark, d):
    fit = fit_powerlaw(m.emsd(tracks(spark, d), MPP, FPS, LAGS, groups=G, undefined=NAN), "lagt", "msd", G)
    return _r(clean(fit, "A"), A="a")  # SQL's intercept is NULL where its slope is NaN


def drift(spark, d):
    return _r(m.compute_drift(tracks(spark, d), groups=G))


def drift_smoothed(spark, d):
    return _r(m.compute_drift(tracks(spark, d), 5, groups=G))


def subtract_drift(spark, d):
    return _r(m.subtract_drift(tracks(spark, d), groups=G))


def subtract_drift_curve(spark, d):
    return _r(m.subtract_drift(tracks(spark, d), table(spark, d, "drift_curve"), groups=G))


def vanhove(spark, d):
    return _r(m.vanhove(tracks(spark, d), 2, MPP, groups=G).drop("edge"))


def vanhove_ensemble(spark, d):
    return _r(m.vanhove(tracks(spark, d), 2, MPP, True, groups=G))


def is_typical(spark, d):
    return _r(m.is_typical(m.imsd(tracks(spark, d), MPP, FPS, LAGS, keys=[*G, *K]), 4, groups=G))


def relate_frames(spark, d):
    return _r(m.relate_frames(tracks(spark, d), 40, 48, keys=[*G, *K]))


def direction_corr(spark, d):
    return _r(m.direction_corr(tracks(spark, d), 40, 42, groups=G, cutoff=120.0))


def velocity_corr(spark, d):
    return _r(m.velocity_corr(tracks(spark, d), 40, 42, groups=G, cutoff=120.0))


def diagonal_size(spark, d):
    return _r(m.diagonal_size(tracks(spark, d), [*G, *K]))


def theta_entropy(spark, d):
    return _r(m.theta_entropy(tracks(spark, d), keys=[*G, *K]))


def min_rolling_theta_entropy(spark, d):
    return _r(m.min_rolling_theta_entropy(tracks(spark, d), 12, keys=[*G, *K]))


def filter_stubs(spark, d):
    return _r(fl.filter_stubs(tracks(spark, d), 30, [*G, *K]))


def filter_clusters(spark, d):
    return _r(fl.filter_clusters(track_features(spark, d), 0.6, keys=[*G, *K]).select("video_id", "particle", "frame", "size"))


def filter_condition(spark, d):
    return _r(fl.filter_tracks(tracks(spark, d), (F.max("x") - F.min("x")) > 5, [*G, *K]))


def mass_size_filter(spark, d):
    f = table(spark, d, "features").select("feature_id", "video_id", "frame", "mass", "size").distinct()
    return _r(fl.mass_size_filter(f, 100.0, 2.2))


def topn(spark, d):
    f = table(spark, d, "features").select("feature_id", "video_id", "frame", "mass").distinct()
    return _r(fl.topn(f, 3, ["video_id", "frame"], "feature_id"))


def verify_integrity(spark, d):
    return _r(fl.integrity_report(table(spark, d, "traj"), groups=G))


QUERIES = {
    f.__name__: f
    for f in (
        emsd, msd_detail, imsd, emsd_detail, emsd_powerlaw, drift, drift_smoothed, subtract_drift, subtract_drift_curve, vanhove, vanhove_ensemble, is_typical, relate_frames, direction_corr,
        velocity_corr, diagonal_size, theta_entropy, min_rolling_theta_entropy, filter_stubs, filter_clusters, filter_condition, mass_size_filter, topn, verify_integrity,
    )
}

T = f"t AS (SELECT DISTINCT video_id, particle, frame, x, y FROM traj WHERE particle IS NOT NULL AND {OK})"
_NEFF = "CASE WHEN l > n / 2 THEN 1 / (1 + ((n - l) ** 3 + 5 * l - 4 * (n - l) ** 2 * l - n) / (6 * (n - l) * l ** 2)) ELSE 6 * (n - l) ** 2 * l / (2 * n - l + 4 * n * l ** 2 - 5 * l ** 3) END"
MSD = f"""{T},
span AS (SELECT video_id, particle, CAST(max(frame) - min(frame) + 1 AS DOUBLE) AS n, count(*) AS obs FROM t GROUP BY ALL),
lags AS (SELECT *, unnest(generate_series(1, least({LAGS}, CAST(n AS BIGINT) - 1))) AS lag FROM span WHERE n > 1),
st AS (SELECT a.video_id, a.particle, b.frame - a.frame AS lag, avg((b.x - a.x) * {MPP}) AS mx, avg((b.y - a.y) * {MPP}) AS my,
       avg(((b.x - a.x) * {MPP}) ** 2) AS mx2, avg(((b.y - a.y) * {MPP}) ** 2) AS my2
       FROM t a JOIN t b ON a.video_id = b.video_id AND a.particle = b.particle AND b.frame > a.frame AND b.frame <= a.frame + {LAGS} GROUP BY ALL),
j AS (SELECT lags.*, CAST(lags.lag AS DOUBLE) AS l, mx, my, mx2, my2, mx2 + my2 AS msd FROM lags LEFT JOIN st USING (video_id, particle, lag)),
e AS (SELECT *, ({_NEFF}) * obs / n AS raw FROM j),
z AS (SELECT *, CASE WHEN msd IS NULL THEN 0 ELSE raw END AS n0 FROM e),
msd AS (SELECT video_id, particle, lag, mx, my, mx2, my2, msd, lag / {FPS} AS lagt,
        n0 * sum(raw) OVER (PARTITION BY video_id, particle) / sum(n0) OVER (PARTITION BY video_id, particle) AS w FROM z)"""
_R = r6
DRIFT = f"""{T}, st AS (SELECT a.video_id, a.frame, avg(a.y - b.y) AS dy, avg(a.x - b.x) AS dx FROM t a JOIN t b
ON a.video_id = b.video_id AND a.particle = b.particle AND a.frame = b.frame + 1 GROUP BY ALL)"""
_CUM = "sum({0}) OVER (PARTITION BY video_id ORDER BY frame)"
_VH = f"""{T}, d AS (SELECT a.video_id, a.particle, a.x * {MPP} - b.x * {MPP} AS d FROM t a JOIN t b ON a.video_id = b.video_id AND a.particle = b.particle AND a.frame = b.frame + 2),
lim AS (SELECT video_id, CASE WHEN min(d) = max(d) THEN min(d) - 0.5 ELSE min(d) END AS lo, CASE WHEN min(d) = max(d) THEN max(d) + 0.5 ELSE max(d) END AS hi FROM d GROUP BY video_id),
b AS (SELECT video_id, particle, lo, hi, CAST(least(floor((d - lo) / (hi - lo) * 24), 23) AS BIGINT) AS bin, count(*) AS c FROM d JOIN lim USING (video_id) GROUP BY ALL),
h AS (SELECT *, c / sum(c) OVER (PARTITION BY video_id, particle) * 24 / (hi - lo) AS density FROM b)"""
_REL = lambda f1, f2: f"""{T}, a AS (SELECT * FROM t WHERE frame = {f1}), b AS (SELECT * FROM t WHERE frame = {f2}),
j AS (SELECT a.video_id, a.particle, a.x, a.y, b.x AS x_b, b.y AS y_b, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS dr, atan2(b.y - a.y, b.x - a.x) AS direction
      FROM a LEFT JOIN b USING (video_id, particle))"""  # noqa: E731
_PAIRS = f"""{_REL(40, 42)}, p AS (SELECT a.video_id, a.particle AS id_1, b.particle AS id_2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS r, cos(a.direction - b.direction) AS c, a.dr AS da, b.dr AS db
      FROM j a JOIN j b ON a.video_id = b.video_id AND a.particle < b.particle) SELECT video_id, id_1, id_2, {_R('r')}, """
_TH = f"""{T}, s AS (SELECT video_id, particle, frame, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS th FROM t WINDOW w AS (PARTITION BY video_id, particle ORDER BY frame)),
b AS (SELECT video_id, particle, frame, CAST(least(floor((th + {math.pi!r}) / ({math.pi!r} + {math.pi!r}) * 24), 23) AS BIGINT) AS bin FROM s WHERE th IS NOT NULL)"""

ORACLES = {
    "msd_detail": f"WITH {MSD} SELECT video_id, particle, lag, {_R('mx', 'mean_x')}, {_R('my', 'mean_y')}, {_R('mx2', 'mean_x2')}, {_R('my2', 'mean_y2')}, {_R('msd')}, {_R('w', 'n_eff')}, {_R('lagt')} FROM msd",
    "imsd": f"WITH {MSD} SELECT video_id, particle, {_R('lagt')}, {_R('msd')} FROM msd",
    "emsd": f"WITH {MSD} SELECT video_id, lag, {_R('any_value(lagt)', 'lagt')}, {_R('sum(coalesce(msd, 0) * w) / sum(w)', 'msd')} FROM msd GROUP BY video_id, lag",
    "emsd_detail": f"WITH {MSD} SELECT video_id, lag, {_R('any_value(lagt)', 'lagt')}, {_R('sum(coalesce(msd, 0) * w) / sum(w)', 'msd')}, "
    + ", ".join(_R(f"sum(coalesce({a}, 0) * w) / sum(w)", b) for a, b in (("mx", "mean_x"), ("my", "mean_y"), ("mx2", "mean_x2"), ("my2", "mean_y2")))
    + f", {_R('sum(w)', 'n_eff')} FROM msd GROUP BY video_id, lag",
    "emsd_powerlaw": f"WITH {MSD}, en AS (SELECT video_id, lag, any_value(lagt) AS lagt, sum(coalesce(msd, 0) * w) / sum(w) AS msd FROM msd GROUP BY video_id, lag) "
    f"SELECT video_id, {_R('regr_slope(ln(msd), ln(lagt))', 'n')}, {_R('exp(regr_intercept(ln(msd), ln(lagt)))', 'a')} FROM en WHERE msd > 0 AND lagt > 0 GROUP BY video_id",
    "drift": f"WITH {DRIFT} SELECT video_id, frame, {_R(_CUM.format('dy'), 'y')}, {_R(_CUM.format('dx'), 'x')} FROM st",
    "drift_smoothed": f"""WITH {DRIFT}, sm AS (SELECT video_id, frame, avg(dy) OVER w AS dy, avg(dx) OVER w AS dx FROM st WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT video_id, frame, {_R(_CUM.format('dy'), 'y')}, {_R(_CUM.format('dx'), 'x')} FROM sm""",
    "subtract_drift": f"""WITH {DRIFT}, dr AS (SELECT video_id, frame, {_CUM.format('dy')} AS dy, {_CUM.format('dx')} AS dx FROM st)
SELECT video_id, particle, frame, {_R('x - coalesce(dx, 0)', 'x')}, {_R('y - coalesce(dy, 0)', 'y')} FROM t LEFT JOIN dr USING (video_id, frame)""",
    "subtract_drift_curve": f"""WITH {T}, dr AS (SELECT video_id, frame, CASE WHEN CAST(y AS VARCHAR) <> 'nan' THEN y END AS dy, CASE WHEN CAST(x AS VARCHAR) <> 'nan' THEN x END AS dx FROM drift_curve)
SELECT video_id, particle, frame, {_R('x - coalesce(dx, 0)', 'x')}, {_R('y - coalesce(dy, 0)', 'y')} FROM t LEFT JOIN dr USING (video_id, frame)""",
    "vanhove": f"WITH {_VH} SELECT video_id, particle, bin, {_R('density')} FROM h",
    "vanhove_ensemble": f"""WITH {_VH}, n AS (SELECT video_id, count(DISTINCT particle) AS n FROM t GROUP BY video_id),
f AS (SELECT video_id, lo, hi, n, unnest(generate_series(0, 23)) AS bin FROM lim JOIN n USING (video_id)),
g AS (SELECT video_id, bin, sum(density) AS s FROM h GROUP BY ALL)
SELECT video_id, bin, {_R('lo + (hi - lo) * bin / 24', 'edge')}, {_R('coalesce(s, 0) / n', 'density')} FROM f LEFT JOIN g USING (video_id, bin)""",
    "is_typical": f"""WITH {MSD}, v AS (SELECT video_id, particle, max(CASE WHEN lag = 5 THEN msd END) AS v FROM msd GROUP BY ALL),
q AS (SELECT video_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM v GROUP BY ALL)
SELECT video_id, particle, CAST(coalesce(v > lo AND v < hi, false) AS BIGINT) AS typical FROM v JOIN q USING (video_id)""",
    "relate_frames": f"WITH {_REL(40, 48)} SELECT video_id, particle, " + ", ".join(_R(c) for c in ("x", "y", "x_b", "y_b", "dx", "dy", "dr", "direction")) + " FROM j",
    "direction_corr": f"WITH {_PAIRS}{_R('c', 'cos')} FROM p WHERE r <= 120",
    "velocity_corr": f"WITH {_PAIRS}{_R('c * abs(da * db)', 'dot_product')} FROM p WHERE r <= 120",
    "diagonal_size": f"WITH {T} SELECT video_id, particle, {_R('sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2)', 'diagonal_size')} FROM t GROUP BY ALL",
    "theta_entropy": f"""WITH {_TH}, c AS (SELECT video_id, particle, bin, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY video_id, particle) AS p FROM c) SELECT video_id, particle, {_R('0.0 - sum(p * ln(p))', 'entropy')} FROM p GROUP BY ALL""",
    "min_rolling_theta_entropy": f"""WITH {_TH}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, particle ORDER BY frame) AS k FROM b),
c AS (SELECT a.video_id, a.particle, a.k, o.bin, count(*) AS c FROM r a JOIN r o ON a.video_id = o.video_id AND a.particle = o.particle AND o.k BETWEEN a.k - 11 AND a.k WHERE a.k >= 12 GROUP BY ALL),
e AS (SELECT video_id, particle, k, -sum(c / 12 * ln(c / 12)) AS e FROM c GROUP BY ALL), m AS (SELECT video_id, particle, min(e) AS e FROM e GROUP BY ALL)
SELECT video_id, particle, round(e, 6) + 0.0 AS entropy FROM (SELECT DISTINCT video_id, particle FROM b) LEFT JOIN m USING (video_id, particle)""",
    "filter_stubs": f"WITH {T} SELECT video_id, particle, frame, {_R('x')}, {_R('y')} FROM t WHERE (video_id, particle) IN (SELECT (video_id, particle) FROM t GROUP BY video_id, particle HAVING count(*) >= 30)",
    "filter_clusters": f"""WITH f AS (SELECT DISTINCT feature_id, mass, size FROM features),
t AS (SELECT DISTINCT video_id, particle, frame, x, y, feature_id FROM traj WHERE particle IS NOT NULL AND {OK}), j AS (SELECT t.*, CASE WHEN CAST(size AS VARCHAR) <> 'nan' THEN size END AS s, size FROM t JOIN f USING (feature_id)),
k AS (SELECT video_id, particle FROM j GROUP BY ALL HAVING avg(s) < (SELECT quantile_cont(s, 0.6) FROM j))
SELECT video_id, particle, frame, {_R('size')} FROM j SEMI JOIN k USING (video_id, particle)""",
    "filter_condition": f"WITH {T} SELECT video_id, particle, frame, {_R('x')}, {_R('y')} FROM t WHERE (video_id, particle) IN (SELECT (video_id, particle) FROM t GROUP BY video_id, particle HAVING max(x) - min(x) > 5)",
    "mass_size_filter": f"SELECT DISTINCT feature_id, video_id, frame, {_R('mass')}, {_R('size')} FROM features WHERE CAST(mass AS VARCHAR) <> 'nan' AND CAST(size AS VARCHAR) <> 'nan' AND mass > 100 AND size < 2.2",
    "topn": f"""WITH f AS (SELECT DISTINCT feature_id, video_id, frame, mass FROM features WHERE mass IS NOT NULL AND CAST(mass AS VARCHAR) <> 'nan'),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY mass DESC, feature_id) AS k FROM f) SELECT feature_id, video_id, frame, {_R('mass')} FROM r WHERE k <= 3""",
    "verify_integrity": "SELECT video_id, frame, particle, count(*) AS n_rows FROM traj WHERE particle IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
}
