"""Queries on images made of the embeddings: one image per label, a row per vector, a column per element."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motespark.common import rounded, table
from motespark.functions.masks import binary_mask, cosmask, gaussian_kernel, r_squared_mask, sinmask
from motespark.operators import pixels as p
from motespark.operators.locate import batch
from motespark.plans.motion_queries import _r
from motespark.plans.sqlutil import r6

K = ["label"]


def pixels(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint"))
    e = e.select("label", "y", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.col("label").cast("bigint").alias("label"), "y", F.col("x").cast("bigint").alias("x"), F.round(F.abs(F.col("e").cast("double")) * 1000).cast("bigint").alias("v"))


def frames(spark, d):
    """The same images, packed."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1), dtype=np.uint16)
        img[pdf.y, pdf.x] = pdf.v
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "shape": [list(img.shape)], "dtype": ["uint16"], "data": [img.tobytes()]})

    return pixels(spark, d).groupBy("label").applyInPandas(pack, "label bigint, shape array<int>, dtype string, data binary")


def px_invert(spark, d):
    return p.invert(pixels(spark, d), 65535)


def px_lowpass(spark, d):
    return _r(p.lowpass(pixels(spark, d), K, 1.0))


def px_boxcar(spark, d):
    return p.boxcar(pixels(spark, d), K, 5)


def px_bandpass(spark, d):
    return _r(p.bandpass(pixels(spark, d), K, 1.0, 5))


def px_convert_to_int(spark, d):
    return _r(p.convert_to_int(pixels(spark, d).withColumn("v", F.col("v") / 7.0), K))


def px_percentile_threshold(spark, d):
    return _r(p.percentile_threshold(pixels(spark, d), K, 64))


def px_dilation_peaks(spark, d):
    return p.dilation_peaks(pixels(spark, d), K, 5)


def px_characterize(spark, d):
    px = pixels(spark, d)
    return _r(p.characterize(px, p.dilation_peaks(px, K, 5), K, 3))


def px_measure_noise(spark, d):
    px = pixels(spark, d)
    lit = px.withColumn("v", F.when(F.col("v") > 400, F.col("v")).otherwise(0))
    return _r(p.measure_noise(lit, px, K, 2))


def locate_batch(spark, d):
    return batch(frames(spark, d), 5, ("label",), minmass=10).select("label", *[rounded(F.col(c), 4).alias(c) for c in ("y", "x", "mass", "size", "ecc", "signal", "raw_mass", "ep")])


QUERIES = {f.__name__: f for f in (px_invert, px_lowpass, px_boxcar, px_bandpass, px_convert_to_int, px_percentile_threshold, px_dilation_peaks, px_characterize, px_measure_noise, locate_batch)}

PX = """e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
px AS (SELECT CAST(label AS BIGINT) AS label, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(round(abs(CAST(e AS DOUBLE)) * 1000) AS BIGINT) AS v FROM e)"""
_K = gaussian_kernel(1.0)
_H = len(_K) // 2


def _conv(axis: str) -> str:
    return " + ".join(f"coalesce(lag(v, {o}) OVER w, 0) * {_K[_H + o]:.17e}" if o >= 0 else f"coalesce(lead(v, {-o}) OVER w, 0) * {_K[_H + o]:.17e}" for o in range(-_H, _H + 1))


_LOW = f"""lo1 AS (SELECT label, y, x, {_conv('y')} AS v FROM px WINDOW w AS (PARTITION BY label, x ORDER BY y)),
low AS (SELECT label, y, x, {_conv('x')} AS v FROM lo1 WINDOW w AS (PARTITION BY label, y ORDER BY x))"""


def _box(src: str, name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT label, y, x, CAST(floor((sum(v) OVER (PARTITION BY label, {b} ORDER BY {a} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
 + first_value(v) OVER f * greatest(2 - ({a} - min({a}) OVER f), 0) + last_value(v) OVER f * greatest(2 - (max({a}) OVER f - {a}), 0)) / 5) AS BIGINT) AS v
 FROM {src} WINDOW f AS (PARTITION BY label, {b} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


_BOX = f"{_box('px', 'bx1', 'y', 'x')}, {_box('bx1', 'box', 'x', 'y')}"
_S = int(2 * 5 / 2**0.5)
_PEAKS = f"""d1 AS (SELECT *, max(v) OVER (PARTITION BY label, x ORDER BY y ROWS BETWEEN {(_S - 1) // 2} PRECEDING AND {_S // 2} FOLLOWING) AS m FROM px),
d2 AS (SELECT label, y, x, v, max(m) OVER (PARTITION BY label, y ORDER BY x ROWS BETWEEN {(_S - 1) // 2} PRECEDING AND {_S // 2} FOLLOWING) AS m FROM d1),
lim AS (SELECT label, max(y) AS my, max(x) AS mx, quantile_cont(CASE WHEN v <> 0 THEN v END, 0.64) AS t FROM px GROUP BY label),
peaks AS (SELECT d2.label, y, x, v FROM d2 JOIN lim USING (label) WHERE v = m AND v > t AND y BETWEEN 2 AND my - 2 AND x BETWEEN 2 AND mx - 2)"""


def _mask(radius: int) -> str:
    m, r2, c, s = binary_mask(radius, 2), r_squared_mask(radius, 2), cosmask(radius), sinmask(radius)
    n = 2 * radius + 1
    return ", ".join(f"({i - radius}, {j - radius}, {r2[i, j]:.17e}, {c[i, j]:.17e}, {s[i, j]:.17e})" for i in range(n) for j in range(n) if m[i, j])


ORACLES = {
    "px_invert": f"WITH {PX} SELECT label, y, x, xor(v, 65535) AS v FROM px",
    "px_lowpass": f"WITH {PX}, {_LOW} SELECT label, y, x, {r6('v')} FROM low",
    "px_boxcar": f"WITH {PX}, {_BOX} SELECT * FROM box",
    "px_bandpass": f"WITH {PX}, {_LOW}, {_BOX}, d AS (SELECT label, y, x, low.v - box.v AS d FROM low JOIN box USING (label, y, x)) SELECT label, y, x, {r6('CASE WHEN d >= 1 THEN d ELSE 0 END', 'v')} FROM d",
    "px_convert_to_int": f"WITH {PX}, q AS (SELECT label, y, x, v / 7.0 AS v FROM px), m AS (SELECT label, 255.0 / CAST(max(v) AS DOUBLE) AS factor FROM q GROUP BY label) "
    f"SELECT label, y, x, CAST(floor(v * factor) AS BIGINT) AS v, {r6('factor')} FROM q JOIN m USING (label)",
    "px_percentile_threshold": f"WITH {PX} SELECT label, {r6('quantile_cont(CASE WHEN v <> 0 THEN v END, 0.64)', 'threshold')} FROM px GROUP BY label",
    "px_dilation_peaks": f"WITH {PX}, {_PEAKS} SELECT * FROM peaks",
    "px_characterize": f"""WITH {PX}, {_PEAKS}, mask(dy, dx, r2, c, s) AS (VALUES {_mask(3)}),
j AS (SELECT p.label, p.y, p.x, px.v, dy, dx, r2, c, s FROM peaks p CROSS JOIN mask LEFT JOIN px ON px.label = p.label AND px.y = p.y + dy AND px.x = p.x + dx),
g AS (SELECT label, y, x, count(v) = {int(binary_mask(3, 2).sum())} AS ok, sum(v) AS mass, sum(v * r2) AS r2, sum(v * c) AS c, sum(v * s) AS s, max(v) AS signal, max(CASE WHEN dy = 0 AND dx = 0 THEN v END) AS mid FROM j GROUP BY ALL)
SELECT label, y, x, {r6('CASE WHEN ok THEN CAST(mass AS DOUBLE) END', 'mass')}, {r6('CASE WHEN ok THEN sqrt(r2 / mass) END', 'size')}, {r6('CASE WHEN ok THEN sqrt(c * c + s * s) / (mass - mid + 1e-6) END', 'ecc')}, {r6('CASE WHEN ok THEN CAST(signal AS DOUBLE) END', 'signal')} FROM g""",
    "px_measure_noise": f"""WITH {PX}, mask(dy, dx, r2, c, s) AS (VALUES {_mask(2)}), near AS (SELECT DISTINCT label, y - dy AS y, x - dx AS x FROM px CROSS JOIN mask WHERE v > 400),
dark AS (SELECT * FROM px ANTI JOIN near USING (label, y, x)), g AS (SELECT label, avg(v) AS b, CASE WHEN count(*) > 1 THEN stddev_pop(v) END AS s FROM dark GROUP BY label)
SELECT label, {r6('b', 'background')}, {r6('s', 'noise')} FROM (SELECT DISTINCT label FROM px) LEFT JOIN g USING (label)""",
}
