"""Image filters on a pixel table (keys, y, x, v): windows along the axes, stencils by join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.functions.masks import binary_mask, cosmask, gaussian_kernel, r_squared_mask, sinmask


def _lines(keys: Sequence[str], axis: str, other: Sequence[str]) -> W:
    return W.partitionBy(*keys, *other).orderBy(axis)


def _other(axis: str, axes: Sequence[str]) -> list[str]:
    return [a for a in axes if a != axis]


def invert(px: DataFrame, max_value: int | float = 255, integer: bool = True) -> DataFrame:
    """Integers: bits flipped below the maximum; floats: maximum less value."""
    v = F.col("v").cast("bigint").bitwiseXOR(F.lit(int(max_value))) if integer else F.lit(float(max_value)) - F.col("v")
    return px.withColumn("v", v)


def lowpass(px: DataFrame, keys: Sequence[str], sigma: float = 1.0, truncate: float = 4.0, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """Gaussian smoothing along each axis, 0 beyond the border. The pixels of a line must be complete."""
    k = gaussian_kernel(sigma, truncate)
    half = len(k) // 2
    out = px.withColumn("v", F.col("v").cast("double"))
    for a in axes:
        w = _lines(keys, a, _other(a, axes))
        terms = [F.coalesce(F.lag("v", o).over(w), F.lit(0.0)) * F.lit(float(k[half + o])) for o in range(-half, half + 1)]
        out = out.withColumn("v", sum(terms[1:], terms[0]))
    return out


def boxcar(px: DataFrame, keys: Sequence[str], size: int, integer: bool = True, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """Mean over an odd box, the border repeated; integer images are cut to integers after each axis."""
    if size % 2 == 0:
        raise ValueError("the smoothing size must be odd")
    h, out = size // 2, px
    for a in axes:
        w = _lines(keys, a, _other(a, axes))
        full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        box = w.rowsBetween(-h, h)
        lo, hi = F.first("v").over(full), F.last("v").over(full)
        short_lo = F.greatest(F.lit(h) - (F.col(a) - F.min(a).over(full)), F.lit(0))
        short_hi = F.greatest(F.lit(h) - (F.max(a).over(full) - F.col(a)), F.lit(0))
        v = (F.sum("v").over(box) + lo * short_lo + hi * short_hi) / F.lit(size)
        out = out.withColumn("v", F.floor(v).cast("bigint") if integer else v)
    return out


def bandpass(px: DataFrame, keys: Sequence[str], lshort: float, llong: int, threshold: float | None = None, integer: bool = True) -> DataFrame:
    """lowpass less boxcar; values below the threshold (1, or 1/255 for floats) are 0."""
    if lshort >= llong:
        raise ValueError("the smoothing length must be larger than the noise length")
    limit = (1.0 if integer else 1 / 255) if threshold is None else float(threshold)
    low = lowpass(px, keys, lshort)
    box = boxcar(px, keys, llong, integer).select(*keys, "y", "x", F.col("v").alias("_b"))
    d = F.col("v") - F.col("_b")
    return low.join(box, [*keys, "y", "x"]).select(*keys, "y", "x", F.when(d >= limit, d).otherwise(F.lit(0.0)).alias("v"))


def convert_to_int(px: DataFrame, keys: Sequence[str], top: int = 255) -> DataFrame:
    """Scaled so that the image's maximum is ``top``, negatives 0, decimals cut; with the ``factor``."""
    peak = px.groupBy(*keys).agg(F.max("v").alias("_m"))
    factor = F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(F.lit(float(top)) / F.col("_m"))
    j = px.join(peak, list(keys)).withColumn("factor", factor)
    return j.withColumn("v", F.floor(F.greatest(F.col("v"), F.lit(0.0)) * F.col("factor")).cast("bigint")).drop("_m")


def percentile_threshold(px: DataFrame, keys: Sequence[str], percentile: float) -> DataFrame:
    """Per image: the linear percentile of the pixels that aren't 0; NULL if there are none."""
    return px.groupBy(*keys).agg(F.percentile(F.when(F.col("v") != 0, F.col("v")), F.lit(percentile / 100)).alias("threshold"))


def dilation_peaks(px: DataFrame, keys: Sequence[str], separation: float, percentile: float = 64, margin: int | None = None) -> DataFrame:
    """Pixels equal to the maximum of the box around them, above the image's percentile, away from the border."""
    size = int(2 * separation / 2**0.5)
    edge = int(separation / 2) if margin is None else margin
    out = px.withColumn("m", F.col("v"))
    for a, b in (("y", "x"), ("x", "y")):
        out = out.withColumn("m", F.max("m").over(_lines(keys, a, [b]).rowsBetween(-((size - 1) // 2), size // 2)))
    lim = px.groupBy(*keys).agg(F.max("y").alias("_y"), F.max("x").alias("_x"), F.percentile(F.when(F.col("v") != 0, F.col("v")), F.lit(percentile / 100)).alias("_t"))
    inside = F.col("y").between(edge, F.col("_y") - edge) & F.col("x").between(edge, F.col("_x") - edge)
    return out.join(lim, list(keys)).where((F.col("v") == F.col("m")) & (F.col("v") > F.col("_t")) & inside).select(*keys, "y", "x", "v")


def _stencil(radius: int) -> Column:
    mask, r2, c, s = binary_mask(radius, 2), r_squared_mask(radius, 2), cosmask(radius), sinmask(radius)
    rows = []
    for i in range(2 * radius + 1):
        for j in range(2 * radius + 1):
            if mask[i, j]:
                rows.append(F.struct(F.lit(i - radius).alias("dy"), F.lit(j - radius).alias("dx"), F.lit(float(r2[i, j])).alias("r2"), F.lit(float(c[i, j])).alias("c"), F.lit(float(s[i, j])).alias("s")))
    return F.array(*rows)


def characterize(px: DataFrame, features: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """mass, size, ecc and signal of features at whole pixels (keys, y, x); NULL where the mask leaves the image."""
    n = int(binary_mask(radius, 2).sum())
    f = features.select(*keys, F.col("y").alias("fy"), F.col("x").alias("fx"), F.explode(_stencil(radius)).alias("m"))
    f = f.select(*keys, "fy", "fx", (F.col("fy") + F.col("m.dy")).alias("y"), (F.col("fx") + F.col("m.dx")).alias("x"), "m")
    j = f.join(px.select(*keys, "y", "x", "v"), [*keys, "y", "x"], "left")
    mid = (F.col("m.dy") == 0) & (F.col("m.dx") == 0)
    g = j.groupBy(*keys, F.col("fy").alias("y"), F.col("fx").alias("x")).agg(
        F.count("v").alias("_n"), F.sum("v").alias("mass"), F.sum(F.col("v") * F.col("m.r2")).alias("_r2"), F.sum(F.col("v") * F.col("m.c")).alias("_c"),
        F.sum(F.col("v") * F.col("m.s")).alias("_s"), F.max("v").alias("signal"), F.max(F.when(mid, F.col("v"))).alias("_v"),
    )
    whole = F.col("_n") == n
    return g.select(
        *keys, "y", "x", F.when(whole, F.col("mass").cast("double")).alias("mass"), F.when(whole & (F.col("mass") != 0), F.sqrt(F.col("_r2") / F.col("mass"))).alias("size"),
        F.when(whole, F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / (F.col("mass") - F.col("_v") + 1e-6)).alias("ecc"), F.when(whole, F.col("signal").cast("double")).alias("signal"),
    )


def measure_noise(bp: DataFrame, raw: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Per image: mean and standard deviation of the raw pixels with nothing lit in ``bp`` under the mask around them."""
    near = bp.where("v <> 0").select(*keys, "y", "x", F.explode(_stencil(radius)).alias("m")).select(*keys, (F.col("y") - F.col("m.dy")).alias("y"), (F.col("x") - F.col("m.dx")).alias("x")).distinct()
    dark = raw.join(near, [*keys, "y", "x"], "left_anti").groupBy(*keys).agg(F.avg("v").alias("background"), F.when(F.count("v") > 1, F.stddev_pop("v")).alias("noise"))
    return raw.select(*keys).distinct().join(dark, list(keys), "left")
