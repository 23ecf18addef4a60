"""Motion analysis of tracks: displacements, drift, displacement histograms, correlations.

Positions are pixels and times are frames; ``mpp`` (microns per pixel) and ``fps`` scale the results. ``keys`` names the
columns that identify a track, ``groups`` those that identify a movie. NaN is treated as NULL throughout. A track must
have at most one row for a frame; repeated rows must be dropped before (``distinct``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import first_rows, need, present
from motespark.operators.intervals import next_reading
from motespark.operators.ordering import numbered

KEYS = ("particle",)
XY = ("x", "y")
#: frames of a block of one track
BLOCK = 4096
#: rows, and cells of (segment, lag), that a task works on at once
CHUNK = 200_000
CELLS = 1 << 20


def _pair_sums(keys: list[str], values: list[str], max_lag: int):
    """Per segment (one block of one track) and lag: pairs of rows, sums of their differences and of the squares.

    A row of lag 0 carries the segment's own first and last frame and number of rows.
    """

    def one(tab: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        frame, own = tab["frame"].to_numpy(), tab["own"].to_numpy(zero_copy_only=False)
        seg = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, tab.num_rows]))
        v = [tab[c].to_numpy() for c in values]
        width = max_lag + 1
        sums = np.zeros((1 + 2 * len(v), len(heads) * width))
        a, step = np.flatnonzero(own), 0
        while len(a):
            step += 1
            a = a[a + step < len(frame)]
            b = a + step
            lag = frame[b] - frame[a]
            near = (seg[a] == seg[b]) & (lag <= max_lag)  # frames ascend: a row past its last partner has none farther on
            a, b, lag = a[near], b[near], lag[near]
            some = lag > 0
            cell = seg[a[some]] * width + lag[some]
            sums[0] += np.bincount(cell, minlength=sums.shape[1])
            for i, x in enumerate(v):
                d = x[b[some]] - x[a[some]]
                sums[1 + 2 * i] += np.bincount(cell, weights=d, minlength=sums.shape[1])
                sums[2 + 2 * i] += np.bincount(cell, weights=d * d, minlength=sums.shape[1])
        cell = np.flatnonzero(sums[0])
        mine = np.flatnonzero(own)
        head = np.unique(seg[mine], return_index=True)
        tail = np.r_[head[1][1:], len(mine)] - 1
        of, n, none = head[0], len(cell), len(head[0])
        cols = [pa.concat_arrays([tab[k].combine_chunks().take(pa.array(heads[cell // width])), tab[k].combine_chunks().take(pa.array(heads[of]))]) for k in keys]
        cols += [pa.array(np.r_[cell % width, np.zeros(none, dtype=np.int64)]), pa.array(np.r_[sums[0][cell].astype(np.int64), np.zeros(none, dtype=np.int64)])]
        cols += [pa.array(np.r_[x[cell], np.zeros(none)]) for x in sums[1:]]
        blank = pa.nulls(n, pa.int64())
        cols += [pa.concat_arrays([blank, pa.array(x)]) for x in (frame[mine[head[1]]], frame[mine[tail]], tail - head[1] + 1)]
        names = [*keys, "lag", "n", *[f"{k}{i}" for i in range(len(v)) for k in "sq"], "first", "last", "rows"]
        yield from pa.table(cols, names=names).to_batches(max_chunksize=65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [], 0

        def whole(tab: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, held
            heads = first_rows(tab, ["seg", *keys])
            stop = tab.num_rows if last else int(heads[-1])
            use = heads if last else heads[:-1]
            many = max(1, CELLS // (max_lag + 1))
            for k in range(0, len(use), many):
                lo, hi = int(use[k]), int(use[k + many]) if k + many < len(use) else stop
                yield from one(tab.slice(lo, hi - lo), use[k : k + many] - lo)
            tab = tab.slice(stop)
            rest, held = tab.to_batches(), tab.num_rows

        for b in batches:
            rest.append(b)
            held += b.num_rows
            if held >= CHUNK:
                yield from whole(pa.Table.from_batches(rest).combine_chunks(), False)
        if held:
            yield from whole(pa.Table.from_batches(rest).combine_chunks(), True)

    return run


def lag_sums(traj: DataFrame, keys: Sequence[str], values: Sequence[str], max_lag: int, block: int = BLOCK) -> DataFrame:
    """Per track and lag 1..min(max_lag, frames spanned - 1): ``n`` pairs of rows so far apart, ``s<i>`` and ``q<i>``, the sums of
    their differences and squared differences in value i, and the track's ``_span`` and ``_n``.

    Tracks are cut into blocks of frames that carry the ``max_lag`` frames after them, so long tracks spread over tasks;
    a task forms its pairs in arrays, and only sums per track, block and lag leave it. Rows with a NULL key or frame are dropped.
    """
    keys, values, block = list(keys), list(values), max(block, max_lag)
    ks, vs = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    blk = F.floor(F.col("frame") / F.lit(block)).cast("bigint")
    at = F.array(blk, F.when(F.col("frame") - blk * block < max_lag, blk - 1))
    src = traj.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col("frame").cast("bigint").alias("frame"), *[F.col(v).cast("double").alias(a) for v, a in zip(values, vs)])
    src = src.dropna(subset=[*ks, "frame"])
    rows = src.withColumn("_b", F.explode(F.filter(at, lambda b: b.isNotNull()))).withColumn("own", F.col("_b") == blk)
    rows = rows.withColumn("seg", F.xxhash64(*ks, "_b")).repartition("seg").sortWithinPartitions("seg", *ks, "_b", "frame").drop("_b")
    sums = [T.StructField(f"{k}{i}", T.DoubleType()) for i in range(len(vs)) for k in "sq"]
    fields = [T.StructField(a, traj.schema[k].dataType) for k, a in zip(keys, ks)] + [T.StructField(c, T.LongType()) for c in ("lag", "n")] + sums
    fields += [T.StructField(c, T.LongType()) for c in ("first", "last", "rows")]
    part = rows.mapInArrow(_pair_sums(ks, vs, max_lag), T.StructType(fields)).repartition(*ks)
    total = [F.sum(c).alias(c) for c in ("n", *[f.name for f in sums])]
    w = W.partitionBy(*ks)
    g = part.groupBy(*ks, "lag").agg(*total, F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"))
    g = g.withColumns({"_span": F.max("last").over(w) - F.min("first").over(w) + 1, "_n": F.max("rows").over(w)})
    # the row of lag 0 stands for all lags of the track, those without a pair included
    lags = F.when(F.col("lag") > 0, F.array("lag")).when(F.col("_span") > 1, F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(max_lag).cast("bigint"), F.col("_span") - 1)))
    full = g.withColumn("lag", F.explode(lags)).groupBy(*ks, "lag").agg(*total, F.max("_span").alias("_span"), F.max("_n").alias("_n"))
    return full.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "lag", "n", *[f.name for f in sums], "_span", "_n")


def effective_n(n: Column, t: Column) -> Column:
    """Number of independent measurements of a squared displacement at lag t in a track of n positions (Qian 1991, B4)."""
    n, t = n.cast("double"), t.cast("double")
    long = F.lit(1) / (1 + (F.pow(n - t, 3) + 5 * t - 4 * F.pow(n - t, 2) * t - n) / (6 * (n - t) * t * t))
    short = 6 * F.pow(n - t, 2) * t / (2 * n - t + 4 * n * t * t - 5 * F.pow(t, 3))
    return F.when(t > n / 2, long).otherwise(short)


def _ratio(a: Column, b: Column, undefined: float | None) -> Column:
    """a / b, with ``undefined`` for 0 / 0 and for a missing side."""
    return F.coalesce(F.try_divide(a, b), F.lit(undefined).cast("double"))


def msd(traj: DataFrame, mpp: float, fps: float, max_lagtime: int = 100, keys: Sequence[str] = KEYS, pos: Sequence[str] = XY, undefined: float | None = None) -> DataFrame:
    """Mean displacement and mean squared displacement of every track at every lag.

    One row for each track and lag 1..min(max_lagtime, frames spanned - 1): ``<p>``, ``<p^2>`` for each position
    column, ``msd`` (NULL where no two frames lie so far apart), ``N`` (effective measurements, 0 where msd is NULL and
    rescaled to keep the track's total) and ``lagt`` in seconds. Rows with a missing position aren't observations.
    A track without any two frames that lie ``max_lagtime`` or less apart has nothing to carry its total: its N is
    ``undefined``, NULL or NaN.
    """
    keys, pos = list(keys), list(pos)
    need(traj, *keys, "frame", *pos)
    t = traj.where(present(*pos)).select(*keys, "frame", *[(F.col(p) * F.lit(float(mpp))).alias(p) for p in pos])
    per = lag_sums(t, keys, pos, max_lagtime)
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    d = per.withColumns({**{f"<{p}>": mean(f"s{i}") for i, p in enumerate(pos)}, **{f"<{p}^2>": mean(f"q{i}") for i, p in enumerate(pos)}})
    d = d.withColumn("msd", sum((F.col(f"<{p}^2>") for p in pos[1:]), F.col(f"<{pos[0]}^2>")))
    d = d.withColumn("_raw", effective_n(F.col("_span"), F.col("lag")) * F.col("_n") / F.col("_span"))
    d = d.withColumn("_n0", F.when(F.col("msd").isNull(), F.lit(0.0)).otherwise(F.col("_raw")))
    w = W.partitionBy(*keys)
    d = d.withColumn("N", _ratio(F.col("_n0") * F.sum("_raw").over(w), F.sum("_n0").over(w), undefined))
    return d.select(*keys, "lag", *[f"<{p}>" for p in pos], *[f"<{p}^2>" for p in pos], "msd", "N", (F.col("lag") / F.lit(float(fps))).alias("lagt"))


def imsd(traj: DataFrame, mpp: float, fps: float, max_lagtime: int = 100, statistic: str = "msd", keys: Sequence[str] = KEYS, pos: Sequence[str] = XY, wide: bool = False) -> DataFrame:
    """One statistic of every track by lag time: long, or with ``wide`` one column for each value of the last key."""
    out = msd(traj, mpp, fps, max_lagtime, keys, pos).select(*keys, "lag", "lagt", F.col(f"`{statistic}`").alias(statistic))
    if not wide:
        return out
    *rest, last = keys
    return out.groupBy(*rest, "lagt").pivot(last).agg(F.first(f"`{statistic}`"))


def emsd(traj: DataFrame, mpp: float, fps: float, max_lagtime: int = 100, detail: bool = False, keys: Sequence[str] = KEYS, groups: Sequence[str] = (), pos: Sequence[str] = XY, compat: bool = False, undefined: float | None = None) -> DataFrame:
    """Ensemble mean squared displacement by lag: groups, ``lag``, ``lagt``, ``msd``; with ``detail`` all means and N.

    Tracks weigh in with N. Those without any pair of frames within the lags are left out, and the mean is NULL at a lag
    that no track has a pair for. With ``undefined`` NaN, 0 / 0 counts as in SQL on doubles: such a lag is NaN, and such a
    track makes its whole group NaN at all of the track's lags. ``compat`` keeps a peculiar rule for means with NULL entries: they are left out of the
    numerator's mean but not of the denominator's.
    """
    d = msd(traj, mpp, fps, max_lagtime, [*groups, *keys], pos, undefined)
    means = [f"<{p}>" for p in pos] + [f"<{p}^2>" for p in pos]
    weighted = lambda c: _ratio(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("N")), F.sum("N"), undefined)
    aggs = [weighted(F.col("msd")).alias("msd")]
    if detail:
        quirk = F.count("N")
        for m in means:
            c = F.col(f"`{m}`")
            aggs.append((_ratio(weighted(c) * quirk, F.count(c), undefined) if compat else weighted(c)).alias(m))
        aggs.append(F.coalesce(F.sum("N"), F.lit(0.0)).alias("N"))
    return d.groupBy(*groups, "lag").agg(F.first("lagt").alias("lagt"), *aggs)


def compute_drift(traj: DataFrame, smoothing: int = 0, keys: Sequence[str] = KEYS, groups: Sequence[str] = (), pos: Sequence[str] = ("y", "x")) -> DataFrame:
    """Cumulative ensemble drift by frame; the first frame, and frames that no track steps into, are absent.

    A step counts if a track is in this frame and in the one before. ``smoothing`` averages the mean steps over that
    many trailing rows. The steps are found by an equi-join on (track, frame), so long tracks spread over all tasks.
    """
    keys, pos, groups = [*groups, *keys], list(pos), list(groups)
    need(traj, *keys, "frame", *pos)
    t = traj.select(*keys, "frame", *pos)
    before = t.select(*keys, (F.col("frame") + 1).alias("frame"), *[F.col(p).alias(f"_{p}") for p in pos])
    step = t.join(before, [*keys, "frame"])
    clean = lambda p: F.when(F.isnan(F.col(p) - F.col(f"_{p}")), None).otherwise(F.col(p) - F.col(f"_{p}"))
    mean = step.groupBy(*groups, "frame").agg(*[F.avg(clean(p)).alias(p) for p in pos])
    order = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy("frame")
    if smoothing > 0:
        back = order.rowsBetween(-(smoothing - 1), 0)
        mean = mean.select(*groups, "frame", *[F.avg(p).over(back).alias(p) for p in pos])
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return mean.select(*groups, "frame", *[F.when(F.col(p).isNotNull(), F.sum(p).over(upto)).alias(p) for p in pos])


def subtract_drift(traj: DataFrame, drift: DataFrame | None = None, keys: Sequence[str] = KEYS, groups: Sequence[str] = ()) -> DataFrame:
    """Positions less the drift of their frame. A missing side counts as 0, both missing stay NULL."""
    if drift is None:
        drift = compute_drift(traj, keys=keys, groups=groups)
    on = [*groups, "frame"]
    pos = [c for c in drift.columns if c not in on]
    d = drift.select(*on, *[F.when(F.isnan(p), None).otherwise(F.col(p)).alias(f"_{p}") for p in pos])
    j = traj.join(d, on, "left")
    zero = F.lit(0.0)

    def less(p: str) -> Column:
        x = F.when(F.isnan(p), None).otherwise(F.col(p))
        return F.when(x.isNull() & F.col(f"_{p}").isNull(), None).otherwise(F.coalesce(x, zero) - F.coalesce(F.col(f"_{p}"), zero))

    return j.select(*[less(c).alias(c) if c in pos else F.col(c) for c in traj.columns])


def is_typical(msds: DataFrame, frame: int = 23, lower: float = 0.1, upper: float = 0.9, keys: Sequence[str] = KEYS, groups: Sequence[str] = ()) -> DataFrame:
    """Per track: does its value in the long ``imsd`` result at lag ``frame + 1`` lie strictly between two quantiles?

    Tracks without a value there are not typical.
    """
    stat = msds.columns[-1]
    at = msds.groupBy(*groups, *keys).agg(F.max(F.when(F.col("lag") == frame + 1, F.col(f"`{stat}`"))).alias("v"))
    q = at.groupBy(*groups).agg(F.percentile("v", F.lit(lower)).alias("lo"), F.percentile("v", F.lit(upper)).alias("hi"))
    j = at.join(q, list(groups)) if groups else at.join(F.broadcast(q))  # q is one row then
    return j.select(*groups, *keys, F.coalesce((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")), F.lit(False)).alias("typical"))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number of v among equal bins of [lo, hi]; the right-most edge belongs to the last bin."""
    return F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def vanhove(traj: DataFrame, lagtime: int, mpp: float = 1.0, ensemble: bool = False, bins: int = 24, column: str = "x", keys: Sequence[str] = KEYS, groups: Sequence[str] = ()) -> DataFrame:
    """Density of displacements at one lag, per track (bins that hold something) or of the ensemble (all bins).

    The bins split the range of all displacements of the movie evenly. The ensemble value is the sum of the tracks'
    densities over the number of tracks, those without a displacement included.
    """
    ks, groups = [*groups, *keys], list(groups)
    t = traj.where(present(column)).select(*ks, "frame", (F.col(column) * F.lit(float(mpp))).alias("v"))
    before = t.select(*ks, (F.col("frame") + lagtime).alias("frame"), F.col("v").alias("u"))
    disp = t.join(before, [*ks, "frame"]).select(*ks, (F.col("v") - F.col("u")).alias("d"))
    lim = disp.groupBy(*groups).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    lim = lim.select(*groups, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    j = disp.join(lim, groups) if groups else disp.join(F.broadcast(lim))  # one row then
    j = j.withColumn("bin", _bin(F.col("d"), F.col("lo"), F.col("hi"), bins))
    per = j.groupBy(*ks, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(W.partitionBy(*ks))
    edge = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins
    per = per.withColumn("density", F.col("c") / n * bins / (F.col("hi") - F.col("lo"))).withColumn("edge", edge)
    if not ensemble:
        return per.select(*ks, "bin", "edge", "density")
    tracks = traj.select(*ks).distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("tracks"))
    full = (lim.join(tracks, groups) if groups else lim.join(F.broadcast(tracks))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    got = per.groupBy(*groups, "bin").agg(F.sum("density").alias("s"))
    out = full.join(got, [*groups, "bin"], "left")
    return out.select(*groups, "bin", edge.alias("edge"), (F.coalesce("s", F.lit(0.0)) / F.col("tracks")).alias("density"))


def relate_frames(traj: DataFrame, frame1: int, frame2: int, pos: Sequence[str] = XY, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions of the tracks in frame1 beside those in frame2 (``<p>_b``), ``d<p>``, ``dr`` and for x, y ``direction``."""
    keys, pos = list(keys), list(pos)
    a = traj.where(F.col("frame") == frame1).select(*keys, *pos)
    b = traj.where(F.col("frame") == frame2).select(*keys, *[F.col(p).alias(f"{p}_b") for p in pos])
    j = a.join(b, keys, "left").withColumns({f"d{p}": F.col(f"{p}_b") - F.col(p) for p in pos})
    j = j.withColumn("dr", F.sqrt(sum((F.col(f"d{p}") * F.col(f"d{p}") for p in pos[1:]), F.col(f"d{pos[0]}") * F.col(f"d{pos[0]}"))))
    return j.withColumn("direction", F.atan2("dy", "dx")) if pos == ["x", "y"] else j


def _moved_pairs(traj: DataFrame, frame1: int, frame2: int, keys: Sequence[str], groups: Sequence[str], cutoff: float | None) -> DataFrame:
    j = relate_frames(traj, frame1, frame2, XY, [*groups, *keys])
    ident = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    side = lambda s: j.select(*groups, ident.alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("x", "y", "dr", "direction")])
    a, b = side("1"), side("2")
    if cutoff is not None:
        size = float(cutoff)
        cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("bigint")
        around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        a = a.withColumns({"_cx": cell("x_1"), "_cy": cell("y_1")})
        b = b.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).withColumns({"_cx": cell("x_2") + F.col("_i"), "_cy": cell("y_2") + F.col("_j")}).drop("_i", "_j")
    on = [*groups] + (["_cx", "_cy"] if cutoff is not None else [])
    if not on:
        raise ValueError("give groups or a cutoff: all pairs of a whole table aren't formed")
    p = a.join(b, on).where(F.col("id_1") < F.col("id_2"))
    r = F.sqrt(F.pow(F.col("x_1") - F.col("x_2"), 2) + F.pow(F.col("y_1") - F.col("y_2"), 2))
    p = p.withColumn("r", r).withColumn("cos", F.cos(F.col("direction_1") - F.col("direction_2")))
    return p.where(F.col("r") <= cutoff) if cutoff is not None else p


def direction_corr(traj: DataFrame, frame1: int, frame2: int, keys: Sequence[str] = KEYS, groups: Sequence[str] = (), cutoff: float | None = None) -> DataFrame:
    """Cosine between the displacements of pairs of tracks, with their distance ``r`` in frame1.

    ``cutoff`` limits the pairs to that distance and finds them by grid cells; without it every pair of the movie is
    formed, which a few thousand tracks can stand. A track that is absent in frame2 has a NULL cosine.
    """
    return _moved_pairs(traj, frame1, frame2, keys, groups, cutoff).select(*groups, "id_1", "id_2", "r", "cos")


def velocity_corr(traj: DataFrame, frame1: int, frame2: int, keys: Sequence[str] = KEYS, groups: Sequence[str] = (), cutoff: float | None = None) -> DataFrame:
    """As ``direction_corr``, with ``dot_product`` of the displacements."""
    p = _moved_pairs(traj, frame1, frame2, keys, groups, cutoff)
    return p.select(*groups, "id_1", "id_2", "r", (F.col("cos") * F.abs(F.col("dr_1") * F.col("dr_2"))).alias("dot_product"))


def diagonal_size(traj: DataFrame, keys: Sequence[str] = KEYS, pos: Sequence[str] = XY) -> DataFrame:
    """Diagonal of each track's bounding box."""
    width = lambda p: F.pow(F.max(F.when(present(p), F.col(p))) - F.min(F.when(present(p), F.col(p))), 2)
    return traj.groupBy(*keys).agg(F.sqrt(sum((width(p) for p in pos[1:]), width(pos[0]))).alias("diagonal_size"))


def _directions(traj: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    t = traj.where(present("x", "y")).select(*keys, "frame", "x", "y")
    n = next_reading(t, keys, "frame", ["x", "y"]).where("next_frame is not null")
    theta = F.atan2(F.col("next_y") - F.col("y"), F.col("next_x") - F.col("x"))
    return n.select(*keys, F.col("next_frame").alias("frame"), _bin(theta, F.lit(-math.pi), F.lit(math.pi), bins).alias("bin"))


def theta_entropy(traj: DataFrame, bins: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shannon entropy (natural log) of each track's step directions, row to row; tracks without a step are absent."""
    c = _directions(traj, keys, bins).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*keys))
    return c.withColumn("p", p).groupBy(*keys).agg((F.lit(0.0) - F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def min_rolling_theta_entropy(traj: DataFrame, window: int = 24, bins: int = 24, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Least entropy of the directions of any ``window`` consecutive steps; NULL for tracks of fewer steps.

    Steps are numbered along their track and cut into blocks of ``block`` steps that carry the ``window`` - 1 steps
    before them, so a long track spreads over tasks.
    """
    keys, block = list(keys), max(block, window)
    d = numbered(_directions(traj, keys, bins), keys, ["frame"], "_k")
    own = F.floor(F.col("_k") / block).cast("bigint")
    at = F.array(own, F.when(F.col("_k") % block > block - window, own + 1))
    d = d.withColumn("_b", F.explode(F.filter(at, lambda b: b.isNotNull())))
    w = W.partitionBy(*keys, "_b").orderBy("_k").rowsBetween(-(window - 1), 0)
    d = d.withColumn("l", F.collect_list("bin").over(w))
    count = lambda b: F.size(F.filter("l", lambda v: v == b))
    part = F.transform(F.array_distinct("l"), lambda b: -(count(b) / F.lit(window)) * F.log(count(b) / F.lit(window)))
    ent = F.when(F.size("l") == window, F.aggregate(part, F.lit(0.0), lambda s, v: s + v))
    return d.groupBy(*keys).agg(F.min(ent).alias("entropy"))


def is_localized(*_args):
    """Not defined for tracks yet."""
    raise NotImplementedError


def is_diffusive(*_args):
    """Not defined for tracks yet."""
    raise NotImplementedError
