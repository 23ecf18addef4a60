"""Filters on tracks and features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.common import need, present
from motespark.operators.ordering import quantile as exact_quantile


def filter_stubs(tracks: DataFrame, threshold: int = 100, keys: Sequence[str] = ("particle",)) -> DataFrame:
    """Tracks of at least ``threshold`` rows with a frame; rows with a NULL key vanish."""
    need(tracks, "frame", *keys)
    t = tracks.dropna(subset=list(keys))
    long = t.groupBy(*keys).agg(F.count("frame").alias("_n")).where(F.col("_n") >= threshold).select(*keys)
    return t.join(long, list(keys), "left_semi")


def filter_clusters(tracks: DataFrame, quantile: float = 0.8, threshold: float | None = None, keys: Sequence[str] = ("particle",)) -> DataFrame:
    """Tracks whose mean ``size`` is below ``threshold``, by default the linear ``quantile`` of all sizes, found first."""
    need(tracks, "size", *keys)
    t = tracks.dropna(subset=list(keys))
    size = F.when(present("size"), F.col("size"))
    mean = t.groupBy(*keys).agg(F.avg(size).alias("_m"))
    if threshold is None:
        threshold = exact_quantile(tracks, size, quantile)
    small = mean.where(F.col("_m") < threshold) if threshold is not None else mean.limit(0)
    return t.join(small.select(*keys), list(keys), "left_semi")


def filter_tracks(tracks: DataFrame, condition: Column | Callable, keys: Sequence[str] = ("particle",)) -> DataFrame:
    """Tracks for which an aggregate condition holds (a Column), or a Python predicate on the track's pandas rows."""
    if isinstance(condition, Column):
        keep = tracks.groupBy(*keys).agg(condition.alias("_ok")).where("_ok").select(*keys)
        return tracks.join(keep, list(keys), "left_semi")
    return tracks.groupBy(*keys).applyInPandas(lambda pdf: pdf if condition(pdf) else pdf.iloc[:0], tracks.schema)


def mass_size_filter(features: DataFrame, minmass: float | None = None, maxsize: float | None = None, inclusive: bool = False) -> DataFrame:
    """mass > minmass (>= with ``inclusive``) and size < maxsize."""
    out = features
    if minmass is not None:
        out = out.where(present("mass") & ((F.col("mass") >= minmass) if inclusive else (F.col("mass") > minmass)))
    return out.where(present("size") & (F.col("size") < maxsize)) if maxsize is not None else out


def topn(features: DataFrame, n: int, groups: Sequence[str] = ("frame",), tie: str | None = None) -> DataFrame:
    """The ``n`` features of largest mass of every frame; Spark limits each group before the shuffle."""
    order = [F.col("mass").desc(), *([F.col(tie)] if tie else [])]
    w = W.partitionBy(*groups).orderBy(*order)
    return features.where(present("mass")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def verify_integrity(tracks: DataFrame, keys: Sequence[str] = ("particle",), groups: Sequence[str] = ()) -> None:
    """Raise ValueError if a particle number is negative or one occurs twice in a frame."""
    if tracks.where(F.col(keys[-1]) < 0).limit(1).count():
        raise ValueError("negative particle number")
    if integrity_report(tracks, keys, groups).limit(1).count():
        raise ValueError("a particle occurs more than once in a frame")


def integrity_report(tracks: DataFrame, keys: Sequence[str] = ("particle",), groups: Sequence[str] = ()) -> DataFrame:
    """Frames and tracks with more than one row."""
    ks = [*groups, "frame", *keys]
    return tracks.dropna(subset=list(keys)).groupBy(*ks).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def strip_diagnostics(tracks: DataFrame) -> DataFrame:
    """Without the ``diag_`` columns."""
    return tracks.drop(*[c for c in tracks.columns if c.startswith("diag_")])


def guess_pos_columns(df: DataFrame) -> list[str]:
    """['y', 'x'], with 'z' first if there is one."""
    return ["z", "y", "x"] if "z" in df.columns else ["y", "x"]


bust_ghosts, bust_clusters = filter_stubs, filter_clusters
