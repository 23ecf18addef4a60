"""The data behind the usual plots, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motespark.common import present
from motespark.operators.motion import relate_frames


def plot_traj(traj: DataFrame, groups: Sequence[str] = (), column: str = "x") -> DataFrame:
    """One column for each particle, a row for each frame; for a few thousand particles at most."""
    return traj.groupBy(*groups, "frame").pivot("particle").agg(F.first(column))


def plot_displacements(traj: DataFrame, frame1: int, frame2: int, keys: Sequence[str] = ("particle",)) -> DataFrame:
    """Arrows from frame1 to frame2 of the particles in both."""
    return relate_frames(traj, frame1, frame2, keys=keys).where("dr is not null")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(present(x, y)).select(x, y)


def mass_ecc(df: DataFrame) -> DataFrame:
    return scatter(df, "ecc", "mass")


def mass_size(df: DataFrame) -> DataFrame:
    return scatter(df, "size", "mass")


def subpx_bias(df: DataFrame, pos: Sequence[str] = ("x", "y"), bins: int = 10) -> DataFrame:
    """Histogram of the fractional part of each position column."""
    long = df.where(present(*pos)).select(F.inline(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in pos])))
    return long.groupBy("axis", F.floor((F.col("v") - F.floor("v")) * bins).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_profile(df: DataFrame, groups: Sequence[str], axis: str = "y", block: float = 32.0) -> DataFrame:
    """Features per strip of ``block`` along an axis and frame seen."""
    ok = df.where(present(axis))
    frames = ok.groupBy(*groups).agg(F.countDistinct("frame").alias("_f"))
    h = ok.groupBy(*groups, F.floor(F.col(axis) / F.lit(block)).cast("bigint").alias("strip")).agg(F.count(F.lit(1)).alias("n"))
    return h.join(frames, list(groups)).select(*groups, "strip", (F.col("n") / F.col("_f")).alias("density"))


def annotate(df: DataFrame, split_category: str | Column, thresholds: Sequence[float]) -> DataFrame:
    """``df`` with ``category``, the number of thresholds that a column reaches."""
    c = F.col(split_category) if isinstance(split_category, str) else split_category
    return df.withColumn("category", sum((F.when(c >= t, 1).otherwise(0) for t in thresholds), F.lit(0)))
