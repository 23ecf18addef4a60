"""Irregular readings onto a regular grid through validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motespark.common import need, present
from motespark.operators.intervals import BLOCK, next_reading


def to_regular_grid(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], step: str, fill: str = "hold", block: int = BLOCK
) -> DataFrame:
    """One row per source and grid cell (``slot`` = time / step rounded down), first to last usable reading.

    Every usable reading (no value NULL or NaN, no key or time NULL) is a step that holds from its own time to the
    next reading of the source, the last one for one time unit. The steps are intersected with the cells. A cell gets

    - ``n_readings``: usable readings in the cell; 0 marks an empty, filled cell (``filled`` is then true),
    - each value's time-weighted mean over the cell's covered part. ``fill="hold"`` carries the last reading
      forward, ``"linear"`` weights the straight line between readings, ``"none"`` leaves empty cells NULL,
    - ``coverage``: part of the cell's time that lies within one ``step`` after a reading (1.0 is a cell fully
      covered by fresh readings).

    ``step`` is a column, constant per source; NULL or below 1 counts as 1. Several readings at one time: repeats are
    one, of different ones the smallest (values compared in order) counts. Empty input gives no rows. Other columns
    are ignored.
    """
    if fill not in ("hold", "linear", "none"):
        raise ValueError("fill must be hold, linear or none")
    keys, values = list(keys), list(values)
    need(df, *keys, time, *values, step)
    usable = present(*values) & F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    src = df.where(usable).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(time).cast("bigint").alias("t"),
        *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)],
        F.greatest(F.coalesce(F.col(step).cast("bigint"), F.lit(1)), F.lit(1)).alias("step"),
    )
    ks, vs = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    one = src.groupBy(*ks, "t").agg(F.min("step").alias("step"), F.min(F.struct(*vs)).alias("v")).select(*ks, "t", "step", *[F.col("v")[v].alias(v) for v in vs])
    steps = next_reading(one, ks, "t", vs, "n_", block)
    end = F.coalesce("n_t", F.col("t") + 1)
    cell = lambda c: F.floor(c / F.col("step")).cast("bigint")
    pieces = steps.withColumn("end", end).withColumn("slot", F.explode(F.sequence(cell(F.col("t")), cell(F.col("end") - 1))))
    lo, hi = F.greatest("t", F.col("slot") * F.col("step")), F.least("end", (F.col("slot") + 1) * F.col("step"))
    pieces = pieces.withColumn("lo", lo).withColumn("hi", hi).withColumn("w", (F.col("hi") - F.col("lo")).cast("double"))
    fresh = F.greatest(F.least("hi", F.col("t") + F.col("step")) - F.col("lo"), F.lit(0))
    mid = ((F.col("lo") + F.col("hi")) / 2 - F.col("t")) / (F.col("end") - F.col("t"))
    at = {v: F.col(v) + (F.coalesce(F.col(f"n_{v}"), F.col(v)) - F.col(v)) * mid if fill == "linear" else F.col(v) for v in vs}
    cells = pieces.groupBy(*ks, "slot").agg(
        F.sum(F.when(F.col("lo") == F.col("t"), 1).otherwise(0)).cast("bigint").alias("n_readings"),
        *[(F.sum(at[v] * F.col("w")) / F.sum("w")).alias(v) for v in vs],
        (F.sum(fresh) / F.first("step")).alias("coverage"),
    )
    empty = F.col("n_readings") == 0
    out = {v: F.when(~empty, F.col(v)) if fill == "none" else F.col(v) for v in vs}
    return cells.select(
        *[F.col(k).alias(n) for k, n in zip(ks, keys)], "slot", *[out[v].alias(n) for v, n in zip(vs, values)],
        "n_readings", empty.alias("filled"), "coverage",
    )
