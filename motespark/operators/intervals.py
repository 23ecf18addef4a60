"""Readings as step functions: each one holds from its own time to the next reading of its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def next_reading(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], prefix: str = "next_", block: int = BLOCK) -> DataFrame:
    """Add the following row's ``order`` and ``values`` within each key, NULL in the last row.

    A source's rows are cut into blocks of ``block`` time steps, so no task holds a whole long source; the first row
    of each block, one row in up to ``block``, is passed to the block before. (keys, order) must be unique.
    """
    keys = list(keys)
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    cols = [order, *values]
    heads = (
        d.groupBy(*keys, "_blk")
        .agg(F.min(F.struct(*cols)).alias("_h"))
        .withColumn("_nh", F.lead("_h").over(W.partitionBy(*keys).orderBy("_blk")))
        .where(F.col("_nh").isNotNull())
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_b"), "_nh")
    )
    inside = W.partitionBy(*keys, "_blk").orderBy(order)
    d = d.withColumn("_lead", F.lead(F.struct(*cols)).over(inside))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_blk") == F.col("_b")]
    joined = d.join(heads, on, "left").withColumn("_lead", F.coalesce("_lead", "_nh"))
    return joined.select(*df.columns, *[F.col("_lead")[c].alias(prefix + c) for c in cols])
