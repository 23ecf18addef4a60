"""Order statistics and running numbers without a task that holds a whole group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.common import cut, free_name, present

#: as many values may be ranked by one task
FEW = 1_000_000
ACCURACY = 10_000


def _ranged(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column]) -> tuple[DataFrame, str, str]:
    """``df`` sorted by (groups, order) over ranges, with each row's range and its place: written once, as ranges are sampled."""
    part, place = free_name(df, "_part"), free_name(df, "_place")
    by = [*(F.col(g).asc_nulls_first() for g in groups), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(rows.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place))), part, place


def _joined(rows: DataFrame, offsets: DataFrame, groups: Sequence[str], part: str) -> DataFrame:
    """``offsets`` (groups, range) beside the rows; NULL groups match too."""
    keys = [*groups, part]
    other = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], *[c for c in offsets.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return rows.join(other, on).drop(*[f"_o{i}" for i in range(len(keys))])


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within the groups along ``order``, which must leave no ties for a stable result.

    One range-partitioned sort; a group may fill any number of ranges, whose counts are summed ahead of each. NULL is a
    group of its own.
    """
    rows, part, place = _ranged(df, groups, order)
    count = rows.groupBy(*groups, part).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_k"))
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offset = count.select(*groups, part, "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_ahead"))
    return _joined(rows, offset, groups, part).select(*df.columns, (F.col(place) - F.col("_first") + F.col("_ahead")).cast("bigint").alias(name))


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the group up to this one along ``order``; NULL counts as 0.

    Totals run within ranges of one sort; the sums of the ranges ahead are added to each.
    """
    rows, part, place = _ranged(df, groups, order)
    v = F.coalesce(F.col(value), F.lit(0))
    local = rows.withColumn("_run", F.sum(v).over(W.partitionBy(*groups, part).orderBy(place).rowsBetween(W.unboundedPreceding, 0)))
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offset = rows.groupBy(*groups, part).agg(F.sum(v).alias("_t")).select(*groups, part, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_ahead"))
    return _joined(local, offset, groups, part).select(*df.columns, (F.col("_run") + F.col("_ahead")).alias(name))


def quantile(df: DataFrame, value: str | Column, q: float) -> float | None:
    """The exact quantile of all values, interpolated linearly; None if there are none. NULL and NaN don't count.

    Approximate percentiles, which merge, narrow the values down to those around the wanted rank until at most a
    million are left; only these are ranked by one task.
    """
    v = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where(present("v"))
    n = v.count()
    if not n:
        return None
    rank, low, high, below, inside = q * (n - 1), -math.inf, math.inf, 0, n
    part = v
    while inside > FEW:
        first, slack = (rank - below) / inside, 3 / ACCURACY
        a, b = part.agg(F.percentile_approx("v", [max(first - slack, 0.0), min(first + slack + 1 / inside, 1.0)], ACCURACY)).first()[0]
        if a == b:  # so many equal values: count them
            less, same = part.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v") == a, 1))).first()
            if below + less <= math.floor(rank) and math.ceil(rank) < below + less + same:
                return float(a)
            break
        less, among = part.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v").between(a, b), 1))).first()
        if not (below + less <= math.floor(rank) and math.ceil(rank) < below + less + among) or among == inside:
            break
        low, high, below, inside = a, b, below + less, among
        part = v.where(F.col("v").between(low, high))
    # the two values around the rank, by distinct values with counts
    counts = part.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    at = running_total(counts, [], ["v"], "k", "upto")
    lo, hi = at.agg(
        F.min(F.when(F.col("upto") > math.floor(rank) - below, F.col("v"))), F.min(F.when(F.col("upto") > math.ceil(rank) - below, F.col("v")))
    ).first()
    return float(lo + (hi - lo) * (rank - math.floor(rank)))
