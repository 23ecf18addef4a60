"""Percentiles per group by radix selection over mergeable histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.common import cut, need, present

#: bits of one digit: a group's histogram of one digit has at most 2**16 rows
DIGIT = 16


def ordered_key(value: Column) -> Column:
    """A 64-bit integer that sorts as the double does; -0.0 counts as 0.0. NULL and NaN must be gone."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def _as_double(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(key)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def digest(df: DataFrame, groups: Sequence[str], values: Sequence[str], bits: int = 64) -> DataFrame:
    """A mergeable histogram: groups, ``metric`` (the value column's name), ``bucket``, ``n``.

    ``bucket`` is the order-preserving integer of the value cut to its first ``bits`` bits. A bucket's values differ by
    less than 2**(12 - bits) of the smaller one's magnitude (for normal numbers), which bounds the error of every
    percentile; 64 bits are exact. Digests of separate partitions or days are combined by ``merge``. NULL and NaN
    values don't count; groups may be NULL; an empty input gives an empty digest.
    """
    groups, values = list(groups), list(values)
    need(df, *groups, *values)
    if not 13 <= bits <= 64:
        raise ValueError("bits must be in 13..64")
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    long = df.select(*groups, F.inline(pairs)).where(present("value"))
    bucket = F.shiftright(ordered_key(F.col("value")), 64 - bits) if bits < 64 else ordered_key(F.col("value"))
    return long.groupBy(*groups, "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(groups: Sequence[str], *digests: DataFrame) -> DataFrame:
    """One digest of all; ``groups`` may leave out columns (as the day) of the digests."""
    every = digests[0].select(*groups, "metric", "bucket", "n")
    for d in digests[1:]:
        every = every.unionByName(d.select(*groups, "metric", "bucket", "n"))
    return every.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def _followed(rows: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys some target follows; adaptive execution splits the rows of a hot key over several tasks."""
    want = active.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(want, on, "left_semi")


def percentiles(dig: DataFrame, groups: Sequence[str], qs: Sequence[float], bits: int = 64) -> DataFrame:
    """The ``qs``-quantiles of every (groups, metric) of a digest, as ``q`` and ``value``, with the count ``n_values``.

    The quantile is the value of rank ceil(q * n), at least 1: always one of the group's own values, or the lower end
    of its bucket for a digest of fewer than 64 bits (for negative numbers too, the end nearer to minus infinity).

    Radix selection: the buckets' digits of 16 bits are taken from the top. Each round counts the current digit's
    histogram among the buckets that begin with a followed prefix, finds the digit that holds each target rank by a
    running total over at most 2**16 digits, subtracts what lies below and follows that digit alone. Rounds: bits / 16,
    rounded up. Groups of any size work: no task holds more of a group than one histogram.
    """
    groups = list(groups)
    keys = [*groups, "metric"]
    if not qs or min(qs) < 0 or max(qs) > 1:
        raise ValueError("qs must be in 0..1")
    rounds = -(-bits // DIGIT)
    # the prefix after a round is the bucket shifted right; the sign stays in the top digit
    shift = [max(bits - DIGIT * (r + 1), 0) for r in range(rounds)]
    top = dig.groupBy(*keys, F.shiftright("bucket", shift[0]).alias("prefix")).agg(F.sum("n").alias("n"))
    run = W.partitionBy(*keys).orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    hist = top.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(W.partitionBy(*keys))})
    targets = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.ceil(F.lit(float(q)) * F.col("all")), F.lit(1)).cast("bigint").alias("rank")) for q in qs])
    here = F.filter(targets, lambda t: (t["rank"] <= F.col("upto")) & (t["rank"] > F.col("upto") - F.col("n")))  # most digits hold no target
    active = hist.withColumn("t", F.explode(here)).select(
        *keys, "t.q", F.col("all").alias("n_values"), "prefix", (F.col("t.rank") - (F.col("upto") - F.col("n"))).alias("rank")
    )
    rows = dig
    for r in range(1, rounds):
        if rounds > 2:
            active = cut(active)  # a few rows a group, used twice in every round
        rows = _followed(rows.withColumn("prefix", F.shiftright("bucket", shift[r - 1])), active, [*keys, "prefix"])
        h = rows.groupBy(*keys, "prefix", F.shiftright("bucket", shift[r]).alias("next")).agg(F.sum("n").alias("n"))
        run = W.partitionBy(*keys, "prefix").orderBy("next").rowsBetween(W.unboundedPreceding, 0)
        h = h.withColumn("upto", F.sum("n").over(run)).select(*[F.col(k).alias(f"h_{k}") for k in [*keys, "prefix"]], "next", "n", "upto")
        on = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
        for k in [*keys, "prefix"]:
            on = on & F.col(k).eqNullSafe(F.col(f"h_{k}"))
        active = active.join(h, on).select(*keys, "q", "n_values", F.col("next").alias("prefix"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
        rows = rows.drop("prefix")
    key = F.shiftleft("prefix", 64 - bits) if bits < 64 else F.col("prefix")
    return active.select(*keys, "q", _as_double(key).alias("value"), "n_values")
