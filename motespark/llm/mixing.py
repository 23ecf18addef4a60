"""Mixing sources to target shares by apportioned blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.common import cut, need

MAX_SOURCES = 10_000


def apportion(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Sainte-Laguë: the ``seats`` highest quotients weight / (2 k + 1) win, ties to the earlier entry.

    No entry gets more than its cap; if the caps end before the seats, the rest stays free. Weights of 0 get nothing.
    """
    w = np.asarray(weights, dtype=float)
    cap = np.full(len(w), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, dtype=np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, float(cap.astype(float).sum())))
    if seats <= 0 or not len(w):
        return np.zeros(len(w), dtype=np.int64)
    # a divisor d gives floor(w / d + 1/2) seats each; bisect for the least d that gives no more than wanted
    given = lambda d: np.where(w > 0, np.minimum(np.floor(np.minimum(w / d, 4e18) + 0.5), cap), 0).astype(np.int64)
    low, high = 0.0, w.max() * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or mid < 1e-300:
            break
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    out = given(high)
    while out.sum() < seats:  # ties at the divisor, in order
        quotient = np.where(out < cap, w / (2 * out + 1), -1.0)
        best = np.flatnonzero(quotient >= quotient.max() * (1 - 1e-12))[: seats - out.sum()]
        out[best] += 1
    return out


def mix_plan(sizes: DataFrame, targets: DataFrame, source: str, tokens: str, blocks: int, total: int | None) -> pd.DataFrame:
    """Per target source: tokens there are, block size, seats. At most ``MAX_SOURCES`` target rows reach the driver."""
    have = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("available"), F.count(F.lit(1)).alias("records"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = t.join(have, "source", "left").limit(MAX_SOURCES + 1).toPandas().sort_values("source", ignore_index=True)
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    share = got.target_share.astype(float).fillna(0).clip(lower=0)
    got["weight"] = share / share.sum() if share.sum() > 0 else 0.0
    got["available"] = got.available.fillna(0).astype("int64")
    got["records"] = got.records.fillna(0).astype("int64")
    got["repeats"] = got.max_repeats.fillna(1).clip(lower=0).astype("int64")
    most = got.available * got.repeats
    usable = (got.weight > 0) & (most > 0)
    reachable = (most / got.weight)[usable].min() if usable.any() else 0.0
    size = float(total if total is not None else reachable)
    got["binds"] = usable & (most / got.weight.where(usable, 1.0) <= reachable) if total is None else False
    block = max(size / blocks, 1.0)
    got["block"] = block
    m = np.where(got.available > 0, np.maximum(np.round(got.available / block), 1), 0)
    got["seats"] = apportion(np.where(usable, got.weight, 0.0), int(round(size / block * got.weight[usable].sum())) if usable.any() else 0, (m * got.repeats).astype("int64"))
    return got


def mix(
    df: DataFrame, ident: str, source: str, tokens: str, targets: DataFrame, *, total: int | None = None, blocks: int = 20_000, shard_tokens: int = 64_000_000, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(chosen records, report) that bring each source to its target share of all tokens.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``. ``total`` is the size wanted in tokens; by default
    the largest at which every source that has tokens can reach its share. The total is cut into ``blocks`` equal
    blocks, given to the sources by Sainte-Laguë's highest quotients, no source beyond its tokens times its repeats.
    A source is hashed into shards of about ``shard_tokens``; its blocks are apportioned to them by size in the same
    way. In a shard, records in seeded order form equal-token blocks, whole records each; a seeded run of consecutive
    blocks is used once more than the rest.

    Records: ``ident``, source, tokens, ``repeats`` (at least 1, at most ``max_repeats``). Report, one row per target
    source: available and selected tokens, ``share`` reached, ``reached`` (within two blocks or longest records), and
    ``binds``: by default, is this the source whose tokens and repeats limit the total?
    Sources without a target, or NULL, are left out; a target source without records has share 0. NULL token counts
    count as 0, rows with a NULL ident are dropped and repeated rows count once. Target shares are scaled to sum 1.
    """
    need(df, ident, source, tokens)
    need(targets, "source", "target_share", "max_repeats")
    kind = df.schema[ident].dataType.simpleString()
    rows = cut(df.where(F.col(ident).isNotNull() & F.col(source).isNotNull()).select(F.col(ident).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n")).distinct())
    spark = df.sparkSession
    plan = mix_plan(rows, targets, "source", "n", blocks, total)
    fields = "source string, repeats bigint, block double, seats bigint, shards bigint"
    shards = np.maximum(np.ceil(plan.available / shard_tokens), 1).astype("int64")
    plan["shards"] = shards
    small = F.broadcast(spark.createDataFrame([(r.source, int(r.repeats), float(r.block), int(r.seats), int(r.shards)) for r in plan.itertuples()], fields))
    order = F.xxhash64(F.lit(seed), "id", "source")
    put = rows.join(small, "source").where("seats > 0").withColumn("h", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("shards")))
    per = put.groupBy("source", "shard").agg(F.sum("n").alias("t"), F.first("seats").alias("seats"), F.first("block").alias("block"), F.first("repeats").alias("repeats"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        m = np.where(pdf.t > 0, np.maximum(np.round(pdf.t / pdf.block), 1), 0).astype("int64")
        q = apportion(pdf.t.to_numpy(dtype=float), int(pdf.seats.iloc[0]), m * pdf.repeats.to_numpy())
        return pd.DataFrame({"source": pdf.source, "shard": pdf.shard, "t": pdf.t, "m": m, "q": q})

    quota = per.groupBy("source").applyInPandas(quotas, "source string, shard bigint, t bigint, m bigint, q bigint")
    d = put.select("source", "shard", "id", "n", "h").join(quota, ["source", "shard"]).where("m > 0")
    w = W.partitionBy("source", "shard").orderBy("h", "id", "n").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("n").over(w)
    block = F.least(F.floor((upto - F.col("n") / 2) / F.col("t") * F.col("m")).cast("bigint"), F.col("m") - 1)
    turn = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("m"))
    d = d.withColumn("block", block).withColumn("repeats", F.floor(F.col("q") / F.col("m")).cast("bigint") + F.when(F.pmod(F.col("block") - turn, F.col("m")) < F.pmod("q", "m"), 1).otherwise(0))
    chosen = d.where("repeats > 0").select(F.col("id").alias(ident), F.col("source"), F.col("n").alias("n_tokens"), "repeats")
    facts = spark.createDataFrame(
        [(r.source, float(r.target_share) if r.target_share == r.target_share else None, int(r.repeats), int(r.records), int(r.available), float(r.block), bool(r.binds)) for r in plan.itertuples()],
        "source string, target_share double, max_repeats bigint, records bigint, available_tokens bigint, block double, binds boolean",
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("selected_tokens"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("selected_records"), F.max(F.col("n_tokens") * F.col("repeats")).alias("longest"))
    rep = facts.join(F.broadcast(used), "source", "left")
    every = W.partitionBy(F.lit(0))  # one row per target source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = F.sum(zero("selected_tokens")).over(every)
    rep = rep.withColumn("all", all_).withColumn("share", F.when(F.col("all") > 0, zero("selected_tokens") / F.col("all")).otherwise(F.lit(0.0)))
    slack = (F.greatest(zero("longest"), F.col("block")) * 2) / F.greatest(F.col("all"), F.lit(1))
    report = rep.select(
        "source", "target_share", "max_repeats", "records", "available_tokens", zero("selected_records").alias("selected_records"), zero("selected_tokens").alias("selected_tokens"),
        zero("most_repeats").alias("most_repeats"), F.round("share", 6).alias("share"), (F.col("share") >= F.coalesce(F.col("target_share"), F.lit(0.0)) - slack).alias("reached"), "binds",
    )
    return chosen, report
