"""Filling fixed-capacity containers: a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.common import cut, need, release

#: items of one island
SHARD_ITEMS = 16_384
#: shards whose worst containers are packed again together
REPAIR = 16
MAX_LIMITS = 1000
MAX_PARTITIONS = 10_000
#: displaced items of which pairs are tried in an exchange
PAIRS = 256


class BestFit:
    """Open bins by free space: an item goes to the bin that it fills best."""

    def __init__(self, capacity: int, free: np.ndarray):
        self.capacity, self.next = capacity, len(free)
        self.free = sorted((int(f), i) for i, f in enumerate(free) if f > 0)

    def put(self, size: int) -> int:
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            b, left = self.next, self.capacity - size
            self.next += 1
        else:
            f, b = self.free.pop(at)
            left = f - size
        if left > 0:
            insort(self.free, (left, b))
        return b


def best_fit(sizes: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    """The bin of each item, items put in ``order``."""
    fit = BestFit(capacity, np.zeros(0))
    out = np.empty(len(sizes), dtype=np.int32)
    for i in order.tolist():
        out[i] = fit.put(int(sizes[i]))
    return out


def _renumber(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(minus the number of bins, mean square filling): fewer bins first, then filling left uneven for later gain."""
    fill = np.bincount(bins, weights=sizes)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def refill(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit the ``loose`` items, largest first, into the bins of the others and new ones."""
    out = bins.copy()
    kept = ~loose
    if kept.any():
        out[kept] = _renumber(bins[kept])
        free = capacity - np.bincount(out[kept], weights=sizes[kept])
    else:
        free = np.zeros(0)
    fit = BestFit(capacity, free)
    which = np.flatnonzero(loose)
    for i in which[np.argsort(-sizes[which], kind="stable")].tolist():
        out[i] = fit.put(int(sizes[i]))
    return _renumber(out)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can undercut: by total size, and by what items larger than half a bin leave over.

    For a threshold a up to half a bin, items above capacity - a fill bins alone, and the items between a and half a
    bin that don't fit beside the larger ones need bins of their own.
    """
    s = np.sort(sizes[sizes > 0].astype(np.int64))
    best = -(-int(s.sum()) // capacity)
    upto = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, capacity // 2, "right")
    for_a = np.unique(s[:half])
    if len(for_a):
        low, high = np.searchsorted(s, for_a, "left"), np.searchsorted(s, capacity - for_a, "right")
        room = (high - half) * capacity - (upto[high] - upto[half])
        more = -(-np.maximum(upto[half] - upto[low] - room, 0) // capacity)
        best = max(best, int((len(s) - half + more).max()))
    return max(best, len(s) - half)


def exchange(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int, passes: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(bins, loose) after swaps of an item for one or two ``loose`` ones that fill its bin better.

    A bin gets the swap of greatest gain, each loose item is used once a pass; the items that come out are loose in the
    next pass. Every swap fills a bin further, so the loose rest becomes smaller and easier to place.
    """
    out, loose = bins.copy(), loose.copy()
    for _ in range(passes):
        free_items = np.flatnonzero(loose)
        held = np.flatnonzero(~loose)
        if not len(free_items) or not len(held):
            break
        free = capacity - np.bincount(out[held], weights=sizes[held], minlength=int(out.max()) + 1).astype(np.int64)
        at = held[free[out[held]] > 0]
        if not len(at):
            break
        most = sizes[at] + free[out[at]]
        free_items = free_items[np.argsort(sizes[free_items], kind="stable")]
        one = sizes[free_items]
        k = np.searchsorted(one, most, "right") - 1
        gain = np.where(k >= 0, one[np.maximum(k, 0)] - sizes[at], 0)
        pair = np.zeros(len(at), dtype=bool)
        if len(one) > 1:
            some = np.unique(np.linspace(0, len(one) - 1, min(len(one), PAIRS)).astype(np.int64))
            i, j = np.triu_indices(len(some), 1)
            both = one[some[i]] + one[some[j]]
            by = np.argsort(both, kind="stable")
            q = np.searchsorted(both[by], most, "right") - 1
            gain2 = np.where(q >= 0, both[by][np.maximum(q, 0)] - sizes[at], 0)
            pair = gain2 > gain
            gain = np.maximum(gain, gain2)
            first, second = some[i[by]], some[j[by]]
        better = np.flatnonzero(gain > 0)
        used, touched, swapped = np.zeros(len(one), dtype=bool), set(), False
        for c in better[np.argsort(-gain[better], kind="stable")].tolist():
            b = int(out[at[c]])
            come = [first[q[c]], second[q[c]]] if pair[c] else [k[c]]
            if b in touched or used[come].any():
                continue
            used[come] = True
            touched.add(b)
            out[free_items[come]], loose[free_items[come]], loose[at[c]], swapped = b, False, True, True
        if not swapped:
            break
    return out, loose


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator, swap: bool) -> np.ndarray:
    """Inject well-filled bins of ``a`` whole into ``b``; b's bins that share an item with them are emptied and refilled.

    With ``swap`` the displaced items are exchanged for those that they fill bins better than, before the rest is best-fitted.
    """
    fill = np.bincount(a, weights=sizes)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    take = np.zeros(len(fill), dtype=bool)
    take[rng.choice(well, size=max(1, int(len(well) * rng.uniform(0.05, 0.4))), replace=False)] = True
    injected = take[a]
    hit = np.zeros(int(b.max()) + 1, dtype=bool)
    hit[b[injected]] = True
    child = b.copy()
    child[injected] = a[injected] + len(hit)
    loose = hit[b] & ~injected
    if swap:
        child, loose = exchange(sizes, child, loose, capacity)
    return refill(sizes, child, loose, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator, swap: bool) -> np.ndarray:
    """Empty the worst-filled bin and some others, and refill."""
    fill = np.bincount(bins, weights=sizes)
    drop = rng.random(len(fill)) < min(0.05, 40 / len(fill))
    drop[fill.argmin()] = True
    loose = drop[bins]
    if swap:
        bins, loose = exchange(sizes, bins, loose, capacity)
    return refill(sizes, bins, loose, capacity)


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], size: int, generations: int, rng: np.random.Generator, patience: int = 12) -> list[np.ndarray]:
    """Steady-state evolution; the population comes back best first.

    Ends early where the number of bins is the least possible, or after ``patience`` generations without a child
    better than the best.
    """
    if not len(sizes):
        return [np.zeros(0, dtype=np.int32)]
    least = least_bins(sizes, capacity)
    pop = [(fitness(sizes, p, capacity), p) for p in population]
    start = best_fit(sizes, capacity, np.argsort(-sizes, kind="stable"))
    pop.append((fitness(sizes, start, capacity), start))
    pop.sort(key=lambda p: p[0], reverse=True)
    while len(pop) < size and -pop[0][0][0] > least:
        noisy = best_fit(sizes, capacity, np.argsort(-sizes * rng.uniform(0.8, 1.25, len(sizes)), kind="stable"))
        pop.append((fitness(sizes, noisy, capacity), noisy))
    pop.sort(key=lambda p: p[0], reverse=True)
    stale = 0
    for _ in range(generations):
        if -pop[0][0][0] <= least or len(pop) < 2 or stale >= patience:
            break
        i, j = rng.choice(len(pop), size=2, replace=False)
        swap = rng.random() < 0.5
        child = crossover(sizes, pop[i][1], pop[j][1], capacity, rng, swap)
        if rng.random() < 0.5:
            child = mutate(sizes, child, capacity, rng, swap)
        f = fitness(sizes, child, capacity)
        stale = 0 if f > pop[0][0] else stale + 1
        if f > pop[-1][0] and all(f != g for g, _ in pop):
            pop[-1] = (f, child)
            pop.sort(key=lambda p: p[0], reverse=True)
    return [p for _, p in pop[:size]]


def _epoch(seed: int, size: int, generations: int):
    """One island a row: evolve its population, the elite that came by migration included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                limit, capacity, shard, island = (b.column(k)[r].as_py() for k in range(4))
                sizes = b.column(4)[r].values.to_numpy()
                pop = [np.asarray(x.values.to_numpy()) for x in b.column(5)[r] if x.is_valid] if b.column(5)[r].is_valid else []
                rng = np.random.default_rng([seed, limit & 0xFFFFFFFF, shard & 0xFFFFFFFF, island])
                pop = evolve(sizes, capacity, pop, size, generations, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([limit]), pa.array([capacity]), pa.array([shard]), pa.array([island], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), pa.array([pop], pa.list_(pa.list_(pa.int32())))],
                    names=STATE,
                )

    return run


STATE = ["limit_id", "capacity", "shard", "island", "sizes", "pop"]
_STATE = "limit_id bigint, capacity bigint, shard bigint, island int, sizes array<bigint>, pop array<array<int>>"


def pack(
    df: DataFrame, ident: str, tokens: str, limits: DataFrame, *, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 60, shard_items: int = SHARD_ITEMS, seed: int = 0
) -> DataFrame:
    """Assign every item to a container: ``limit_id``, ident, ``part``, ``n_tokens``, ``container``, ``capacity``.

    ``limits`` has ``limit_id`` and ``capacity_tokens`` and is packed for each of its rows on its own. An item larger
    than the capacity fills containers of its own (parts 0, 1, ...) and its rest, the last part, is packed as an item;
    no other item is split.

    Grouping genetic algorithm: items are hashed into shards of about ``shard_items``. A shard's islands each evolve
    partitions of its items; crossover injects whole well-filled bins of one parent into another, removes the bins that
    held their items and best-fits the displaced ones, half of the time after swaps that fill bins better. After each
    epoch the best of every island moves on to the next island of the ring; at last the shard's best partition counts.
    The worst-filled containers of 16 shards at a time, about one shard of items, then evolve together, so
    that the shards' rests don't each leave space over. Every row of the state is one island of bounded size, so
    islands and shards evolve in parallel on all executors.

    Items of size 0 are assigned too. Rows with a NULL ident are dropped, NULL sizes count as 0, rows equal in ident and
    size are one. Limits that are NULL or below 1 give no rows; so does an empty input. One seed, one result.
    """
    need(df, ident, tokens)
    need(limits, "limit_id", "capacity_tokens")
    items = cut(df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n")).distinct())
    caps = limits.where("capacity_tokens >= 1 and limit_id is not null").select(F.col("limit_id").cast("bigint").alias("limit_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    shards = max(1, -(-items.count() // shard_items))
    rows = caps.limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    # every item is packed once for each limit: the result has that many rows
    choice = F.array(*[F.struct(F.lit(r[0]).cast("bigint").alias("limit_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in sorted(rows)])
    each = items.select("id", "n", F.inline(choice if rows else F.lit(None).cast("array<struct<limit_id:bigint,capacity:bigint>>")))
    full = F.when(F.col("n") > F.col("capacity"), F.floor((F.col("n") - 1) / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    each = each.withColumn("full", full)
    whole = each.where("full > 0").select("limit_id", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part"), F.col("capacity").alias("n"), "capacity", F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("-")).alias("c"))
    whole = whole.withColumn("container", F.concat("c", F.col("part").cast("string"))).drop("c")
    rest = each.select("limit_id", "capacity", "id", F.col("full").alias("part"), (F.col("n") - F.col("full") * F.col("capacity")).alias("n"), F.pmod(F.xxhash64(F.lit(seed), "id", "n"), F.lit(shards)).cast("bigint").alias("shard"))
    base = cut(rest.groupBy("limit_id", "capacity", "shard").agg(F.array_sort(F.collect_list(F.struct("id", "part", "n"))).alias("items")))
    start = base.select("limit_id", "capacity", "shard", F.transform("items", lambda x: x["n"]).alias("sizes"), F.lit(None).cast("array<array<int>>").alias("pop"))
    rows_of_state = shards * max(len(rows), 1) * islands

    def solved(start: DataFrame, seed: int, partitions: int) -> DataFrame:
        """limit_id, shard and the best partition after all epochs."""
        state = start.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).select(*STATE)
        for e in range(epochs):
            before = state
            if e:
                elite = state.select("limit_id", "shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("pop")[0].alias("elite"))
                state = state.join(elite, ["limit_id", "shard", "island"]).select("limit_id", "capacity", "shard", "island", "sizes", F.concat(F.array("elite"), "pop").alias("pop"))
            # a number of its own, as adaptive execution would put the few, small rows into one task
            spread = state.repartition(partitions, "limit_id", "shard", "island")
            state = cut(spread.mapInArrow(_epoch(seed + e, population, generations), _STATE))
            if e:
                release(before)
        used = F.size(F.array_distinct(F.col("pop")[0]))
        return state.groupBy("limit_id", "shard").agg(F.min_by(F.col("pop")[0], F.struct(used, "island")).alias("bins"))

    best = solved(start, seed, min(rows_of_state, MAX_PARTITIONS))
    each = base.join(best, ["limit_id", "shard"]).select("limit_id", "capacity", "shard", F.explode(F.arrays_zip("items", "bins")).alias("z")).select(
        "limit_id", "capacity", "shard", F.col("z.items.id").alias("id"), F.col("z.items.part").alias("part"), F.col("z.items.n").alias("n"), F.col("z.bins").alias("bin")
    )
    if shards > 1:
        each = _repaired(cut(each), max(1, shard_items // REPAIR), lambda start: solved(start, seed + epochs, min(-(-rows_of_state // REPAIR), MAX_PARTITIONS)))
    packed = each.select("limit_id", "id", "part", "n", "capacity", F.concat(F.lit("p"), F.col("shard").cast("string"), F.lit("-"), F.col("bin").cast("string")).alias("container"))
    return packed.unionByName(whole).select("limit_id", F.col("id").alias(ident), "part", F.col("n").alias("n_tokens"), "container", "capacity")


def _repaired(each: DataFrame, share: int, solved) -> DataFrame:
    """``each`` item's shard and bin after the worst-filled bins of every REPAIR shards were packed again together.

    Of each shard the worst bins come, until they hold ``share`` items. The bins that they have now are
    one of the partitions that evolution starts from, so there are never more afterwards.
    """
    shard = ["limit_id", "capacity", "shard"]
    bins = each.groupBy(*shard, "bin").agg(F.sum("n").alias("fill"), F.count(F.lit(1)).alias("k"))
    bins = bins.withColumn("upto", F.sum("k").over(W.partitionBy(*shard).orderBy("fill", "bin")))
    loose = bins.where((F.col("upto") <= share) & (F.col("fill") < F.col("capacity"))).select("limit_id", "shard", "bin")
    taken = each.join(loose, ["limit_id", "shard", "bin"])
    old = F.dense_rank().over(W.partitionBy("limit_id", "group").orderBy("shard", "bin")) - 1
    grouped = taken.withColumn("group", F.floor(F.col("shard") / REPAIR).cast("bigint")).withColumn("old", old.cast("int"))
    base = cut(grouped.groupBy("limit_id", "capacity", "group").agg(F.array_sort(F.collect_list(F.struct("id", "part", "n", "old"))).alias("items")))
    start = base.select("limit_id", "capacity", F.col("group").alias("shard"), F.transform("items", lambda x: x["n"]).alias("sizes"), F.array(F.transform("items", lambda x: x["old"])).alias("pop"))
    best = solved(start).withColumnRenamed("shard", "group")
    again = base.join(best, ["limit_id", "group"]).select("limit_id", "capacity", (-F.col("group") - 1).alias("shard"), F.explode(F.arrays_zip("items", "bins")).alias("z"))
    again = again.select(*shard, F.col("z.items.id").alias("id"), F.col("z.items.part").alias("part"), F.col("z.items.n").alias("n"), F.col("z.bins").alias("bin"))
    return each.join(loose, ["limit_id", "shard", "bin"], "left_anti").select(*again.columns).unionByName(again)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per limit: containers used, the least number that could do, tokens, part of the space filled."""
    bins = packed.groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("capacity"))
    out = bins.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("capacity").alias("capacity"), F.max("n").alias("fullest"))
    return out.select("limit_id", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))
