"""Implausible readings per source: an isolation forest over movement features, exact checks and physical limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import first_rows, need, present, small_side

BLOCK = 65_536
CHUNK = 100_000
#: readings of context on both sides of a block
CONTEXT = 16
#: levels of a tree; 2**DEPTH leaves
DEPTH = 8
#: bins of the step histogram for a doubling of the step
BINS = 32
#: sources whose leaf counts are held at once
PIECE = 8192
#: a step below this share of the median step counts as no movement in the usual step
IDLE = 0.02


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n leaves."""
    n = np.maximum(n.astype(np.float64), 1)
    large = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n >= 3, large, np.interp(n, [1, 2, 3], [0.0, 1.0, 1.2]))


@lru_cache(maxsize=8)
def trees_of(features: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of the inner nodes of every tree in heap order, drawn over the unit cube.

    A node cuts its own cell at a uniform place along a random feature, whatever the data: trees of all sources are
    the same, and only the readings that fall into their nodes differ. On every path each feature comes once in as
    many levels as there are features, which keeps the scores of few trees steady.
    """
    rng = np.random.default_rng(seed)
    pick, cut = np.empty((trees, (1 << DEPTH) - 1), dtype=np.int64), np.empty((trees, (1 << DEPTH) - 1))
    for t in range(trees):
        low, high, due = np.zeros((1, features)), np.ones((1, features)), rng.random((1, features))
        for level in range(DEPTH):
            k = np.arange(1 << level)
            if level % features == 0:
                due = rng.random((len(k), features))
            at = due.argmax(axis=1)
            place = low[k, at] + rng.random(len(k)) * (high[k, at] - low[k, at])
            pick[t, len(k) - 1 : 2 * len(k) - 1], cut[t, len(k) - 1 : 2 * len(k) - 1] = at, place
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            high[2 * k, at], low[2 * k + 1, at] = place, place
            due[k, at] = -1
            due = np.repeat(due, 2, axis=0)
    return pick, cut


def leaves(mat: np.ndarray, pick: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of every reading in one tree; ``mat`` has one row for each feature."""
    n = mat.shape[1]
    flat, row = np.ascontiguousarray(mat).ravel(), np.arange(n)
    node = np.zeros(n, dtype=np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (flat.take(pick.take(node) * n + row) >= cut.take(node))
    return node - ((1 << DEPTH) - 1)


def _scores(mat: np.ndarray, seg: np.ndarray, counts_of, trees: int, sample: int, seed: int) -> np.ndarray:
    """Isolation scores; ``counts_of(tree, leaf)`` gives the fitted readings in every (source, leaf) of a tree."""
    pick, cut = trees_of(mat.shape[0], trees, seed)
    n, depth, known = mat.shape[1], np.zeros(mat.shape[1]), np.ones(mat.shape[1], dtype=bool)
    for t in range(trees):
        leaf = leaves(mat, pick[t], cut[t])
        held = counts_of(t, leaf)
        ns = len(held)
        key = (seg << DEPTH) + leaf
        cells = np.flatnonzero(np.bincount(key, minlength=ns << DEPTH))
        total = held.sum(axis=1)
        share = np.minimum(1.0, sample / np.maximum(total, 1))[cells >> DEPTH]
        ladder = [held]
        for _ in range(DEPTH):
            ladder.append(ladder[-1].reshape(ns, -1, 2).sum(axis=2))
        ended, alone = np.full(len(cells), np.nan), np.zeros(len(cells), dtype=bool)
        for level in range(DEPTH + 1):
            m = ladder[DEPTH - level].ravel()[cells >> (DEPTH - level)] * share
            now = ~alone & (m <= 1)
            ended[now] = level
            alone |= now
        ended[~alone] = DEPTH + _mean_path(m[~alone])
        by_cell = np.zeros(ns << DEPTH)
        by_cell[cells] = ended
        depth += by_cell[key]
        known = (total > 1)[seg]
    return np.where(known, np.power(2.0, -depth / max(trees, 1) / _mean_path(np.array([256]))[0]), 0.5) if n else depth


def forest_scores(mat: np.ndarray, seg: np.ndarray, fit: np.ndarray, trees: int = 50, sample: int = 64, seed: int = 1) -> np.ndarray:
    """Isolation scores in 0..1 of readings (columns of ``mat``, features scaled to 0..1), one forest for each source.

    ``seg`` numbers the sources in ascending order, ``fit`` marks the readings that the forest is fitted on. A reading
    is isolated at the first node that holds at most one of ``sample`` fitted readings of its source, in expectation;
    readings that aren't fitted can't hide it. Where a source has no two fitted readings, nothing is known and scores are 0.5.
    """
    score, n = np.zeros(len(seg)), len(seg)
    if not n:
        return score
    at = 0
    while at < n:
        stop = int(np.searchsorted(seg, seg[at] + PIECE))
        part, base = slice(at, stop), seg[at]
        s, w = seg[part] - base, fit[part].astype(float)
        ns = int(s[-1]) + 1
        score[part] = _scores(mat[:, part], s, lambda t, leaf: np.bincount((s << DEPTH) + leaf, weights=w, minlength=ns << DEPTH).reshape(ns, -1), trees, sample, seed)  # noqa: B023
        at = stop
    return score


def _shift(a: np.ndarray, seg: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` rows later (earlier if negative) in the same segment, else NaN."""
    out = np.full(len(a), np.nan)
    if by > 0:
        ok = seg[by:] == seg[:-by]
        out[:-by][ok] = a[by:][ok]
    elif by < 0:
        ok = seg[:by] == seg[-by:]
        out[-by:][ok] = a[:by][ok]
    return out


def steps(t: np.ndarray, pos: list[np.ndarray], seg: np.ndarray) -> np.ndarray:
    """Distance from the reading before, by the square root of the time passed; NaN at the start of a segment."""
    passed = np.maximum(t - _shift(t.astype(float), seg, -1), 1)
    return np.sqrt(sum((p - _shift(p, seg, -1)) ** 2 for p in pos)) / np.sqrt(passed)


def step_bins(step: np.ndarray) -> np.ndarray:
    """The histogram bin of positive steps."""
    return np.floor(np.log2(step) * BINS).astype(np.int64)


def step_of(bins: np.ndarray) -> np.ndarray:
    """The middle of histogram bins."""
    return np.exp2((bins + 0.5) / BINS)


def usual_step(owner: np.ndarray, bins: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The usual step of each of ``n`` sources from (owner, bin, count) of a histogram, NaN where nothing moves.

    The lower median, taken twice: the second time without steps so short that they are jitter of a reading that
    stands still. Counts of parts of a source add up, so the result doesn't depend on how a source is cut.
    """
    by = np.lexsort((bins, owner))
    o, b, c = owner[by], bins[by], count[by].astype(float)

    def median(o: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.full(n, np.nan)
        if len(o):
            total = np.bincount(o, weights=c, minlength=n)
            upto = np.cumsum(c)
            before = np.r_[0.0, np.cumsum(total)[:-1]][o]
            hit = np.flatnonzero(upto - before >= np.floor((total[o] - 1) / 2) + 1)
            first = np.unique(o[hit], return_index=True)
            out[first[0]] = b[hit[first[1]]]
        return out

    first = median(o, b, c)
    keep = b >= first[o] + np.log2(IDLE) * BINS
    return step_of(median(o[keep], b[keep], c[keep]))


def _repeats(v: np.ndarray, seg: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of each reading in its run of nearly equal values; the first reading of a run has place 0.

    A run holds the readings that lie within ``near`` of its first one, so that slow movement doesn't chain into one.
    """
    n = len(v)
    place = np.zeros(n, dtype=np.int64)
    anchor = np.arange(n)
    close = np.zeros(n, dtype=bool)
    close[1:] = (seg[1:] == seg[:-1]) & (np.abs(v[1:] - v[:-1]) <= 2 * near[1:])
    # only stretches in which each reading is near the one before can hold a run: usually a few
    for at in np.flatnonzero(close).tolist():
        head = anchor[at - 1]
        if abs(v[at] - v[head]) <= near[at]:
            anchor[at], place[at] = head, at - head
    length = np.bincount(anchor, minlength=n)[anchor]
    return place, length


def _excursions(t: np.ndarray, pos: list[np.ndarray], seg: np.ndarray, scale: np.ndarray, skip: np.ndarray, close: float, within: int) -> np.ndarray:
    """How far off the line between the readings around it, in usual steps, a reading lies if the source comes back.

    An excursion of at most ``within`` readings between two readings a and b counts if b is no farther from a than
    ``close`` usual steps for the time passed; it is as far off as its nearest reading, and of all excursions that
    hold a reading the farthest counts. Readings marked ``skip`` aren't looked at.
    """
    use = np.flatnonzero(~skip)
    tt, ss, pp, sc = t[use].astype(float), seg[use], [p[use] for p in pos], scale[use]
    far = np.zeros(len(use))
    n = len(use)
    for m in range(1, within + 1):
        if n <= m + 1:
            break
        a, b = np.arange(n - m - 1), np.arange(m + 1, n)
        passed = np.sqrt(np.maximum(tt[b] - tt[a], 1))
        back = (ss[a] == ss[b]) & (np.sqrt(sum((p[b] - p[a]) ** 2 for p in pp)) <= close * sc[a] * passed)
        a, b = a[back], b[back]
        nearest = np.full(len(a), np.inf)
        for k in range(1, m + 1):
            i = a + k
            f = (tt[i] - tt[a]) / np.maximum(tt[b] - tt[a], 1)
            off = np.sqrt(sum((p[i] - (p[a] + (p[b] - p[a]) * f)) ** 2 for p in pp))
            nearest = np.minimum(nearest, off / (sc[a] * np.sqrt(np.maximum(np.minimum(tt[i] - tt[a], tt[b] - tt[i]), 1))))
        for k in range(1, m + 1):
            far[a + k] = np.maximum(far[a + k], nearest)
    out = np.zeros(len(t))
    out[use] = far
    return out


class Readings:
    """Readings sorted by source and time with all that the forest and the checks look at.

    ``source`` numbers the sources, ``usual`` holds their usual steps; a source's readings more than ``gap`` time steps
    apart aren't compared.
    """

    def __init__(self, t: np.ndarray, pos: list[np.ndarray], source: np.ndarray, usual: np.ndarray, outside: np.ndarray, opts: dict):
        n = len(t)
        seg = contiguous(t, source, opts["gap"])
        self.moving = np.isfinite(usual)[source]
        scale = np.where(self.moving, usual[source], 1.0)
        runs = [_repeats(p, seg, opts["tolerance"] * scale) for p in pos]
        repeats = [np.where(place > 0, length - 1, 0) for place, length in runs]
        self.held = np.zeros(n, dtype=bool)
        for place, length in runs:
            self.held |= (place > 0) & (length > 2)
        self.held &= sum(repeats) >= 3  # two repeats of one value happen by chance
        self.far = np.where(self.moving, _excursions(t, pos, seg, scale, self.held | outside, opts["close"], opts["within"]), 0.0)
        around = []
        for p in pos:
            near = np.stack([_shift(p, seg, k) for k in (-3, -2, -1, 1, 2, 3)])
            near.sort(axis=0)
            have = np.isfinite(near).sum(axis=0)
            mid = np.where(have > 0, near[np.maximum((have - 1) // 2, 0), np.arange(n)], p)
            around.append(p - mid)
        level = np.sqrt(sum(a**2 for a in around)) / scale
        # usual level at the same phase: the lower median of the six readings around, each taken at its own phase
        season, phase = opts["season"], np.mod(t, opts["season"])
        rank = np.lexsort((t, phase, seg))
        ordered, group = level[rank], (seg * season + phase)[rank]
        near = np.stack([_shift(ordered, group, k) for k in (-2, -1, 1, 2)])
        near.sort(axis=0)
        have = np.isfinite(near).sum(axis=0)
        seasonal = np.zeros(n)
        seasonal[rank] = np.where(have > 0, near[np.maximum((have - 1) // 2, 0), np.arange(n)], 0.0)
        reach = opts["reach"]
        self.mat = np.stack([
            np.minimum(level, reach) / reach,
            np.minimum(self.far, reach) / reach,
            np.minimum(np.abs(level - seasonal), reach) / reach,
            np.minimum(sum(repeats), opts["longest"]) / opts["longest"],
        ])
        # the forest is fitted on ordinary readings: repeats, physically impossible ones and clear excursions stay out
        self.fit = (sum(repeats) == 0) & ~outside & (self.far <= opts["far"])


def contiguous(t: np.ndarray, source: np.ndarray, gap: int) -> np.ndarray:
    """Numbers of the stretches of a source without a pause of more than ``gap`` time steps."""
    if not len(t):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(t), dtype=np.int64)
    new[1:] = (source[1:] != source[:-1]) | (t[1:] - t[:-1] > gap)
    return np.cumsum(new)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole segments (runs of one ``seg``), about CHUNK rows each."""
    rest, held = [], 0
    for b in batches:
        rest.append(b)
        held += b.num_rows
        if held >= CHUNK:
            t = pa.Table.from_batches(rest).combine_chunks()
            h = t["seg"].to_numpy()
            heads = np.flatnonzero(h[1:] != h[:-1]) + 1
            if len(heads):
                yield t.slice(0, int(heads[-1]))
                t = t.slice(int(heads[-1]))
            rest, held = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(rest).combine_chunks()


def _histogram(t: np.ndarray, pos: list[np.ndarray], source: np.ndarray, own: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, bin, count) of the steps that end in own readings."""
    step = steps(t, pos, contiguous(t, source, gap))
    ok = own & (step > 0) & np.isfinite(step)
    pair = np.stack([source[ok], step_bins(step[ok])])
    both, count = np.unique(pair, axis=1, return_counts=True)
    return both[0], both[1], count


def _stage(what: str, keys: list[str], values: list[str], opts: dict, names: list[str]):
    """The Arrow body of one pass over sorted blocks.

    "whole" judges sources that lie in one block. Sources over several blocks take three passes: "steps" counts steps,
    "leaves" counts fitted readings in the leaves of all trees, "judge" flags; what the passes before found comes as a
    control row in front of each block.
    """
    trees, sample, seed = opts["trees"], opts["sample"], opts["seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _chunks(batches):
            control = None
            if what in ("leaves", "judge"):
                is_control = tab["t"].is_null().to_numpy()
                control, tab = tab.filter(pa.array(is_control)), tab.filter(pa.array(~is_control))
            start = first_rows(tab, ["seg", *keys])
            source = np.repeat(np.arange(len(start)), np.diff(np.r_[start, tab.num_rows]))
            t, pos = tab["t"].to_numpy(), [tab[v].to_numpy() for v in values]
            outside, own = tab["outside"].to_numpy(zero_copy_only=False), tab["own"].to_numpy(zero_copy_only=False)
            if what == "steps":
                of, at, count = _histogram(t, pos, source, own, opts["gap"])
                cols = [tab[k].combine_chunks().take(pa.array(start[of])) for k in keys]
                yield from pa.table([*cols, pa.array(at), pa.array(count)], names=names).to_batches()
                continue
            if what == "whole":
                usual = usual_step(*_histogram(t, pos, source, own, opts["gap"]), len(start))
            else:
                usual = step_of(control["bin"].combine_chunks().cast(pa.float64()).fill_null(np.nan).to_numpy())
            r = Readings(t, pos, source, usual, outside, opts)
            if what == "whole":
                score = forest_scores(r.mat, source, r.fit, trees, sample, seed)
            elif what == "leaves":
                pick, cut = trees_of(r.mat.shape[0], trees, seed)
                use = r.fit & own
                mat, of = r.mat[:, use], source[use]
                for i in range(trees):
                    cell, count = np.unique((of << DEPTH) + leaves(mat, pick[i], cut[i]), return_counts=True)
                    cols = [tab[k].combine_chunks().take(pa.array(start[cell >> DEPTH])) for k in keys]
                    yield from pa.table([*cols, pa.array((i << DEPTH) + (cell & ((1 << DEPTH) - 1))), pa.array(count)], names=names).to_batches()
                continue
            else:
                score = np.zeros(len(t))
                for s, lo in enumerate(start):
                    hi = start[s + 1] if s + 1 < len(start) else len(t)
                    table = np.zeros(trees << DEPTH)
                    entry = control["held"][s].as_py() or []
                    if entry:
                        table[[e["leaf"] for e in entry]] = [e["n"] for e in entry]
                    table = table.reshape(trees, 1, -1)
                    score[lo:hi] = _scores(r.mat[:, lo:hi], source[lo:hi] - s, lambda i, leaf: table[i], trees, sample, seed)  # noqa: B023
            odd = score >= opts["threshold"]
            spike, stuck = odd & (r.far > opts["far"]), odd & r.held & r.moving
            out = [tab[k].combine_chunks() for k in keys] + [tab["t"].combine_chunks(), pa.array(score), pa.array(spike), pa.array(stuck), pa.array(outside)]
            yield from pa.table(out, names=names).filter(pa.array(own)).to_batches(max_chunksize=65_536)

    return run


def flag_readings(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    impossible: Column | None = None,
    *,
    season: int = 7,
    trees: int = 50,
    sample: int = 64,
    threshold: float = 0.7,
    far: float = 6.0,
    close: float = 5.0,
    within: int = 3,
    tolerance: float = 0.005,
    gap: int = 256,
    reach: float = 24.0,
    longest: int = 5,
    block: int = BLOCK,
    seed: int = 1,
) -> DataFrame:
    """Score every usable reading of every source and flag the wrong ones.

    An isolation forest for each source works on four features: level (distance from the median of the six readings
    around, in units of the source's usual step, the median of its steps), difference (distance from the line between
    the readings before and after an excursion of at most ``within`` readings, 0 if the source doesn't come back to
    within ``close`` usual steps), seasonal (level against the level at the same phase of ``season`` time steps) and
    run length (repeats of a value over all coordinates). The features are scaled to 0..1 at ``reach`` usual steps and
    ``longest`` repeats; ``trees`` trees cut that range at random, the same for all sources, and each source's own
    ordinary readings (no repeats, nothing impossible, no excursion beyond ``far``) decide where a reading is isolated. ``sample`` is
    the number of readings that a tree counts as, however long the source is. Flags:

    - ``spike``: score of at least ``threshold``, and the reading lies in an excursion of more than ``far`` usual steps
      that comes back. A move that lasts is no spike.
    - ``stuck``: score of at least ``threshold``, and the reading is a later one of a run of three or more that lie
      within ``tolerance`` usual steps of the run's first, in any value, with three repeats or more over all values.
    - ``outside``: the physical-limit rule ``impossible`` (a condition on ``df``'s columns) holds.

    Readings of a source more than ``gap`` time steps apart aren't compared. A source of more than ``block`` time
    steps is spread over tasks; steps and leaf counts of its blocks are added up first, so flags and scores don't depend on
    ``block``. Readings with a NULL or NaN value, NULL key or NULL time get no row. Repeated rows are one; of different
    rows at one time the smallest counts. A source without any movement, or of one reading, has no spikes and isn't
    stuck. Empty input gives no rows. Returns keys, time, ``score``, ``spike``, ``stuck``, ``outside``.
    """
    keys, values = list(keys), list(values)
    need(df, *keys, time, *values)
    halo = CONTEXT * gap
    if block < 1 or gap < 1:
        raise ValueError("block and gap must be positive")
    ok = present(*values) & F.col(time).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    ks, vs = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    rule = F.coalesce(impossible, F.lit(False)) if impossible is not None else F.lit(False)
    src = df.where(ok).select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(time).cast("bigint").alias("t"), F.struct(*[F.col(v).cast("double").alias(a) for v, a in zip(values, vs)], rule.alias("outside")).alias("r")
    )
    blk = lambda c: F.floor(c / F.lit(block)).cast("bigint")
    one = src.groupBy(*ks, "t").agg(F.min("r").alias("r")).select(*ks, "t", "r.*")
    opts = {
        "season": season, "trees": trees, "sample": sample, "threshold": threshold, "far": far, "close": close, "within": within,
        "tolerance": tolerance, "gap": gap, "reach": reach, "longest": longest, "seed": seed,
    }
    names = [*keys, time, "score", "spike", "stuck", "outside"]
    key_fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    schema = T.StructType(
        [*key_fields, T.StructField(time, T.LongType()), T.StructField("score", T.DoubleType())] + [T.StructField(c, T.BooleanType()) for c in ("spike", "stuck", "outside")]
    )
    long = src.groupBy(*ks).agg(blk(F.min("t")).alias("b0"), blk(F.max("t")).alias("b1")).where("b0 < b1").select(*ks)
    seg = F.xxhash64(*ks).alias("seg")

    def whole(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.lit(True).alias("own"), seg)
        return rows.repartition(*ks).sortWithinPartitions("seg", *ks, "t").mapInArrow(_stage("whole", ks, vs, opts, names), schema)

    if long.isEmpty():
        return whole(one)
    long = small_side(long)
    home = blk(F.col("t"))
    spread = one.join(long, ks, "left_semi").withColumn("blk", F.explode(F.sequence(blk(F.col("t") - halo), blk(F.col("t") + halo)))).withColumn("own", F.col("blk") == home)
    blocks = spread.where("own").select(*ks, "blk").distinct()

    def over_blocks(what: str, control: DataFrame | None, names: list[str], schema: T.StructType) -> DataFrame:
        rows = spread
        if control is not None:
            rows = spread.join(blocks, [*ks, "blk"], "left_semi").unionByName(blocks.join(control, ks, "left"), allowMissingColumns=True)
        # by seg, as both sides of the union may be partitioned by keys and block, each into a number of its own
        rows = rows.withColumn("seg", F.xxhash64(*ks, "blk"))
        return rows.repartition("seg").sortWithinPartitions("seg", *ks, "blk", F.col("t").asc_nulls_first()).mapInArrow(_stage(what, ks, vs, opts, names), schema)

    count = T.StructField("n", T.LongType())
    found = over_blocks("steps", None, [*ks, "bin", "n"], T.StructType([*[T.StructField(k, f.dataType) for k, f in zip(ks, key_fields)], T.StructField("bin", T.LongType()), count]))
    hist = found.groupBy(*ks, "bin").agg(F.sum("n").alias("n")).groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("hist"))
    every = blocks.select(*ks).distinct()
    usual = every.join(hist, ks, "left").select(*ks, _usual_bin("hist").alias("bin"))
    leaf_schema = T.StructType([*[T.StructField(k, f.dataType) for k, f in zip(ks, key_fields)], T.StructField("leaf", T.LongType()), count])
    held = over_blocks("leaves", usual, [*ks, "leaf", "n"], leaf_schema).groupBy(*ks, "leaf").agg(F.sum("n").alias("n")).groupBy(*ks).agg(F.collect_list(F.struct("leaf", "n")).alias("held"))
    judged = over_blocks("judge", usual.join(held, ks, "left"), names, schema)
    return whole(one.join(long, ks, "left_anti")).unionByName(judged)


def _usual_bin(hist: str) -> Column:
    """The bin of the usual step in a sorted histogram column, chosen as ``usual_step`` does."""

    def median(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
        rank = F.floor((total - 1) / 2) + 1
        none = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("bin"))

        def step(a: Column, e: Column) -> Column:
            upto = a["upto"] + e["n"]
            return F.struct(upto.alias("upto"), F.when(a["bin"].isNull() & (upto >= rank), e["bin"]).otherwise(a["bin"]).alias("bin"))

        return F.aggregate(h, none, step)["bin"]

    first = median(F.col(hist))
    return median(F.filter(F.col(hist), lambda e: e["bin"] >= first + F.lit(float(np.log2(IDLE) * BINS))))
