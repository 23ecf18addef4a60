"""Totals over trailing windows by a two-stack queue run over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import need, no_nan

#: monoids: (NumPy ufunc, identity)
MONOIDS = {"sum": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}
BLOCK = 8192
CHUNK = 1 << 20
#: time steps that a task holds in dense arrays at once, a segment's at least
CELLS = 1 << 20


def two_stack(values: np.ndarray, window: int, monoid: str) -> np.ndarray:
    """The monoid's total over the trailing ``window`` entries at every entry.

    The queue's two stacks, for a whole array at once: the back stack holds running totals since the last flip, the
    front stack running totals down to that flip; a flip comes every ``window`` pushes. Nothing is ever subtracted, so
    any associative operation works.
    """
    op, zero = MONOIDS[monoid]
    n = len(values)
    padded = np.full(-(-max(n, 1) // window) * window, zero)
    padded[:n] = values
    grid = padded.reshape(-1, window)
    back = op.accumulate(grid, axis=1).ravel()
    front = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    i = np.arange(n)
    out = back[:n].copy()
    crossing = (i >= window - 1) & ((i + 1) % window != 0)
    out[crossing] = op(front[i[crossing] - window + 1], back[i[crossing]])
    return out


def _segments(batches: Iterator[pa.RecordBatch], halo: int) -> Iterator[pa.Table]:
    """Tables of whole (source, block) segments of about CHUNK rows and CELLS time steps at most.

    A segment begins with a control row and fills as many cells as it has time steps, however few rows it holds.
    """
    rest: list[pa.RecordBatch] = []
    rows = cells = 0

    def pieces(t: pa.Table, heads: np.ndarray) -> Iterator[pa.Table]:
        size = t["until"].combine_chunks().fill_null(0).to_numpy()[heads] - t["t"].to_numpy()[heads] + 1 + halo
        upto = np.cumsum(size)
        first = np.flatnonzero(np.r_[True, upto[1:] // CELLS != upto[:-1] // CELLS])
        ends = np.r_[heads[first[1:]], t.num_rows]
        for a, b in zip(heads[first], ends):
            yield t.slice(int(a), int(b - a))

    for b in batches:
        rest.append(b)
        rows += b.num_rows
        at = pc.filter(b["until"], pc.equal(b["kind"], 0)), pc.filter(b["t"], pc.equal(b["kind"], 0))
        cells += (pc.sum(pc.subtract(*at)).as_py() or 0) + len(at[0]) * (1 + halo)
        if rows >= CHUNK or cells >= CELLS:
            t = pa.Table.from_batches(rest).combine_chunks()
            heads = np.flatnonzero(t["kind"].to_numpy() == 0)
            last = int(heads[-1])
            if last > 0:
                yield from pieces(t.slice(0, last), heads[:-1])
                t = t.slice(last)
            rest, rows, cells = t.to_batches(), t.num_rows, 0
    if rows:
        t = pa.Table.from_batches(rest).combine_chunks()
        yield from pieces(t, np.flatnonzero(t["kind"].to_numpy() == 0))


def _roller(keys: list[str], values: list[str], windows: list[int], extra: list[str], names: list[str]):
    halo = max(windows) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, halo):
            kind, at = t["kind"].to_numpy(), t["t"].to_numpy()
            heads = np.flatnonzero(kind == 0)
            lo, hi = at[heads], t["until"].combine_chunks().fill_null(0).to_numpy()[heads]
            length = hi - lo + 1 + halo  # each segment has its halo in front, so no window reaches another segment
            offset = np.cumsum(length) - length
            total = int(length.sum())
            seg = np.cumsum(kind == 0) - 1
            body = kind == 1
            cell = (offset[seg] + halo + at - lo[seg])[body]
            emit = np.ones(total, dtype=bool)
            emit[(offset[:, None] + np.arange(halo)).ravel()] = False
            which = np.repeat(np.arange(len(heads)), hi - lo + 1)
            cols = [t[k].combine_chunks().take(pa.array(heads[which])) for k in keys]
            frames = np.arange(total)[emit] - offset[which] - halo + lo[which]
            cols.append(pa.array(frames))
            dense: dict[tuple, np.ndarray] = {}
            for v in values:
                col = t[v].combine_chunks()
                ok = np.asarray(col.is_valid())[body]
                x = np.asarray(col.fill_null(0.0))[body]
                c = np.zeros(total)
                np.add.at(c, cell[ok], 1.0)
                dense[v, "n"] = c
                for m in ("sum", *extra):
                    op, zero = MONOIDS[m]
                    d = np.full(total, zero)
                    op.at(d, cell[ok], x[ok])
                    dense[v, m] = d
            for w in windows:
                for v in values:
                    n = two_stack(dense[v, "n"], w, "sum")[emit]
                    none = n == 0
                    s = two_stack(dense[v, "sum"], w, "sum")[emit]
                    cols += [pa.array(n.astype(np.int64)), pa.array(s, mask=none), pa.array(s / np.maximum(n, 1), mask=none)]
                    cols += [pa.array(two_stack(dense[v, m], w, m)[emit], mask=none) for m in extra]
            yield from pa.table(cols, names=names).to_batches(max_chunksize=65_536)

    return run


def rolling(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], windows: Sequence[int], extra: Sequence[str] = ("max",), block: int = BLOCK
) -> DataFrame:
    """Trailing totals for every source and every time step from its first to its last row, idle steps included.

    For each window ``w`` and value ``v``: ``n_v_w`` (readings), ``sum_v_w``, ``avg_v_w`` and one column for each
    non-invertible aggregate in ``extra`` ("max", "min"), over the ``w`` steps that end with the row's own. The window
    lives in a two-stack queue inside sorted partitions. Sources are cut into blocks of ``block`` steps, which carry
    the rows of the ``max(windows) - 1`` steps before them, so a long or hot source spreads over many tasks.

    NULL and NaN values count as no reading; aggregates over no reading are NULL and ``n`` is 0. Rows that are equal
    in keys, time and values are one; different rows at one step all count. Rows with a NULL key or time are dropped;
    empty input gives no rows. Other columns are ignored. Window sizes must be positive.
    """
    keys, values, windows, extra = list(keys), list(values), [int(w) for w in windows], list(extra)
    need(df, *keys, time, *values)
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive")
    if block < max(windows):
        raise ValueError("block must be at least the longest window")
    ok = F.col(time).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    ks, vs = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    rows = df.where(ok).select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(time).cast("bigint").alias("t"), *[no_nan(F.col(v).cast("double")).alias(a) for v, a in zip(values, vs)]
    ).distinct()
    blk = lambda c: F.floor(c / F.lit(block)).cast("bigint")
    span = df.where(ok).groupBy(*[F.col(k).alias(a) for k, a in zip(keys, ks)]).agg(F.min(F.col(time).cast("bigint")).alias("lo"), F.max(F.col(time).cast("bigint")).alias("hi"))
    halo = max(windows) - 1
    # rows go to the blocks that their halo reaches too; a block after the source's end has a control row that emits nothing
    lo = F.greatest(F.col("lo"), F.col("blk") * block)
    control = span.withColumn("blk", F.explode(F.sequence(blk(F.col("lo")), blk(F.col("hi") + halo)))).select(
        *ks, "blk", F.lit(0).alias("kind"), lo.alias("t"), F.greatest(F.least(F.col("hi"), (F.col("blk") + 1) * block - 1), lo - 1).alias("until"),
        *[F.lit(None).cast("double").alias(v) for v in vs],
    )
    body = rows.withColumn("blk", F.explode(F.sequence(blk(F.col("t")), blk(F.col("t") + halo)))).select(
        *ks, "blk", F.lit(1).alias("kind"), "t", F.lit(None).cast("bigint").alias("until"), *vs
    )
    sorted_ = control.unionByName(body).repartition(*ks, "blk").sortWithinPartitions(*ks, "blk", "kind", "t")
    names = [*keys, time]
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(time, T.LongType())]
    for w in windows:
        for v in values:
            for stem, kind in (("n", T.LongType()), ("sum", T.DoubleType()), ("avg", T.DoubleType()), *((m, T.DoubleType()) for m in extra)):
                names.append(f"{stem}_{v}_{w}")
                fields.append(T.StructField(names[-1], kind))
    return sorted_.mapInArrow(_roller(ks, vs, windows, extra, names), T.StructType(fields))
