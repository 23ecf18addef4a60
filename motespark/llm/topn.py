"""Top N items within every group by one global range-partitioned sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import free_name, need


def _differs(col: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Per row: is the value another one than in the row before? NULL equals NULL, NaN equals NaN."""
    n = len(col)
    out = np.ones(n, dtype=bool)
    if n > 1:
        a, b = col.slice(1), col.slice(0, n - 1)
        ne = pc.fill_null(pc.not_equal(a, b), False)
        ne = pc.or_(ne, pc.xor(pc.is_valid(a), pc.is_valid(b)))
        if pa.types.is_floating(col.type):
            ne = pc.and_not(ne, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out[1:] = ne.to_numpy(zero_copy_only=False)
    if before is not None and n:
        first = col[0]
        same = first.is_valid == before.is_valid and (not first.is_valid or first == before)
        if not same and first.is_valid and before.is_valid and pa.types.is_floating(col.type):
            same = first.as_py() != first.as_py() and before.as_py() != before.as_py()
        out[0] = not same
    return out


def _ranker(groups: list[str], score: str, ident: str, n: int, rank: str, part: str):
    """Numbers the distinct rows of each group within one sorted partition and keeps ranks up to ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: dict[str, pa.Scalar] = {}
        seen = 0  # distinct rows so far of the group that the last batch ended in
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in [*groups, score, ident]}
            fresh = np.zeros(rows, dtype=bool)
            for g in groups:
                fresh |= _differs(of[g], last.get(g))
            if not last:
                fresh[0] = True
            new = fresh | _differs(of[score], last.get(score)) | _differs(of[ident], last.get(ident))
            running = np.cumsum(new)
            start = np.where(fresh, running - 1, np.int64(-1))
            start[0] = 0 if fresh[0] else -seen
            at = np.maximum.accumulate(np.where(fresh | (np.arange(rows) == 0), np.arange(rows), 0))
            ranks = running - start[at]
            seen = int(ranks[-1])
            last = {c: a[rows - 1] for c, a in of.items()}
            keep = new & (ranks <= n)
            if keep.any():
                out = batch.filter(pa.array(keep))
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(ranks[keep], pa.int64()), pa.array(np.full(k, pid), pa.int32())],
                    names=[*out.schema.names, rank, part],
                )

    return run


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], score: str, ident: str, n: int, keep: Sequence[str] = (), position: str = "position", partitions: int | None = None
) -> DataFrame:
    """The ``n`` rows of highest ``score`` of every group, equal scores by the smaller ``ident``.

    One range-partitioned sort on (groups, score descending, ident) spreads even a group that holds most rows over
    many tasks. Each sorted partition numbers its rows of a group and keeps local numbers up to ``n``; the kept counts
    of the partitions before are then summed for each group into exact positions, and positions up to ``n`` stay. The
    second shuffle holds at most ``n`` rows for each group and partition that the group reaches into.

    Rows whose score is NULL or NaN never count. A NULL group is a group of its own. Rows of one group with equal
    score and ident are one row (which of them is kept is open if ``keep`` columns differ). An empty input, or ``n``
    below 1, gives no rows. ``partitions`` sets the number of ranges, else Spark's setting holds. Returns groups, ident, score, ``keep`` and ``position`` (1 is best).
    """
    groups, keep = list(groups), [c for c in keep if c not in {*groups, score, ident}]
    need(df, *groups, score, ident, *keep)
    cols = [*groups, ident, score, *keep]
    if position in cols:
        raise ValueError(f"position column {position!r} is also an input column")
    kind = df.schema[score].dataType
    ok = F.col(score).isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        ok = ok & ~F.isnan(F.col(score))
    order = [*(F.col(g).asc_nulls_first() for g in groups), F.col(score).desc(), F.col(ident).asc_nulls_first()]
    picked = df.select(*cols).where(ok)
    rank, part = free_name(picked, "_rank"), free_name(picked, "_part")
    schema = T.StructType([*picked.schema.fields, T.StructField(rank, T.LongType()), T.StructField(part, T.IntegerType())])
    ranged = picked.repartitionByRange(partitions, *order) if partitions else picked.repartitionByRange(*order)
    local = ranged.sortWithinPartitions(*order)
    ranked = local.mapInArrow(_ranker(groups, score, ident, n, rank, part), schema)
    before = W.partitionBy(*groups).orderBy(part).rangeBetween(W.unboundedPreceding, -1)
    exact = ranked.withColumn(position, F.count(F.lit(1)).over(before) + F.col(rank))
    return exact.where(F.col(position) <= n).drop(rank, part)
