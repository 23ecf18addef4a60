"""Linking a stream of features with state for each movie."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motespark.operators.linking import Linker

STATE = "blob binary, waiting binary, last bigint, late bigint"


def _advance(linker: Linker, rows: pd.DataFrame, last: int, pos: list[str], t: str, fill: bool) -> tuple[pd.DataFrame, int]:
    """Link the rows' frames in order."""
    parts = []
    for now, f in rows.groupby(t, sort=True):
        now = int(now)
        if fill and last >= 0:
            for gap in range(last + 1, min(now, last + linker.memory + 2)):
                linker.step(gap, np.zeros((0, len(pos))))
        parts.append(f.assign(particle=linker.step(now, f[pos].to_numpy(dtype=float))))
        last = now
    return (pd.concat(parts, ignore_index=True) if parts else rows.assign(particle=np.zeros(0, dtype=np.int64))), last


def link_stream(df: DataFrame, groups: Sequence[str], search_range, pos: Sequence[str] = ("y", "x"), t: str = "frame", make: Callable[[], Linker] | None = None, fill: bool = True, wait: int = 60, **kw) -> DataFrame:
    """A streaming ``df`` with ``particle`` and ``late`` (rows of its movie that came too late so far).

    The state of a movie is its linker (last positions, memory) and its newest frame, which waits until rows of a
    later frame show that it is complete, or for ``wait`` seconds. Rows of a frame that is already linked are dropped
    and counted. Rows with a missing position or frame are dropped. Use append mode; with waiting frames an
    ``availableNow`` trigger goes on until they time out, a ``once`` trigger ends after its batch.
    """
    pos, groups = list(pos), list(groups)
    fields = list(df.schema.fields)
    schema = T.StructType([*fields, T.StructField("particle", T.LongType()), T.StructField("late", T.LongType())])
    build = make or (lambda: Linker(search_range, **kw))
    cols = [f.name for f in fields]

    def run(_key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            blob, waiting, last, late = state.get
            linker, held = pickle.loads(blob), pickle.loads(waiting)
        else:
            linker, held, last, late = build(), pd.DataFrame(columns=cols), -1, 0
        if state.hasTimedOut:
            ready, held = held, held.iloc[:0]
        else:
            fresh = [p.dropna(subset=[*pos, t]) for p in parts]
            rows = pd.concat([x for x in (held, *fresh) if len(x)], ignore_index=True) if len(held) or any(len(x) for x in fresh) else held
            old = rows[t].astype("int64") <= last if len(rows) else pd.Series([], dtype=bool)
            late += int(old.sum())
            rows = rows[~old]
            newest = rows[t].max() if len(rows) else None
            ready, held = rows[rows[t] < newest] if len(rows) else rows, rows[rows[t] == newest] if len(rows) else rows
        out, last = _advance(linker, ready, last, pos, t, fill)
        state.update((pickle.dumps(linker), pickle.dumps(held), last, late))
        if len(held):
            state.setTimeoutDuration(wait * 1000)
        if len(out):
            yield out.assign(late=late)[schema.names]

    return df.groupBy(*groups).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
