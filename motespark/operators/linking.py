"""Linking features into tracks.

Without memory no state goes beyond one frame: ``link`` solves all pairs of consecutive frames at once. With memory it
folds over time within sets of features that come near each other. ``link_stateful`` folds over the frames of a
movie, which a predictor or a custom metric asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import cut, free_name, need, present, release
from motespark.operators.assignment import MAX_NEIGHBORS, MAX_SUBNET, MAX_SUBNET_ADAPTIVE, SLACK, _assign, assign, check_strategy
from motespark.operators.components import connected_components, roots
from motespark.operators.ordering import numbered
from motespark.operators.static import _points, pairs_within

#: a zone, whose links are worked on in one task, is this many search ranges wide and so many frames long
TILE = 64.0
SPELL = 64
#: rows that a task works on at once
CHUNK = 400_000


def _scaled(df: DataFrame, groups: Sequence[str], ident: str, pos: Sequence[str], reach, t: str) -> tuple[DataFrame, float]:
    pts = _points(df, groups, ident, pos, {"t": F.col(t).cast("bigint")}).where("t is not null")
    if hasattr(reach, "__iter__"):
        r = list(reach)
        if len(set(r)) == 1:
            return pts, float(r[0])
        return pts.withColumns({f"p{i}": F.col(f"p{i}") / F.lit(float(x)) for i, x in enumerate(r)}), 1.0
    return pts, float(reach)


def _edges(df: DataFrame, groups: Sequence[str], ident: str, search_range, pos: Sequence[str], t: str, memory: int = 0) -> tuple[DataFrame, DataFrame, float]:
    """(points, pairs, range): pairs of points of frames at most ``memory`` + 1 apart, with the source's zone.

    Points are joined on (groups, frame, grid cell), so dense frames spread over many tasks.
    """
    pts, reach = _scaled(df, groups, ident, pos, search_range, t)
    # a point is a destination at its own frame and a source at the next ones
    later = [F.struct((F.col("t") + k).alias("pair"), F.lit(k).alias("ago")) for k in range(memory + 2)]
    both = pts.withColumn("s", F.explode(F.array(*later))).select(*groups, "id", *[f"p{i}" for i in range(len(pos))], F.col("s.pair").alias("pair"), F.col("s.ago").alias("ago"))
    near = pairs_within(both, [*groups, "pair"], len(pos), reach + SLACK, ordered=True, keep=["ago"], inclusive=False).where("a_ago > 0 and b_ago = 0")
    zone = F.xxhash64(*groups, F.floor(F.col("pair") / SPELL), *[F.floor(F.col(f"a_p{i}") / F.lit(TILE * reach)) for i in range(len(pos))])
    return pts, near.select(*groups, "pair", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "dist", zone.alias("zone")), reach


def _nearest_sources(edges: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` nearest sources of each destination (all if None), with their number ``n_d``."""
    every = W.partitionBy("dst")
    e = edges.withColumn("n_d", F.count(F.lit(1)).over(every))
    if most is None:
        return e
    e = e.withColumn("_k", F.row_number().over(every.orderBy("dist", "src"))).where(F.col("_k") <= most).drop("_k")
    return e.withColumn("n_d", F.least("n_d", F.lit(most)))


def link_candidates(df: DataFrame, groups: Sequence[str], ident: str, search_range, pos: Sequence[str] = ("y", "x"), t: str = "frame", most: int | None = MAX_NEIGHBORS) -> DataFrame:
    """Candidate links between consecutive frames: groups, ``src``, ``dst``, ``dist``; of each destination its ``most`` nearest sources (None: all)."""
    return _nearest_sources(_edges(df, groups, ident, search_range, pos, t)[1], most).drop("zone", "n_d")


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of about CHUNK rows, cut where the sorted ``key`` changes."""
    rest, held = [], 0
    for b in batches:
        rest.append(b)
        held += b.num_rows
        if held >= CHUNK:
            tab = pa.Table.from_batches(rest).combine_chunks()
            k = tab[key].to_numpy()
            heads = np.flatnonzero(k[1:] != k[:-1]) + 1
            if len(heads):
                yield tab.slice(0, int(heads[-1]))
                tab = tab.slice(int(heads[-1]))
            rest, held = tab.to_batches(), tab.num_rows
    if held:
        yield pa.Table.from_batches(rest).combine_chunks()


def _coded(*cols: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """(sorted distinct values, their numbers in each column)."""
    parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
    values, code = np.unique(np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]), return_inverse=True)
    return pa.array(values, parts[0].type), np.split(code, np.cumsum([len(p) for p in parts])[:-1])


def _links(edges: DataFrame, reach: float, strategy, max_size: int, stop: float | None, step: float) -> DataFrame:
    """(src, dst, zone) of the chosen links among edges with ``n_d``.

    Each task solves the subnets of its zones. A subnet goes on if one of its destinations has candidates in other zones;
    those few are put together by components of their sources and solved in a second pass.
    """
    kind = edges.schema["src"].dataType
    fields = [T.StructField("src", kind), T.StructField("dst", kind), T.StructField("dist", T.DoubleType()), T.StructField("zone", T.LongType()), T.StructField("low", kind)]

    def best(s: np.ndarray, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sources, destinations) of the links among numbered candidates, in an order that rows don't decide."""
        by = np.lexsort((s, v, t))
        n_src, n_dst = int(s.max(initial=-1)) + 1, int(t.max(initial=-1)) + 1
        out = np.full(n_dst, -1)
        _assign(s[by], t[by], v[by], n_src, n_dst, reach, strategy, stop, step, max_size, out)
        return out[out >= 0], np.flatnonzero(out >= 0)

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _by_key(batches, "zone"):
            # a destination takes part once for each zone that it is looked at from
            (src, (s,)), (dst, (t,)) = _coded(tab["src"]), _coded(tab["dst"])
            v, n_d = tab["dist"].to_numpy(), tab["n_d"].to_numpy()
            here = np.bincount(t, minlength=len(dst))[t]
            comp = roots(s, len(src) + t, len(src) + len(dst))[s]
            if strategy == "drop":
                open_ = np.zeros(len(s), dtype=bool)
                alone = (np.bincount(s)[s] == 1) & (n_d == 1)
                ls, lt = s[alone], t[alone]
            else:
                open_ = np.bincount(comp, weights=here != n_d, minlength=len(src))[comp] > 0
                ls, lt = best(s[~open_], t[~open_], v[~open_])
            zone = np.zeros(len(src), dtype=np.int64)
            zone[s] = tab["zone"].to_numpy()
            left = np.flatnonzero(open_)
            a, b = np.concatenate([ls, s[left]]), np.concatenate([lt, t[left]])
            n = len(ls)
            low = pa.array(comp[left]) if len(left) else pa.array([], pa.int64())
            cols = [src.take(pa.array(a)), dst.take(pa.array(b)), pa.array(np.concatenate([np.zeros(n), v[left]])), pa.array(zone[a]), pa.concat_arrays([pa.nulls(n, src.type), src.take(low)])]
            yield from pa.table(cols, names=[f.name for f in fields]).to_batches(max_chunksize=65_536)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _by_key(batches, "subnet"):
            (src, (s,)), (dst, (t,)) = _coded(tab["src"]), _coded(tab["dst"])
            zone = np.zeros(len(src), dtype=np.int64)
            zone[s] = tab["zone"].to_numpy()
            a, b = best(s, t, tab["dist"].to_numpy())
            yield from pa.table([src.take(pa.array(a)), dst.take(pa.array(b)), pa.array(zone[a])], names=["src", "dst", "zone"]).to_batches()

    rows = edges.select("src", "dst", "dist", "n_d", "zone").repartition("zone").sortWithinPartitions("zone")
    first = cut(rows.mapInArrow(zones, T.StructType(fields)))
    done, left = first.where("low is null").select("src", "dst", "zone"), first.where("low is not null")
    if strategy == "drop" or left.isEmpty():
        return done
    star = left.withColumn("least", F.min("low").over(W.partitionBy("dst"))).where("low <> least").select(F.col("low").alias("id_a"), F.col("least").alias("id_b"))
    comp = connected_components(star).select(F.col("id").alias("low"), "component")
    rows = left.join(comp, "low", "left").select("src", "dst", "dist", "zone", F.xxhash64(F.coalesce("component", "low")).alias("subnet"))
    second = rows.repartition("subnet").sortWithinPartitions("subnet").mapInArrow(joined, T.StructType([fields[0], fields[1], fields[3]]))
    return done.unionByName(second)


def chains(links: DataFrame) -> DataFrame:
    """``id`` and ``head``, the first point of its chain, of every point that a link (src, dst, zone) leads to.

    Each task follows the links of its zones; only chains that cross zones go on, by pointer jumping on their crossings.
    """
    kind = links.schema["src"].dataType

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _by_key(batches, "zone"):
            ids, (s, t) = _coded(tab["src"], tab["dst"])
            to = np.arange(len(ids))
            to[t] = s
            while True:
                up = to[to]
                if (up == to).all():
                    break
                to = up
            yield from pa.table([ids.take(pa.array(t)), ids.take(pa.array(to[t]))], names=["id", "head"]).to_batches(max_chunksize=65_536)

    rows = links.repartition("zone").sortWithinPartitions("zone")
    ptr = cut(rows.mapInArrow(follow, T.StructType([T.StructField("id", kind), T.StructField("head", kind)])))
    over = cut(ptr.select(F.col("head").alias("id")).distinct().join(ptr, "id"))
    if over.isEmpty():
        return ptr
    while True:
        ahead = over.select(F.col("id").alias("head"), F.col("head").alias("next"))
        nxt = cut(over.join(ahead, "head", "left").select("id", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved")))
        release(over)
        over = nxt.select("id", "head")
        if nxt.where("moved").isEmpty():
            break
    far = over.select(F.col("id").alias("head"), F.col("head").alias("far"))
    return ptr.join(far, "head", "left").select("id", F.coalesce("far", "head").alias("head"))


def _remembered(pts: DataFrame, pairs: DataFrame, pos: Sequence[str], reach: float, memory: int, make: Callable[[], Linker]) -> DataFrame:
    """``id`` and ``head`` of points linked with memory: a fold over time within each set of points that come near each other.

    Points that are never within range, ``memory`` + 1 frames apart at most, can't compete, so components of such
    pairs are linked apart from each other.
    """
    comp = connected_components(pairs.select("zone", F.col("src").alias("id_a"), F.col("dst").alias("id_b")), near=["zone"])
    cols = [f"p{i}" for i in range(len(pos))]
    rows = pts.join(comp, "id").select("id", "t", *cols, F.xxhash64("component").alias("subnet"), "component")
    kind = pts.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _by_key(batches, "subnet"):
            ids = tab["id"].combine_chunks()
            comp = _coded(tab["component"])[1][0]
            t, at = tab["t"].to_numpy(), np.stack([tab[c].to_numpy() for c in cols], axis=1)
            head = np.empty(len(t), dtype=np.int64)
            start = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]])
            # a set of at most one point in each frame, each in reach of the one before, is one track
            passed, way = np.diff(t), np.sqrt((np.diff(at, axis=0) ** 2).sum(axis=1))
            broken = np.r_[(passed < 1) | (passed > memory + 1) | (way >= reach), False]
            broken[start[1:] - 1] = False
            single = np.add.reduceat(broken.astype(np.int64), start) == 0
            head[:] = np.repeat(start, np.diff(np.r_[start, len(t)]))
            for part in [p for p, whole in zip(np.split(np.arange(len(t)), start[1:]), single) if not whole]:
                number = fold(at[part], t[part], make)
                first = np.full(number.max() + 1, len(t))
                np.minimum.at(first, number, part)
                head[part] = first[number]
            yield from pa.table([ids, ids.take(pa.array(head))], names=["id", "head"]).to_batches(max_chunksize=65_536)

    order = rows.repartition("subnet").sortWithinPartitions("subnet", "component", "t", "id")
    return order.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("head", kind)]))


def link(
    df: DataFrame,
    groups: Sequence[str],
    ident: str,
    search_range,
    pos: Sequence[str] = ("y", "x"),
    t: str = "frame",
    strategy="exact",
    max_size: int | None = None,
    *,
    memory: int = 0,
    adaptive_stop: float | None = None,
    adaptive_step: float = 0.95,
    neighbors: int | None = MAX_NEIGHBORS,
    predictor: Callable | None = None,
    dist_func: Callable | None = None,
    to_eucl: Callable | None = None,
) -> DataFrame:
    """``df`` with ``particle``: the ident of the first feature of its track.

    Features of consecutive frames closer than ``search_range`` (one number, or one for each axis) are candidates, of
    each destination its ``neighbors`` nearest sources (None: all). A pair without other candidates is linked; contested subnets
    are solved exactly (least sum of squared distances, range² for each unlinked source), left unlinked
    (``strategy="drop"``) or given to a function (see ``assign``). More than ``max_size`` sources in a subnet (30, or 15
    with ``adaptive_stop``) raise SubnetOversizeError, or with ``adaptive_stop`` are solved at ranges shorter by
    ``adaptive_step``. A particle lost for up to ``memory`` frames is looked for where it was last.

    Without memory, subnets of one pair of frames are solved in tasks of one region each. With memory, sets of features
    that come near each other are folded over time, each in one task. A ``predictor`` (a function that makes one), a
    metric ``dist_func`` or a map ``to_eucl`` needs whole frames: the movie is folded in one task.

    ``ident`` must be unique and not NULL. Features with a missing position or frame get a NULL particle; those with a
    NULL group are tracks of their own. Ties go to the smaller idents. Empty input gives no rows.
    """
    need(df, *groups, ident, *pos, t)
    check_strategy(strategy)
    limit = max_size or (MAX_SUBNET if adaptive_stop is None else MAX_SUBNET_ADAPTIVE)
    if predictor is not None or dist_func is not None or to_eucl is not None:
        kw = {"memory": memory, "strategy": strategy, "adaptive_stop": adaptive_stop, "adaptive_step": adaptive_step, "dist_func": dist_func, "to_eucl": to_eucl, "max_size": limit, "most": neighbors}
        return link_stateful(df, groups, search_range, pos, t, predictor=predictor, ident=ident, **kw)
    pts, pairs, reach = _edges(df, groups, ident, search_range, pos, t, memory)
    if memory:
        opts = {"memory": memory, "strategy": strategy, "adaptive_stop": adaptive_stop, "adaptive_step": adaptive_step, "max_size": limit, "most": neighbors}
        heads = _remembered(pts, pairs, pos, reach, memory, lambda: Linker(reach, **opts))
    else:
        heads = chains(_links(_nearest_sources(pairs, neighbors), reach, strategy, limit, adaptive_stop, adaptive_step))
    label = free_name(df, "_id")
    heads = heads.select(F.col("id").alias(label), F.col("head").alias("particle"))
    usable = present(*pos) & F.col(t).isNotNull()
    out = df.drop("particle") if "particle" in df.columns else df
    found = out.join(heads, out[ident] == heads[label], "left")
    return found.select(*[out[c] for c in out.columns], F.coalesce("particle", F.when(usable, out[ident])).alias("particle"))


def renumber(df: DataFrame, groups: Sequence[str], t: str = "frame") -> DataFrame:
    """``particle`` as 0, 1, ... within the groups, by the order of first appearance; tracks that appear together by their old number."""
    first = df.where("particle is not null").groupBy(*groups, "particle").agg(F.min(t).alias("_t"))
    num = numbered(first, groups, ["_t", "particle"], "_new").drop("_t")
    return _null_safe(df, num, [*groups, "particle"], "left").select(*[F.col("_new").alias("particle") if c == "particle" else F.col(c) for c in df.columns])


class Linker:
    """Links one frame after another; the state is the last positions of the tracks, ``memory`` frames back at most."""

    def __init__(self, search_range, memory: int = 0, predictor=None, strategy: str = "exact", adaptive_stop=None, adaptive_step: float = 0.95, dist_func: Callable | None = None, to_eucl: Callable | None = None, max_size: int | None = None, most: int | None = MAX_NEIGHBORS):
        check_strategy(strategy)
        aniso = hasattr(search_range, "__iter__")
        self.scale = np.asarray(search_range, dtype=float) if aniso else 1.0
        self.reach = 1.0 if aniso else float(search_range)
        self.memory, self.predictor, self.to_eucl = memory, predictor, to_eucl
        self.opts = {"strategy": strategy, "adaptive_stop": adaptive_stop, "adaptive_step": adaptive_step, "dist_func": dist_func, "max_size": max_size, "most": most}
        self.ids, self.pos, self.age, self.seen = np.zeros(0, dtype=np.int64), None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.next_id = 0

    def _space(self, pos: np.ndarray) -> np.ndarray:
        return (self.to_eucl(pos) if self.to_eucl else pos) / self.scale

    def step(self, t: int, coords: np.ndarray) -> np.ndarray:
        """Particle numbers of the points of the next frame."""
        coords = np.asarray(coords, dtype=float)
        if coords.ndim != 2:
            coords = coords.reshape(0, self.pos.shape[1] if self.pos is not None else 1)
        if self.pos is None:
            self.pos = np.zeros((0, coords.shape[1]))
        src = self.pos
        if self.predictor is not None and len(src):
            src = self.predictor.predict(t, self.ids, self.pos, self.seen)
        of = assign(self._space(src), self._space(coords), self.reach, **self.opts) if len(src) and len(coords) else np.full(len(coords), -1)
        out = np.where(of >= 0, self.ids[of] if len(self.ids) else 0, -1).astype(np.int64)
        born = out < 0
        out[born] = self.next_id + np.arange(born.sum())
        self.next_id += int(born.sum())
        lost = np.ones(len(self.ids), dtype=bool)
        lost[of[of >= 0]] = False
        lost &= self.age < self.memory
        self.ids = np.concatenate([out, self.ids[lost]])
        self.pos = np.concatenate([coords, self.pos[lost]])
        self.seen = np.concatenate([np.full(len(out), t, dtype=np.int64), self.seen[lost]])
        self.age = np.concatenate([np.zeros(len(out), dtype=np.int64), self.age[lost] + 1])
        if self.predictor is not None:
            self.predictor.observe(t, out, coords)
        return out


def link_frames(frames: Iterator[tuple[int, np.ndarray]], search_range, **kw) -> Iterator[tuple[int, np.ndarray]]:
    """(time, particle numbers) of a stream of (time, coordinates); gaps in time aren't filled."""
    linker = Linker(search_range, **kw)
    for t, coords in frames:
        yield t, linker.step(t, coords)


def link_df_iter(tables: Iterable[pd.DataFrame], search_range, pos: Sequence[str] = ("y", "x"), t: str = "frame", fill: bool = True, **kw) -> Iterator[pd.DataFrame]:
    """The tables of a stream, one for each frame, with ``particle``; options are Linker's.

    An empty table is a frame without features; with ``fill`` so is a frame number that is passed over. Rows with a
    missing position get a NULL particle.
    """
    linker, last, pos = Linker(search_range, **kw), None, list(pos)
    for f in tables:
        ok = f[pos].notna().all(axis=1).to_numpy()
        now = int(f[t].iloc[0]) if len(f) else (0 if last is None else last + 1)
        for gap in range(last + 1, min(now, last + linker.memory + 2)) if fill and last is not None else ():
            linker.step(gap, np.zeros((0, len(pos))))
        number = pd.array(np.full(len(f), -1), dtype="Int64")
        number[ok] = linker.step(now, f.loc[ok, pos].to_numpy(dtype=float).reshape(-1, len(pos)))
        number[~ok] = pd.NA
        yield f.assign(particle=number)
        last = now


def fold(coords: np.ndarray, frames: np.ndarray, make: Callable[[], Linker], fill: bool = True) -> np.ndarray:
    """Particle numbers of one movie's points; ``fill`` takes missing frames as empty ones."""
    order = np.argsort(frames, kind="stable")
    out = np.full(len(frames), -1, dtype=np.int64)
    linker = make()
    last = None
    for rows in np.split(order, np.flatnonzero(np.diff(frames[order])) + 1):
        if not len(rows):
            continue
        now = int(frames[rows[0]])
        if fill and last is not None:
            # beyond the memory nothing is left to remember
            for gap in range(last + 1, min(now, last + linker.memory + 2)):
                linker.step(gap, np.zeros((0, coords.shape[1])))
        out[rows] = linker.step(now, coords[rows])
        last = now
    return out


def link_stateful(df: DataFrame, groups: Sequence[str], search_range, pos: Sequence[str] = ("y", "x"), t: str = "frame", fill: bool = True, predictor: Callable | None = None, ident: str | None = None, **kw) -> DataFrame:
    """``df`` with ``particle``, linked frame after frame with state: numbered from 0 in each group, or with ``ident`` the ident of the track's first feature.

    Options: ``memory`` (frames a lost particle is kept), ``predictor`` (a function that makes one), ``strategy``,
    ``adaptive_stop`` and ``adaptive_step``, ``dist_func``, ``to_eucl``, ``most``. Each movie is a fold over time in one task:
    the result of a frame depends on all before. Without a predictor, metric or map use ``link``, which has no such
    limit; a movie too long for one task can be cut into patches of frames and joined by ``link_partial``. Rows with a
    missing position or frame get a NULL particle. With ``ident`` ties go to the smaller idents, else rows of
    a frame are taken by position.
    """
    need(df, *groups, *pos, t, *([ident] if ident else []))
    pos = list(pos)
    kept = [f for f in df.schema.fields if f.name != "particle"]
    schema = T.StructType([*kept, T.StructField("particle", df.schema[ident].dataType if ident else T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ident] if ident else pos, kind="stable", ignore_index=True)
        ok = pdf[[*pos, t]].notna().all(axis=1).to_numpy()
        out = np.full(len(pdf), -1, dtype=np.int64)
        out[ok] = fold(pdf.loc[ok, pos].to_numpy(dtype=float), pdf.loc[ok, t].to_numpy().astype(np.int64), lambda: Linker(search_range, predictor=predictor() if predictor else None, **kw), fill)
        if ident:
            number = pd.Series(pd.NA, index=pdf.index, dtype="object")
            rows = pdf.loc[ok].assign(_n=out[ok]).sort_values(t, kind="stable")
            number[ok] = pd.Series(out[ok]).map(rows.groupby("_n")[ident].first()).to_numpy()
            number = number.astype(pdf[ident].dtype) if ok.all() else number.where(number.notna(), None)
        else:
            number = pd.array(out, dtype="Int64")
            number[out < 0] = pd.NA
        return pdf.assign(particle=number)[schema.names]

    return df.groupBy(*groups).applyInPandas(run, schema)


def reconnect(df: DataFrame, groups: Sequence[str], link_range: tuple[int, int], t: str = "frame", new: str = "particle", old: str = "old") -> DataFrame:
    """``df`` with ``new``, where the frames of ``link_range`` (start, stop) carry new track names, put in line with ``old``.

    A new track that holds the first frame of the patch takes the old name there, if there are frames before; one that
    holds the last frame passes its name to the old track after the patch. New tracks without an old name
    keep theirs, which must differ from all old ones. An old track that doesn't go on through the patch gets
    the name of its first new continuation, or stays as it is unless its name went to another track in the patch; it
    then takes that name negated and less one.
    """
    start, stop = link_range
    groups = list(groups)
    on = lambda a, b: [a[g].eqNullSafe(b[g]) for g in groups]
    every = df.where(F.col(new).isNotNull())
    inside = every.where((F.col(t) >= start) & (F.col(t) < stop))
    ends = inside.groupBy(*groups).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    before = every.where(F.col(t) < start).select(*groups).distinct().withColumn("_has", F.lit(True)) if groups else None
    at = _null_safe(inside, ends, groups)
    if groups:
        at = _null_safe(at, before, groups, "left")
    else:
        at = at.withColumn("_has", F.lit(not every.where(F.col(t) < start).isEmpty()))
    named = at.where((F.col(t) == F.col("_first")) & F.col("_has")).groupBy(*groups, F.col(new).alias("_new")).agg(F.min(old).alias("_name"))
    renamed = _null_safe(at.withColumn("_new", F.col(new)), named, [*groups, "_new"], "left").withColumn("_name", F.coalesce("_name", "_new"))
    passed = renamed.where(F.col(t) == F.col("_last")).groupBy(*groups, F.col(old).alias("_old")).agg(F.min("_name").alias("_after"))
    taken = renamed.select(*groups, F.col("_name").alias("_old")).distinct().withColumn("_taken", F.lit(True))
    rest = df.where(~((F.col(t) >= start) & (F.col(t) < stop)) | F.col(t).isNull() | F.col(new).isNull())
    rest = _null_safe(_null_safe(rest.withColumn("_old", F.col(old)), passed, [*groups, "_old"], "left"), taken, [*groups, "_old"], "left")
    name = F.when((F.col(t) >= stop) & F.col("_after").isNotNull(), F.col("_after")).when((F.col(t) >= stop) & F.col("_taken"), -F.col(old) - 1).otherwise(F.col(old))
    cols = df.columns
    done = renamed.select(*[F.col("_name").alias(new) if c == new else F.col(c) for c in cols])
    return done.unionByName(rest.select(*[name.alias(new) if c == new else F.col(c) for c in cols]))


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, NULL equal to NULL, that keeps ``a``'s columns and ``b``'s others."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row for each aggregate without groups
    other = b.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return a.join(other, cond, how).drop(*[f"_r{i}" for i in range(len(keys))])


def link_partial(df: DataFrame, groups: Sequence[str], ident: str, search_range, link_range: tuple[int, int], pos: Sequence[str] = ("y", "x"), t: str = "frame", **kw) -> DataFrame:
    """``df`` (with ``particle``) with the frames start <= frame < stop linked anew and the rest kept connected.

    Options are ``link``'s. Relinked tracks that don't go on from before are named -1 less the ident of their first
    feature, so that they differ from all given names, which must not be negative. See ``reconnect``. Rows whose
    position or frame is missing keep their particle.
    """
    start, stop = link_range
    if not start < stop:
        raise ValueError("link_range must not be empty")
    old, new = free_name(df, "_old"), free_name(df, "_new")
    patch = df.where((F.col(t) >= start) & (F.col(t) < stop))
    fresh = link(patch.select(*dict.fromkeys([*groups, ident, *pos, t])), groups, ident, search_range, pos, t, **kw).select(F.col(ident).alias(new), F.col("particle").cast("bigint").alias("_p"))
    names = df.withColumnRenamed("particle", old).join(fresh, F.col(ident) == F.col(new), "left")
    names = names.withColumn("particle", F.when(F.col("_p").isNotNull(), -F.col("_p") - 1).otherwise(F.col(old)))
    return reconnect(names.drop("_p", new), groups, link_range, t, "particle", old).select(*df.columns)
