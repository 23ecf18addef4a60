"""Exact spans of at least a given length that several documents share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from motespark.common import cut, need

#: fixed odd multipliers and their inverses modulo 2**64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TAIL = 24  # bits of a position within one piece of concatenated text
PIECE = 1 << 20
#: places of the anchor that make one block of windows
STEP = 24
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Polynomial hashes modulo 2**64 of any stretch of an array of code points; equal stretches, equal hashes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, which: int):
        base = _BASES[which]
        n = len(codes)
        have = self._powers.get(which)
        if have is None or len(have[0]) <= n:
            size = 1 << max(n + 1, 1 << 16).bit_length()
            inverse = pow(base, -1, 1 << 64)
            have = tuple(self._geometric(b, size) for b in (base, inverse))
            self._powers[which] = have
        self.inverse = have[1]
        with np.errstate(over="ignore"):
            v = mix(codes.astype(np.uint64) + U(0x632BE59BD9B4E019 * (which + 1) & (1 << 64) - 1))
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(v * have[0][:n], out=self.sums[1:])

    @staticmethod
    def _geometric(b: int, size: int) -> np.ndarray:
        out = np.full(size, b, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(out)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive entries."""
    n = len(keys)
    pad = -(-n // width) * width
    grid = np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = keys
    grid = grid.reshape(-1, width)
    back = np.minimum.accumulate(grid, axis=1).ravel()
    front = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(front[: n - width + 1], back[width - 1 : n])


def anchors(codes: np.ndarray, ends: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor's place after it, anchor hash, two context hashes) of concatenated texts.

    A window is a stretch of ``min_len`` characters; its anchor is the gram of least hash in it, the last of equals, so
    that equal windows have equal anchors at equal offsets. Windows next to each other with one anchor are one run; its
    context is all the text that its windows cover.
    """
    n = len(codes)
    nothing = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(3))
    if n < min_len:
        return nothing
    one = Hashes(codes, 0)
    at = np.arange(n - gram + 1)
    grams = one.of(at, at + gram)
    tail = U((1 << _TAIL) - 1)
    low = sliding_min((grams & ~tail) | (tail - at.astype(np.uint64)), min_len - gram + 1)
    anchor = (tail - (low & tail)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[: n - min_len + 1]
    valid = np.flatnonzero(np.arange(n - min_len + 1) + min_len <= ends[doc])
    if not len(valid):
        return nothing
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (anchor[valid[1:]] != anchor[valid[:-1]]) | (valid[1:] != valid[:-1] + 1) | (doc[valid[1:]] != doc[valid[:-1]])
    head = np.flatnonzero(new)
    first = valid[head]
    count = np.diff(np.r_[head, len(valid)])
    stop = first + count - 1 + min_len
    off = anchor[first] - first
    mark = off.astype(np.uint64)
    two = Hashes(codes, 1)
    with np.errstate(over="ignore"):
        h1, h2 = mix(one.of(first, stop) ^ mix(mark + U(1))), mix(two.of(first, stop) + mark)
    return doc[first], first, count, off, grams[anchor[first]], h1, h2


def _pieces(texts: list[str], min_len: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Batches of (text number, offset, code points), each below 2**24 characters; long texts come in overlapping pieces."""
    which, offset, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        if len(text) < min_len:
            continue
        codes = _code_points(text)
        for s in range(0, len(codes) - min_len + 1, PIECE):
            part = codes[s : s + PIECE + min_len - 1]
            if held and held + len(part) > PIECE:
                yield which, offset, parts
                which, offset, parts, held = [], [], [], 0
            which.append(i)
            offset.append(s)
            parts.append(part)
            held += len(part)
    if parts:
        yield which, offset, parts


def _fingerprint(min_len: int, gram: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            ids, hashes = b.column(0), b.column(1)
            for which, offset, parts in _pieces(texts, min_len):
                doc, first, count, off, a, h1, h2 = anchors(np.concatenate(parts), np.cumsum([len(p) for p in parts]), min_len, gram)
                begin = np.cumsum([0, *(len(p) for p in parts)])[:-1]
                row = pa.array(np.asarray(which)[doc])
                place = first - begin[doc] + np.asarray(offset)[doc]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), pa.array(place), pa.array(count), pa.array(off), *[pa.array(x.view(np.int64)) for x in (a, h1, h2)]], names=names
                )

    return run


def _gathered(b: pa.RecordBatch, names: tuple[str, ...], stop: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """The stretches of text that listed structs need, some texts at a time: (code points, row and start of each struct, columns).

    ``b`` has the columns doc, th, text, c; a struct's stretch begins at its ``p`` and ends before ``stop(columns)``.
    """
    if not b.num_rows:
        return
    lists = b.column(3)
    flat = lists.flatten()
    cols = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in names}
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    starts = np.r_[0, ends[:-1]]
    low = np.minimum.reduceat(cols["p"], starts)
    high = np.maximum.reduceat(stop(cols), starts)
    texts = b.column(2)
    first, held, parts = 0, 0, []
    for i in range(b.num_rows):
        parts.append(_code_points(texts[i].as_py()[low[i] : high[i]]))
        held += len(parts[-1])
        if held >= PIECE or i == b.num_rows - 1:
            base = np.cumsum([0, *(len(x) for x in parts)])[:-1]
            use = slice(starts[first], ends[i])
            row = np.repeat(np.arange(first, i + 1), ends[first : i + 1] - starts[first : i + 1])
            yield np.concatenate(parts), row, cols["p"][use] + (base - low[first : i + 1])[row - first], {k: v[use] for k, v in cols.items()}
            first, held, parts = i + 1, 0, []


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number within it) of ``count[which]`` entries each."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _batches(cols: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)
    for s in range(0, whole.num_rows, 100_000):
        yield whole.slice(s, 100_000)


def _blocks(min_len: int, gram: int, names: list[str]):
    """Each context's windows in blocks by the anchor's place in the window.

    A block's hull is all the text that its windows cover; its core is what any window with the anchor in the block's
    places must hold. Both are hashed with their place around the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, row, p0, c in _gathered(b, ("p", "n", "off", "h1", "h2", "lo", "hi"), lambda c: c["p"] + c["n"] - 1 + min_len):
                one, two = Hashes(codes, 0), Hashes(codes, 1)
                which, i = _spread(c["n"])
                place = c["off"][which] - i
                block = place // STEP
                head = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (block[1:] != block[:-1])])
                tail = np.r_[head[1:], len(which)] - 1
                w, i0, i1, blk, at = which[head], i[head], i[tail], block[head], place[head]
                p = p0[w]
                anchor = p + c["off"][w]
                near, far = blk * STEP, np.minimum(blk * STEP + STEP - 1, min_len - gram)
                with np.errstate(over="ignore"):
                    u1 = mix(one.of(p + i0, p + i1 + min_len) ^ mix(at.astype(np.uint64) + U(1)))
                    u2 = mix(two.of(p + i0, p + i1 + min_len) + at.astype(np.uint64))
                    core = mix(one.of(anchor - near, anchor - far + min_len) ^ mix(blk.astype(np.uint64) + U(7)))
                same = pa.array(row[w])
                yield from _batches([b.column(0).take(same), b.column(1).take(same), c["h1"][w], c["h2"][w], c["p"][w], i0, i1, u1.view(np.int64), u2.view(np.int64), core.view(np.int64), c["lo"][w], c["hi"][w]], names)

    return run


def _windows(min_len: int, names: list[str]):
    """Hashes of all windows of the given stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, _, p0, c in _gathered(b, ("p", "i0", "i1", "u1", "u2", "lo", "hi"), lambda c: c["p"] + c["i1"] + min_len):
                which, i = _spread(c["i1"] - c["i0"] + 1)
                start = (p0 + c["i0"])[which] + i
                w = [Hashes(codes, k).of(start, start + min_len).view(np.int64) for k in (0, 1)]
                yield from _batches([c["u1"][which], c["u2"][which], i, *w, c["lo"][which], c["hi"][which]], names)

    return run


def shared_spans(df: DataFrame, ident: str, text: str, min_len: int = 200, gram: int = 64) -> DataFrame:
    """The longest runs of shared characters of every document: ident, ``span_start``, ``span_end``.

    A character is shared if it lies in a stretch of at least ``min_len`` characters that occurs exactly in the text of
    a document with another ident. Positions count code points from 0; ``span_end`` is exclusive.

    Every window of ``min_len`` characters names an anchor, its gram of least hash, so equal windows meet under equal
    anchors. What a run of windows with one anchor covers is its context. Contexts found in two documents are shared as
    a whole. Where an anchor has contexts of different text (at the edges of shared stretches), they are cut into
    blocks of windows: a block whose hull is found in two documents is shared, one whose core isn't is not, and only
    the windows of the rest are compared one by one. All comparisons are of 128-bit hashes (64 bits for the cores and
    anchors, which only propose) that keep the least and the greatest ident, so copies of one text cost one row in
    each map task and never meet in pairs. The result is exact but for hash collisions.

    A repeat within one document is no case; rows repeated with the same ident count once. Texts that are NULL or
    shorter than ``min_len`` share nothing, rows with a NULL ident are dropped. Whole texts of any length are used.
    """
    need(df, ident, text)
    if not 0 < gram <= min_len:
        raise ValueError("gram must be in 1..min_len")
    kind = df.schema[ident].dataType.simpleString()
    typed = lambda names: ", ".join(f"{c} {kind if c in ('doc', 'lo', 'hi') else 'bigint'}" for c in names)
    least = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    docs = df.where(F.col(ident).isNotNull() & (F.length(text) >= min_len)).select(F.col(ident).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    names = ["doc", "th", "p", "n", "off", "a", "h1", "h2"]
    runs = cut(docs.mapInArrow(_fingerprint(min_len, gram, names), typed(names)))
    at = F.struct("doc", "th", "p", "n", "off")
    ctx = runs.groupBy("a", "h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(at).alias("at"))
    by_anchor = ctx.groupBy("a").agg(*least, F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("open")).where("lo <> hi and k > 1 and open > 0").select("a")
    unsure = ctx.join(by_anchor, "a", "left_semi")
    lists = unsure.groupBy("at.doc", "at.th").agg(F.collect_list(F.struct("at.p", "at.n", "at.off", "h1", "h2", "lo", "hi")).alias("c"))
    bn = ["doc", "th", "h1", "h2", "p", "i0", "i1", "u1", "u2", "core", "lo", "hi"]
    beside = lambda listed: docs.join(listed, ["doc", "th"]).select("doc", "th", "text", "c")
    blocks = cut(beside(lists).mapInArrow(_blocks(min_len, gram, bn), typed(bn)))
    hulls = blocks.groupBy("u1", "u2", "core").agg(*least, F.min(F.struct("doc", "th", "p", "i0", "i1")).alias("at"))
    open_core = hulls.groupBy("core").agg(*least, F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("open")).where("lo <> hi and open > 0").select("core")
    rest = hulls.join(open_core, "core", "left_semi")
    lists = rest.groupBy("at.doc", "at.th").agg(F.collect_list(F.struct("at.p", "at.i0", "at.i1", "u1", "u2", "lo", "hi")).alias("c"))
    wn = ["u1", "u2", "i", "w1", "w2", "lo", "hi"]
    windows = cut(beside(lists).mapInArrow(_windows(min_len, wn), typed(wn)))
    common = windows.groupBy("w1", "w2").agg(*least).where("lo <> hi").select("w1", "w2")
    hit = windows.where("lo = hi").join(common, ["w1", "w2"], "left_semi").groupBy("u1", "u2").agg(F.array_sort(F.collect_set("i")).alias("i"))
    part = hit.select("u1", "u2", F.explode(_ranges("i")).alias("r")).select("u1", "u2", "r.s", "r.e")
    full = hulls.where("lo <> hi").select("u1", "u2", F.lit(0).cast("bigint").alias("s"), (F.col("at.i1") - F.col("at.i0")).alias("e"))
    settled = blocks.where("lo = hi").join(part.unionByName(full), ["u1", "u2"]).select("h1", "h2", (F.col("i0") + F.col("s")).alias("s"), (F.col("i0") + F.col("e")).alias("e"))
    whole = ctx.where("lo <> hi").select("h1", "h2", F.lit(0).cast("bigint").alias("s"), (F.col("at.n") - 1).alias("e"))
    found = runs.select("doc", "th", "p", "h1", "h2").join(whole.unionByName(settled), ["h1", "h2"])
    spans = found.select("doc", "th", (F.col("p") + F.col("s")).alias("s"), (F.col("p") + F.col("e") + min_len).alias("e"))
    return _merge(spans).select(F.col("doc").alias(ident), F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def _ranges(col: str):
    """Runs (s, e) of consecutive numbers in a sorted array, at most as long as one run of windows."""
    a = F.col(col)
    heads = F.filter(a, lambda v, k: (k == 0) | (F.element_at(a, F.when(k > 0, k).otherwise(F.lit(1))) != v - 1))
    ends = F.filter(a, lambda v, k: (k == F.size(a) - 1) | (F.element_at(a, F.least(k + 2, F.size(a))) != v + 1))
    return F.arrays_zip(heads.alias("s"), ends.alias("e"))


def _merge(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of one text as one."""
    w = W.partitionBy("doc", "th").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = spans.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return d.groupBy("doc", "th", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def span_report(df: DataFrame, ident: str, text: str, min_len: int = 200) -> DataFrame:
    """Per document: ``n_spans``, ``shared_chars`` and ``share`` of its characters that other documents contain."""
    per = shared_spans(df, ident, text, min_len).groupBy(ident).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    size = df.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.max(F.length(text)).cast("bigint").alias("chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = size.join(per, ident, "left").select(ident, "chars", zero("n_spans").alias("n_spans"), zero("shared_chars").alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)))
