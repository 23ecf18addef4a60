"""Finding and linking in one pass: features lost by the search are looked for again near where they were last."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from motespark.functions import imageproc as ip
from motespark.functions.masks import mask_image, slice_image
from motespark.functions.scalar import validate_tuple
from motespark.operators.assignment import neighbours
from motespark.operators.components import roots
from motespark.operators.linking import Linker
from motespark.operators.locate import refine_com, unpack_frame

COLUMNS = ("y", "x", "mass", "size", "ecc", "signal", "raw_mass")


class FindLinker(Linker):
    """A Linker that also sees the images."""

    def __init__(self, search_range, separation, diameter=None, minmass: float = 0, noise_size=1, smoothing_size=None, threshold=None, percentile: float = 64, preprocess: bool = True, refine: bool = True, before_link: Callable | None = None, after_link: Callable | None = None, **kw):
        super().__init__(search_range, **kw)
        self.range, self.separation = search_range, separation
        self.diameter = diameter if diameter is not None else int(np.max(separation)) // 2 * 2 + 1
        self.minmass, self.refine = minmass, refine
        self.filter = {"noise_size": noise_size, "smoothing_size": smoothing_size, "threshold": threshold, "percentile": percentile, "preprocess": preprocess}
        self.before_link, self.after_link = before_link, after_link

    def find(self, t: int, raw: np.ndarray) -> pd.DataFrame:
        """The frame's features with particle numbers."""
        ndim, o = raw.ndim, self.filter
        dia = validate_tuple(self.diameter, ndim)
        radius = tuple(int(d) // 2 for d in dia)
        image = ip.bandpass(raw, o["noise_size"], o["smoothing_size"] or dia, o["threshold"]) if o["preprocess"] else raw
        factor, image = ip.convert_to_int(image, raw.dtype if np.issubdtype(raw.dtype, np.integer) else np.uint8)
        names = ["z", "y", "x"][-ndim:]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            peaks = ip.grey_dilation(image, self.separation, o["percentile"], radius)
        f = self._measure(raw, image, radius, peaks, factor)
        if self.before_link is not None:
            f = self.before_link(t, f)
        more = self._again(t, raw, image, radius, f, names, factor)
        if len(more):
            f = pd.concat([f, more], ignore_index=True)
        f["particle"] = self.step(t, f[names].to_numpy(dtype=float)) if len(f) else np.zeros(0, dtype=np.int64)
        return self.after_link(t, f) if self.after_link is not None else f

    def _measure(self, raw, image, radius, peaks, factor) -> pd.DataFrame:
        f = refine_com(raw, image, radius, peaks, max_iterations=10 if self.refine else 1)
        if len(f):
            f["mass"] /= factor
            f["signal"] /= factor
            f = f[f["mass"] >= self.minmass].reset_index(drop=True)
        return f

    def _again(self, t: int, raw, image, radius, f, names, factor) -> pd.DataFrame:
        """Features that the search missed, found near where the tracks are expected.

        Sources and features in reach of each other form subnets; one whose source has nothing in reach takes in all sources
        within twice the range, as a feature found for it may be in their reach too. A subnet with fewer features
        than sources gets the most massive new ones, at most as many as are missing.
        """
        none = f.iloc[:0]
        if not len(self.ids):
            return none
        src = self.predictor.predict(t, self.ids, self.pos, self.seen) if self.predictor is not None else self.pos
        have = f[names].to_numpy(dtype=float).reshape(-1, len(names))
        at, n = self._space(src), len(src)
        s, d, _ = neighbours(at, self._space(have), self.reach, self.opts["most"]) if len(have) else (np.zeros(0, dtype=int),) * 3
        lost = np.setdiff1d(np.arange(n), s)
        a, b, _ = neighbours(at[lost], at, 2 * self.reach, None)
        subnet = roots(np.r_[s, lost[a]], np.r_[n + d, b], n + len(have))
        missing = np.bincount(subnet[:n], minlength=n) - np.bincount(subnet[n + np.unique(d)], minlength=n)[:n]
        found = [none]
        for label in np.flatnonzero(missing > 0):
            known = np.concatenate([have, *[g[names].to_numpy(dtype=float) for g in found[1:]]])
            new = self._peaks(raw, image, radius, src[subnet[:n] == label], known, names, factor)
            if len(new):
                found.append(new.sort_values("mass", ascending=False, kind="stable").head(int(missing[label])))
        return pd.concat(found[1:], ignore_index=True) if len(found) > 1 else none

    def _peaks(self, raw, image, radius, near: np.ndarray, known: np.ndarray, names, factor) -> pd.DataFrame:
        """Measured local maxima within the search range of ``near``, of the image without the ``known`` features."""
        none = pd.DataFrame({c: [] for c in names})
        ndim = len(names)
        reach = np.asarray(validate_tuple(self.range, ndim), dtype=float)
        sep = np.asarray(validate_tuple(self.separation, ndim), dtype=float)
        view = tuple(int(r + w + 1) for r, w in zip(reach, radius))
        part, origin = slice_image(near, image, view)
        level = ip.percentile_threshold(image, self.filter["percentile"])
        if not part.size or np.isnan(level):
            return none
        part = mask_image(near, part, view, origin)
        close = (np.abs(known - np.clip(known, origin, origin + np.asarray(part.shape) - 1)) < sep).all(axis=1)
        if close.any():
            part = mask_image(known[close], part, tuple(sep), origin, invert=True)
        peak = np.argwhere((part == ip.dilate(part, [int(2 * w / np.sqrt(ndim)) for w in sep])) & (part > level))
        glow = part[tuple(peak.T)]
        place = peak + origin
        inside = ((place >= np.asarray(radius)) & (place <= np.asarray(image.shape) - np.asarray(radius) - 1)).all(axis=1)
        far = np.sqrt(((self._space(place.astype(float))[:, None] - self._space(near)[None]) ** 2).sum(axis=2)).min(axis=1) if len(place) else np.zeros(0)
        ok = inside & (far <= self.reach)
        place = ip.drop_close(place[ok], sep, glow[ok])
        return self._measure(raw, image, radius, place, factor) if len(place) else none


def find_link_iter(frames: Iterable[tuple[int, np.ndarray]], search_range, separation, fill: bool = True, **kw) -> Iterator[tuple[int, pd.DataFrame]]:
    """(frame number, features with ``particle``) of a stream of (frame number, image); options are FindLinker's.

    With ``fill`` a frame number that is passed over is a frame without features.
    """
    linker, last = FindLinker(search_range, separation, **kw), None
    for now, image in frames:
        for gap in range(last + 1, min(now, last + linker.memory + 2)) if fill and last is not None else ():
            linker.step(gap, np.zeros((0, image.ndim)))
        yield now, linker.find(now, image)
        last = now


def find_link(frames: DataFrame, groups: Sequence[str], search_range, separation, t: str = "frame", columns: Sequence[str] = COLUMNS, **kw) -> DataFrame:
    """Features with ``particle`` of packed frames, found and linked frame after frame within each movie.

    A movie is a fold over time: one task holds its frames. Options are FindLinker's.
    """
    groups, columns = list(groups), list(columns)
    kinds = dict(frames.dtypes)
    schema = T._parse_datatype_string(", ".join([*[f"`{g}` {kinds[g]}" for g in groups], f"`{t}` bigint", *[f"`{c}` double" for c in columns], "particle bigint"]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(t)
        images = ((int(now), unpack_frame(*packed)) for now, *packed in zip(rows[t], rows["shape"], rows["dtype"], rows["data"]))
        own = {g: pdf[g].iloc[0] for g in groups}
        out = [f.reindex(columns=[*columns, "particle"]).assign(**{t: now}, **own) for now, f in find_link_iter(images, search_range, separation, **kw)]
        return pd.concat(out, ignore_index=True)[schema.names] if out else pd.DataFrame({n: [] for n in schema.names})

    return frames.groupBy(*groups).applyInPandas(run, schema)
