"""Rings of bright-field particles: radial search for the dark edge and a circle fit."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from motespark.functions.imageproc import convert_to_int, where_close
from motespark.operators.locate import locate, unpack_frame


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cubic interpolation at fractional places; NaN outside of the image."""
    h, w = image.shape
    out = np.zeros(y.shape)
    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)

    def weights(f):
        return [((-0.5 * f + 1) * f - 0.5) * f, (1.5 * f - 2.5) * f * f + 1, ((-1.5 * f + 2) * f + 0.5) * f, (0.5 * f - 0.5) * f * f]

    wy, wx = weights(y - iy), weights(x - ix)
    for a in range(4):
        for b in range(4):
            out += wy[a] * wx[b] * image[np.clip(iy + a - 1, 0, h - 1), np.clip(ix + b - 1, 0, w - 1)]
    return np.where((y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1), out, np.nan)


def fit_circle(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """(radius, y, x) of the circle with least algebraic error."""
    my, mx = y.mean(), x.mean()
    a = np.column_stack([2 * (y - my), 2 * (x - mx), np.ones(len(y))])
    cy, cx, c = np.linalg.lstsq(a, (y - my) ** 2 + (x - mx) ** 2, rcond=None)[0]
    return float(np.sqrt(max(c + cy * cy + cx * cx, 0))), float(cy + my), float(cx + mx)


def _edge(rays: np.ndarray, threshold: float, max_dev: float, bright_left: bool, factor: float, min_percentile: float) -> np.ndarray:
    """Place of the dark ring on each ray, NaN where none is found."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        level = np.nanpercentile(rays, min_percentile, axis=1)
        place = np.nanmedian(np.where(rays < level[:, None], np.arange(rays.shape[1]), np.nan), axis=1)
        place[level > threshold * np.nanmax(rays)] = np.nan
    got = place[np.isfinite(place)]
    if not len(got):
        return place
    v, n = np.unique(got, return_counts=True)
    usual = v[n.argmax()]
    place[np.abs(place - usual) > round(max_dev)] = np.nan
    cut = int(round(usual))
    if bright_left and np.isfinite(place).any() and 0 < cut < rays.shape[1] and not np.nanmean(rays[:, :cut]) >= factor * np.nanmean(rays[:, cut:]):
        place[:] = np.nan
    return place


def refine_ring(image: np.ndarray, radius: float, y: float, x: float, min_points_frac: float = 0.35, max_ev: int = 10, rad_range: tuple[float, float] | None = None, max_r_dev: float = 0.5, threshold: float = 0.45, max_dev: float = 1, bright_left: bool = True, bright_left_factor: float = 1.2, min_percentile: float = 5.0) -> tuple[float, float, float] | None:
    """(radius, y, x) of the ring near a place, or None. The radial range grows by 3 % with each of ``max_ev`` tries."""
    if max_ev == 0:
        return float(radius), float(y), float(x)
    low, high = rad_range or (-radius, radius)
    n = max(8, int(2 * np.pi * radius / 0.25))
    phi = np.linspace(-np.pi, np.pi, n, endpoint=False)
    for _ in range(max_ev):
        off = np.arange(low, high + 1)
        r = radius + off[None]
        place = _edge(_sample(image.astype(float), y + r * np.sin(phi)[:, None], x + r * np.cos(phi)[:, None]), threshold, max_dev, bright_left, bright_left_factor, min_percentile)
        ok = np.isfinite(place)
        if ok.mean() >= min_points_frac and ok.sum() >= 3:
            at = radius + low + place[ok]
            fr, fy, fx = fit_circle(y + at * np.sin(phi[ok]), x + at * np.cos(phi[ok]))
            if np.isfinite([fr, fy, fx]).all() and low < fr - radius < high and abs(fr - radius) <= max_r_dev * radius:
                return fr, fy, fx
        low, high = low * 1.03, high * 1.03
    return None


def locate_brightfield_ring(raw: np.ndarray, diameter: float, separation: float | None = None, previous: pd.DataFrame | None = None, **kw) -> pd.DataFrame:
    """Rings of a frame: y, x, r. Seeds are ``previous`` coordinates, whose other columns are kept, or bright features."""
    image = convert_to_int(np.squeeze(raw), raw.dtype if np.issubdtype(raw.dtype, np.integer) else np.uint8)[1]
    sep = diameter if separation is None else separation
    if previous is not None and len(previous):
        seeds = previous.reset_index(drop=True)
    else:
        odd = int(diameter) | 1
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            seeds = locate(raw, odd, separation=sep, characterize=False)
        seeds = seeds[["y", "x"]] if len(seeds) else pd.DataFrame({"y": [], "x": []})
    rows = []
    for s in seeds.to_dict("records"):
        got = refine_ring(image, diameter / 2, s["y"], s["x"], **kw)
        if got is not None:
            rows.append({**s, "r": got[0], "y": got[1], "x": got[2]})
        elif "particle" in s:
            warnings.warn(f"particle {int(s['particle'])} was lost")
    out = pd.DataFrame(rows, columns=[*seeds.columns, *(["r"] if "r" not in seeds else [])])
    return out.drop(index=where_close(out[["y", "x"]].to_numpy(dtype=float), sep)).reset_index(drop=True) if len(out) and sep > 0 else out


def brightfield_batch(frames: DataFrame, diameter: float, keys=("frame",), **kw) -> DataFrame:
    """``locate_brightfield_ring`` on every packed frame."""
    keys = list(keys)
    kinds = dict(frames.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y double", "x double", "r double"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                f = locate_brightfield_ring(unpack_frame(row.shape, row.dtype, row.data), diameter, **kw)
                if len(f):
                    yield pd.DataFrame({k: [getattr(row, k)] * len(f) for k in keys} | {c: f[c].astype(float) for c in ("y", "x", "r")})

    return frames.select(*keys, "shape", "dtype", "data").mapInPandas(run, schema)
