"""Finding features in frames: NumPy bodies that run inside Arrow batches of packed frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from motespark.common import write_text
from motespark.functions import imageproc as ip
from motespark.functions.masks import binary_mask, cosmask, n_binary_mask, r_squared_mask, sinmask, x_squared_masks
from motespark.functions.scalar import validate_tuple
from motespark.operators.filtering import guess_pos_columns  # noqa: F401  (part of this module's interface)

AXES = ("z", "y", "x")


def _patches(image: np.ndarray, at: np.ndarray, radius: tuple[int, ...]) -> np.ndarray:
    """The box of each centre, one row a feature: shape (N, *box)."""
    offsets = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in radius], indexing="ij"))
    index = at.T.reshape(len(radius), -1, *[1] * len(radius)) + offsets[:, None]
    return image[tuple(index)]


def _measures(patch: np.ndarray, radius: tuple[int, ...], mass: np.ndarray) -> dict[str, np.ndarray]:
    """Size, eccentricity and signal of masked neighbourhoods."""
    ndim = len(radius)
    flat = patch.reshape(len(patch), int(np.prod(patch.shape[1:])))
    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        if len(set(radius)) == 1:
            out["size"] = np.sqrt(flat @ r_squared_mask(radius, ndim).ravel() / mass)
        else:
            for name, m in zip(AXES[-ndim:], x_squared_masks(radius, ndim)):
                out[f"size_{name}"] = np.sqrt(ndim * (flat @ m.ravel()) / mass)
        if ndim == 2:
            centre = flat[:, flat.shape[1] // 2]
            out["ecc"] = np.hypot(flat @ cosmask(radius).ravel(), flat @ sinmask(radius).ravel()) / (mass - centre + 1e-6)
        else:
            out["ecc"] = np.full(len(flat), np.nan)
    out["signal"] = flat.max(axis=1) if len(flat) else np.zeros(0)
    return out


def refine_com(raw: np.ndarray, image: np.ndarray, radius, coords: np.ndarray, max_iterations: int = 10, shift_thresh: float = 0.6, characterize: bool = True) -> pd.DataFrame:
    """Centres of mass of all features at once: a mask moves a pixel towards its centroid until that is near its middle.

    The mask never leaves the image. A dark neighbourhood keeps its middle.
    """
    ndim = image.ndim
    radius = tuple(int(r) for r in validate_tuple(radius, ndim))
    names = list(AXES[-ndim:])
    if not len(coords):
        return pd.DataFrame(columns=[*names, "mass"])
    mask = binary_mask(radius, ndim)
    grid = np.stack(np.meshgrid(*[np.arange(-r, r + 1.0) for r in radius], indexing="ij")).reshape(ndim, -1)
    rad, top = np.asarray(radius), np.asarray(image.shape) - 1 - np.asarray(radius)
    at = np.clip(np.asarray(coords, dtype=int), rad, top)
    used, centre = at.copy(), at.astype(float)
    moving = np.arange(len(at))
    for _ in range(max_iterations):
        p = (_patches(image, at[moving], radius) * mask).reshape(len(moving), -1).astype(float)
        total = p.sum(axis=1)
        off = np.where(total[:, None] > 0, (p @ grid.T) / np.where(total > 0, total, 1)[:, None], 0.0)
        centre[moving], used[moving] = at[moving] + off, at[moving]
        go = (np.abs(off) >= shift_thresh).any(axis=1)
        moving, off = moving[go], off[go]
        if not len(moving):
            break
        at[moving] = np.clip(at[moving] + (off > shift_thresh) - (off < -shift_thresh), rad, top)
    patch = _patches(image, used, radius) * mask
    mass = patch.sum(axis=tuple(range(1, ndim + 1))).astype(float)
    out = {n: centre[:, i] for i, n in enumerate(names)} | {"mass": mass}
    if characterize:
        out |= _measures(patch.astype(float), radius, mass)
        out["raw_mass"] = (_patches(raw, used, radius) * mask).reshape(len(patch), -1).sum(axis=1).astype(float)
    return pd.DataFrame(out)


def characterize(coords: np.ndarray, image: np.ndarray, radius, scale_factor: float = 1.0) -> dict[str, np.ndarray]:
    """mass, signal, ecc and size at rounded coordinates; NaN where the mask leaves the image."""
    ndim = image.ndim
    radius = tuple(int(r) for r in validate_tuple(radius, ndim))
    at = np.round(coords).astype(int)
    ok = ((at >= radius) & (at + radius < image.shape)).all(axis=1)
    patch = (_patches(image, at[ok], radius) * binary_mask(radius, ndim)).astype(float)
    mass = patch.sum(axis=tuple(range(1, ndim + 1))) / scale_factor
    found = _measures(patch, radius, mass) | {"mass": mass}
    found["signal"] = found["signal"] / scale_factor
    out = {k: np.full(len(at), np.nan) for k in found}
    for k, v in found.items():
        out[k][ok] = v
    return out


def estimate_mass(image: np.ndarray, radius, coord) -> float:
    return float(characterize(np.atleast_2d(coord), image, radius)["mass"][0])


def estimate_size(image: np.ndarray, radius, coord, mass: float | None = None) -> float:
    return float(characterize(np.atleast_2d(coord), image, radius)["size"][0])


def locate(
    raw: np.ndarray, diameter, minmass: float = 0, maxsize: float | None = None, separation=None, noise_size=1, smoothing_size=None, threshold: float | None = None, invert: bool = False,
    percentile: float = 64, topn: int | None = None, preprocess: bool = True, max_iterations: int = 10, characterize: bool = True, frame_no: int | None = None,
) -> pd.DataFrame:
    """Bright features of an image: positions, mass, size, ecc, signal, raw_mass and the static error ``ep``.

    Band-passed and brought to integers, the image's local maxima are refined to their centres of mass; of features
    closer than ``separation`` the lighter goes; mass > minmass and size < maxsize decide, then the ``topn`` of largest
    mass. ``diameter`` must be odd.
    """
    raw = np.squeeze(raw)
    ndim = raw.ndim
    dia = tuple(int(d) for d in validate_tuple(diameter, ndim))
    if any(d % 2 == 0 for d in dia):
        raise ValueError("the diameter must be odd")
    radius = tuple(d // 2 for d in dia)
    same = len(set(radius)) == 1
    if not same and maxsize is not None:
        raise ValueError("maxsize needs one diameter for all axes")
    sep = tuple(d + 1 for d in dia) if separation is None else validate_tuple(separation, ndim)
    smooth = dia if smoothing_size is None else validate_tuple(smoothing_size, ndim)
    noise = validate_tuple(noise_size, ndim)
    is_int = np.issubdtype(raw.dtype, np.integer)
    if threshold is None:
        threshold = 1 if is_int else 1 / 255
    if invert:
        raw = ip.invert_image(raw)
    image = ip.bandpass(raw, noise, smooth, threshold) if preprocess else raw
    factor, image = ip.convert_to_int(image, raw.dtype if is_int else np.uint8)
    margin = tuple(max(r, int(s) // 2 - 1, int(m) // 2) for r, s, m in zip(radius, sep, smooth))
    found = refine_com(raw, image, radius, ip.grey_dilation(image, sep, percentile, margin, precise=False), max_iterations, characterize=characterize)
    names = list(AXES[-ndim:])
    if len(found) and all(s > 0 for s in sep):
        found = found.drop(index=ip.where_close(found[names].to_numpy(), sep, found["mass"])).reset_index(drop=True)
    found["mass"] = found["mass"].astype(float) / factor
    if "signal" in found:
        found["signal"] = found["signal"] / factor
    keep = found["mass"] > minmass
    if maxsize is not None:
        keep &= found["size"] < maxsize
    found = found[keep].reset_index(drop=True)
    if topn is not None and len(found) > topn:
        found = found.iloc[np.argsort(found["mass"].to_numpy(), kind="stable")[-topn:]].reset_index(drop=True)
    if characterize and len(found):
        black, sigma = ip.measure_noise(image, raw, radius)
        mass = found["raw_mass"].to_numpy() - n_binary_mask(radius, ndim) * black
        roots = [np.sqrt(m.sum()) for m in x_squared_masks(radius, ndim)]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = sigma / mass
        ratio[~(ratio >= 0)] = np.nan
        if same and len(set(noise)) == 1:
            found["ep"] = ratio * noise[0] * roots[0]
        else:
            for n, s, r in zip(names, noise, roots):
                found[f"ep_{n}"] = ratio * s * r
    if frame_no is not None:
        found["frame"] = frame_no
    return found


def pack_frame(image: np.ndarray) -> tuple[list[int], str, bytes]:
    """(shape, dtype, data) of a frame, as the packed frames' columns."""
    return list(image.shape), str(image.dtype), np.ascontiguousarray(image).tobytes()


def unpack_frame(shape, dtype: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=dtype).reshape(tuple(int(s) for s in shape))


FEATURES_2D = ("y", "x", "mass", "size", "ecc", "signal", "raw_mass", "ep")


def batch(frames: DataFrame, diameter, keys: tuple[str, ...] = ("frame",), columns: tuple[str, ...] = FEATURES_2D, after_locate: Callable | None = None, meta: str | None = None, **options) -> DataFrame:
    """``locate`` on every packed frame (columns ``keys``, ``shape``, ``dtype``, ``data``): one feature a row.

    Frames are read, filtered and searched within one task each, without a shuffle. ``after_locate(frame, features)``
    may change a frame's features. ``meta`` names a file, in any file system that Spark knows, to which the parameters are written. Frames that are NULL or
    hold nothing give no rows.
    """
    if meta:
        write_text(frames.sparkSession, meta, json.dumps({"diameter": diameter, **{k: str(v) for k, v in options.items()}}, indent=1))
    keys = list(keys)
    kinds = dict(frames.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{c}` double" for c in columns]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                if row.data is None:
                    continue
                import warnings

                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    f = locate(unpack_frame(row.shape, row.dtype, row.data), diameter, **options)
                if after_locate is not None:
                    f = after_locate(getattr(row, keys[-1]), f)
                if len(f):
                    out = {k: [getattr(row, k)] * len(f) for k in keys} | {c: f[c] if c in f else np.nan for c in columns}
                    yield pd.DataFrame(out)

    return frames.select(*keys, "shape", "dtype", "data").mapInPandas(run, schema)


def minmass_v03_change(raw: np.ndarray, old: float, radius, smoothing_size=None, noise_size=1, threshold=None) -> float:
    """The minimum mass now that stands for one measured on an image normalized to 0..255 before."""
    dia = tuple(2 * int(r) + 1 for r in validate_tuple(radius, raw.ndim))
    image = ip.bandpass(raw, noise_size, dia if smoothing_size is None else smoothing_size, threshold)
    return old / (255.0 / image.max()) if image.max() > 0 else old


def minmass_v04_change(old: float, diameter, ndim: int = 2, smoothing_size=None, old_smoothing=None) -> float:
    """The minimum mass for a square background box that stands for one with a round box."""
    dia = validate_tuple(diameter, ndim)
    smooth = dia if smoothing_size is None else validate_tuple(smoothing_size, ndim)
    before = dia if old_smoothing is None else validate_tuple(old_smoothing, ndim)
    n_feature = n_binary_mask(tuple(int(d) // 2 for d in dia), ndim)
    n_old = n_binary_mask(tuple(int(s) for s in before), ndim)
    return old / (1 - n_feature / n_old) * (1 - n_feature / float(np.prod(smooth)))
