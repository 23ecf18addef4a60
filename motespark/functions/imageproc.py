"""Image filters on NumPy arrays of any dimension."""

from __future__ import annotations

import warnings

import numpy as np

from motespark.functions.masks import binary_mask, gaussian_kernel
from motespark.functions.scalar import validate_tuple
from motespark.operators.assignment import neighbours


def _windows(image: np.ndarray, before: int, after: int, axis: int, mode: str) -> np.ndarray:
    """View of each entry's window along the axis, the window as last dimension."""
    pad = [(0, 0)] * image.ndim
    pad[axis] = (before, after)
    wide = np.pad(image, pad, mode="edge") if mode == "edge" else np.pad(image, pad, mode="constant")
    return np.lib.stride_tricks.sliding_window_view(wide, before + after + 1, axis=axis)


def lowpass(image: np.ndarray, sigma=1, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing, zero beyond the border; an axis of sigma 0 is left out."""
    out = np.asarray(image, dtype=float)
    for axis, s in enumerate(validate_tuple(sigma, image.ndim)):
        if s > 0:
            k = gaussian_kernel(s, truncate)
            out = _windows(out, len(k) // 2, len(k) // 2, axis, "zero") @ k
    return out


def boxcar(image: np.ndarray, size) -> np.ndarray:
    """Mean over a box of odd size, the border repeated. An integer image is cut to integers after each axis."""
    sizes = validate_tuple(size, image.ndim)
    if any(s % 2 == 0 for s in sizes):
        raise ValueError("the smoothing size must be odd")
    out = np.asarray(image)
    for axis, s in enumerate(sizes):
        if s > 1:
            s = int(s)
            total = _windows(out, s // 2, s // 2, axis, "edge").sum(axis=-1, dtype=float) / s
            out = total.astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else total
    return out


def bandpass(image: np.ndarray, lshort, llong, threshold: float | None = None, truncate: float = 4.0) -> np.ndarray:
    """lowpass less boxcar, values below the threshold set to 0 (default 1 for integers, 1/255 for floats)."""
    short, long = validate_tuple(lshort, image.ndim), validate_tuple(llong, image.ndim)
    if any(a >= b for a, b in zip(short, long)):
        raise ValueError("the smoothing length must be larger than the noise length")
    if threshold is None:
        threshold = 1 if np.issubdtype(image.dtype, np.integer) else 1 / 255
    out = lowpass(image, short, truncate) - boxcar(image, long)
    return np.where(out >= threshold, out, 0)


def legacy_bandpass(image: np.ndarray, lshort, llong, threshold: float | None = None) -> np.ndarray:
    """As ``bandpass``, with a Gaussian in Fourier space, a box of 2 * llong + 1 and a strict threshold (1/256 for floats)."""
    short, long = validate_tuple(lshort, image.ndim), validate_tuple(llong, image.ndim)
    if any(2 * a >= b for a, b in zip(short, long)):
        raise ValueError("the smoothing length must be more than twice the noise length")
    if threshold is None:
        threshold = 1 if np.issubdtype(image.dtype, np.integer) else 1 / 256
    background = boxcar(image, tuple(2 * int(s) + 1 for s in long))
    spectrum = np.fft.fftn(image)
    for axis, s in enumerate(short):
        shape = [1] * image.ndim
        shape[axis] = -1
        spectrum = spectrum * np.exp(-2 * (np.pi * s * np.fft.fftfreq(image.shape[axis])) ** 2).reshape(shape)
    out = np.fft.ifftn(spectrum).real - background
    return np.where(out > threshold, out, 0)


legacy_bandpass_fftw = legacy_bandpass


def invert_image(image: np.ndarray, max_value: float | None = None) -> np.ndarray:
    """Integers: every bit below the maximum flipped; floats: maximum (1) less value."""
    if np.issubdtype(image.dtype, np.integer):
        return image ^ np.array(np.iinfo(image.dtype).max if max_value is None else max_value, dtype=image.dtype)
    return (1.0 if max_value is None else max_value) - image


def convert_to_int(image: np.ndarray, dtype=np.uint8) -> tuple[float, np.ndarray]:
    """(factor, integer image): floats are scaled to the type's maximum, negatives cut, decimals dropped."""
    if np.issubdtype(image.dtype, np.integer):
        return 1.0, image
    peak = image.max() if image.size else 0
    factor = 1.0 if peak == 0 else np.iinfo(dtype).max / peak
    return factor, (np.maximum(image, 0) * factor).astype(dtype)


def scalefactor_to_gamut(image: np.ndarray, dtype) -> float:
    return np.iinfo(dtype).max / image.max()


def scale_to_gamut(image: np.ndarray, dtype, factor: float | None = None) -> np.ndarray:
    f = scalefactor_to_gamut(image, dtype) if factor is None else factor
    return (np.maximum(image, 0) * f).astype(dtype)


def percentile_threshold(image: np.ndarray, percentile: float) -> float:
    """Percentile of the pixels that aren't 0; NaN if there are none."""
    lit = image[image != 0]
    return float(np.percentile(lit, percentile)) if lit.size else float("nan")


def dilate(image: np.ndarray, size) -> np.ndarray:
    """Maximum over a box around each pixel (one more to the far side for even sizes), 0 beyond the border."""
    out = image
    for axis, s in enumerate(size):
        if s > 1:
            out = _windows(out, (s - 1) // 2, s // 2, axis, "zero").max(axis=-1)
    return out


def where_close(pos: np.ndarray, separation, intensity=None) -> np.ndarray:
    """Rows to drop: of each pair closer than ``separation`` the dimmer, of equals the one of smaller coordinate sum."""
    if not len(pos):
        return np.zeros(0, dtype=int)
    sep = np.asarray(validate_tuple(separation, pos.shape[1]), dtype=float)
    if (sep == 0).any():
        return np.zeros(0, dtype=int)
    p = np.asarray(pos, dtype=float) / sep
    s, t, d = neighbours(p, p, 1.0, most=None)
    ok = (s < t) & (d <= 1 - 1e-7)
    a, b = s[ok], t[ok]
    total = p.sum(axis=1)
    drop_b = total[a] > total[b]
    if intensity is not None:
        glow = np.asarray(intensity, dtype=float)
        drop_b = np.where(glow[a] == glow[b], drop_b, glow[a] > glow[b])
    return np.unique(np.where(drop_b, b, a))


def drop_close(pos: np.ndarray, separation, intensity=None) -> np.ndarray:
    return np.delete(pos, where_close(pos, separation, intensity), axis=0)


def grey_dilation(image: np.ndarray, separation, percentile: float = 64, margin=None, precise: bool = True, elliptic: bool = False) -> np.ndarray:
    """Pixels that are the maximum of the box around them and above the percentile of all lit pixels.

    Peaks nearer to the border than ``margin`` (half the separation) are left out; ``precise`` also drops the dimmer of
    two peaks closer than ``separation``. ``elliptic`` uses the ellipse of that separation in place of the box.
    """
    image = convert_to_int(image)[1]
    ndim = image.ndim
    sep = validate_tuple(separation, ndim)
    edge = np.asarray([int(s) if elliptic else int(s / 2) for s in sep] if margin is None else validate_tuple(margin, ndim))
    none = np.empty((0, ndim), dtype=int)
    level = percentile_threshold(image, percentile)
    if np.isnan(level):
        warnings.warn("the image is black")
        return none
    if elliptic:
        mask = binary_mask(tuple(int(s) for s in sep), ndim)
        wide = np.pad(image, [(n // 2, n // 2) for n in mask.shape])
        top = np.zeros_like(image)
        for at in np.argwhere(mask):
            np.maximum(top, wide[tuple(slice(a, a + n) for a, n in zip(at, image.shape))], out=top)
    else:
        top = dilate(image, [int(2 * s / np.sqrt(ndim)) for s in sep])
    pos = np.argwhere((image == top) & (image > level))
    if not len(pos):
        warnings.warn("the image has no local maxima")
        return none
    inside = ((pos >= edge) & (pos <= np.asarray(image.shape) - edge - 1)).all(axis=1)
    pos = pos[inside]
    if not len(pos):
        warnings.warn("all local maxima lie in the margins")
        return none
    return drop_close(pos, sep, image[tuple(pos.T)]) if precise else pos


def grey_dilation_legacy(image: np.ndarray, separation, percentile: float = 64, margin=None) -> np.ndarray:
    return grey_dilation(image, separation, percentile, margin, False, True)


def local_maxima(image: np.ndarray, radius, percentile: float = 64, margin=None) -> np.ndarray:
    """Maxima within an ellipse of ``radius``, the least distance between two of them, at least ``margin`` (the radius) from the border."""
    return grey_dilation_legacy(image, radius, percentile, margin)


def measure_noise(image_bp: np.ndarray, image_raw: np.ndarray, radius) -> tuple[float, float]:
    """Mean and standard deviation of the raw pixels away from everything lit in the filtered image."""
    mask = binary_mask(radius, image_bp.ndim)
    lit = np.pad(image_bp != 0, [(n // 2, n // 2) for n in mask.shape])
    near = np.zeros(image_bp.shape, dtype=bool)
    for at in np.argwhere(mask):
        near |= lit[tuple(slice(a, a + n) for a, n in zip(at, image_bp.shape))]
    dark = image_raw[~near]
    if not dark.size:
        return float("nan"), float("nan")
    return float(dark.mean()), float(dark.std()) if dark.size > 1 else float("nan")
