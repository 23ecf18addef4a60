"""Small arrays around a feature's centre."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _grid(radius: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates from the centre, inside the ellipse)."""
    c = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in radius], indexing="ij"))
    scaled = sum((c[i] / r) ** 2 if r else np.zeros(c[i].shape) for i, r in enumerate(radius))
    return c, scaled <= 1


def _as_tuple(radius, ndim: int) -> tuple[int, ...]:
    return tuple(int(r) for r in radius) if hasattr(radius, "__iter__") else (int(radius),) * ndim


@lru_cache(256)
def _binary(radius: tuple[int, ...]) -> np.ndarray:
    return _grid(radius)[1]


def binary_mask(radius, ndim: int) -> np.ndarray:
    """True inside the ellipse, its border included."""
    return _binary(_as_tuple(radius, ndim))


def n_binary_mask(radius, ndim: int) -> int:
    return int(binary_mask(radius, ndim).sum())


def x_squared_masks(radius, ndim: int) -> np.ndarray:
    """One array for each axis: squared distance along it, 0 outside."""
    c, inside = _grid(_as_tuple(radius, ndim))
    return np.where(inside, c**2, 0)


def r_squared_mask(radius, ndim: int) -> np.ndarray:
    return x_squared_masks(radius, ndim).sum(axis=0)


def theta_mask(radius) -> np.ndarray:
    """Angle of each pixel seen from the centre, y down."""
    y, x = _grid(_as_tuple(radius, 2))[0]
    return np.arctan2(y, x)


def sinmask(radius) -> np.ndarray:
    return np.sin(2 * theta_mask(radius))


def cosmask(radius) -> np.ndarray:
    return np.cos(2 * theta_mask(radius))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Normalized Gaussian, cut at ``truncate`` sigma."""
    half = int(truncate * sigma + 0.5)
    g = np.exp(-(np.arange(-half, half + 1) ** 2) / (2.0 * sigma**2))
    return g / g.sum()


def get_slice(coords: np.ndarray, shape, radius) -> tuple[tuple[slice, ...], np.ndarray]:
    """(slices, origin) of the least box of the image that holds all masks around ``coords``."""
    rad = np.asarray(_as_tuple(radius, len(shape)))
    at = np.round(np.atleast_2d(coords)).astype(int)
    lo = np.clip(at.min(axis=0) - rad, 0, shape)
    hi = np.clip(at.max(axis=0) + rad + 1, lo, shape)
    return tuple(slice(a, b) for a, b in zip(lo, hi)), lo


def slice_image(coords: np.ndarray, image: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
    s, origin = get_slice(coords, image.shape, radius)
    return image[s], origin


def get_mask(coords: np.ndarray, shape, radius, include_edge: bool = True) -> np.ndarray:
    """Union of the ellipses around ``coords`` in an array of ``shape``."""
    rad = np.asarray(_as_tuple(radius, len(shape)), dtype=float)
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"))
    out = np.zeros(shape, dtype=bool)
    for c in np.atleast_2d(coords):
        r2 = sum(((grid[i] - c[i]) / rad[i]) ** 2 for i in range(len(shape)))
        out |= (r2 <= 1) if include_edge else (r2 < 1)
    return out


def mask_image(coords: np.ndarray, image: np.ndarray, radius, origin=None, invert: bool = False, include_edge: bool | None = None) -> np.ndarray:
    """The image with 0 outside (inside if ``invert``) the ellipses around ``coords``; the edge goes with the kept part."""
    edge = (not invert) if include_edge is None else include_edge
    at = np.atleast_2d(coords) - (0 if origin is None else np.asarray(origin))
    m = get_mask(at, image.shape, radius, edge)
    return np.where(~m if invert else m, image, 0).astype(image.dtype)
