"""Static error of located positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motespark.functions.masks import n_binary_mask, x_squared_masks


def static_error(features: DataFrame, noise: DataFrame | float, diameter: int | Sequence[int], noise_size: float | Sequence[float] = 1.0, on: Sequence[str] = ("frame",), ndim: int = 2) -> DataFrame:
    """``features`` with ``ep``: noise / mass * noise_size * root of the mask's sum of x².

    The mass is ``mass`` if ``noise`` is a number or a table (``on``, ``noise``); with a ``background`` column in the
    table it is ``raw_mass`` less the mask's pixels of background. Anisotropic diameters (y, x order) give ``ep_y``,
    ``ep_x``. A negative error, a mass of 0, missing noise or mass give NULL.
    """
    dia = list(diameter) if hasattr(diameter, "__iter__") else [diameter] * ndim
    size = list(noise_size) if hasattr(noise_size, "__iter__") else [noise_size] * len(dia)
    radius = tuple(int(d) // 2 for d in dia)
    roots = [math.sqrt(m.sum()) for m in x_squared_masks(radius, len(radius))]
    if isinstance(noise, DataFrame):
        cols = [c for c in ("background", "noise") if c in noise.columns]
        j = features.join(noise.select(*on, *[F.when(~F.isnan(c), F.col(c)).alias(f"_{c}") for c in cols]), list(on), "left")
        mass = F.col("raw_mass") - n_binary_mask(radius, len(radius)) * F.col("_background") if "background" in cols else F.col("mass")
        sigma = F.col("_noise")
    else:
        j, mass, sigma = features, F.col("mass"), F.lit(float(noise))
    ns = sigma / F.when((mass != 0) & ~F.isnan(mass), mass)
    err = lambda i: F.when(ns >= 0, ns * F.lit(float(size[i]) * roots[i]))
    same = len(set(radius)) == 1 and len(set(size)) == 1
    names = ["ep"] if same else [f"ep_{c}" for c in (["z", "y", "x"][-len(dia):] if len(dia) < 4 else [f"x{i}" for i in range(len(dia))])]
    return j.select(*features.columns, *[err(i).alias(n) for i, n in enumerate(names)])
