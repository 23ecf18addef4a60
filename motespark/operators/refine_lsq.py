"""Least-squares refinement: model images fitted to overlapping features, cluster by cluster.

Levenberg-Marquardt steps with projected bounds; equality constraints by an augmented Lagrangian.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from motespark.functions.scalar import validate_tuple
from motespark.operators.assignment import neighbours, subnets
from motespark.operators.locate import unpack_frame


class RefineError(Exception):
    """The fit did not reach an acceptable result."""


def _gauss(r2, p, ndim):
    return np.exp(np.maximum(-ndim / 2 * r2, -700))


def _disc(r2, p, ndim):
    if p[0] <= 0:
        return _gauss(r2, p, ndim)
    d = min(p[0], 0.999)
    return np.exp(np.maximum(-ndim / 2 * (np.maximum(np.sqrt(r2) - d, 0) / (1 - d)) ** 2, -700))


def _ring(r2, p, ndim):
    return np.exp(np.maximum(-ndim / 2 * ((np.sqrt(r2) - 1 + p[0]) / p[0]) ** 2, -700))


def inv_series(order: int) -> dict:
    """signal_mult / (1 + a r² + b r⁴ + ...)."""
    names = ["signal_mult", *[f"param_{chr(97 + i)}" for i in range(order)]]
    return {"params": names, "fun": lambda r2, p, ndim: p[0] / (1 + sum(c * r2 ** (i + 1) for i, c in enumerate(p[1:]))), "default": {names[0]: 1.0, **{n: 1.0 for n in names[1:]}}}


MODELS = {
    "gauss": {"params": [], "fun": _gauss},
    "disc": {"params": ["disc_size"], "fun": _disc, "default": {"disc_size": 0.5}},
    "ring": {"params": ["thickness"], "fun": _ring, "default": {"thickness": 0.2}, "continuous": False},
}


def dimer(dist, ndim: int = 2) -> dict:
    """Two features at a fixed distance."""
    return _all_pairs(2, dist, ndim)


def trimer(dist, ndim: int = 2) -> dict:
    """Three features at one distance from each other."""
    return _all_pairs(3, dist, ndim)


def tetramer(dist, ndim: int = 2) -> dict:
    """Four features: a square in two dimensions, a tetrahedron in three."""
    return _all_pairs(4, dist, ndim)


def _all_pairs(n: int, dist, ndim: int) -> dict:
    d = np.asarray(validate_tuple(dist, ndim), dtype=float)
    i, j = np.triu_indices(n, 1)

    def fun(pos: np.ndarray) -> np.ndarray:
        gap = (((pos[i] - pos[j]) / d) ** 2).sum(axis=1)
        return 1 - (np.sort(gap)[:4] if n == 4 and ndim == 2 else gap)  # a square's sides

    return {"cluster_size": n, "fun": fun}


def dimer_global(dists: np.ndarray) -> np.ndarray:
    """Differences of consecutive squared distances: zero where all pairs are equally long."""
    return np.diff(np.asarray(dists, dtype=float) ** 2)


def clusters_of(pos: np.ndarray, separation) -> np.ndarray:
    """Cluster number of each position: single linkage at scaled distance 1."""
    n = len(pos)
    if n < 2:
        return np.arange(n)
    p = pos / np.asarray(validate_tuple(separation, pos.shape[1]), dtype=float)
    s, t, _ = neighbours(p, p, 1.0, most=1 << 62)
    label = np.arange(n)
    own = subnets(n, n, np.r_[s, np.arange(n)], np.r_[t, np.arange(n)])
    label[np.r_[s, np.arange(n)]] = own
    return np.unique(label, return_inverse=True)[1]


class Model:
    """Parameters of one cluster: background, signal, positions, sizes and shape, each const, var or cluster-wide."""

    def __init__(self, fit_function: str | dict, ndim: int, isotropic: bool, modes: dict | None = None):
        spec = MODELS[fit_function] if isinstance(fit_function, str) and fit_function in MODELS else inv_series(int(fit_function.split("_")[-1])) if isinstance(fit_function, str) and fit_function.startswith("inv_series") else fit_function
        if not isinstance(spec, dict):
            raise ValueError(f"unknown fit function {fit_function!r}")
        self.fun, self.extra, self.default = spec["fun"], list(spec.get("params", [])), spec.get("default", {})
        self.hole = not spec.get("continuous", True)
        self.ndim = ndim
        self.pos = ["z", "y", "x"][-ndim:]
        self.size = ["size"] if isotropic else [f"size_{a}" for a in self.pos]
        self.names = ["background", "signal", *self.pos, *self.size, *self.extra]
        self.mode = {n: "const" for n in self.names} | {"background": "cluster", "signal": "var"} | {p: "var" for p in self.pos} | (modes or {})
        unknown = set(self.mode) - set(self.names)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        other = sorted(n for n, v in self.mode.items() if v not in ("const", "var", "cluster"))
        if other:  # sharing over all clusters isn't built
            raise ValueError(f"modes of {other}: const, var or cluster")

    def pack(self, table: np.ndarray) -> np.ndarray:
        out = []
        for k, n in enumerate(self.names):
            if self.mode[n] == "var":
                out.append(table[:, k])
            elif self.mode[n] == "cluster":
                out.append([table[:, k].mean()])
        return np.concatenate(out) if out else np.zeros(0)

    def unpack(self, vector: np.ndarray, table: np.ndarray) -> np.ndarray:
        out, at, n = table.copy(), 0, len(table)
        for k, name in enumerate(self.names):
            if self.mode[name] == "var":
                out[:, k] = vector[at : at + n]
                at += n
            elif self.mode[name] == "cluster":
                out[:, k] = vector[at]
                at += 1
        return out

    def bounds(self, table: np.ndarray, reach: Sequence[float], given: dict | None) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full(table.shape, -np.inf), np.full(table.shape, np.inf)
        for k, n in enumerate(self.names):
            if n in ("background", "signal", *self.size):
                lo[:, k] = 1e-7
            if n in self.pos:
                r = reach[self.pos.index(n)]
                lo[:, k], hi[:, k] = table[:, k] - r, table[:, k] + r
            for key, kind in ((n, "abs"), (f"{n}_abs", "diff"), (f"{n}_rel", "rel")):
                if given and key in given:
                    a, b = given[key]
                    v = table[:, k]
                    low = {"abs": a, "diff": v - a, "rel": v / a if a else -np.inf}[kind]
                    high = {"abs": b, "diff": v + b, "rel": v * b}[kind]
                    lo[:, k], hi[:, k] = np.maximum(lo[:, k], low), np.minimum(hi[:, k], high)
        return self.pack(lo), self.pack(hi)

    def image(self, table: np.ndarray, mesh: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Model value of each pixel; ``near`` (features x pixels) says which pixels a feature covers."""
        out = np.full(mesh.shape[1], table[0, 0])
        p0, s0 = 2, 2 + self.ndim
        for row, ok in zip(table, near):
            size = np.resize(row[s0 : s0 + len(self.size)], self.ndim)
            d = mesh[:, ok] - row[p0:s0, None]
            r2 = ((d / size[:, None]) ** 2).sum(axis=0)
            v = row[1] * self.fun(r2, row[s0 + len(self.size):], self.ndim)
            if self.hole:
                v = np.where((d**2).sum(axis=0) < 1, 0, v)
            out[ok] += v
        return out


def minimize(residual: Callable, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, constraint: Callable | None = None, iterations: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """(best parameters, sum of squares) of bounded, perhaps equality-constrained, least squares."""
    mult, weight = (np.zeros(len(constraint(x))), 10.0) if constraint else (None, 0.0)

    def full(v):
        r = residual(v)
        if constraint is None:
            return r
        return np.concatenate([r, np.sqrt(weight) * (constraint(v) + mult / weight)])

    def jac(v, r):
        out = np.empty((len(r), len(v)))
        for k in range(len(v)):
            h = 1e-6 * max(1.0, abs(v[k]))
            w = v.copy()
            w[k] += h if v[k] + h <= hi[k] else -h
            out[:, k] = (full(w) - r) / (w[k] - v[k])
        return out

    x = np.clip(x, lo, hi)
    for _ in range(8 if constraint else 1):
        r = full(x)
        cost, damp = float(r @ r), 1e-3
        for _ in range(iterations):
            j = jac(x, r)
            g, a = j.T @ r, j.T @ j
            stuck = ((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0))
            free = ~stuck
            if not free.any():
                break
            moved = False
            for _ in range(12):
                step = np.zeros(len(x))
                h = a[np.ix_(free, free)] + damp * np.diag(np.maximum(np.diag(a)[free], 1e-12))
                try:
                    step[free] = np.linalg.solve(h, -g[free])
                except np.linalg.LinAlgError:
                    damp *= 10
                    continue
                new = np.clip(x + step, lo, hi)
                rn = full(new)
                cn = float(rn @ rn)
                if np.isfinite(cn) and cn < cost:
                    moved, gain = True, cost - cn
                    x, r, cost, damp = new, rn, cn, max(damp / 5, 1e-12)
                    break
                damp *= 5
            if not moved or gain <= tol * cost:
                break
        if constraint is None:
            break
        c = constraint(x)
        if np.abs(c).max() < 1e-6:
            break
        mult = mult + weight * c
        weight *= 4
    r = residual(x)
    return x, float(r @ r)


def refine_leastsq(features: pd.DataFrame, image: np.ndarray, diameter, separation=None, fit_function: str | dict = "gauss", param_mode: dict | None = None, param_val: dict | None = None, bounds: dict | None = None, constraints: Sequence[dict] = (), max_iter: int = 10, max_shift: float = 1.0, max_rms_dev: float = 1.0, residual_factor: float = 100000.0, compute_error: bool = False) -> pd.DataFrame:
    """Features of one frame with fitted positions and parameters, ``cluster``, ``cluster_size`` and ``cost``.

    Features closer than ``separation`` (the diameter) are fitted together. ``cost`` is the root mean square residual
    relative to the image's maximum; where a fit fails or ``cost`` exceeds ``max_rms_dev``, the coordinates stay and
    ``cost`` is NaN. ``compute_error`` adds ``<p>_std`` from the curvature.
    """
    ndim = image.ndim
    dia = validate_tuple(diameter, ndim)
    reach = np.asarray([int(d) // 2 for d in dia], dtype=float)
    same = len(set(dia)) == 1 and "size" in features.columns or not any(f"size_{a}" in features for a in "zyx")
    m = Model(fit_function, ndim, same, param_mode)
    out = features.reset_index(drop=True).copy()
    val = {"background": 0.0, "signal": float(image.max()), **{s: float(d) / 4 for s, d in zip(m.size, dia)}, **m.default, **(param_val or {})}
    for n in m.names:
        if n not in out or (param_val and n in param_val):
            out[n] = val[n]
    out["cluster"] = clusters_of(out[m.pos].to_numpy(dtype=float), dia if separation is None else separation)
    out["cluster_size"] = out.groupby("cluster")["cluster"].transform("size")
    out["cost"] = np.nan
    peak = float(image.max()) or 1.0
    for _, rows in out.groupby("cluster").groups.items():
        table = out.loc[rows, m.names].to_numpy(dtype=float)
        try:
            fit, cost, std = _fit(m, table, image, reach, bounds, [c for c in constraints if c["cluster_size"] == len(rows)], max_iter, max_shift, peak)
            if not cost <= max_rms_dev:
                raise RefineError(f"deviation {cost}")
        except (RefineError, np.linalg.LinAlgError, FloatingPointError):
            continue
        out.loc[rows, m.names] = fit
        out.loc[rows, "cost"] = cost
        if compute_error:
            for k, n in enumerate(m.names):
                if m.mode[n] == "var":
                    out.loc[rows, f"{n}_std"] = std[:, k]
    return out


def _fit(m: Model, table, image, reach, bounds, constraints, max_iter, max_shift, peak):
    ndim, std = m.ndim, None
    for _ in range(max_iter):
        at = np.round(table[:, 2 : 2 + ndim])
        lo = np.maximum(at.min(axis=0) - reach, 0).astype(int)
        hi = np.minimum(at.max(axis=0) + reach + 1, image.shape).astype(int)
        if (hi <= lo).any():
            raise RefineError("outside of the image")
        mesh = np.stack(np.meshgrid(*[np.arange(a, b) for a, b in zip(lo, hi)], indexing="ij")).reshape(ndim, -1).astype(float)
        near = (((mesh[None] - at[:, :, None]) / reach[None, :, None]) ** 2).sum(axis=1) <= 1
        used = near.any(axis=0)
        mesh, near = mesh[:, used], near[:, used]
        pix = image[tuple(mesh.astype(int))].astype(float) / peak
        scaled = table.copy()
        scaled[:, :2] /= peak
        given = {k: (v[0] / peak, v[1] / peak) if k in ("background", "signal") else v for k, v in (bounds or {}).items()}
        low, high = m.bounds(scaled, reach, given)
        residual = lambda v: m.image(m.unpack(v, scaled), mesh, near) - pix  # noqa: B023, E731
        cons = (lambda v: np.concatenate([c["fun"](m.unpack(v, scaled)[:, 2 : 2 + ndim]) for c in constraints])) if constraints else None  # noqa: B023, E731
        x, ss = minimize(residual, m.pack(scaled), low, high, cons)
        fit = m.unpack(x, scaled)
        if not np.isfinite(fit).all():
            raise RefineError("no finite result")
        cost = float(np.sqrt(ss / max(len(pix), 1)))
        std = _errors(m, residual, x, fit, ss, len(pix))
        fit[:, :2] *= peak
        moved = np.abs(fit[:, 2 : 2 + ndim] - at).max()
        table = fit
        if moved < max_shift:
            break
    return table, cost, std


def _errors(m: Model, residual, x, fit, ss, n) -> np.ndarray:
    j = np.stack([(residual(x + h) - residual(x - h)) / (2 * e) for e, h in ((1e-5, 1e-5 * np.eye(len(x))[k]) for k in range(len(x)))], axis=1) if len(x) else np.zeros((n, 0))
    cov = np.linalg.pinv(j.T @ j) * ss / max(n - len(x), 1)
    return m.unpack(np.sqrt(np.maximum(np.diag(cov), 0)), np.full(fit.shape, np.nan))


def train_leastsq(features: pd.DataFrame, image: np.ndarray, diameter, fit_function: str | dict, param_mode: dict | None = None, **kw) -> dict:
    """Shape parameters that fit a frame's features best: the medians of fits in which they vary."""
    ndim = image.ndim
    m = Model(fit_function, ndim, len(set(validate_tuple(diameter, ndim))) == 1)
    free = {n: "var" for n in [*m.size, *m.extra]} | (param_mode or {})
    done = refine_leastsq(features, image, diameter, fit_function=fit_function, param_mode=free, **kw)
    return done.loc[done["cost"].notna(), [*m.size, *m.extra]].median().to_dict()


def refine_batch(features: DataFrame, frames: DataFrame, diameter, keys: Sequence[str] = ("frame",), columns: Sequence[str] = ("y", "x", "signal", "background", "size", "cost"), **kw) -> DataFrame:
    """``refine_leastsq`` frame by frame: features are cogrouped with their packed frames. Extra columns are dropped."""
    keys, columns = list(keys), list(columns)
    kinds = dict(features.dtypes)
    schema = T._parse_datatype_string(", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{c}` double" for c in columns], "cluster bigint", "cluster_size bigint"]))

    def run(f: pd.DataFrame, im: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(im):
            return pd.DataFrame({n: [] for n in schema.names})
        image = unpack_frame(im["shape"].iloc[0], im["dtype"].iloc[0], im["data"].iloc[0])
        start = f.dropna(subset=["y", "x"])
        return refine_leastsq(start, image, diameter, **kw).reindex(columns=schema.names)

    return features.groupBy(*keys).cogroup(frames.groupBy(*keys)).applyInPandas(run, schema)
