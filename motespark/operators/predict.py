"""Predictors: where the particles of the last frame are expected in the next one.

A predictor has ``predict(t, ids, pos, seen)``, the expected positions of particles last seen at times ``seen``, and
``observe(t, ids, pos)``, told of each linked frame. A plain function becomes one by ``predictor``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd

from motespark.operators.assignment import nearest


class NullPredict:
    """Nothing moves."""

    def observe(self, t: int, ids: np.ndarray, pos: np.ndarray) -> None:
        pass

    def predict(self, t: int, ids: np.ndarray, pos: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return pos


def predictor(func: Callable) -> type:
    """A predictor class of a function (t, id, position) -> position of one particle."""

    class OfFunction(NullPredict):
        def predict(self, t, ids, pos, seen):
            return np.array([func(t, i, p) for i, p in zip(ids, pos)]).reshape(pos.shape)

    return OfFunction


class RecentVelocity(NullPredict):
    """Base: velocities between the last frame and the one ``span`` observations before."""

    def __init__(self, span: int = 1, guess: np.ndarray | None = None, guess_pos: np.ndarray | None = None):
        self.seen: deque = deque(maxlen=span + 1)
        self.guess, self.guess_pos = guess, guess_pos

    def observe(self, t, ids, pos):
        if len(pos):
            self.seen.append((t, np.asarray(ids), np.asarray(pos)))

    def velocities(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, velocities) of the particles in both frames."""
        if not self.seen:
            return np.zeros((0, 1)), np.zeros((0, 1))
        t1, ids1, pos1 = self.seen[-1]
        t0, ids0, pos0 = self.seen[0]
        if t1 == t0:
            if self.guess is not None:
                g = np.atleast_2d(self.guess)
                return (np.atleast_2d(self.guess_pos) if self.guess_pos is not None else np.zeros_like(g)), g
            return pos1, np.zeros_like(pos1)
        _, i1, i0 = np.intersect1d(ids1, ids0, return_indices=True)
        return pos1[i1], (pos1[i1] - pos0[i0]) / (t1 - t0)


class NearestVelocityPredict(RecentVelocity):
    """Each particle moves as the nearest one of known velocity, since it was last seen."""

    def predict(self, t, ids, pos, seen):
        at, v = self.velocities()
        return pos + v[nearest(pos, at)] * (t - seen)[:, None] if len(v) else pos


class DriftPredict(RecentVelocity):
    """All particles move at the mean velocity, each since it was last seen."""

    def predict(self, t, ids, pos, seen):
        _, v = self.velocities()
        return pos + v.mean(axis=0) * (t - seen)[:, None] if len(v) else pos


class ChannelPredict(RecentVelocity):
    """Velocity along the flow depends on the place across it: means of bins of ``bin_size``, at least ``minsamples`` each.

    ``flow`` is the axis of the flow (0 for the first position column), two dimensions only. Bins of too few particles
    take the nearest valid bin's value.
    """

    def __init__(self, bin_size: float, flow: int = 1, minsamples: int = 20, span: int = 1, profile: tuple[np.ndarray, np.ndarray] | None = None):
        super().__init__(span)
        self.size, self.flow, self.least, self.profile = bin_size, flow, minsamples, profile

    def observe(self, t, ids, pos):
        super().observe(t, ids, pos)
        at, v = self.velocities()
        if len(v) and self.seen[-1][0] != self.seen[0][0]:
            b = np.floor(at[:, 1 - self.flow] / self.size)
            bins, inv, n = np.unique(b, return_inverse=True, return_counts=True)
            ok = n >= self.least
            if ok.any():
                self.profile = ((bins[ok] + 0.5) * self.size, (np.bincount(inv, weights=v[:, self.flow]) / n)[ok])

    def predict(self, t, ids, pos, seen):
        if self.profile is None or not len(pos) or not self.seen:
            return pos
        at, v = self.profile
        out = pos.copy()
        own = (np.floor(pos[:, 1 - self.flow] / self.size) + 0.5) * self.size
        near = np.abs(own[:, None] - np.asarray(at)[None]).argmin(axis=1)
        out[:, self.flow] += np.asarray(v)[near] * (t - seen)
        return out


def instrumented(cls: type) -> type:
    """A predictor class that also records predictions and outcomes; ``dump()`` joins them on the particle."""

    class Recorded(cls):
        def __init__(self, *a, **kw):
            super().__init__(*a, **kw)
            self.log: list[tuple] = []
            self.real: dict[int, tuple] = {}

        def predict(self, t, ids, pos, seen):
            out = super().predict(t, ids, pos, seen)
            self.log.append((t, np.array(ids), np.array(out)))
            return out

        def observe(self, t, ids, pos):
            self.real[t] = (np.array(ids), np.array(pos))
            super().observe(t, ids, pos)

        def dump(self) -> pd.DataFrame:
            parts = []
            for t, ids, out in self.log:
                d = pd.DataFrame(out, columns=[f"pred_{i}" for i in range(out.shape[1])]).assign(particle=ids, frame=t)
                if t in self.real:
                    rid, rpos = self.real[t]
                    d = d.merge(pd.DataFrame(rpos, columns=[f"real_{i}" for i in range(rpos.shape[1])]).assign(particle=rid), on="particle", how="left")
                parts.append(d)
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

    return Recorded
