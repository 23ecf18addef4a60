"""Linking points of one time to points of the next: neighbours, subnets and their cheapest assignment."""

from __future__ import annotations

import numpy as np

from motespark.operators.components import roots

MAX_SUBNET = 30
MAX_SUBNET_ADAPTIVE = 15
MAX_NEIGHBORS = 10
SLACK = 1e-7


class UnknownLinkingError(ValueError):
    """No linking strategy of that name."""


class SubnetOversizeError(Exception):
    """Too many sources compete for the same destinations within the search range."""


def check_strategy(strategy) -> None:
    """Raise UnknownLinkingError unless ``strategy`` is "exact", "drop" or a function."""
    if not callable(strategy) and strategy not in ("exact", "drop"):
        raise UnknownLinkingError(f"strategy {strategy!r}: exact, drop or a function")


def cheapest(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest assignment (rows <= columns): shortest augmenting paths with potentials."""
    n, m = cost.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for r in range(n):
        best, via = np.full(m, np.inf), np.full(m, -1)
        open_ = np.ones(m, dtype=bool)
        row, col = r, -1
        while True:
            slack = cost[row] - row_pot[row] - col_pot
            better = open_ & (slack < best)
            best[better], via[better] = slack[better], col
            nxt = int(np.where(open_, best, np.inf).argmin())
            step = best[nxt]
            row_pot[r] += step
            used = np.flatnonzero(~open_)
            row_pot[owner[used]] += step
            col_pot[used] -= step
            best[open_] -= step
            open_[nxt] = False
            col = nxt
            if owner[nxt] < 0:
                break
            row = owner[nxt]
        while col >= 0:
            before = via[col]
            owner[col] = owner[before] if before >= 0 else r
            col = before
    out = np.full(n, -1)
    has = owner >= 0
    out[owner[has]] = np.flatnonzero(has)
    return out


def solve(n_src: int, n_dst: int, src: np.ndarray, dst: np.ndarray, dist: np.ndarray, reach: float) -> np.ndarray:
    """Destination of each source of one subnet, -1 for none: least sum of squared distances, ``reach``² for each unlinked source."""
    far = (reach**2 + 1) * (n_src + 1) * 4
    cost = np.full((n_src, n_dst + n_src), far)
    cost[src, dst] = dist**2
    cost[np.arange(n_src), n_dst + np.arange(n_src)] = reach**2
    got = cheapest(cost)
    return np.where(got < n_dst, got, -1)


def metric_pairs(src: np.ndarray, dst: np.ndarray, reach: float, dist_func, pivots: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within ``reach`` under any metric.

    Distances to a few pivots are measured first: where they differ by more than ``reach``, the triangle inequality
    rules the pair out, so that the metric is only called on the pairs left.
    """
    to = [0]
    table_s, table_d = [], []
    for _ in range(min(pivots, len(src))):
        p = src[to[-1]]
        table_s.append(np.array([dist_func(p, a) for a in src], dtype=float))
        table_d.append(np.array([dist_func(p, b) for b in dst], dtype=float))
        to.append(int(np.minimum.reduce(table_s).argmax()))  # the source farthest from all pivots so far
    ts, td, slack = np.stack(table_s), np.stack(table_d), reach * (1 + 1e-9) + SLACK
    order = np.argsort(ts[0], kind="stable")
    a, b = np.searchsorted(ts[0][order], td[0] - slack, "left"), np.searchsorted(ts[0][order], td[0] + slack, "right")
    t = np.repeat(np.arange(len(dst)), b - a)
    i = np.arange(len(t)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    s = order[i]
    ok = (np.abs(ts[:, s] - td[:, t]) <= slack).all(axis=0)
    s, t = s[ok], t[ok]
    v = np.array([dist_func(src[i], dst[j]) for i, j in zip(s, t)], dtype=float)
    ok = v <= reach
    return s[ok], t[ok], v[ok]


def neighbours(src: np.ndarray, dst: np.ndarray, reach: float, most: int | None = MAX_NEIGHBORS, dist_func=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, destination, distance) of pairs nearer than ``reach``; of each destination its ``most`` nearest sources, or all."""
    none = (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
    if not len(src) or not len(dst):
        return none
    limit = reach + SLACK
    if dist_func is not None:
        s, t, v = metric_pairs(src, dst, reach, dist_func)
    elif len(src) * len(dst) <= 4096:
        d = np.sqrt(((src[None] - dst[:, None]) ** 2).sum(axis=2))
        t, s = np.nonzero(d < limit)
        v = d[t, s]
    else:
        ndim = src.shape[1]
        low = np.minimum(src.min(axis=0), dst.min(axis=0))
        cs, cd = np.floor((src - low) / limit).astype(np.int64) + 1, np.floor((dst - low) / limit).astype(np.int64) + 1
        size = np.maximum(cs.max(axis=0), cd.max(axis=0)) + 2
        weight = np.r_[np.cumprod(size[::-1])[:-1][::-1], 1].astype(np.int64)
        key = cs @ weight
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        parts = []
        for shift in np.ndindex(*([3] * ndim)):
            want = (cd + np.asarray(shift) - 1) @ weight
            a, b = np.searchsorted(sorted_key, want, "left"), np.searchsorted(sorted_key, want, "right")
            n = b - a
            t = np.repeat(np.arange(len(dst)), n)
            i = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            parts.append((order[i], t))
        s, t = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        v = np.sqrt(((src[s] - dst[t]) ** 2).sum(axis=1))
        ok = v < limit
        s, t, v = s[ok], t[ok], v[ok]
    by = np.lexsort((s, v, t))
    s, t, v = s[by], t[by], v[by]
    if len(t) and most is not None:
        head = np.r_[True, t[1:] != t[:-1]]
        first = np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
        keep = np.arange(len(t)) - first < most
        s, t, v = s[keep], t[keep], v[keep]
    return s, t, v


def nearest(points: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The nearest of ``of`` (not empty) to each point, equal ones by the smaller index.

    ``of`` lies in a grid of about one in a cell; a point looks at rings of cells, farther out until no nearer one can come.
    """
    out, best = np.zeros(len(points), dtype=np.int64), np.full(len(points), np.inf)
    if not len(points):
        return out
    ndim = of.shape[1]
    low, extent = of.min(axis=0), np.maximum(np.ptp(of, axis=0), 1e-9)
    cell = max(float(np.prod(extent) / len(of)) ** (1 / ndim), float(extent.max()) / len(of), 1e-9)
    across = np.floor(extent / cell).astype(np.int64) + 1
    weight = np.r_[np.cumprod((across + 2)[::-1])[:-1][::-1], 1].astype(np.int64)
    key = (np.floor((of - low) / cell).astype(np.int64) + 1) @ weight
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    # a point outside of the grid begins at its border and is the farther from every cell
    at = np.clip(np.floor((points - low) / cell).astype(np.int64), 0, across - 1)
    active, ring = np.arange(len(points)), 0
    while len(active):
        for shift in np.ndindex(*([2 * ring + 1] * ndim)):
            d = np.asarray(shift) - ring
            if np.abs(d).max(initial=0) != ring:
                continue
            c = at[active] + d
            inside = ((c >= 0) & (c < across)).all(axis=1)
            who = active[inside]
            want = (c[inside] + 1) @ weight
            a, b = np.searchsorted(sorted_key, want, "left"), np.searchsorted(sorted_key, want, "right")
            n = b - a
            p = np.repeat(who, n)
            q = order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            d2 = ((points[p] - of[q]) ** 2).sum(axis=1)
            by = np.lexsort((q, d2, p))
            p, q, d2 = p[by], q[by], d2[by]
            first = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, dtype=bool)
            p, q, d2 = p[first], q[first], d2[first]
            better = (d2 < best[p]) | ((d2 == best[p]) & (q < out[p]))
            out[p[better]], best[p[better]] = q[better], d2[better]
        # cells beyond this ring are at least ring cells away, measured from the edge of the own cell
        done = (best[active] <= (ring * cell) ** 2) | (ring >= across.max())
        active, ring = active[~done], ring + 1
    return out


def subnets(n_src: int, n_dst: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Component of every edge of the bipartite graph, by its least source."""
    return roots(s, n_src + t, n_src + n_dst)[s]


def assign(src: np.ndarray, dst: np.ndarray, reach: float, strategy: str = "exact", adaptive_stop: float | None = None, adaptive_step: float = 0.95, dist_func=None, max_size: int | None = None, most: int | None = MAX_NEIGHBORS) -> np.ndarray:
    """Source of every destination, -1 for none.

    A source and a destination that are each other's only candidates are linked. In larger subnets ``exact`` finds the
    least sum of squared distances with reach² for each unlinked source, ``drop`` links nothing. A subnet of too many
    sources raises SubnetOversizeError, or with ``adaptive_stop`` is solved again with a range shorter by
    ``adaptive_step``, as long as that is above ``adaptive_stop``. ``strategy`` may be a function of a subnet (numbers
    of sources and destinations, source, destination and distance of each candidate, range) that gives the destination
    of each source, -1 for none. ``most`` bounds the candidates of a destination; None takes all.
    """
    check_strategy(strategy)
    out = np.full(len(dst), -1)
    s, t, v = neighbours(src, dst, reach, most, dist_func)
    limit = max_size or (MAX_SUBNET if adaptive_stop is None else MAX_SUBNET_ADAPTIVE)
    _assign(s, t, v, len(src), len(dst), reach, strategy, adaptive_stop, adaptive_step, limit, out)
    return out


def _assign(s, t, v, n_src, n_dst, reach, strategy, stop, step, limit, out) -> None:
    """Write the source of every linked destination into ``out``."""
    if not len(s):
        return
    comp = subnets(n_src, n_dst, s, t)
    single = (np.bincount(s, minlength=n_src)[s] == 1) & (np.bincount(t, minlength=n_dst)[t] == 1)
    out[t[single]] = s[single]
    if strategy == "drop" or single.all():
        return
    s, t, v, comp = s[~single], t[~single], v[~single], comp[~single]
    by = np.argsort(comp, kind="stable")
    for edges in np.split(by, np.flatnonzero(np.diff(comp[by])) + 1):
        us, si = np.unique(s[edges], return_inverse=True)
        ut, ti = np.unique(t[edges], return_inverse=True)
        if len(us) > limit:
            if stop is None:
                raise SubnetOversizeError(f"{len(us)} sources in one subnet; the limit is {limit}")
            shorter = reach * step
            if shorter <= stop:
                raise SubnetOversizeError(f"a subnet of {len(us)} sources is left at range {reach}")
            near = v[edges] < shorter + SLACK
            _assign(s[edges][near], t[edges][near], v[edges][near], n_src, n_dst, shorter, strategy, stop, step, limit, out)
        elif not callable(strategy) and (len(us) == 1 or len(ut) == 1):  # the nearest pair wins
            k = int(v[edges].argmin())
            out[t[edges][k]] = s[edges][k]
        else:
            got = np.asarray((strategy if callable(strategy) else solve)(len(us), len(ut), si, ti, v[edges], reach))
            out[ut[got[got >= 0]]] = us[got >= 0]
