"""Array kernels for Arrow batches: blocked neighbour search, local linear maps."""

from __future__ import annotations

import numpy as np


def distances(p: np.ndarray, lib: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added in the order of dimensions."""
    total = np.zeros((len(p), len(lib)))
    for j in range(p.shape[1]):
        diff = p[:, j, None] - lib[None, :, j]
        total += diff * diff
    return np.sqrt(total)


def nearest(p_rows: np.ndarray, p: np.ndarray, l_rows: np.ndarray, lib: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in p, place in lib, distance) of the k nearest library rows more than ``radius`` rows away, by (distance, |p - l|, l)."""
    if not len(p) or not len(lib) or k < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if p.shape[1] >= SCREENED and k * SPAN < len(lib) and (found := screened(p_rows, p, l_rows, lib, k, radius)) is not None:
        i, j, d = found
        return first_of(i, j, d, np.abs(p_rows[i] - l_rows[j]), l_rows[j], k)
    gap = np.abs(p_rows[:, None] - l_rows[None, :])
    d = np.where(gap > radius, distances(p, lib), np.inf)
    if k < len(lib):
        edge = np.partition(d, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero((d <= edge[:, None]) & (d < np.inf))
    else:
        i, j = np.nonzero(d < np.inf)
    return first_of(i, j, d[i, j], gap[i, j], l_rows[j], k)


def first_of(i: np.ndarray, j: np.ndarray, d: np.ndarray, gap: np.ndarray, l_rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) the k first of each i by (distance, row difference, library row)."""
    order = np.lexsort((l_rows, gap, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


#: Dimensions from which products of matrices say which pairs' distances are worked out; library rows of which one minimum is taken; numbers of a block, which stays in a core's cache; such pairs at most.
SCREENED, SPAN, BLOCK, SCREEN = 8, 64, 131_072, 400_000


def screened(p_rows: np.ndarray, p: np.ndarray, l_rows: np.ndarray, lib: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, distance) of all pairs that can be among a row's k nearest, ties included; None where bounds of rounding leave too many, or numbers are too large.

    |a|^2 + |b|^2 - 2ab differs from the sum of squares by rounding only, which has a bound. The k-th least of minima over spans of rows is no less than the k-th least of
    all, so what lies above it by more than twice the bound is out. The distances of the others are those of :func:`distances`.
    """
    middle = lib.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = p - middle, lib - middle
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        slack = np.finfo(float).eps * 8 * (p.shape[1] + 8) * (aa + bb.max()) + np.finfo(float).tiny
        if not np.isfinite(slack).all():
            return None
    b = np.ascontiguousarray(-2 * b.T)
    width = max(SPAN, BLOCK // len(p) // SPAN * SPAN)
    meet = p_rows.min() - radius <= l_rows.max() and l_rows.min() <= p_rows.max() + radius
    least, found, many = np.full((len(p), k), np.inf), [], 0
    for at in range(0, len(lib), width):
        near = a @ b[:, at : at + width]
        near += bb[at : at + width]
        if meet:
            near[np.abs(p_rows[:, None] - l_rows[None, at : at + width]) <= radius] = np.inf
        whole = near.shape[1] // SPAN * SPAN
        spans = near[:, :whole].reshape(len(p), -1, SPAN).min(axis=2)
        least = np.partition(np.concatenate((least, spans), axis=1), k - 1, axis=1)[:, :k]
        place = np.flatnonzero((near <= (least[:, k - 1] + slack)[:, None]) & (near < np.inf))
        i, j = np.divmod(place, near.shape[1])
        found.append((i, j + at, near[i, j]))
        many += len(i)
        if many > SCREEN:
            return None
    i, j, value = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = value <= least[i, k - 1] + slack[i]
    i, j = i[ok], j[ok]
    total = np.zeros(len(i))
    for c in range(p.shape[1]):
        diff = p[i, c] - lib[j, c]
        total += diff * diff
    return i, j, np.sqrt(total)


#: Numbers that a block of distances holds, about.
CELLS = 4_000_000


def eligible(p_rows: np.ndarray, p: np.ndarray, l_rows: np.ndarray, lib: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, infinite within the radius; row differences)."""
    gap = np.abs(p_rows[:, None] - l_rows[None, :])
    return np.where(gap > radius, distances(p, lib), np.inf), gap


def k_first(d: np.ndarray, gap: np.ndarray, l_rows: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's finite distances are its k first by (distance, row difference, row)."""
    there = d < np.inf
    if k >= d.shape[1]:
        return there
    edge = np.partition(d, k - 1, axis=1)[:, k - 1, None] if k > 0 else np.full((len(d), 1), -np.inf)
    inside = (d < edge) & there
    tied = (d == edge) & there
    room = k - inside.sum(axis=1)
    for r in np.flatnonzero(tied.sum(axis=1) > room):
        at = np.flatnonzero(tied[r])
        tied[r, at[np.lexsort((l_rows[at], gap[r, at]))[max(0, room[r]) :]]] = False
    return inside | tied


def triangles(rows: np.ndarray) -> np.ndarray:
    """Square triangular factors of each of stacked matrices; fewer rows than columns are filled up with zeros."""
    r = np.linalg.qr(rows, mode="r")
    if r.shape[1] < r.shape[2]:
        r = np.concatenate((r, np.zeros((len(r), r.shape[2] - r.shape[1], r.shape[2]))), axis=1)
    return r


def map_factors(d: np.ndarray, used: np.ndarray, lib: np.ndarray, y: np.ndarray, mean: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What weighted local maps need of some library rows: triangular factors of (1, states, target) and of (1, target), and numbers of rows.

    Factors of other rows can be stacked below these and factored again. The second has roots of weights, for the variance.
    """
    used = used & np.isfinite(y)
    w = np.exp(-theta * np.where(used, d, 0) / np.where(mean > 0, mean, 1)[:, None]) if theta else np.ones_like(d)
    w[mean <= 0] = 1
    w *= used
    every = np.column_stack((np.ones(len(lib)), lib, np.where(np.isfinite(y), y, 0)))
    return triangles(w[:, :, None] * every), triangles(np.sqrt(w)[:, :, None] * every[:, [0, -1]]), used.sum(axis=1)


def solved_maps(p: np.ndarray, factors: np.ndarray, spread: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, variance, coefficients, singular values) of each map, not a number where it has no rows or no such value."""
    width = factors.shape[2] - 1
    u, s, vt = np.linalg.svd(factors[:, :width, :width])
    rank = s > np.finfo(float).eps * np.maximum(n, width)[:, None] * s[:, :1]
    inverse = np.where(rank, 1 / np.where(rank, s, 1), 0)
    c = np.einsum("rkj,rk->rj", vt, inverse * np.einsum("rik,ri->rk", u, factors[:, :width, width]))
    got = c[:, 0] + (p * c[:, 1:]).sum(axis=1)
    off = spread @ np.stack((-got, np.ones(len(got))), axis=1)[:, :, None]
    total = spread[:, 0, 0] ** 2
    var = (off[:, :, 0] ** 2).sum(axis=1) / np.where(total > 0, total, 1)
    empty = n == 0
    got[empty], var[empty], c[empty] = np.nan, np.nan, np.nan
    s[np.arange(width)[None] >= np.minimum(n, width)[:, None]] = np.nan
    return got, var, c, s


def smap_rows(p_rows: np.ndarray, p: np.ndarray, l_rows: np.ndarray, lib: np.ndarray, y: np.ndarray, k: int, radius: int, thetas: list[float]):
    """Yields (places in p, theta, predictions, variances, coefficients, singular values) of weighted local linear maps over a whole library."""
    step = max(1, CELLS // max(1, len(lib) * (lib.shape[1] + 2)))
    for at in range(0, len(p), step):
        here = slice(at, at + step)
        d, gap = eligible(p_rows[here], p[here], l_rows, lib, radius)
        used = k_first(d, gap, l_rows, k)
        mean = np.where(used, d, 0).sum(axis=1) / np.maximum(1, used.sum(axis=1))
        for theta in thetas:
            yield np.arange(at, at + len(d)), theta, *solved_maps(p[here], *map_factors(d, used, lib, y, mean, theta))
