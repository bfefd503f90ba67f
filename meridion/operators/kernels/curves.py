"""Adaptive subdivision, level by level over all open intervals of all edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

QUARTERS = np.array([0.25, 0.5, 0.75])


@dataclass
class Curves:
    """Points of each edge in the order of their parameter; the start of each edge comes first."""

    edge: np.ndarray
    t: np.ndarray
    xyz: np.ndarray
    error: str = "none"
    failed_edge: int = -1
    extra: dict = field(default_factory=dict)


def chord_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points to segments, along the last axis; a segment may be a point."""
    d = b - a
    square = (d * d).sum(axis=-1)
    t = ((p - a) * d).sum(axis=-1) / np.where(square > 0, square, 1)
    t = np.where(square > 0, np.clip(t, 0, 1), 0)
    return np.sqrt((((p - a) - t[..., None] * d) ** 2).sum(axis=-1))


def fan_area(samples: np.ndarray) -> np.ndarray:
    """Half the absolute fan of five plane samples (n, 5, 2)."""
    v = samples[:, 1:] - samples[:, :1]
    cross = v[:, :-1, 0] * v[:, 1:, 1] - v[:, 1:, 0] * v[:, :-1, 1]
    return np.abs(cross).sum(axis=1) / 2


def subdivide_groups(
    sample: Callable[[np.ndarray, np.ndarray], np.ndarray], group: np.ndarray, accept: Callable[[np.ndarray, np.ndarray], np.ndarray], max_depth: int, max_segments: int,
) -> tuple[Curves, dict[int, tuple[str, int]]]:
    """Bisects the edges of many groups together until ``accept`` takes the five samples of every interval.

    ``sample(edge, t)`` gives points (n, k), NaN where it fails; ``accept`` gets edges and samples (n, 5, k);
    ``group`` is each edge's group. The accepted intervals are the same as in a depth-first walk of each edge
    alone, so the order by edge and t is too. Limits are errors: nothing is cut off. A group that fails, for
    the word and edge in the second result, has no points, and others go on.
    """
    edges = len(group)
    groups = int(group.max()) + 1 if edges else 0
    failed: dict[int, tuple[str, int]] = {}
    edge = np.arange(edges)
    a, b = np.zeros(edges), np.ones(edges)
    pa, pb = sample(edge, a), sample(edge, b)
    start = pa
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = np.zeros(edges, int)

    def fail(word: str, bad: np.ndarray) -> np.ndarray:
        """Notes the first bad edge of each group that has one; True for intervals of groups that go on."""
        for e in np.unique(bad).tolist():
            failed.setdefault(int(group[e]), (word, e))
        lost = np.zeros(groups, bool)
        lost[list(failed)] = True
        return ~lost[group[edge]]

    for depth in range(max_depth + 1):
        if not len(edge):
            break
        inner = [sample(edge, a + q * (b - a)) for q in QUARTERS]
        five = np.stack([pa, *inner, pb], axis=1)
        broken = ~np.isfinite(five).all(axis=(1, 2))
        good = np.zeros(len(edge), bool)
        good[~broken] = accept(edge[~broken], five[~broken])
        going = fail("sample_failed", edge[broken]) if broken.any() else np.ones(len(edge), bool)
        count += np.bincount(edge[good & going], minlength=edges)
        open_ = ~good & going
        over = count + 2 * np.bincount(edge[open_], minlength=edges) > max_segments
        if over.any():
            going &= fail("limit_exceeded", np.flatnonzero(over))
        if depth == max_depth and (open_ & going).any():
            going &= fail("limit_exceeded", edge[open_ & going])
        good &= going
        open_ &= going
        done.append((edge[good], b[good], pb[good]))
        m, pm = ((a + b) / 2)[open_], inner[1][open_]
        edge, a, b = np.concatenate([edge[open_]] * 2), np.concatenate([a[open_], m]), np.concatenate([m, b[open_]])
        pa, pb = np.concatenate([pa[open_], pm]), np.concatenate([pm, pb[open_]])
    edge = np.concatenate([np.arange(edges), *(d[0] for d in done)])
    t = np.concatenate([np.zeros(edges), *(d[1] for d in done)])
    xyz = np.concatenate([start, *(d[2] for d in done)])
    if failed:
        keep = ~np.isin(group[edge], list(failed))
        edge, t, xyz = edge[keep], t[keep], xyz[keep]
    order = np.lexsort((t, edge))
    return Curves(edge[order], t[order], xyz[order]), failed


def subdivide(
    sample: Callable[[np.ndarray, np.ndarray], np.ndarray], edges: int, accept: Callable[[np.ndarray], np.ndarray], max_depth: int, max_segments: int,
) -> Curves:
    """The same for one group of edges."""
    curves, failed = subdivide_groups(sample, np.zeros(edges, int), lambda _, five: accept(five), max_depth, max_segments)
    if failed:
        word, edge = failed[0]
        return Curves(np.zeros(0, int), np.zeros(0), np.zeros((0, 2)), word, edge)
    return curves


def joined(curves: Curves) -> np.ndarray:
    """One chain of points: an edge's first point is left out where it repeats the one before."""
    p = curves.xyz
    keep = np.ones(len(p), bool)
    keep[1:] = (curves.t[1:] != 0) | (p[1:] != p[:-1]).any(axis=1)
    return p[keep]
