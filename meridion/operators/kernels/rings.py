"""Canonical rings, their exact areas, and planar areas."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from meridion.functions.constants import EPS, HALF_PI, HALF_TURN, Q_POLE, SEMI_MAJOR, TWO_PI, WINDING_TOLERANCE

from .sphere import authalic_q, principal, remainder

AREA_UNIT = SEMI_MAJOR**2
SIDES = ("unspecified", "left", "right")


@dataclass(frozen=True)
class Ring:
    """Unwrapped vertices; the closing edge goes from the last one to (closing_lon, first latitude)."""

    lon: np.ndarray
    lat: np.ndarray
    closing_lon: float
    winding: int
    side: str = "unspecified"

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.lon, self.lat

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return np.append(self.lon[1:], self.closing_lon), np.append(self.lat[1:], self.lat[0])

    def shifted(self, by: float) -> Ring:
        return replace(self, lon=self.lon + by, closing_lon=self.closing_lon + by)


def canonicalise(lon, lat, side: str = "unspecified") -> tuple[Ring | None, str]:
    """A canonical ring of raw points, or the reason why there is none."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if len(lon) < 3:
        return None, "too_few_vertices"
    infinite = ~(np.isfinite(lon) & np.isfinite(lat))
    with np.errstate(invalid="ignore"):
        bad = np.flatnonzero(infinite | (np.abs(lat) > HALF_PI))
    if len(bad):
        return None, "non_finite_coordinate" if infinite[bad[0]] else "latitude_out_of_range"
    if len(lon) >= 4 and lat[-1] == lat[0] and math.remainder(lon[-1] - lon[0], TWO_PI) == 0:
        lon, lat = lon[:-1], lat[:-1]
    if len(lon) < 3:
        return None, "too_few_vertices"
    steps = np.array([math.remainder(d, TWO_PI) for d in np.diff(np.append(lon, lon[0]))])
    if (np.abs(np.abs(steps) - math.pi) <= HALF_TURN).any():
        return None, "ambiguous_half_turn"
    path = np.cumsum(np.concatenate([[float(principal(lon[0]))], steps]))
    turns = (path[-1] - path[0]) / TWO_PI
    if abs(turns - round(turns)) > WINDING_TOLERANCE:
        return None, "numerical_domain_error"
    return Ring(path[:-1], lat, float(path[-1]), int(round(turns)), side), "none"


def validate_stored(ring: Ring) -> str:
    """Whether a ring has the stored form: first longitude principal, steps below half a turn, its winding, a side if it winds."""
    if len(ring.lon) < 3:
        return "too_few_vertices"
    if not (np.isfinite(ring.lon).all() and np.isfinite(ring.lat).all() and math.isfinite(ring.closing_lon)):
        return "non_finite_coordinate"
    if np.abs(ring.lat).max() > HALF_PI:
        return "latitude_out_of_range"
    if not -math.pi < ring.lon[0] <= math.pi:
        return "longitude_not_canonical"
    steps = np.diff(np.append(ring.lon, ring.closing_lon))
    if np.abs(steps).max() > math.pi:
        return "longitude_step_too_long"
    if round((ring.closing_lon - ring.lon[0]) / TWO_PI) != ring.winding:
        return "winding_mismatch"
    if ring.winding and ring.side == "unspecified":
        return "missing_interior_side"
    return "none"


def _integrals(lat0: np.ndarray, lat1: np.ndarray, tolerance: float, depth: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Mean of q along each edge by adaptive Simpson, all open intervals at once; its error, and whether all closed."""
    total, error = np.zeros(len(lat0)), np.zeros(len(lat0))
    flat = lat0 == lat1
    total[flat] = authalic_q(lat0[flat])
    edge = np.flatnonzero(~flat)

    def at(e: np.ndarray, t: np.ndarray) -> np.ndarray:
        return authalic_q(lat0[e] + t * (lat1[e] - lat0[e]))

    a, b = np.zeros(len(edge)), np.ones(len(edge))
    fa, fm, fb = at(edge, a), at(edge, (a + b) / 2), at(edge, b)
    tol = np.full(len(edge), tolerance)
    for level in range(depth + 1):
        if not len(edge):
            break
        m = (a + b) / 2
        fl, fr = at(edge, (a + m) / 2), at(edge, (m + b) / 2)
        whole = (b - a) / 6 * (fa + 4 * fm + fb)
        halves = (b - a) / 12 * (fa + 4 * fl + 2 * fm + 4 * fr + fb)
        delta = halves - whole
        good = np.abs(delta) <= 15 * tol
        np.add.at(total, edge[good], (halves + delta / 15)[good])
        np.add.at(error, edge[good], np.abs(delta[good]) / 15)
        if level == depth and not good.all():
            return total, error, False
        k = ~good
        edge, a, b, fa, fb, fm = (np.concatenate([x[k], y[k]]) for x, y in ((edge, edge), (a, m), (m, b), (fa, fm), (fm, fb), (fl, fr)))
        tol = np.concatenate([tol[k], tol[k]]) / 2
    return total, error, True


def ring_area(ring: Ring, tolerance: float = 1e-14, depth: int = 24) -> tuple[float, float, str]:
    """Signed area (counter-clockwise positive), its error bound, and an error word.

    With an interior side the area is the representative of that side: left in [0, surface), right in
    (-surface, 0]. Without one a ring that winds has no area.
    """
    if ring.winding and ring.side == "unspecified":
        return math.nan, math.nan, "longitude_winding_unsupported"
    (lon0, lat0), (lon1, lat1) = ring.starts(), ring.ends()
    step = lon1 - lon0
    use = step != 0
    mean, error, done = _integrals(lat0[use], lat1[use], tolerance, depth)
    if not done:
        return math.nan, math.nan, "integration_limit_exceeded"
    integral = math.fsum(step[use] * mean)
    bound = math.fsum(np.abs(step[use]) * (error + 16 * EPS * np.maximum(1, np.abs(mean))))
    value = -integral / 2
    if ring.side == "unspecified":
        return AREA_UNIT * value, AREA_UNIT * bound / 2, "none"
    surface = TWO_PI * Q_POLE
    value = math.fmod(value + ring.winding * math.pi * Q_POLE, surface)
    if ring.side == "left" and value < 0:
        value += surface
    if ring.side == "right" and value > 0:
        value -= surface
    return AREA_UNIT * value, AREA_UNIT * (bound / 2 + 16 * EPS * (abs(value) + surface)), "none"


def planar_area(x, y) -> float:
    """Signed area of a plane ring: a compensated fan about its first vertex; 0 below three points, NaN if one is not finite."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 3:
        return 0.0
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return math.nan
    x, y = x - x[0], y - y[0]
    return math.fsum((x[1:-1] * y[2:] - x[2:] * y[1:-1]).tolist()) / 2


def unwrap_all(lon) -> np.ndarray:
    """Longitudes without jumps, each the nearest branch to the one before."""
    lon = np.asarray(lon, float)
    return np.cumsum(np.concatenate([[principal(lon[0])], remainder(np.diff(lon))])) if len(lon) else lon
