"""Geodesy on numpy arrays: the same formulas as the Column expressions."""

from __future__ import annotations

import numpy as np

from meridion.functions.constants import (
    AUTHALIC_RADIUS,
    E2,
    HALF_PI,
    PI,
    Q_POLE,
    ROTATION_TOLERANCE,
    TWO_PI,
    E,
)

R = AUTHALIC_RADIUS


def authalic_q(lat):
    s = np.sin(lat)
    return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(E * s) / E)


def authalic_latitude(lat):
    beta = np.arcsin(np.clip(authalic_q(lat) / Q_POLE, -1, 1))
    return np.where(np.abs(lat) == HALF_PI, lat, beta)


def remainder(x):
    """The IEEE remainder by a whole turn."""
    return np.remainder(np.asarray(x) + PI, TWO_PI) - PI if np.any(np.abs(x) > 3 * PI) else x - TWO_PI * np.rint(np.asarray(x) / TWO_PI)


def principal(x):
    r = remainder(x)
    return np.where(r <= -PI, r + TWO_PI, np.where(r > PI, r - TWO_PI, r))


def mollweide_theta(beta):
    s = np.abs(np.sin(beta))
    t = HALF_PI - np.cbrt(0.75 * PI * (1 - s))
    for _ in range(10):
        slope = 2 + 2 * np.cos(2 * t)
        step = np.where(slope < 1e-12, 0, (2 * t + np.sin(2 * t) - PI * s) / np.where(slope < 1e-12, 1, slope))
        t = np.clip(t - step, 0, HALF_PI)
    return np.where(np.abs(beta) == HALF_PI, beta, np.copysign(t, beta))


def project(primitive: str, lon, lat):
    """Plane positions of geodetic points whose longitude is measured from the central meridian."""
    beta = authalic_latitude(lat)
    if primitive == "sinusoidal":
        return R * lon * np.cos(beta), R * beta
    if primitive == "mollweide":
        theta = mollweide_theta(beta)
        return R * 2 * 2**0.5 / PI * lon * np.cos(theta), R * 2**0.5 * np.sin(theta)
    raise ValueError(f"unknown primitive {primitive}")


def rotation_x(a: float) -> np.ndarray:
    return np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])


def rotation_y(a: float) -> np.ndarray:
    return np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])


def rotation_z(a: float) -> np.ndarray:
    return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])


def is_rotation(m) -> bool:
    m = np.asarray(m, float)
    return bool(
        m.shape == (3, 3) and np.isfinite(m).all() and np.abs(m @ m.T - np.eye(3)).max() <= ROTATION_TOLERANCE and abs(np.linalg.det(m) - 1) <= ROTATION_TOLERANCE
    )


def camera(lon: float, lat: float) -> np.ndarray:
    """Turns the geodetic point (lon, lat) to the front, north up."""
    return rotation_y(float(authalic_latitude(lat))) @ rotation_z(-lon)


def globe(lon, lat, matrix: np.ndarray):
    """Screen x and y, and depth, of geodetic points."""
    beta = authalic_latitude(lat)
    v = np.stack([np.cos(beta) * np.cos(lon), np.cos(beta) * np.sin(lon), np.sin(beta)])
    depth, x, y = R * np.tensordot(matrix, v, axes=1)
    return x, y, depth
