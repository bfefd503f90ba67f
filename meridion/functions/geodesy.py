"""Geodesy as Column expressions, so that it stays inside whole-stage code.

Functions that can fail return STRUCT<value, error>: error is "none" or a reason, value is null then.
Angles are radians, lengths metres.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    AUTHALIC_CLAMP,
    AUTHALIC_RADIUS,
    E2,
    EPS,
    HALF_PI,
    HALF_TURN,
    MOLLWEIDE_CLAMP,
    PI,
    POLE_FLOOR,
    Q_POLE,
    RADIANS,
    SEMI_MAJOR,
    SURFACE,
    TWO_PI,
    E,
)

R = AUTHALIC_RADIUS


def lit(x: float) -> Column:
    return F.lit(float(x))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def planar(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def result(value: Column, error: Column) -> Column:
    """STRUCT<value, error>; the value is dropped if there is an error."""
    return F.struct(F.when(error == "none", value).alias("value"), error.alias("error"))


def finite(x: Column) -> Column:
    """NaN counts as the largest value in comparisons, so it is asked for first."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < lit("inf"))


def radians(degrees: Column) -> Column:
    return degrees * lit(RADIANS)


def latitude_error(lat: Column) -> Column:
    return F.when(~finite(lat), "non_finite_input").when(F.abs(lat) > lit(HALF_PI), "latitude_out_of_range").otherwise("none")


def clamp_unit(x: Column, slack: float) -> Column:
    """STRUCT<value, error>: values up to ``slack`` outside [-1, 1] are set to its ends."""
    error = F.when(~finite(x), "non_finite_input").when(F.abs(x) > lit(1 + slack), "numerical_domain_error").otherwise("none")
    return result(F.greatest(lit(-1), F.least(lit(1), x)), error)


def principal(x: Column) -> Column:
    """The angle in (-pi, pi] that equals ``x`` up to whole turns (the IEEE remainder for |x| up to 3 pi)."""
    r = x - lit(TWO_PI) * F.rint(x / lit(TWO_PI))
    return F.when(r <= lit(-PI), r + lit(TWO_PI)).when(r > lit(PI), r - lit(TWO_PI)).otherwise(r)


def stored_longitude(x: Column) -> Column:
    """A central meridian in (-pi, pi], through a remainder with the sign of ``x``."""
    r = x % lit(TWO_PI)
    return F.when(r > lit(PI), r - lit(TWO_PI)).when(r <= lit(-PI), r + lit(TWO_PI)).otherwise(r) + lit(0)


def view_longitude_degrees(x: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(x + lit(180), lit(360)) - lit(180)


def half_turn(delta: Column) -> Column:
    """True if a difference of longitudes is half a turn, so that its direction is open."""
    return F.abs(F.abs(delta) - lit(PI)) <= lit(HALF_TURN)


def authalic_q(lat: Column) -> Column:
    s = F.sin(lat)
    return lit(1 - E2) * (s / (lit(1) - lit(E2) * s * s) + F.atanh(lit(E) * s) / lit(E))


def authalic_latitude(lat: Column) -> Column:
    """The latitude on the authalic sphere, without checks; exact at the poles."""
    beta = F.asin(F.greatest(lit(-1), F.least(lit(1), authalic_q(lat) / lit(Q_POLE))))
    return F.when(F.abs(lat) == lit(HALF_PI), lat).otherwise(beta)


def authalic_latitude_checked(lat: Column) -> Column:
    ratio = clamp_unit(authalic_q(lat) / lit(Q_POLE), AUTHALIC_CLAMP)
    error = latitude_error(lat)
    return result(F.when(F.abs(lat) == lit(HALF_PI), lat).otherwise(F.asin(ratio["value"])), F.when(error != "none", error).otherwise(ratio["error"]))


def geodetic_latitude(beta: Column, steps: int = 60) -> Column:
    """The inverse of authalic_latitude by bisection on the latitude itself."""
    target = lit(Q_POLE) * F.sin(beta)

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / lit(2)
        below = authalic_q(mid) < target
        return F.struct(F.when(below, mid).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(lit(-HALF_PI).alias("lo"), lit(HALF_PI).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / lit(2))
    return F.when(F.abs(beta) == lit(HALF_PI), beta).otherwise(found)


def sinusoidal(lon: Column, beta: Column) -> Column:
    return planar(lit(R) * lon * F.cos(beta), lit(R) * beta)


def sinusoidal_inverse(x: Column, y: Column) -> Column:
    """STRUCT<value POINT, error>; at the poles the longitude is indeterminate."""
    beta = y / lit(R)
    c = F.cos(beta)
    error = (
        F.when(~finite(x) | ~finite(y), "non_finite_input").when(F.abs(beta) > lit(HALF_PI * (1 + 4 * EPS)), "latitude_out_of_range")
        .when(c <= lit(POLE_FLOOR), "indeterminate_coordinate").otherwise("none")
    )
    return result(point(x / (lit(R) * c), beta), error)


def mollweide_theta(beta: Column, steps: int = 10) -> Column:
    """The auxiliary angle t of 2 t + sin 2 t = pi sin(beta).

    Newton steps from the pole's expansion x = (3 pi (1 - s) / 4)^(1/3), t = pi/2 - x, which is near
    enough everywhere for a fixed number of steps.
    """
    s = F.abs(F.sin(beta))
    start = lit(HALF_PI) - F.pow(lit(0.75 * PI) * (lit(1) - s), lit(1 / 3))

    def newton(t: Column, _: Column) -> Column:
        slope = lit(2) + lit(2) * F.cos(lit(2) * t)
        nxt = t - (lit(2) * t + F.sin(lit(2) * t) - lit(PI) * s) / slope
        return F.when(slope < lit(1e-12), t).otherwise(F.greatest(lit(0), F.least(lit(HALF_PI), nxt)))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton)
    return F.when(F.abs(beta) == lit(HALF_PI), beta).otherwise(F.when(beta < lit(0), -found).otherwise(found))


def mollweide(lon: Column, beta: Column) -> Column:
    theta = mollweide_theta(beta)
    return planar(lit(R * 2 * 2**0.5 / PI) * lon * F.cos(theta), lit(R * 2**0.5) * F.sin(theta))


def mollweide_inverse(x: Column, y: Column) -> Column:
    """STRUCT<value POINT, error>; closed form."""
    s = clamp_unit(y / lit(R * 2**0.5), MOLLWEIDE_CLAMP)
    theta = F.asin(s["value"])
    b = clamp_unit((lit(2) * theta + F.sin(lit(2) * theta)) / lit(PI), MOLLWEIDE_CLAMP)
    c = F.cos(theta)
    error = (
        F.when(~finite(x) | ~finite(y), "non_finite_input").when(s["error"] != "none", s["error"]).when(b["error"] != "none", b["error"])
        .when(c <= lit(POLE_FLOOR), "indeterminate_coordinate").otherwise("none")
    )
    return result(point(lit(PI) * x / (lit(R * 2 * 2**0.5) * c), F.asin(b["value"])), error)


FORWARD: dict[str, Callable[[Column, Column], Column]] = {"sinusoidal": sinusoidal, "mollweide": mollweide}
INVERSE: dict[str, Callable[[Column, Column], Column]] = {"sinusoidal": sinusoidal_inverse, "mollweide": mollweide_inverse}


def project_point(lon: Column, lat: Column, primitive: str = "sinusoidal", central_meridian: float = 0.0) -> Column:
    """A geodetic point on the plane; the longitude is not wrapped."""
    return FORWARD[primitive](lon - lit(central_meridian), authalic_latitude(lat))


def unit_vector(lon: Column, lat: Column) -> Column:
    c = F.cos(lat)
    return F.struct((c * F.cos(lon)).alias("x"), (c * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def from_vector(v: Column) -> Column:
    """STRUCT<value POINT, error> of a vector of any length but zero."""
    flat = F.hypot(v["x"], v["y"])
    length = F.hypot(flat, v["z"])
    error = F.when(~finite(length), "non_finite_input").when(length == lit(0), "numerical_domain_error").when(flat <= lit(POLE_FLOOR) * length, "indeterminate_coordinate").otherwise("none")
    return result(point(F.atan2(v["y"], v["x"]), F.atan2(v["z"], flat)), error)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def rotate(matrix: list[list[float]], v: Column) -> Column:
    """A constant 3 x 3 matrix, folded into the plan, times a vector."""
    rows = [lit(m[0]) * v["x"] + lit(m[1]) * v["y"] + lit(m[2]) * v["z"] for m in matrix]
    return F.struct(*[c.alias(n) for c, n in zip(rows, "xyz", strict=True)])


def globe_point(lon: Column, lat: Column, camera: list[list[float]]) -> Column:
    """STRUCT<x, y, depth, visible> of a geodetic point, seen orthographically."""
    v = rotate(camera, unit_vector(lon, authalic_latitude(lat)))
    depth = lit(R) * v["x"]
    return F.struct((lit(R) * v["y"]).alias("x"), (lit(R) * v["z"]).alias("y"), depth.alias("depth"), (depth >= lit(0)).alias("visible"))


def cell_area(delta_lon: Column, south: Column, north: Column) -> Column:
    """The exact area between two parallels over a difference of longitudes."""
    return lit(SEMI_MAJOR**2 / 2) * delta_lon * (authalic_q(north) - authalic_q(south))


def coverage(area: Column, uncertainty: Column) -> Column:
    """minor, major or ambiguous: an area against half the surface, with a band of uncertainty."""
    half = lit(SURFACE / 2)
    size = F.abs(area)
    return F.when(size + uncertainty < half, "minor").when(size - uncertainty > half, "major").otherwise("ambiguous")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance of a point to a segment, which may be a single point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > lit(0), F.greatest(lit(0), F.least(lit(1), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(lit(0))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def area_envelope(xs: list[Column], ys: list[Column]) -> Column:
    """Half the sum of the absolute cross products of a fan from the first of five samples to the others."""
    total = None
    for i in (1, 2, 3):
        cross = F.abs((xs[i] - xs[0]) * (ys[i + 1] - ys[0]) - (xs[i + 1] - xs[0]) * (ys[i] - ys[0]))
        total = cross if total is None else total + cross
    return total / lit(2)


def limb_angle(x: Column, y: Column) -> Column:
    """The angle of a limb point in [0, 2 pi)."""
    return F.pmod(F.atan2(y, x), lit(TWO_PI))


def smoothstep(p: Column) -> Column:
    """Quintic: 6 p^5 - 15 p^4 + 10 p^3 on [0, 1]."""
    t = F.greatest(lit(0), F.least(lit(1), p))
    return t * t * t * (t * (t * lit(6) - lit(15)) + lit(10))


def mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def fit_viewport(x: Column, y: Column, bounds: dict[str, Column | float], width: float, height: float, margin: float = 52.0) -> Column:
    """Screen position: the bounds centred in the viewport with a margin, y downwards."""
    b = {k: v if isinstance(v, Column) else lit(v) for k, v in bounds.items()}
    scale = F.least(lit(width - 2 * margin) / (b["max_x"] - b["min_x"]), lit(height - 2 * margin) / (b["max_y"] - b["min_y"]))
    return planar(lit(width / 2) + (x - (b["min_x"] + b["max_x"]) / lit(2)) * scale, lit(height / 2) - (y - (b["min_y"] + b["max_y"]) / lit(2)) * scale)


def edge_point(a: Column, b: Column, t: Column) -> Column:
    """A point of an edge that is straight in longitude and latitude."""
    return point(mix(a["lon"], b["lon"], t), mix(a["lat"], b["lat"], t))
