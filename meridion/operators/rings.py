"""Rings as arrays of points: edges, unwrapping, canonical form, areas - as Column expressions.

A ring is STRUCT<vertices ARRAY<STRUCT<lon, lat>>, closing_lon, winding, interior_side>. Arrays are folded
in their own order, so no shuffle is needed and results don't depend on partitions. Long rings go through
``project_rings`` and its kin, whose kernels do the same per row in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridion.functions.constants import EPS, PI, Q_POLE, SEMI_MAJOR, TWO_PI, WINDING_TOLERANCE
from meridion.functions.geodesy import authalic_q, finite, half_turn, lit, point, principal

# Gauss-Legendre nodes and weights on [0, 1] with eight points.
_NODES = (0.019855071751231884, 0.10166676129318664, 0.2372337950418355, 0.4082826787521751)
_WEIGHTS = (0.05061426814518813, 0.11119051722668724, 0.15685332293894363, 0.181341891689181)
GAUSS = [(t, w) for t, w in zip(_NODES, _WEIGHTS, strict=True)] + [(1 - t, w) for t, w in zip(_NODES, _WEIGHTS, strict=True)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is mentioned: the optimizer doesn't write out lambda variables."""
    return F.transform(F.array(value), body)[0]


def rectangle(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Four corners, counter-clockwise."""
    return F.array(point(west, south), point(east, south), point(east, north), point(west, north))


def edges(points: Column, closing: Column | None = None) -> Column:
    """ARRAY<STRUCT<a, b>>: each point and the next, the last with the closing point (the first by default)."""

    def pairs(p: Column) -> Column:
        end = closing if closing is not None else p[0]
        return F.zip_with(p, F.concat(F.slice(p, F.lit(2), F.size(p) - 1), F.array(end)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(points, pairs)


def without_repeated_end(points: Column) -> Column:
    last, first = F.element_at(points, -1), points[0]
    same = (F.size(points) >= 4) & (last["lat"] == first["lat"]) & (principal(last["lon"] - first["lon"]) == lit(0))
    return F.when(same, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)


LONG = 64  # points from which longitudes are summed by blocks


def unwrapped(points: Column) -> Column:
    """The points with longitudes that never jump: each is the one before plus the nearest way, taken between raw longitudes.

    The sums of short rings are folded; those of long ones by blocks of a square root of their points, so that
    no array is built point by point.
    """

    def fold(steps: Column) -> Column:
        return F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.slice(steps, 1, 1), lambda path, d: F.concat(path, F.array(F.element_at(path, -1) + d)))

    def blocks(steps: Column) -> Column:
        def summed(size: Column) -> Column:
            total = lambda first, n: F.aggregate(F.slice(steps, first + 1, n), lit(0), lambda s, d: s + d)
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / size).cast("int")), lambda k: total(k * size, size))
            starts = F.aggregate(sums, F.array(lit(0)), lambda path, d: F.concat(path, F.array(F.element_at(path, -1) + d)))
            # A block's sum and the sum up to its last point are the same steps in the same order, so they are equal to the bit.
            place = lambda i, starts: F.get(starts, F.floor(i / size).cast("int")) + total(F.floor(i / size).cast("int") * size, i - F.floor(i / size).cast("int") * size + 1)
            return let(starts, lambda starts: F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: place(i, starts)))

        return let(F.ceil(F.sqrt(F.size(steps))).cast("int"), summed)

    def path(p: Column) -> Column:
        steps = F.concat(F.array(principal(p[0]["lon"])), F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: principal(b["lon"] - a["lon"])))
        lons = let(steps, lambda s: F.when(F.size(s) < LONG, fold(s)).otherwise(blocks(s)))
        return F.zip_with(lons, p, lambda lon, q: point(lon, q["lat"]))

    return let(points, path)


def canonical_ring(points: Column, side: Column | str = "unspecified") -> Column:
    """STRUCT<value RING, error> of raw points."""
    side = F.lit(side) if isinstance(side, str) else side

    def built(points: Column, raw: Column, path: Column) -> Column:
        bad = F.get(F.filter(points, lambda p: ~finite(p["lon"]) | ~finite(p["lat"]) | (F.abs(p["lat"]) > lit(PI / 2))), F.lit(0))
        closing = F.element_at(path, -1)["lon"] + principal(raw[0]["lon"] - F.element_at(raw, -1)["lon"])
        half = F.exists(edges(raw), lambda e: half_turn(principal(e["b"]["lon"] - e["a"]["lon"])))

        def ring(closing: Column) -> Column:
            turns = (closing - path[0]["lon"]) / lit(TWO_PI)
            error = (
                F.when(bad.isNotNull(), F.when(finite(bad["lon"]) & finite(bad["lat"]), "latitude_out_of_range").otherwise("non_finite_coordinate")).when(F.size(raw) < 3, "too_few_vertices")
                .when(half, "ambiguous_half_turn").when(F.abs(turns - F.rint(turns)) > lit(WINDING_TOLERANCE), "numerical_domain_error").otherwise("none")
            )
            value = F.struct(path.alias("vertices"), closing.alias("closing_lon"), F.rint(turns).cast("int").alias("winding"), side.alias("interior_side"))
            return let(error, lambda e: F.struct(F.when(e == "none", value).alias("value"), e.alias("error")))

        return let(closing, ring)

    whole = let(points, lambda p: let(without_repeated_end(p), lambda raw: let(unwrapped(raw), lambda path: built(p, raw, path))))
    return F.when(F.size(points) < 3, F.struct(F.lit(None).alias("value"), F.lit("too_few_vertices").alias("error"))).otherwise(whole)


def ring_edges(ring: Column) -> Column:
    return let(ring, lambda r: edges(r["vertices"], point(r["closing_lon"], r["vertices"][0]["lat"])))


def _kahan(values: Column) -> Column:
    """A compensated sum of an array of doubles, in its order."""
    zero = F.struct(lit(0).alias("s"), lit(0).alias("c"))

    def add(state: Column, v: Column) -> Column:
        y = v - state["c"]
        t = state["s"] + y
        return F.struct(t.alias("s"), ((t - state["s"]) - y).alias("c"))

    return F.aggregate(values, zero, add, lambda s: s["s"])


def planar_area(points: Column) -> Column:
    """Signed area of ARRAY<STRUCT<x, y>>: a compensated fan about the first point; 0 below three, NaN if one is not finite."""

    def area(p: Column) -> Column:
        first, n = p[0], F.greatest(F.size(p) - 2, F.lit(0))
        fan = F.zip_with(
            F.slice(p, F.lit(2), n), F.slice(p, F.lit(3), n), lambda a, b: (a["x"] - first["x"]) * (b["y"] - first["y"]) - (b["x"] - first["x"]) * (a["y"] - first["y"])
        )
        broken = F.exists(p, lambda a: ~finite(a["x"]) | ~finite(a["y"]))
        return F.when(F.size(p) < 3, lit(0)).when(broken, lit("nan")).otherwise(_kahan(fan) / lit(2))

    return let(points, area)


def ring_area(ring: Column) -> Column:
    """STRUCT<value STRUCT<area, bound>, error>: the line integral with eight Gauss points an edge.

    Exact to rounding where edges span up to some tens of degrees of latitude; the numpy kernel
    integrates adaptively and gives a bound that holds for any edge.
    """

    def term(e: Column) -> Column:
        a, b = e["a"], e["b"]
        q = None
        for t, w in GAUSS:
            part = lit(w) * authalic_q(a["lat"] + lit(t) * (b["lat"] - a["lat"]))
            q = part if q is None else q + part
        flat = authalic_q(a["lat"])
        return (b["lon"] - a["lon"]) * F.when(a["lat"] == b["lat"], flat).otherwise(q)

    surface = lit(TWO_PI * Q_POLE)

    def finished(r: Column, turn: Column) -> Column:
        side = r["interior_side"]
        half = -_kahan(F.transform(turn, term)) / lit(2)

        def sided(half: Column) -> Column:
            branch = (half + r["winding"] * lit(PI * Q_POLE)) % surface
            return F.when(side == "unspecified", half).when((side == "left") & (branch < lit(0)), branch + surface).when((side == "right") & (branch > lit(0)), branch - surface).otherwise(branch)

        bound = lit(64 * EPS) * (F.aggregate(F.transform(turn, lambda e: F.abs(e["b"]["lon"] - e["a"]["lon"])), lit(0), lambda s, x: s + x) + lit(1)) * lit(Q_POLE)
        area = F.struct((lit(SEMI_MAJOR**2) * let(half, sided)).alias("area"), (lit(SEMI_MAJOR**2) * bound).alias("bound"))
        error = F.when((r["winding"] != 0) & (side == "unspecified"), "longitude_winding_unsupported").otherwise("none")
        return F.struct(F.when(error == "none", area).alias("value"), error.alias("error"))

    return let(ring, lambda r: let(F.filter(ring_edges(r), lambda e: e["a"]["lon"] != e["b"]["lon"]), lambda turn: finished(r, turn)))


def branch_shift(points: Column, meridian: float = 0.0) -> Column:
    """STRUCT<turns, fits>: the whole turns that bring a ring's longitudes around the meridian, and whether they fit there."""
    slack = lit(1024 * EPS * PI)

    def shift(low: Column, high: Column) -> Column:
        turns = F.round((lit(meridian) - (low + high) / lit(2)) / lit(TWO_PI))
        fits = (low + turns * lit(TWO_PI) >= lit(meridian - PI) - slack) & (high + turns * lit(TWO_PI) <= lit(meridian + PI) + slack)
        return F.struct(turns.cast("int").alias("turns"), fits.alias("fits"))

    return let(F.transform(points, lambda p: p["lon"]), lambda x: let(F.array_min(x), lambda low: let(F.array_max(x), lambda high: shift(low, high))))


def strips(low: Column, high: Column, meridian: float = 0.0) -> Column:
    """Numbers of the strips of longitudes, a turn wide around the meridian, that an interval overlaps: a range join without a join."""
    base = lit(meridian - PI)
    first, last = F.floor((low - base) / lit(TWO_PI)), F.ceil((high - base) / lit(TWO_PI)) - 1
    return F.sequence(first, F.greatest(first, last))


def centroid(points: Column) -> Column:
    """STRUCT<x, y>: the area-weighted centroid, or the centre of the bounds if the area vanishes."""
    first = points[0]

    def add(s: Column, e: Column) -> Column:
        px, py, qx, qy = e["a"]["x"] - first["x"], e["a"]["y"] - first["y"], e["b"]["x"] - first["x"], e["b"]["y"] - first["y"]
        c = px * qy - qx * py
        return F.struct((s["a"] + c).alias("a"), (s["x"] + c * (px + qx)).alias("x"), (s["y"] + c * (py + qy)).alias("y"))

    total = F.aggregate(edges(points), F.struct(lit(0).alias("a"), lit(0).alias("x"), lit(0).alias("y")), add)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    size = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    flat = F.abs(total["a"]) <= lit(1e-12) * size
    x = F.when(flat, (F.array_min(xs) + F.array_max(xs)) / lit(2)).otherwise(first["x"] + total["x"] / (lit(3) * total["a"]))
    y = F.when(flat, (F.array_min(ys) + F.array_max(ys)) / lit(2)).otherwise(first["y"] + total["y"] / (lit(3) * total["a"]))
    return F.struct(x.alias("x"), y.alias("y"))


def stored_ring_error(ring: Column) -> Column:
    """The reason why a ring may not be stored, or none."""
    v = ring["vertices"]
    steps = F.transform(ring_edges(ring), lambda e: e["b"]["lon"] - e["a"]["lon"])
    return (
        F.when(F.size(v) < 3, "too_few_vertices").when(F.exists(v, lambda p: ~finite(p["lon"]) | ~finite(p["lat"])) | ~finite(ring["closing_lon"]), "non_finite_coordinate")
        .when(F.exists(v, lambda p: F.abs(p["lat"]) > lit(PI / 2)), "latitude_out_of_range").when(~((v[0]["lon"] > lit(-PI)) & (v[0]["lon"] <= lit(PI))), "longitude_not_canonical")
        .when(F.exists(steps, lambda d: F.abs(d) > lit(PI)), "longitude_step_too_long").when(F.rint((ring["closing_lon"] - v[0]["lon"]) / lit(TWO_PI)) != ring["winding"], "winding_mismatch")
        .when((ring["winding"] != 0) & (ring["interior_side"] == "unspecified"), "missing_interior_side").otherwise("none")
    )
