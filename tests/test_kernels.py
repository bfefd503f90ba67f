import math
import time

import numpy as np
import pytest

from meridion.functions.constants import AUTHALIC_RADIUS, HALF_PI, Q_POLE, SEMI_MAJOR, SURFACE
from meridion.operators.kernels import globe, projection, rings, seam, sphere
from meridion.operators.kernels.curves import joined, subdivide

IDENTITY = np.eye(3)


def ring(points, side="unspecified"):
    p = np.radians(np.array(points, float))
    return rings.canonicalise(p[:, 0], p[:, 1], side)


RECT = [(-10, -20), (30, -20), (30, 25), (-10, 25)]
CONCAVE = [(160, -50), (-160, -50), (-160, -20), (170, -20), (170, 20), (-160, 20), (-160, 50), (160, 50)]
CAP = [(0, 80), (90, 80), (180, 80), (-90, 80)]


def test_constants_and_authalic_latitudes():
    assert math.isclose(Q_POLE, 1.9955310875028376, rel_tol=2e-15) and abs(AUTHALIC_RADIUS - 6371007.180918476) < 1e-6
    for degrees, authalic in ((0, 0), (30, 29.888997034459564), (45, 44.87170287343392), (60, 59.88878556988508), (89, 88.99551395786139), (-30, -29.88899703445959)):
        assert abs(np.degrees(sphere.authalic_latitude(np.radians(degrees))) - authalic) < 2e-12
    sweep = sphere.authalic_latitude(np.arange(-900, 901) * np.pi / 1800)
    assert (np.diff(sweep) > 0).all() and sweep[0] == -HALF_PI and sweep[-1] == HALF_PI


def test_mollweide_theta_residual():
    beta = np.radians(np.arange(-89, 90))
    t = sphere.mollweide_theta(beta)
    assert np.abs(2 * t + np.sin(2 * t) - np.pi * np.sin(beta)).max() < 2e-14


@pytest.mark.parametrize(
    ("points", "error"),
    [([(0, 0), (1, 1)], "too_few_vertices"), ([(0, 0), (1, 91), (2, 0)], "latitude_out_of_range"), ([(0, 0), (math.nan, 0), (2, 95)], "non_finite_coordinate"), ([(0, 0), (180, 0), (90, 50)], "ambiguous_half_turn"),
     ([(0, 0), (10, 0), (5, 5), (360, 0)], "none"), ([(0, 0), (10, 0), (0, 0)], "none")],
)
def test_canonical_errors(points, error):
    found, word = ring(points)
    assert word == error
    if len(points) == 4 and error == "none":
        assert len(found.lon) == 3  # the repeated end is gone


def test_areas():
    exact = SEMI_MAJOR**2 / 2 * np.radians(40) * (sphere.authalic_q(np.radians(25)) - sphere.authalic_q(np.radians(-20)))
    area, bound, _ = rings.ring_area(ring(RECT)[0])
    assert math.isclose(area, exact, rel_tol=2e-15) and bound < 1
    assert math.isclose(rings.ring_area(ring(RECT[::-1])[0])[0], -exact, rel_tol=2e-15)
    assert rings.ring_area(ring(CAP)[0])[2] == "longitude_winding_unsupported"
    cap = math.pi * SEMI_MAJOR**2 * (Q_POLE - float(sphere.authalic_q(np.radians(80))))
    left, right = (rings.ring_area(ring(CAP, s)[0])[0] for s in ("left", "right"))
    assert math.isclose(left, cap, rel_tol=1e-12) and math.isclose(right, -(SURFACE - cap), rel_tol=1e-12)
    slanted = rings.ring_area(ring([(-35, -20), (25, -12), (40, 28), (-15, 42)])[0])
    assert slanted[0] > 0 and slanted[1] < 100
    assert rings.ring_area(ring([(-35, -20), (25, -12), (40, 28)])[0], depth=1)[2] == "integration_limit_exceeded"


def test_planar_area():
    assert rings.planar_area([0, 2, 2, 0], [0, 0, 2, 2]) == 4 and rings.planar_area([0, 1], [0, 1]) == 0
    assert math.isnan(rings.planar_area([0, 1, math.inf], [0, 1, 2]))


@pytest.mark.parametrize(
    ("points", "side", "pieces", "crossings"),
    [([(170, -20), (-170, -20), (-170, 20), (170, 20)], "left", 2, 2), ([(170, 20), (-170, 20), (-170, -20), (170, -20)], "right", 2, 2), (CONCAVE, "left", 3, 4), (RECT, "unspecified", 1, 0)],
)
def test_seam_split(points, side, pieces, crossings):
    own = ring(points, side)[0]
    s = seam.split_at_seam(own)
    assert (s.error, len(s.pieces), s.crossings) == ("none", pieces, crossings)
    assert len({np.sign(a) for a in s.areas}) == 1 and math.isclose(sum(s.areas), rings.ring_area(own)[0], rel_tol=1e-13)
    assert all(np.abs(p.lon).max() <= math.pi + 1e-9 for p in s.pieces)


def test_seam_errors():
    assert seam.split_at_seam(ring([(170, -20), (-170, -20), (-170, 20), (170, 20)])[0]).error == "missing_interior_side"
    assert seam.split_at_seam(ring(CAP, "left")[0]).error == "nonzero_winding_unsupported"
    assert seam.split_at_seam(ring(CONCAVE, "left")[0], max_pieces=2).error == "piece_limit_exceeded"
    assert seam.split_at_seam(ring([(170, -20), (180, -20), (180, 20), (170, 20), (170, 5), (-170, 5), (-170, 0), (170, 0)], "left")[0]).error == "seam_coincident_edge"
    assert seam.pair_endpoints([(0.1, 0, True), (0.1, 1, False)], True) == "ambiguous_seam_touch"
    assert seam.pair_endpoints([(0.1, 0, False), (0.2, 1, True)], True) == "topology_inconsistent"
    assert seam.cycles({0: 1, 1: 0, 2: 2}, 3) == [[0, 1], [2]] and seam.cycles({0: 0, 1: 0}, 2) == "topology_inconsistent"


@pytest.mark.parametrize("primitive", ["sinusoidal", "mollweide"])
@pytest.mark.parametrize("meridian", [0.0, math.pi / 2, -math.pi])
def test_area_survives_projection(primitive, meridian):
    options = projection.RingOptions(primitive, meridian, relative_error=1e-7, geometric_tolerance=500.0, area_tolerance=1e7)
    for points, side in ((RECT, "left"), (CONCAVE, "left"), ([(-180, -80), (-90, -80), (0, -80), (90, -80), (180, -80)], "right")):
        p = projection.project_piecewise(ring(points, side)[0], options)
        assert p.error == "none" and p.area_error <= p.allowed_error and np.sign(p.planar_area) == np.sign(p.source_area)


def test_projection_errors():
    own = ring(RECT)[0]
    assert projection.project_ring(own, projection.RingOptions(max_rounds=0)).error == "invalid_options"
    assert projection.project_ring(own, projection.RingOptions(max_rounds=1)).error == "area_budget_unmet"
    assert projection.project_ring(own, projection.RingOptions(max_segments=3)).detail == "limit_exceeded"
    assert projection.project_piecewise(ring(CAP, "left")[0], projection.RingOptions(central_meridian=math.nan)).error == "invalid_options"


def test_subdivision_is_depth_first_order():
    seen = subdivide(lambda e, t: np.stack([t, t**2 + e], axis=-1), 2, lambda five: np.abs(five[:, 2, 1] - (five[:, 0, 1] + five[:, 4, 1]) / 2) < 1e-3, 20, 1000)
    assert (np.diff(seen.t[seen.edge == 0]) > 0).all() and seen.error == "none"
    assert len(joined(seen)) == len(seen.t)
    assert subdivide(lambda e, t: np.stack([t, np.where(t > 0.4, np.nan, t)], axis=-1), 1, lambda f: np.ones(len(f), bool), 5, 10).error == "sample_failed"


def test_globe():
    x, y, depth = sphere.globe(0.3, 0.2, sphere.camera(0.3, 0.2))
    assert abs(x) < 1e-6 and abs(y) < 1e-6 and math.isclose(depth, AUTHALIC_RADIUS)
    assert not sphere.is_rotation(np.eye(3) * 2) and sphere.is_rotation(sphere.camera(1.0, -0.4))
    assert globe.visible_curve(ring(RECT)[0], np.eye(3) * 2).error == "invalid_rotation"
    sliver = ring([(89.9, -10), (100, -10), (100, 10), (89.9, 10)], "left")[0]
    curve = globe.visible_curve(sliver, IDENTITY)
    assert curve.crossings == 2 and len(curve.parts) == 1
    v = globe.verified_polygon(sliver, IDENTITY, globe.VerifiedOptions(globe.PolygonOptions(globe.CurveOptions(5000.0, 0.01), 500.0), max_rounds=18))
    assert v.error == "none" and v.rounds >= 2 and v.polygon.area > 0 and len(v.polygon.rings) == 1


@pytest.mark.parametrize(
    ("points", "side", "rings_", "sign"),
    [(RECT, "left", 1, 1), (RECT, "right", 2, -1), ([(150, -20), (190, -20), (190, 25), (150, 25)], "left", 0, 0), ([(150, -20), (190, -20), (190, 25), (150, 25)], "right", 1, -1),
     ([(60, -20), (120, -20), (120, 25), (60, 25)], "left", 1, 1), ([(60, -20), (120, -20), (120, 25), (60, 25)], "right", 1, -1), ([(0, 60), (90, 60), (180, 60), (-90, 60)], "left", 1, 1)],
)
def test_globe_fill(points, side, rings_, sign):
    v = globe.verified_polygon(ring(points, side)[0], IDENTITY)
    assert v.error == "none" and len(v.polygon.rings) == rings_ and np.sign(v.polygon.area) == sign
    other = globe.verified_polygon(ring(points, "right" if side == "left" else "left")[0], IDENTITY)
    assert math.isclose(abs(v.polygon.area) + abs(other.polygon.area), math.pi * AUTHALIC_RADIUS**2, rel_tol=1e-3)


def test_negligible_component():
    lon, lat = np.array([HALF_PI - 1e-7, np.radians(100), np.radians(100), HALF_PI - 1e-7]), np.radians([-1.0, -1, 1, 1])
    own = rings.canonicalise(lon, lat, "left")[0]
    v = globe.verified_polygon(own, IDENTITY, globe.VerifiedOptions(globe.PolygonOptions(globe.CurveOptions(1e-3), 1e-4), max_rounds=6))
    assert (v.error, v.significant, v.negligible) == ("none", 0, 1)
    assert globe.visible_polygon(rings.canonicalise(lon, lat)[0], IDENTITY).error == "missing_interior_side"


@pytest.mark.parametrize("west", [-14.5, 20.0, 65.5, 125.5, -154.5])
def test_edges_on_the_horizon(west):
    """From above the pole an edge on the equator touches the horizon, whatever roundoff says of its depth."""
    pole = sphere.camera(0.0, HALF_PI)
    cell = lambda south, north: ring([(west, south), (west + 30, south), (west + 30, north), (west, north)], "left")[0]
    seen = [globe.visible_curve(cell(*x), pole) for x in ((0, 10), (-10, 0), (-10, 10), (5, 10))]
    assert [(len(c.parts), c.crossings, c.closed, c.whole) for c in seen] == [(1, 0, False, True), (0, 0, False, False), (1, 2, False, False), (1, 0, True, True)]
    above, below = (globe.verified_polygon(cell(*x), pole) for x in ((0, 10), (-10, 0)))
    sector = AUTHALIC_RADIUS**2 / 2 * np.radians(30) * np.sin(sphere.authalic_latitude(np.radians(10))) ** 2
    assert (above.error, len(above.polygon.rings), above.polygon.coverage) == ("none", 1, "minor") and math.isclose(above.polygon.area, sector, rel_tol=1e-2)
    assert (below.error, below.polygon.rings, below.polygon.area) == ("none", [], 0.0)


def test_an_edge_on_the_horizon_between_both_sides():
    """A step of the ring along the horizon is one crossing, and a touch in front is part of the filled outline."""
    pole = sphere.camera(0.0, HALF_PI)
    step, _ = ring([(0, -10), (30, -10), (30, 0), (50, 0), (50, 20), (0, 20)], "left")
    c = globe.visible_curve(step, pole)
    assert (len(c.parts), c.crossings, c.closed) == (1, 2, False)
    v = globe.verified_polygon(step, pole)
    assert v.error == "none" and math.isclose(v.polygon.area, AUTHALIC_RADIUS**2 / 2 * np.radians(50) * np.sin(sphere.authalic_latitude(np.radians(20))) ** 2, rel_tol=1e-2)
    touch, _ = ring([(0, -10), (20, -10), (20, 10), (30, 10), (30, 0), (50, 0), (50, 20), (0, 20)], "left")
    c = globe.visible_curve(touch, pole)
    assert (len(c.parts), len(c.outline), c.crossings) == (2, 1, 2) and globe.verified_polygon(touch, pole).error == "none"


@pytest.mark.parametrize("south, north", [(-5.0, 0.01), (-9.0, 0.3), (10.0, 20.0), (-20.0, 60.0)])
def test_region_areas_are_exact(south, north):
    """Areas with what the chords leave out, and slivers whose chords don't settle in the rounds that are allowed."""
    options = globe.VerifiedOptions(globe.PolygonOptions(globe.CurveOptions(200.0), 200.0), relative_change=1e-6, max_rounds=18)
    v = globe.verified_polygon(ring([(12, south), (40, south), (40, north), (12, north)], "left")[0], sphere.camera(0.0, HALF_PI), options)
    low, high = (np.cos(sphere.authalic_latitude(np.radians(x))) ** 2 for x in (max(south, 0), north))
    exact = AUTHALIC_RADIUS**2 / 2 * np.radians(28) * (low - high)
    assert v.error == "none" and abs(v.polygon.region_area - exact) <= max(60, 1e-11 * exact)
    full = globe.verified_polygon(ring([(12, 10), (40, 10), (40, 20), (12, 20)], "right")[0], sphere.camera(0.0, HALF_PI), options).polygon
    assert math.isclose(full.regions[0], -math.pi * AUTHALIC_RADIUS**2, rel_tol=1e-13) and len(full.regions) == 2


def test_arcs_are_subdivided_together():
    """Twenty thousand arcs of circles as deep as their sagitta says, in seconds."""
    from meridion.plans.kernel_queries import arc_depths

    k = np.arange(20_000)
    r, theta, tol = (1000 + k % 9000).astype(float), np.radians(10.0 + k % 150), (1 + k % 37) / 10
    began = time.process_time()
    found = [arc_depths(*(x[i : i + 1024] for x in (r, theta, tol))) for i in range(0, len(k), 1024)]
    assert time.process_time() - began < 8
    depth, points = (np.concatenate(x) for x in zip(*found))
    want = (r[:, None] * (1 - np.cos(theta[:, None] / 2.0 ** np.arange(1, 25))) <= tol[:, None]).argmax(axis=1)
    assert (depth == want).all() and (points == 2**want + 1).all()
