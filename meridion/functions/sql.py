"""SQL names of the ring operators: table functions for LATERAL joins, scalar functions for expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from meridion.operators.kernels.globe import CurveOptions, VerifiedOptions, verified_polygon, visible_curve
from meridion.operators.kernels.projection import RingOptions, project_piecewise, project_ring
from meridion.operators.kernels.rings import canonicalise, ring_area
from meridion.operators.kernels.seam import split_at_seam
from meridion.operators.kernels.sphere import camera


def _ring(points, side: str):
    return canonicalise([p["lon"] for p in points], [p["lat"] for p in points], side or "unspecified")


class SeamPieces:
    """seam_pieces(points, side, meridian): a row for each piece, or one with the reason."""

    def eval(self, points, side: str, meridian: float) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        split = split_at_seam(ring, meridian) if ring else None
        if split is None or split.error != "none":
            yield None, None, None, error if split is None else split.error
            return
        for k, (piece, area) in enumerate(zip(split.pieces, split.areas, strict=True)):
            yield k, [tuple(p) for p in np.stack([piece.lon, piece.lat], axis=-1).tolist()], float(area), "none"


class ProjectedPieces:
    """projected_pieces(points, side, primitive, meridian): the verified plane rings of each piece."""

    def eval(self, points, side: str, primitive: str, meridian: float) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        found = project_piecewise(ring, RingOptions(primitive, meridian)) if ring else None
        if found is None or found.error != "none":
            yield None, None, None, error if found is None else found.error
            return
        for k, piece in enumerate(found.pieces):
            yield k, [tuple(p) for p in piece.tolist()], found.area_error, "none"


class RingArea:
    """wgs84_ring_area(points, side): one row with area, bound and error."""

    def eval(self, points, side: str) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        area, bound, word = ring_area(ring) if ring else (None, None, error)
        yield (float(area), float(bound), "none") if word == "none" else (None, None, word)


class CanonicalRing:
    """canonical_ring(points, side): one row with unwrapped vertices, closing longitude, winding and error."""

    def eval(self, points, side: str) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        if ring is None:
            yield None, None, None, error
        else:
            yield list(zip(ring.lon.tolist(), ring.lat.tolist(), strict=True)), ring.closing_lon, ring.winding, "none"


class SubdividedRing:
    """subdivided_ring(points, side, primitive, distance, area): the plane points of an outline within the tolerances, not cut."""

    def eval(self, points, side: str, primitive: str, distance: float, area: float) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        # One round with a budget that any outline meets: the tolerances alone decide.
        found = project_ring(ring, RingOptions(primitive, absolute_error=1e300, geometric_tolerance=distance, area_tolerance=area)) if ring else None
        if found is None or found.error != "none":
            yield None, error if found is None else found.error
        else:
            yield [tuple(p) for p in found.pieces[0].tolist()], "none"


class GlobeCurveParts:
    """globe_curve_parts(points, side, lon, lat): a row for each visible part of a ring from a camera, or one with the reason."""

    def eval(self, points, side: str, lon: float, lat: float) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        found = visible_curve(ring, camera(lon, lat), CurveOptions()) if ring else None
        if found is None or found.error != "none":
            yield None, None, error if found is None else found.error
            return
        for k, part in enumerate(found.parts):
            yield k, [tuple(p[:2]) for p in np.asarray(part).tolist()], "none"


class GlobeFillRings:
    """globe_fill_rings(points, side, lon, lat): the verified visible interior, a row for each plane ring, or one with the reason."""

    def eval(self, points, side: str, lon: float, lat: float) -> Iterator[tuple]:
        ring, error = _ring(points, side)
        found = verified_polygon(ring, camera(lon, lat), VerifiedOptions()) if ring else None
        if found is None or found.error != "none":
            yield None, None, None, error if found is None else found.error
            return
        for k, (own, area) in enumerate(zip(found.polygon.rings, found.polygon.areas, strict=True)):
            yield k, [tuple(p[:2]) for p in np.asarray(own).tolist()], float(area), "none"


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    lonlat, xy = "array<struct<lon: double, lat: double>>", "array<struct<x: double, y: double>>"
    for name, f, schema in (
        ("seam_pieces", SeamPieces, f"piece int, points {lonlat}, area double, error string"),
        ("projected_pieces", ProjectedPieces, f"piece int, points {xy}, area_error double, error string"),
        ("wgs84_ring_area", RingArea, "area double, bound double, error string"),
        ("canonical_ring", CanonicalRing, f"vertices {lonlat}, closing_lon double, winding int, error string"),
        ("subdivided_ring", SubdividedRing, f"points {xy}, error string"),
        ("globe_curve_parts", GlobeCurveParts, f"part int, points {xy}, error string"),
        ("globe_fill_rings", GlobeFillRings, f"ring int, points {xy}, area double, error string"),
    ):
        spark.udtf.register(name, udtf(f, returnType=schema))
