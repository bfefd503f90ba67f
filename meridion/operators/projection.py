"""Verified projections and globe views of tables of rings.

Input rows have ``points`` (raw ARRAY<STRUCT<lon, lat>> in radians) and ``side``; other columns are kept.
A row's work runs in numpy kernels inside Arrow batches: each ring refines itself to convergence, so there
is one job and no iteration over the table. Rings differ by orders of magnitude in cost; ``spread`` deals
them evenly before the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels.globe import CurveOptions, PolygonOptions, VerifiedOptions, verified_polygon, visible_curve, visible_polygon
from .kernels.projection import Projected, RingOptions, project_many
from .kernels.rings import Ring, canonicalise, ring_area
from .kernels.seam import split_at_seam
from .kernels.sphere import camera, project

PIECES = "pieces array<array<struct<x: double, y: double>>>"
PROJECTED = (
    f"{PIECES}, source_area double, planar_area double, area_error double, allowed_error double, rounds int, crossings int, partition_error double, n_pieces int, n_vertices int, "
    "within_budget boolean, error string, detail string, failed_edge int"
)
AREA = "winding int, area double, bound double, error string"
SPLIT = "pieces array<array<struct<lon: double, lat: double>>>, areas array<double>, crossings int, partition_error double, error string"
CURVE = "parts array<array<struct<x: double, y: double>>>, crossings int, closed boolean, n_vertices int, error string"
FILL = (
    "rings array<array<struct<x: double, y: double>>>, areas array<double>, area double, crossings int, n_vertices int, arc_segments int, coverage string, region_area double, rounds int, significant int, "
    "negligible int, change double, tolerance double, arc_tolerance double, error string, detail string"
)


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Deals rows evenly by a hash of a key, so that a run of costly rings is not one task's."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(key))


def map_rings(df: DataFrame, work: Callable[[list[tuple[Ring | None, str]]], list[dict]], schema: str, rows: int = 256) -> DataFrame:
    """Adds the columns of ``schema``, made by ``work`` from the canonical rings of some rows at a time (None and the reason if there is none)."""
    added = df.sparkSession.createDataFrame([], schema).schema
    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                points, sides = (batch.column(batch.schema.names.index(n)) for n in ("points", "side"))
                out = work(_rings(points, sides.to_pylist()))
                columns = [_nested([r.get(n) for r in out], t) if _is_nested(t) else pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in added.fields]
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def _rings(points: pa.ListArray, sides: list[str | None]) -> list[tuple[Ring | None, str]]:
    """Canonical rings of a column of point lists; a null list or a null point is no ring."""
    flat = points.flatten()
    lon, lat = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.zeros(0) for k in (0, 1))
    gone = flat.is_null().to_numpy(zero_copy_only=False).astype(bool) if flat.null_count else np.zeros(len(flat), bool)
    sizes = points.value_lengths().fill_null(0).to_numpy()
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for k, side in enumerate(sides):
        part = slice(int(cuts[k]), int(cuts[k + 1]))
        if sizes[k] == 0 or gone[part].any():
            out.append((None, "too_few_vertices"))
        else:
            out.append(canonicalise(lon[part], lat[part], side or "unspecified"))
    return out


def each(work: Callable[[Ring | None, str], dict]) -> Callable[[list[tuple[Ring | None, str]]], list[dict]]:
    """Work on one ring after another."""
    return lambda rings: [work(ring, error) for ring, error in rings]


def _is_nested(t: pa.DataType) -> bool:
    return pa.types.is_list(t) and pa.types.is_list(t.value_type) and pa.types.is_struct(t.value_type.value_type)


def _nested(rows: list[list[np.ndarray] | None], t: pa.DataType) -> pa.Array:
    """Rows of lists of (n, 2) arrays as lists of lists of structs, without an object for each point."""
    parts = [p for own in rows for p in own or ()]
    xy = np.concatenate(parts) if parts else np.zeros((0, 2))
    fields = list(t.value_type.value_type)
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in range(2)], fields=fields)
    inner = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    outer = np.concatenate([[0], np.cumsum([len(own or ()) for own in rows])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(inner), points, type=t.value_type)
    return pa.ListArray.from_arrays(pa.array(outer), lists, type=t, mask=pa.array([own is None for own in rows]))


def _projected(found: Projected) -> dict:
    real = lambda v: None if v != v else v
    return {
        "pieces": found.pieces, "source_area": real(found.source_area), "planar_area": real(found.planar_area), "area_error": real(found.area_error),
        "allowed_error": real(found.allowed_error), "rounds": found.rounds, "crossings": found.crossings, "partition_error": found.partition_error, "n_pieces": len(found.pieces),
        "n_vertices": found.vertices, "within_budget": found.error == "none" and found.area_error <= found.allowed_error, "error": found.error, "detail": found.detail, "failed_edge": found.failed_edge,
    }


def project_rings(df: DataFrame, options: RingOptions = RingOptions(), piecewise: bool = True) -> DataFrame:
    """Projects each ring until its plane area is within its budget; cut at the seam first if ``piecewise``."""

    def work(rings: list[tuple[Ring | None, str]]) -> list[dict]:
        found = iter(project_many([r for r, _ in rings if r is not None], options, piecewise))
        return [_projected(next(found) if r is not None else Projected([], error="ring_invalid", detail=error)) for r, error in rings]

    return map_rings(df, work, PROJECTED)


def round_ladder(df: DataFrame, options: RingOptions, limits: tuple[int, ...]) -> DataFrame:
    """Each ring with each limit of rounds: which one it needs."""
    ladder = df.withColumn("limit", F.explode(F.array(*[F.lit(n) for n in limits])))
    parts = [project_rings(ladder.where(F.col("limit") == n), replace(options, max_rounds=n)) for n in limits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ring_areas(df: DataFrame, tolerance: float = 1e-14, depth: int = 24) -> DataFrame:
    """Exact signed areas with an error bound, by adaptive integration."""

    def work(ring: Ring | None, error: str) -> dict:
        if ring is None:
            return {"error": error}
        area, bound, error = ring_area(ring, tolerance, depth)
        return {"winding": ring.winding, "area": area, "bound": bound, "error": error} if error == "none" else {"winding": ring.winding, "error": error}

    return map_rings(df, each(work), AREA)


def split_rings(df: DataFrame, meridian: float = 0.0, max_pieces: int = 4096) -> DataFrame:
    """Pieces of each ring inside the domain around the meridian."""

    def work(ring: Ring | None, error: str) -> dict:
        if ring is None:
            return {"error": error}
        s = split_at_seam(ring, meridian, max_pieces)
        pieces = [np.stack([p.lon, p.lat], axis=-1) for p in s.pieces]
        return {"pieces": pieces, "areas": s.areas, "crossings": s.crossings, "partition_error": s.partition_error, "error": s.error}

    return map_rings(df, each(work), SPLIT)


def globe_curves(df: DataFrame, view: tuple[float, float], options: CurveOptions = CurveOptions()) -> DataFrame:
    """Visible parts of each ring from a camera at (longitude, latitude)."""
    matrix = camera(*view)

    def work(ring: Ring | None, error: str) -> dict:
        if ring is None:
            return {"error": error}
        c = visible_curve(ring, matrix, options)
        return {"parts": c.parts, "crossings": c.crossings, "closed": c.closed, "n_vertices": c.vertices, "error": c.error}

    return map_rings(df, each(work), CURVE)


def globe_fill(df: DataFrame, view: tuple[float, float], options: VerifiedOptions | PolygonOptions = VerifiedOptions()) -> DataFrame:
    """Filled visible interior of each ring; with VerifiedOptions refined until two rounds agree.

    ``areas`` and ``area`` are of the rings as they are, ``region_area`` of what their chords stand for.
    """
    matrix = camera(*view)

    def work(ring: Ring | None, error: str) -> dict:
        if ring is None:
            return {"error": error, "detail": "ring_invalid"}
        if isinstance(options, PolygonOptions):
            p, extra = visible_polygon(ring, matrix, options), {}
            error, detail = p.error, p.detail
        else:
            v = verified_polygon(ring, matrix, options)
            p, error, detail = v.polygon, v.error, v.detail
            extra = {"rounds": v.rounds, "significant": v.significant, "negligible": v.negligible, "change": None if v.change != v.change else v.change, "tolerance": v.tolerance, "arc_tolerance": v.arc_tolerance}
        return {
            "rings": p.rings, "areas": p.areas, "area": p.area, "crossings": p.crossings, "n_vertices": p.vertices, "arc_segments": p.arc_segments, "coverage": p.coverage,
            "region_area": p.region_area, "error": error, "detail": detail, **extra,
        }

    return map_rings(df, each(work), FILL)


def outline_areas(df: DataFrame, vertices: str, out: str, segments: int = 16, primitive: str = "sinusoidal") -> DataFrame:
    """Adds the plane area of each ring's projected outline, with ``segments`` pieces an edge, for all rings of a batch together.

    ``vertices`` are unwrapped points in radians whose last one is joined to the first; null rings have a null area.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(segments) / segments
        for batch in batches:
            column = batch.column(batch.schema.names.index(vertices))
            flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            lon, lat = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            first = np.cumsum(sizes) - sizes
            follow = np.arange(1, len(lon) + 1)
            follow[(first + sizes - 1)[sizes > 0]] = first[sizes > 0]
            x, y = project(primitive, (lon[:, None] + t * (lon[follow] - lon)[:, None]).ravel(), (lat[:, None] + t * (lat[follow] - lat)[:, None]).ravel())
            # A fan about each ring's first point keeps the terms small.
            start, size = first * segments, sizes * segments
            x, y = x - np.repeat(x[start[size > 0]], size[size > 0]), y - np.repeat(y[start[size > 0]], size[size > 0])
            cross = np.append(x[:-1] * y[1:] - x[1:] * y[:-1], 0.0) if len(x) else x
            cross[(start + size - 1)[size > 0]] = 0.0  # to the first point, which is the origin
            area = np.zeros(len(sizes))
            area[size > 0] = np.add.reduceat(cross, start[size > 0]) / 2 if (size > 0).any() else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(area, mask=column.is_null().to_numpy(zero_copy_only=False))], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def world_summary(projected: DataFrame, *keys: str, role: Column | None = None) -> DataFrame:
    """Counts, semantic area (exteriors count, interiors are taken off), errors and splits of projected rings."""
    sign = F.when((role if role is not None else F.lit("exterior")) == "interior", -1.0).otherwise(1.0)
    return projected.groupBy(*keys).agg(
        F.count("*").alias("rings"), F.sum("n_pieces").alias("pieces"), F.sum("n_vertices").alias("vertices"), F.sum(sign * F.abs("source_area")).alias("semantic_area"),
        F.sum(sign * F.abs("planar_area")).alias("semantic_planar_area"), F.sum("allowed_error").alias("allowed_error"), F.sum("area_error").alias("sum_ring_error"), F.max("area_error").alias("max_ring_error"), F.max("rounds").alias("max_rounds"),
        F.count_if(F.col("n_pieces") > 1).alias("split_rings"), F.sum("crossings").alias("crossings"), F.count_if(F.col("error") != "none").alias("failed"),
    ).withColumn("within_budget", (F.col("failed") == 0) & (F.abs(F.col("semantic_planar_area") - F.col("semantic_area")) <= F.col("allowed_error")))
